"""Exact percentiles of a distributed column: values are counted, and ranks follow from running counts over ranges of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked_values(df: DataFrame, value: str | Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """``*keys, value, n, before, total``: each distinct value of a key, its rows, the key's rows of smaller values, and all.

    Nulls are left out. Equal values are added up before the shuffle; a key's values may lie in many range partitions, each
    of which is ordered by itself and shifted by the partitions before it. Only a key that goes on from one partition into
    the next has a shift, so there are at most as many as partitions.
    """
    v = F.col(value) if isinstance(value, str) else value
    counts = df.select(*keys, v.alias("value")).where("value is not null").groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    parts = counts.repartitionByRange(*keys, "value").withColumn("__part", F.spark_partition_id()).checkpoint()
    sums = parts.groupBy("__part", *keys).agg(F.sum("n").alias("__n"))
    own = W.partitionBy(*keys)
    earlier = F.coalesce(F.sum("__n").over(own.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spread = sums.withColumn("__start", earlier).withColumn("__total", F.sum("__n").over(own)).where("__n < __total").drop("__n")
    rank = F.sum("n").over(W.partitionBy("__part", *keys).orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    inside = F.sum("n").over(W.partitionBy("__part", *keys))
    out = parts.withColumn("before", rank - F.col("n")).withColumn("total", inside).join(F.broadcast(spread), ["__part", *keys], "left")
    return out.select(*keys, "value", "n", (F.col("before") + F.coalesce("__start", F.lit(0))).alias("before"), F.coalesce("__total", F.col("total")).alias("total"))


def percentile(share: float) -> Column:
    """The value at ``share`` of the way through all rows, between two neighbours in proportion: an aggregate of ``ranked_values``."""
    at = share * (F.col("total") - 1)
    holds = lambda place: (F.col("before") <= place) & (place < F.col("before") + F.col("n"))
    low, high = F.max(F.when(holds(F.floor(at)), F.col("value"))), F.max(F.when(holds(F.ceil(at)), F.col("value")))
    part = F.max(at - F.floor(at))
    return (low + (high - low) * part).cast("double")


def count_rows() -> Column:
    """How many rows there are."""
    return F.coalesce(F.sum("n"), F.lit(0))


def mean_value() -> Column:
    return F.sum(F.col("value") * F.col("n")) / F.sum("n")
