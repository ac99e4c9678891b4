"""Row numbers over whole tables without one task that orders everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .hashing import hash_order


def _numbered(df: DataFrame, bucket: list[str], order: list, name: str) -> DataFrame:
    """Numbers from 0 by bucket, then order: buckets are counted, and few; rows are ordered within their bucket alone."""
    counts = df.groupBy(*bucket).agg(F.count(F.lit(1)).alias("__c"))
    before = W.orderBy(*bucket).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*bucket, F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__start"))
    own = df.withColumn("__row", F.row_number().over(W.partitionBy(*bucket).orderBy(*order)) - 1)
    return own.join(F.broadcast(starts), bucket).withColumn(name, F.col("__start") + F.col("__row")).drop("__start", "__row")


def number_by_hash(df: DataFrame, seed: object, id_col: str, name: str, first: str | None = None, digits: int = 3) -> DataFrame:
    """``df`` with its place from 0 by ``first`` (if any, of few values), the hash of seed and id, then the id.

    A bucket is the hash's first hexadecimal digits: 16 ** ``digits`` buckets of like size, per value of ``first``.
    """
    own = df.withColumn("__hash", hash_order(seed, id_col)).withColumn("__bucket", F.substring("__hash", 1, digits))
    bucket = ([first] if first else []) + ["__bucket"]
    return _numbered(own, bucket, ["__hash", id_col], name).drop("__hash", "__bucket")


def number_within(df: DataFrame, group: str, seed: object, id_col: str, name: str, digits: int = 3) -> DataFrame:
    """``df`` with its place from 0 within ``group``, by the hash of seed and id, then the id.

    A group is dealt over 16 ** ``digits`` buckets by the hash's first digits, so a hot one isn't ordered in one task; what is
    added up per group are its buckets' counts.
    """
    own = df.withColumn("__hash", hash_order(seed, id_col)).withColumn("__bucket", F.substring("__hash", 1, digits))
    counts = own.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("__c"))
    before = W.partitionBy(group).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("__group"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__start"))
    own = own.withColumn("__row", F.row_number().over(W.partitionBy(group, "__bucket").orderBy("__hash", id_col)) - 1)
    both = own.join(starts, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__bucket") == F.col("__b")))
    return both.withColumn(name, F.col("__start") + F.col("__row")).drop("__hash", "__bucket", "__group", "__b", "__start", "__row")


def number_sorted(df: DataFrame, cols: list[str], name: str) -> DataFrame:
    """``df`` with its place from 0 by ``cols``: range partitions, written once, are numbered each and shifted by those before."""
    parts = df.repartitionByRange(*cols).withColumn("__part", F.spark_partition_id()).checkpoint()
    return _numbered(parts, ["__part"], [F.col(c) for c in cols], name).drop("__part")


def hash_bucket(seed: object, *ids: str | Column, digits: int = 3) -> Column:
    return F.substring(hash_order(seed, *ids), 1, digits)


def running_sums(df: DataFrame, order: str, cols: list[str]) -> DataFrame:
    """``df`` with ``{c}_before`` of each column: its sum over rows of smaller ``order``, whose values differ.

    Range partitions are written once, added up, and each is shifted by those before it.
    """
    parts = df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()).checkpoint()
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    sums = parts.groupBy("__part").agg(*[F.sum(c).alias(c) for c in cols])
    starts = sums.select("__part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__{c}") for c in cols])
    own = W.partitionBy("__part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    inside = [F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"{c}_in") for c in cols]
    out = parts.select("*", *inside).join(F.broadcast(starts), "__part")
    return out.select(*df.columns, *[(F.col(f"{c}_in") + F.col(f"__{c}")).alias(f"{c}_before") for c in cols])
