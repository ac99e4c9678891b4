"""Run logs in long form ``(run_id, step, ts, name, value)``: timing, wide rows, latest and best values, early stopping, meters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def step_timing(steps: DataFrame, planned: int, run: str = "run_id") -> DataFrame:
    """``run, step, seconds, total, eta``: time since the step before and since the first, and the mean step times those to come."""
    w = W.partitionBy(run).orderBy("step")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    t = steps.select(run, "step", at.alias("at"), F.lag(at).over(w).alias("was"), F.first(at).over(w).alias("began"))
    total = F.col("at") - F.col("began")
    eta = total / F.nullif(F.col("step") - 1, F.lit(0)) * (planned - F.col("step"))
    return t.select(run, "step", F.round(F.col("at") - F.col("was"), 4).alias("seconds"), F.round(total, 4).alias("total"), F.round(eta, 2).alias("eta"))


def wide_log(steps: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row a key with fixed columns, null where a name is absent; other names and NaN values are dropped."""
    return steps.where(~F.isnan("value")).groupBy(*keys).agg(*[F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in columns])


def latest(steps: DataFrame, keys: list[str]) -> DataFrame:
    """The last step of each key and its value."""
    return steps.groupBy(*keys).agg(F.max("step").alias("step"), F.round(F.max_by("value", "step"), 6).alias("value"))


def kind_score(wide: DataFrame, chain: list[str]) -> DataFrame:
    """``score, source``: the first finite value along the chain of columns, and its column."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    score = F.coalesce(*[F.when(finite(c), F.col(c)) for c in chain])
    source = F.coalesce(*[F.when(finite(c), F.lit(c)) for c in chain])
    return wide.withColumn("score", score).withColumn("source", source)


def best_by_kind(steps: DataFrame, run: str, kind: str, independent: str) -> DataFrame:
    """The best step and value of each kind of a run, ties to the earlier; ``overall`` is the independent kind's alone."""
    every = F.when(F.col(kind) == independent, F.array(F.col(kind), F.lit("overall"))).otherwise(F.array(F.col(kind)))
    each = steps.select(run, "step", "value", F.explode(every).alias("kind"))
    return each.groupBy(run, "kind").agg(F.max_by("step", F.struct("value", (-F.col("step")).alias("s"))).alias("step"), F.max("value").alias("value"))


def early_stop(steps: DataFrame, run: str, order: str, least_epochs: int, delta: float, patience: int) -> DataFrame:
    """``run, epochs, best_epoch, best, stopped``: training ends once ``patience`` epochs in a row haven't beaten the best by ``delta``, not before ``least_epochs``.

    A run's values are folded in order; a run is one series of epochs.
    """
    rows = steps.groupBy(run).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "value"))), lambda r: r["value"]).alias("v"))
    start = F.struct(F.lit(0).alias("epoch"), F.lit(0).alias("best_epoch"), F.lit(None).cast("double").alias("best"), F.lit(0).alias("bad"), F.lit(False).alias("stopped"))

    def step(s, x):
        better = s["best"].isNull() | (x > s["best"] + delta)
        epoch, bad = s["epoch"] + 1, F.when(better, 0).otherwise(s["bad"] + 1)
        new = F.struct(epoch.alias("epoch"), F.when(better, epoch).otherwise(s["best_epoch"]).alias("best_epoch"), F.when(better, x).otherwise(s["best"]).alias("best"), bad.alias("bad"), ((epoch >= least_epochs) & (bad >= patience)).alias("stopped"))
        return F.when(s["stopped"], s).otherwise(new)

    end = rows.select(run, F.aggregate("v", start, step).alias("s"))
    return end.select(run, F.col("s.epoch").cast("long").alias("epochs"), F.col("s.best_epoch").cast("long").alias("best_epoch"), "s.best", "s.stopped")


def eval_rows(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: rows, mean, least and largest value."""
    return steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.round(f("value"), 6).alias(n) for f, n in ((F.avg, "mean"), (F.min, "low"), (F.max, "high"))])


def mean_meter(df: DataFrame, keys: list[str], value: str, size: str) -> DataFrame:
    """Means weighted by batch size, and the rows in all."""
    return df.groupBy(*keys).agg(F.round(F.sum(F.col(value) * F.col(size)) / F.sum(size), 6).alias("mean"), F.sum(size).alias("n"))


def merge_counters(df: DataFrame, col: str) -> DataFrame:
    """``key, n``: maps of counts added up."""
    return df.select(F.explode(col).alias("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))
