"""Evaluation metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.quantiles import count_rows, mean_value, percentile, ranked_values


def confusion(df: DataFrame, target: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(target).alias("target"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_summary(df: DataFrame, target: str, pred: str, classes: int, digits: int = 6) -> DataFrame:
    """IoU, precision, recall and F1 of each of ``classes``, absent ones included; denominators are at least 1.

    Rows whose target isn't a class are left out; so are predictions that aren't, which ``confusion_summary`` counts.
    """
    within = lambda c: F.col(c).between(0, classes - 1)
    c = confusion(df.where(within(target)), target, pred).where(within("pred"))
    zero = F.lit(0).cast("long")
    part = lambda k, tp, t, p: F.struct(F.col(k).cast("int").alias("class"), tp.alias("tp"), t.alias("t"), p.alias("p"))
    n = F.col("n")
    each = c.select(F.inline(F.array(part("target", F.when(F.col("target") == F.col("pred"), n).otherwise(zero), n, zero), part("pred", zero, zero, n))))
    every = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("class"), zero.alias("tp"), zero.alias("t"), zero.alias("p"))
    s = each.union(every).groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("t").alias("t"), F.sum("p").alias("p"))
    over = lambda a, b: a / F.greatest(b, F.lit(1))
    tp, t, p = F.col("tp"), F.col("t"), F.col("p")
    precision, recall = over(tp, p), over(tp, t)
    f1 = 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-8))
    return s.select("class", *[F.round(x, digits).alias(name) for x, name in ((over(tp, t + p - tp), "iou"), (precision, "precision"), (recall, "recall"), (f1, "f1"))])


def confusion_summary(df: DataFrame, target: str, pred: str, classes: int) -> DataFrame:
    """One row: mean IoU and F1 over all classes, cell accuracy, cells counted, and cells dropped as their prediction is no class."""
    means = class_summary(df, target, pred, classes, 15).agg(F.round(F.avg("iou"), 6).alias("miou"), F.round(F.avg("f1"), 6).alias("f1"))
    live = df.where(F.col(target).between(0, classes - 1))
    known = F.col(pred).between(0, classes - 1)
    counts = live.agg(F.count_if(known).alias("n"), F.count_if(~known).alias("dropped"), F.count_if(F.col(target) == F.col(pred)).alias("right"))
    both = means.crossJoin(F.broadcast(counts))  # one row each
    return both.select("miou", "f1", F.round(F.col("right") / F.greatest("n", F.lit(1)), 6).alias("accuracy"), "n", "dropped")


def image_miou(df: DataFrame, image: str, target: str, pred: str, classes: int) -> DataFrame:
    """Per image: mean IoU of classes in the target (presence) and of classes in target or prediction (false positives count); 0 without one.

    Cells are counted per image, target and prediction first.
    """
    n = df.groupBy(image, F.col(target).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    of = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    t, p = F.col("t"), F.col("p")
    s = n.groupBy(image).agg(*[f(c) for c in range(classes) for f in (lambda c: of((t == c) & (p == c)).alias(f"i{c}"), lambda c: of((t == c) | (p == c)).alias(f"u{c}"), lambda c: of(t == c).alias(f"t{c}"))])
    iou = [F.col(f"i{c}") / F.col(f"u{c}") for c in range(classes)]

    def mean(kind):
        total = sum((F.when(F.col(f"{kind}{c}") > 0, iou[c]).otherwise(0.0) for c in range(classes)), F.lit(0.0))
        held = sum(((F.col(f"{kind}{c}") > 0).cast("int") for c in range(classes)), F.lit(0))
        return F.round(total / F.greatest(held, F.lit(1)), 6)

    return s.select(image, mean("t").alias("miou_present"), mean("u").alias("miou_fp"))


def depth_metrics(df: DataFrame, pred: Column, target: Column) -> DataFrame:
    """Depth errors over rows where both are positive."""
    v = df.where((pred > 0) & (target > 0)).select(pred.alias("p"), target.alias("t"))
    p, t = F.col("p"), F.col("t")
    ratio, logs = F.greatest(p / t, t / p), F.ln(p) - F.ln(t)
    r = lambda c: F.round(c, 6)
    return v.agg(
        r(F.avg((ratio < 1.25).cast("double"))).alias("a1"), r(F.avg((ratio < 1.25**2).cast("double"))).alias("a2"), r(F.avg((ratio < 1.25**3).cast("double"))).alias("a3"), r(F.avg(F.abs(p - t) / t)).alias("abs_rel"), r(F.avg((p - t) * (p - t) / t)).alias("sq_rel"),
        r(F.sqrt(F.avg((p - t) * (p - t)))).alias("rmse"), r(F.sqrt(F.avg(logs * logs))).alias("rmse_log"), r(F.avg(F.abs(F.log10(p) - F.log10(t)))).alias("log10"), r(F.avg(F.abs(p - t))).alias("mae"),
        r(100 * F.sqrt(F.greatest(F.avg(logs * logs) - F.avg(logs) * F.avg(logs), F.lit(0.0)))).alias("silog"),
    )


def align_scale_shift(df: DataFrame, key: str, pred: str, target: str) -> DataFrame:
    """Least-squares scale and shift per key; 1 and 0 where the prediction doesn't vary."""
    return df.groupBy(key).agg(F.round(F.coalesce(F.regr_slope(target, pred), F.lit(1.0)), 4).alias("scale"), F.round(F.coalesce(F.regr_intercept(target, pred), F.lit(0.0)), 2).alias("shift"))


def topk_hits(votes: DataFrame, key: list[str], target: str, score: str, code: str, ks: tuple[int, ...]) -> DataFrame:
    """Per key: the target's rank by descending score (ties by class) and hits in the top k."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc(score), code))
    own = votes.withColumn("rank", rank)
    return own.groupBy(*key, target).agg(*[F.max(((F.col(code) == F.col(target)) & (F.col("rank") <= k)).cast("int")).alias(f"top{k}") for k in ks])


def boundary(cells: DataFrame, image: str, code: str) -> DataFrame:
    """Cells with a 4-neighbour of another class, by two windows and no join."""
    row, col = W.partitionBy(image, "y").orderBy("x"), W.partitionBy(image, "x").orderBy("y")
    c = F.col(code)
    differs = lambda n: F.coalesce(n != c, F.lit(False))
    return cells.select(image, "y", "x", code, (differs(F.lag(code).over(row)) | differs(F.lead(code).over(row)) | differs(F.lag(code).over(col)) | differs(F.lead(code).over(col))).alias("edge"))


def summarize_counts(df: DataFrame, col: str) -> DataFrame:
    """Count, least, largest, mean and exact percentiles of a column; values are counted first."""
    shares = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    return ranked_values(df, col).agg(count_rows().alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(mean_value(), 6).alias("mean"), *[F.round(percentile(p), 6).alias(f"p{int(p * 100)}") for p in shares])


def histogram(df: DataFrame, col: str) -> DataFrame:
    """``value, n`` of a column."""
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def average_over_tries(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and sample deviation (null for one try)."""
    return df.groupBy(*keys).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("std"), F.count(F.lit(1)).alias("tries"))
