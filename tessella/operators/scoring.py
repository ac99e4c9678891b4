"""Classification metrics over predictions with one array of class scores per row.

``preds`` has ``scores`` (an array with one score per class) and a target: a class number, an array of classes, or an array
of 0 and 1 per class. Ranks within a row are counted inside the row's own array, so nothing shuffles but the final sums.
Ties between classes go to the smaller class unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _rank(scores: str, cls: Column) -> Column:
    """The 1-based place of a class by descending score, ties by class."""
    own = F.get(scores, cls)
    before = F.filter(scores, lambda s, i: (s > own) | ((s == own) & (i < cls)))
    return F.size(before) + 1


def _top1(scores: str) -> Column:
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def _mean(c: Column) -> Column:
    return F.round(F.avg(c), 6)


def _hits(preds: DataFrame, ks: tuple[int, ...], target: str, scores: str) -> DataFrame:
    """``k, target, hit, top1`` of each row and k."""
    rank = _rank(scores, F.col(target))
    rows = preds.select(F.col(target).cast("int").alias("target"), rank.alias("rank"), _top1(scores).alias("top1"))
    return rows.select("target", "top1", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("rank") <= k).cast("int").alias("hit")) for k in ks])).alias("r")).select("r.k", "target", "r.hit", "top1")


def topk_accuracy(preds: DataFrame, ks: tuple[int, ...] = (1, 5), target: str = "target", scores: str = "scores") -> DataFrame:
    """``k, class, n, accuracy``: per class of the targets, and over all rows where class is null."""
    hits = _hits(preds, ks, target, scores)
    each = hits.groupBy("k", F.col("target").alias("class")).agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))
    return each.rollup("k", "class").agg(F.sum("n").alias("n"), F.round(F.sum("hits") / F.sum("n"), 6).alias("accuracy")).where("k is not null")


def topk_macro(preds: DataFrame, ks: tuple[int, ...] = (1, 5), target: str = "target", scores: str = "scores") -> DataFrame:
    """``k, micro, macro`` recall: the mean of the classes' recalls. For k = 1 a class that is only predicted counts as 0."""
    hits = _hits(preds, ks, target, scores)
    wrong = hits.where("k = 1 and target <> top1").select("k", F.col("top1").alias("target"), F.lit(0).alias("n"), F.lit(0).alias("hit"))
    each = hits.select("k", "target", F.lit(1).alias("n"), "hit").union(wrong).groupBy("k", "target").agg(F.sum("n").alias("n"), F.sum("hit").alias("hits"))
    return each.groupBy("k").agg(F.round(F.sum("hits") / F.sum("n"), 6).alias("micro"), _mean(F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(0.0)).alias("macro"))


def any_match(preds: DataFrame, ks: tuple[int, ...] = (1, 5), targets: str = "targets", scores: str = "scores", by: str | None = None) -> DataFrame:
    """``k[, by], n, accuracy``: a row hits if any of its targets is in the top k. Targets below 0 don't count, nor do rows without others.

    With ``by`` there is one row for each value of that column, and one for all rows where it is null.
    """
    found = F.filter(targets, lambda t: t >= 0)
    best = F.array_min(F.transform(found, lambda t: F.size(F.filter(scores, lambda s, i: (s > F.get(scores, t)) | ((s == F.get(scores, t)) & (i < t)))) + 1))
    rows = preds.where(F.size(found) > 0).select(best.alias("rank"), *([F.col(by).alias("by")] if by else []))
    each = rows.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("rank") <= k).cast("int").alias("hit")) for k in ks])).alias("r")).select("r.k", "r.hit", *(["by"] if by else []))
    if not by:
        return each.groupBy("k").agg(F.count(F.lit(1)).alias("n"), _mean("hit").alias("accuracy"))
    sums = each.groupBy("k", "by").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))
    return sums.rollup("k", "by").agg(F.sum("n").alias("n"), F.round(F.sum("hits") / F.sum("n"), 6).alias("accuracy")).where("k is not null")


def macro_mrr(preds: DataFrame, n_classes: int, target: str = "target", scores: str = "scores") -> DataFrame:
    """``mrr``: mean reciprocal rank per class, averaged over all ``n_classes``; ties count against the target, absent classes as 0."""
    own = F.get(scores, F.col(target))
    rank = F.size(F.filter(scores, lambda s: s >= own))
    each = preds.groupBy(F.col(target).alias("class")).agg((F.sum(1 / rank) / (F.count(F.lit(1)) + 1e-6)).alias("r"))
    return each.agg(F.round(F.coalesce(F.sum("r"), F.lit(0.0)) / n_classes, 6).alias("mrr"))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)


def _counted_f1(counts: DataFrame, key: str) -> DataFrame:
    """``micro, macro`` of ``counts(key, tp, fp, fn)``."""
    per = counts.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return per.agg(F.round(_f1(F.sum("tp"), F.sum("fp"), F.sum("fn")), 6).alias("micro"), _mean(_f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro"))


def multiclass_f1(preds: DataFrame, target: str = "target", scores: str = "scores") -> DataFrame:
    """``micro, macro`` F1 of the best class; classes neither wanted nor predicted don't count."""
    rows = preds.select(F.col(target).cast("int").alias("t"), _top1(scores).alias("p"))
    right = F.col("t") == F.col("p")
    one = lambda c, tp, fp, fn: F.struct(F.col(c).alias("class"), tp.cast("int").alias("tp"), fp.cast("int").alias("fp"), fn.cast("int").alias("fn"))
    no = F.lit(0)
    return _counted_f1(rows.select(F.inline(F.array(one("t", right, no, ~right), one("p", no, ~right, no)))), "class")


def _labels(preds: DataFrame, hot: str, scores: str) -> DataFrame:
    """``label, truth, score``, one row per row and label."""
    return preds.select(F.posexplode(F.arrays_zip(F.col(hot).alias("truth"), F.col(scores).alias("score"))).alias("label", "r")).select("label", F.col("r.truth").cast("int").alias("truth"), F.col("r.score").cast("double").alias("score"))


def multilabel_f1(preds: DataFrame, hot: str = "hot", scores: str = "scores", threshold: float = 0.5) -> DataFrame:
    """``micro, macro`` F1 over labels, predicted where the score is above the threshold."""
    rows = _labels(preds, hot, scores)
    p, t = F.col("score") > threshold, F.col("truth") == 1
    flag = lambda c: c.cast("int")
    return _counted_f1(rows.select("label", flag(p & t).alias("tp"), flag(p & ~t).alias("fp"), flag(~p & t).alias("fn")), "label")


def score_curve(preds: DataFrame, hot: str = "hot", scores: str = "scores") -> DataFrame:
    """``label, score, pos, neg, tp, fp, p, n``: for each distinct score of a label, the rows at it, those at it or above, and all.

    Rows are counted per label and score before anything is ordered, so a window holds distinct scores, not rows.
    """
    at = _labels(preds, hot, scores).groupBy("label", "score").agg(F.sum("truth").alias("pos"), F.sum(1 - F.col("truth")).alias("neg"))
    down = W.partitionBy("label").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("label")
    return at.select("label", "score", "pos", "neg", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("n"))


def auroc(preds: DataFrame, hot: str = "hot", scores: str = "scores") -> DataFrame:
    """``label, auroc``: the share of pairs of a positive and a negative row that scores order rightly, ties counting half; labels with both only."""
    c = score_curve(preds, hot, scores).where("p > 0 and n > 0")
    below = F.col("n") - F.col("fp")
    return c.groupBy("label").agg(F.round(F.sum(F.col("pos") * (below + F.col("neg") / 2)) / F.max(F.col("p") * F.col("n")), 6).alias("auroc"))


def average_precision(preds: DataFrame, hot: str = "hot", scores: str = "scores") -> DataFrame:
    """``label, ap``: precision at each distinct score, weighted by the recall that it adds; labels with positives only."""
    c = score_curve(preds, hot, scores).where("p > 0")
    return c.groupBy("label").agg(F.round(F.sum(F.col("pos") / F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))), 6).alias("ap"))


def map_voc07(preds: DataFrame, hot: str = "hot", scores: str = "scores", levels: int = 11) -> DataFrame:
    """``map``: the largest precision at a recall of r or more, averaged over ``levels`` values of r and labels with positives.

    The curve ends in precision 1 at recall 0, so the first level is always 1.
    """
    c = score_curve(preds, hot, scores).where("p > 0").select("label", (F.col("tp") / F.col("p")).alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))
    steps = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(i / (levels - 1)).alias("r")) for i in range(levels)])
    best = c.select("label", "recall", "precision", F.inline(steps)).where("recall >= r - 1e-12").groupBy("label", "level").agg(F.max("precision").alias("best"))
    return best.agg(_mean(F.when(F.col("level") == 0, 1.0).otherwise(F.col("best"))).alias("map"))


def corruption_error(scores: DataFrame, reference: DataFrame) -> DataFrame:
    """``type, error`` of ``scores(type, level, accuracy)``: mean error over the mean of ``reference(type, level, error)``; type null is the mean of types.

    Levels and types that only one side has are left out.
    """
    both = scores.join(reference, ["type", "level"])
    each = both.groupBy("type").agg((F.avg(1 - F.col("accuracy")) / F.avg("error")).alias("e"))
    return each.select("type", F.round("e", 6).alias("error")).union(each.agg(_mean("e").alias("error")).select(F.lit(None).cast("string").alias("type"), "error"))
