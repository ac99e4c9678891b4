"""Evaluation of several heads by several metrics at once.

Each row sends its heads' parts to the classes they count for, and all metrics that are built from sums are read off one
table of sums by head and class: one scan and one exchange, however many heads and metrics there are. Metrics that need the
order of scores share a second table, of rows by head, label and score.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Postprocessor = Callable[[Column], Column]


def field(*names: str) -> Postprocessor:
    """A nested field of a head's output."""

    def get(c: Column) -> Column:
        for n in names:
            c = c[n]
        return c

    return get


def softmax(temperature: float = 1.0) -> Postprocessor:
    """Shares of 1 from scores."""

    def soften(c: Column) -> Column:
        e = lambda s, top: F.exp((s.cast("double") - top.cast("double")) / temperature)
        return _let(F.transform(c, lambda s: e(s, F.array_max(c))), lambda v: F.transform(v, lambda s: s / F.aggregate(v, F.lit(0.0), lambda a, b: a + b)))

    return soften


def among(classes: list[int]) -> Postprocessor:
    """Only the scores of some classes, in this order: class i is then the i-th of them."""
    return lambda c: F.transform(F.array(*[F.lit(k) for k in classes]), lambda k: F.get(c, k))


POSTPROCESSORS: dict[str, Callable[..., Postprocessor]] = {"field": field, "softmax": softmax, "among": among}


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


@dataclass(frozen=True)
class Metric:
    """What a metric needs (target, targets, hot), whether it has a value per k, and how it is read off."""

    needs: str
    by_k: bool
    value: Callable[[int], Column]
    per_class: bool = False
    ranked: bool = False


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.nullif(F.col(b), F.lit(0))


#: By name. ``value`` is a column of the table of sums: of all classes, or of one for metrics per class.
METRICS: dict[str, Metric] = {
    "mean_accuracy": Metric("target", True, lambda k: _ratio(f"hit_{k}", "n")),
    "mean_per_class_accuracy": Metric("target", True, lambda k: F.col(f"mean_hit_{k}")),
    "per_class_accuracy": Metric("target", True, lambda k: _ratio(f"hit_{k}", "n"), per_class=True),
    "mean_recall": Metric("target", True, lambda k: _ratio(f"hit_{k}", "n")),
    "mean_per_class_recall": Metric("target", True, lambda k: F.col(f"mean_hit_{k}")),
    "mean_multiclass_f1": Metric("target", False, lambda k: F.coalesce(2 * F.col("tp") / F.nullif(F.col("n") + F.col("predicted"), F.lit(0)), F.lit(0.0))),
    "mean_per_class_multiclass_f1": Metric("target", False, lambda k: F.col("mean_f1")),
    "macro_averaged_mean_reciprocal_rank": Metric("target", False, lambda k: F.col("mrr")),
    "any_match_accuracy": Metric("targets", True, lambda k: _ratio(f"any_{k}", "any_n")),
    "mean_multilabel_f1": Metric("hot", False, lambda k: F.coalesce(2 * F.col("l_tp") / F.nullif(F.col("l_n") + F.col("l_predicted"), F.lit(0)), F.lit(0.0))),
    "mean_per_class_multilabel_f1": Metric("hot", False, lambda k: F.col("mean_l_f1")),
    "auroc": Metric("hot", False, lambda k: F.col("auroc"), ranked=True),
    "macro_multilabel_average_precision": Metric("hot", False, lambda k: F.col("ap"), ranked=True),
    "map_voc2007": Metric("hot", False, lambda k: F.col("voc"), ranked=True),
}


def metric(name: str) -> Metric:
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; there are {', '.join(sorted(METRICS))}")
    return METRICS[name]


def default_ks(classes: int) -> tuple[int, ...]:
    return (1, 5) if classes >= 5 else (1,)


def evaluate(preds: DataFrame, heads: dict[str, Column], metrics: list[str], classes: int, ks: tuple[int, ...] | None = None, index: str | None = None, target: str = "target", targets: str = "targets", hot: str = "hot", threshold: float = 0.5) -> DataFrame:
    """``head, metric, k, class, value`` of each head by each metric, rounded to six places.

    ``heads`` maps a name to its scores, an array with one per class, after post-processing. ``k`` is 1 for metrics without
    one; ``class`` is -1 but for metrics per class. Rows with a negative ``index`` are padding and don't count. Ties of
    scores go to the smaller class, for reciprocal ranks against the target. A class that is only predicted counts as 0 in
    means over classes where k is 1; labels below 0 are no targets. A head that a metric has no row for has no value.
    """
    ks = ks or default_ks(classes)
    wanted = {m: metric(m) for m in metrics}
    live = preds.where(F.col(index) >= 0) if index else preds
    needs = {m.needs for m in wanted.values() if not m.ranked}
    parts = []
    if needs:
        sums = _class_sums(live, heads, needs, classes, ks, target, targets, hot, threshold)
        parts.append(_read(sums, {n: m for n, m in wanted.items() if not m.ranked}, ks))
    if ranked := {n: m for n, m in wanted.items() if m.ranked}:
        parts.append(_read(_ranked(live, heads, hot), ranked, ks))
    out = parts[0]
    return out.union(parts[1]) if len(parts) > 1 else out


def _class_sums(live: DataFrame, heads: dict[str, Column], needs: set[str], classes: int, ks: tuple[int, ...], target: str, targets: str, hot: str, threshold: float) -> DataFrame:
    """Sums by head and class, and means over classes where ``class`` is -1."""
    names = ["n", "predicted", "tp", "rr", *(f"hit_{k}" for k in ks), "any_n", *(f"any_{k}" for k in ks), "l_n", "l_predicted", "l_tp"]

    def entry(head: Column, cls: Column, **values: Column) -> Column:
        return F.struct(head.alias("head"), cls.cast("int").alias("class"), *[values.get(n, F.lit(0)).cast("double").alias(n) for n in names])

    def place(s: Column, cls: Column) -> Column:
        """The place of a class by descending score, ties by class."""
        own = F.get(s, cls)
        return F.size(F.filter(s, lambda v, i: (v > own) | ((v == own) & (i < cls)))) + 1

    def of(head: Column) -> Column:
        h, s = head["h"], head["s"]
        one, out = F.lit(1), []
        if "target" in needs:
            t = F.col(target).cast("int")
            top = F.array_position(s, F.array_max(s)).cast("int") - 1
            own = F.get(s, t)
            rank = place(s, t)
            out.append(F.array(entry(h, t, n=one, rr=1 / F.size(F.filter(s, lambda v: v >= own)), **{f"hit_{k}": (rank <= k).cast("int") for k in ks}), entry(h, top, predicted=one, tp=(top == t).cast("int"))))
        if "targets" in needs:
            found = F.filter(F.col(targets), lambda t: t >= 0)
            best = F.array_min(F.transform(found, lambda t: place(s, t)))
            some = F.array(entry(h, F.lit(-1), any_n=one, **{f"any_{k}": (best <= k).cast("int") for k in ks}))
            out.append(F.when(F.size(found) > 0, some).otherwise(F.filter(some, lambda x: F.lit(False))))
        if "hot" in needs:
            truth = F.col(hot)
            yes = lambda v: v.cast("double") > threshold
            out.append(F.transform(s, lambda v, i: entry(h, i, l_n=F.get(truth, i), l_predicted=yes(v).cast("int"), l_tp=(yes(v) & (F.get(truth, i) == 1)).cast("int"))))
        return F.concat(*out)

    each = F.array(*[F.struct(F.lit(n).alias("h"), s.alias("s")) for n, s in heads.items()])
    rows = live.select(F.explode(each).alias("x"), *[c for c, need in ((target, "target"), (targets, "targets"), (hot, "hot")) if need in needs])
    sums = rows.select(F.inline(of(F.col("x")))).groupBy("head", "class").agg(*[F.sum(n).alias(n) for n in names])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    only = F.when(F.col("predicted") > 0, 0.0)
    f1 = lambda tp, n, p: F.when(F.col(n) + F.col(p) > 0, 2 * F.col(tp) / (F.col(n) + F.col(p)))
    labels = F.when(F.col("class") >= 0, F.coalesce(f1("l_tp", "l_n", "l_predicted"), F.lit(0.0)))
    means = [F.avg(F.coalesce(ratio(f"hit_{k}", "n"), only) if k == 1 else ratio(f"hit_{k}", "n")).alias(f"mean_hit_{k}") for k in ks]
    means += [F.avg(f1("tp", "n", "predicted")).alias("mean_f1"), (F.sum(F.when(F.col("n") > 0, F.col("rr") / (F.col("n") + 1e-6))) / classes).alias("mrr"), F.avg(labels).alias("mean_l_f1")]
    both = sums.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("all")).groupBy("head", "all", F.when(F.col("all"), -1).otherwise(F.col("class")).alias("class"))
    return both.agg(*[F.sum(n).alias(n) for n in names], *means)


def _ranked(live: DataFrame, heads: dict[str, Column], hot: str, levels: int = 11) -> DataFrame:
    """Means over labels of the metrics that need the order of scores; rows are counted by head, label and score first."""
    each = F.array(*[F.struct(F.lit(n).alias("head"), s.alias("s")) for n, s in heads.items()])
    pairs = live.select(F.inline(each), F.col(hot).alias("hot")).select("head", F.posexplode(F.arrays_zip(F.col("hot").alias("truth"), F.col("s").alias("score"))).alias("label", "r"))
    at = pairs.groupBy("head", "label", F.col("r.score").cast("double").alias("score")).agg(F.sum(F.col("r.truth").cast("int")).alias("pos"), F.sum(1 - F.col("r.truth").cast("int")).alias("neg"))
    whole = W.partitionBy("head", "label")
    down = whole.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    c = at.select("head", "label", "pos", "neg", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("m")).where("p > 0")
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.col("p")
    steps = [F.coalesce(F.max(F.when(recall >= i / (levels - 1) - 1e-12, precision)), F.lit(0.0)) if i else F.lit(1.0) for i in range(levels)]
    per = c.groupBy("head", "label").agg(F.when(F.max("m") > 0, F.sum(F.col("pos") * (F.col("m") - F.col("fp") + F.col("neg") / 2)) / F.max(F.col("p") * F.col("m"))).alias("auroc"), F.sum(F.col("pos") / F.col("p") * precision).alias("ap"), (sum(steps[1:], steps[0]) / levels).alias("voc"))
    return per.groupBy("head").agg(F.avg("auroc").alias("auroc"), F.avg("ap").alias("ap"), F.avg("voc").alias("voc")).select("*", F.lit(-1).alias("class"), F.lit(True).alias("all"))


def _read(sums: DataFrame, wanted: dict[str, Metric], ks: tuple[int, ...]) -> DataFrame:
    rows = [F.struct(F.lit(n).alias("metric"), F.lit(k).alias("k"), F.lit(m.per_class).alias("own"), F.round(m.value(k), 6).cast("double").alias("value")) for n, m in wanted.items() for k in (ks if m.by_k else (1,))]
    each = sums.select("head", "class", "all", F.inline(F.array(*rows)))
    return each.where((F.col("own") != F.col("all")) & F.col("value").isNotNull()).select("head", "metric", "k", "class", "value")
