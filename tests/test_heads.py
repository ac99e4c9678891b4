"""Several heads and metrics at once against the single metrics, and the shape of the plan."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import heads, scoring

CLASSES = 7


@pytest.fixture(scope="module")
def preds(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        a, b = ([round(rng.random(), 1) for _ in range(CLASSES)] for _ in range(2))
        t = rng.randrange(CLASSES - 1)
        targets = [t, rng.choice([-1, rng.randrange(CLASSES)])] if i % 9 else [-1]
        rows.append((i if i % 10 else -1, a, {"x": {"y": b}}, t, targets, [int(c in targets) for c in range(CLASSES)]))
    return spark.createDataFrame(rows, "i int, a array<double>, b struct<x:struct<y:array<double>>>, target int, targets array<int>, hot array<int>").repartition(3).checkpoint()


def test_equal_to_single_metrics(preds):
    own = {"a": F.col("a"), "b": heads.field("x", "y")(F.col("b")), "soft": heads.softmax(0.5)(F.col("a"))}
    got = {(r.head, r.metric, r.k, r["class"]): r.value for r in heads.evaluate(preds, own, list(heads.METRICS), CLASSES, index="i").collect()}
    live, want = preds.where("i >= 0"), {}
    for name, scores in own.items():
        df = live.withColumn("scores", scores).checkpoint()
        for r in scoring.topk_accuracy(df).collect():
            if r["class"] is None:
                want[name, "mean_accuracy", r.k, -1] = want[name, "mean_recall", r.k, -1] = r.accuracy
            else:
                want[name, "per_class_accuracy", r.k, r["class"]] = r.accuracy
        for r in scoring.topk_macro(df).collect():
            want[name, "mean_per_class_accuracy", r.k, -1] = want[name, "mean_per_class_recall", r.k, -1] = r.macro
        for kind, f in (("multiclass", scoring.multiclass_f1), ("multilabel", scoring.multilabel_f1)):
            r = f(df).first()
            want[name, f"mean_{kind}_f1", 1, -1], want[name, f"mean_per_class_{kind}_f1", 1, -1] = r.micro, r.macro
        want[name, "macro_averaged_mean_reciprocal_rank", 1, -1] = scoring.macro_mrr(df, CLASSES).first().mrr
        for r in scoring.any_match(df).collect():
            want[name, "any_match_accuracy", r.k, -1] = r.accuracy
        mean = lambda rows, c: round(sum(r[c] for r in rows) / len(rows), 6)
        want[name, "auroc", 1, -1] = mean(scoring.auroc(df).collect(), "auroc")
        want[name, "macro_multilabel_average_precision", 1, -1] = mean(scoring.average_precision(df).collect(), "ap")
        want[name, "map_voc2007", 1, -1] = scoring.map_voc07(df).first()["map"]
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def test_one_scan_and_one_exchange_of_rows(preds, tmp_path, spark):
    path = str(tmp_path / "preds")
    preds.write.parquet(path)
    df = spark.read.parquet(path)
    own = {"a": F.col("a"), "b": heads.field("x", "y")(F.col("b")), "part": heads.among([2, 0, 5])(F.col("a"))}
    out = heads.evaluate(df, own, ["mean_accuracy", "mean_multiclass_f1", "any_match_accuracy"], CLASSES)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1
    # The sums by head and class, and the means over classes.
    assert plan.count("Exchange hashpartitioning") == 2
    assert "hot" not in plan[plan.index("ReadSchema") :].split("\n")[0]


def test_postprocessors_and_unknown_names(preds, spark):
    row = spark.createDataFrame([([1.0, 3.0, 2.0],)], "a array<double>")
    soft = row.select(heads.POSTPROCESSORS["softmax"](1.0)(F.col("a")).alias("s")).first().s
    assert sum(soft) == pytest.approx(1) and soft[1] > soft[2] > soft[0]
    assert row.select(heads.among([2, 0])(F.col("a")).alias("s")).first().s == [2.0, 1.0]
    with pytest.raises(ValueError, match="unknown metric"):
        heads.evaluate(preds, {"a": F.col("a")}, ["best"], CLASSES)
    assert heads.default_ks(4) == (1,) and heads.default_ks(5) == (1, 5)
    assert heads.evaluate(preds.where("false"), {"a": F.col("a")}, list(heads.METRICS), CLASSES).count() == 0
