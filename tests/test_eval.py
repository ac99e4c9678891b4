"""Percentiles, dataset statistics, orientations, suites and stored artefacts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import quantiles as q
from tessella.operators import color, evaluation, stats
from tessella.sources.artefacts import Artefacts
from tessella.sources.shared import fresh_path


def test_percentiles_are_exact(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([1.5, 2.0, 7.25]) if k == 0 else rng.gauss(0, 9)) for k in (0, 1, 1, 1, 2) for _ in range(400)] + [(3, 5.0), (4, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    shares = (0.0, 0.1, 0.5, 0.9, 0.95, 1.0)
    got = q.ranked_values(df, "v", ("k",)).groupBy("k").agg(q.count_rows().alias("n"), q.mean_value().alias("m"), *[q.percentile(p).alias(str(p)) for p in shares]).collect()
    assert {r.k for r in got} == {0, 1, 2, 3}
    for r in got:
        own = [v for k, v in rows if k == r.k]
        assert r.n == len(own) and r.m == pytest.approx(np.mean(own))
        assert [r[str(p)] for p in shares] == pytest.approx([np.percentile(own, 100 * p) for p in shares])
    every = [v for _, v in rows if v is not None]
    one = color.delta_e_stats(df, "v").first()
    assert (one.n, one.p50, one.p95, one.most) == (len(every), round(np.percentile(every, 50), 4), round(np.percentile(every, 95), 4), round(max(every), 4))
    assert color.delta_e_stats(df.where("false"), "v").first().n == 0


def test_statistics_of_nothing_are_zeros(spark):
    code = ", ".join(f"code_{c} long" for c in range(2))
    images = spark.createDataFrame([("valid", None, 4, 5, 3, 1, 2)], f"status string, split string, width int, height int, candidates long, {code}")
    none = spark.createDataFrame([], "area long"), spark.createDataFrame([], f"split string, strategy string, tiny boolean, {code}")
    got = {(r.section, r.name): r.value for r in stats.dataset_stats(images, *none, [0, 1]).collect()}
    assert got["images by split", "none"] == 1 and got["images", "width_mean"] == 4 and got["classes", "code_1"] == 2
    assert got["components", "count"] == got["components", "p90"] == got["crops", "count"] == got["crops", "code_0"] == 0
    got = {(r.section, r.name): r.value for r in stats.dataset_stats(images.where("false"), *none, [0, 1]).collect()}
    assert got["images", "count"] == 0 and not any(s == "images by status" for s, _ in got)


def test_turned_back_scores_are_the_same(spark):
    rng = np.random.default_rng(5)
    h, w = 3, 5
    target = rng.integers(0, 3, (h, w))
    cells = spark.createDataFrame([(0, y, x, int(target[y, x])) for y in range(h) for x in range(w)], "image_id int, y int, x int, target int")
    rows, want = [], {}
    for k in range(8):
        turned = np.rot90(target, k % 4)
        turned = np.flip(turned, 1) if k >= 4 else turned
        pred = np.where(rng.random(turned.shape) < 0.6, turned, rng.integers(0, 3, turned.shape))
        want[k] = np.mean([((turned == c) & (pred == c)).sum() / ((turned == c) | (pred == c)).sum() for c in np.unique(target)])
        rows += [(0, k, y, x, int(pred[y, x])) for y in range(pred.shape[0]) for x in range(pred.shape[1])]
    preds = spark.createDataFrame([*rows, (0, 3, 99, 99, 1)], "image_id int, k int, oy int, ox int, pred int")
    for r in evaluation.inverse_consistency(cells, preds, 3).collect():
        assert r.transformed_miou == r.inverse_miou == pytest.approx(want[r.k], abs=1e-6) and r.delta == 0


def scored(spark, rows):
    return spark.createDataFrame(rows, "suite string, k int, miou double, boundary double, small double, seam double")


def test_a_missing_orientation_spoils_the_score(spark):
    rows = [("scene", k, 0.1 * k, 0.5, None, 0.4) for k in range(8)] + [("spatial", k, 0.5, 0.5, 0.5, None) for k in (0, 1, 1, 7)] + [("capacity", 2, None, None, None, None)]
    got = {r.suite: r for r in evaluation.orientation_scores(scored(spark, rows), ["suite"], list(range(8))).collect()}
    assert (got["scene"].missing, got["scene"].worst_k, got["scene"].worst) == ("", 0, 0.0)
    # Without small parts the mean IoU stands in for them.
    assert got["scene"].score == pytest.approx(0.25 * 0.35 + 0.2 * 0.5 + 0.15 * 0.35 + 0.15 * 0.4)
    assert (got["spatial"].missing, got["spatial"].found, got["spatial"].score) == ("2,3,4,5,6", 3, None)
    assert got["capacity"].worst is None and got["capacity"].n == 1
    free = {r.suite: r.score for r in evaluation.orientation_scores(scored(spark, rows), ["suite"]).collect()}
    assert free["spatial"] == pytest.approx(0.25 * 0.5 * 2 + 0.2 * 0.5 + 0.15 * 0.5)


def test_the_mode_picks_the_suite(spark):
    rows = [("scene", 0, 0.9, 0.9, 0.9, 0.9), ("spatial", 0, 0.5, 0.5, 0.5, 0.5), ("other", 0, 0.1, 0.1, 0.1, 0.1)]
    of = lambda rows, mode: {r.name: r.value for r in evaluation.suite_summary(scored(spark, rows), mode).collect()}
    got = of(rows, "generalization")
    assert got["score"] == got["scene_score"] == pytest.approx(0.9) and got["spat_miou"] == 0.5 and got["evaluated"] == 1
    assert of(rows, "capacity")["miou"] == 0.5 and of(rows, "held_out")["miou"] == 0.9
    got = of(rows[1:], "generalization")
    assert got["evaluated"] == 0 and "score" not in got and got["spat_score"] == 0.5
    with pytest.raises(ValueError, match="mode"):
        of(rows, "best")


def test_tiles_have_core_and_halo(spark):
    cells = spark.createDataFrame([(0, y, x, 1, int((y, x) != (0, 0))) for y in range(5) for x in range(6)], "image_id int, y int, x int, target int, pred int")
    got = {r.region: (r.n, r.acc) for r in evaluation.tile_metrics(cells, "target", "pred", F.lit(True), 2, 1, 2).collect()}
    assert got == {"global": (30, round(29 / 30, 6)), "core": (4, 1.0), "halo": (18, round(17 / 18, 6))}


def test_artefacts_are_built_once_for_an_identity(spark):
    store, built = Artefacts(spark, fresh_path(spark)), []
    df = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, name string, other int")

    def build(rows):
        built.append(1)
        return rows.groupBy().agg(F.count(F.lit(1)).alias("n"))

    first, there = store.reuse("count", 1, df, ["id", "name"], build)
    assert not there and first.first().n == 2
    # Order, partitions and columns that the table doesn't depend on make no difference.
    again, there = store.reuse("count", 1, df.withColumn("other", F.lit(7)).orderBy(F.desc("id")).repartition(2), ["id", "name"], build)
    assert there and again.first().n == 2 and len(built) == 1
    for other, version, more in ((df.where("id = 1"), 1, None), (df.withColumn("name", F.upper("name")), 1, None), (df, 2, None), (df, 1, {"seed": 3})):
        assert not store.reuse("count", version, other, ["id", "name"], build, more)[1]
    assert len(built) == 5
    own = store.identity(df, ["id", "name"])
    assert len(store.stale("count", 1, own)) == 4 and store.stale("nothing", 1, own) == []


def test_a_second_writer_reads_what_is_there_and_halves_dont_count(spark):
    store = Artefacts(spark, fresh_path(spark))
    one, two = (spark.range(n).toDF("id") for n in (3, 5))
    assert store.put("t", 1, "x", one).count() == 3
    assert store.put("t", 1, "x", two).count() == 3
    two.write.parquet(store.path("t", 1, "y"))
    from tessella.sources.tables import _fs

    fs, done = _fs(spark, f"{store.path('t', 1, 'y')}/_SUCCESS")
    fs.delete(done, False)
    assert store.get("t", 1, "y") is None
