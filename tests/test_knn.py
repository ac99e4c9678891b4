"""Nearest neighbours over several blocks, lanes and tries against a plain search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import vectors


def rows(seed, n, first=0):
    rng = random.Random(seed)
    return [(first + i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)], rng.randrange(3), i % 2) for i in range(n)]


def plain(test, train, k):
    out = []
    for t, v, *_ in test:
        best = sorted((-round(float(np.dot(v, u)), 6), i, c) for i, u, c, _ in train)[:k]
        out += [(t, i, c, -s, r) for r, (s, i, c) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(3, 5), (1024, 4096)])
def test_nearest(spark, monkeypatch, sizes):
    monkeypatch.setattr(vectors, "TEST", sizes[0])
    monkeypatch.setattr(vectors, "TRAIN", sizes[1])
    test, train = rows(1, 17), rows(2, 90, 100)
    kind = "id long, v array<double>, label int, try int"
    a, b = spark.createDataFrame(test, kind).repartition(3), spark.createDataFrame(train, kind).repartition(4)
    got = vectors.knn(a, b, 7)
    assert sorted((r.test_id, r.train_id, r.label, r.score, r["rank"]) for r in got.collect()) == plain(test, train, 7)
    got = vectors.knn(a, b, 50, "try").collect()
    for t in (0, 1):
        assert sorted((r.test_id, r.train_id, r.label, r.score, r["rank"]) for r in got if r["try"] == t) == plain(test, [r for r in train if r[3] == t], 50)
    assert vectors.knn(a.where("false"), b, 3).count() == vectors.knn(a, b.where("false"), 3).count() == 0


def test_no_row_goes_through_the_driver(spark):
    kind = "id long, v array<double>, label int, try int"
    df = spark.createDataFrame(rows(1, 20), kind)
    plan = vectors.knn(df, df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan and "WindowGroupLimit" in plan


def test_k_is_capped_to_the_try(spark):
    kind = "id long, v array<double>, label int, try int"
    test, train = rows(3, 12), rows(4, 30, 100)
    train = [r for r in train if r[3] == 0] + [r for r in train if r[3] == 1][:4]
    got = {r.k: r for r in vectors.knn_evaluation(spark.createDataFrame(test, kind), spark.createDataFrame(train, kind), [3, 10, 99], "try").collect()}
    # Fifteen rows in one try, four in the other.
    assert {k: r.tries for k, r in got.items()} == {3: 2, 10: 1, 15: 1, 4: 1}
    assert got[10].top1_std is None
    want = []
    for t in (0, 1):
        hit = []
        for _, v, label, _ in test:
            best = sorted((-round(float(np.dot(v, u)), 6), i, c) for i, u, c, n in train if n == t)[:3]
            votes = {}
            for s, _, c in best:
                votes[c] = votes.get(c, 0) + np.exp((-s + best[0][0]) / 0.07)
            hit.append(min(votes, key=lambda c: (-round(votes[c], 6), c)) == label)
        want.append(100 * np.mean(hit))
    assert got[3].top1_mean == pytest.approx(np.mean(want), abs=1e-5) and got[3].top1_std == pytest.approx(np.std(want, ddof=1), abs=1e-5)
