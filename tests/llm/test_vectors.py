"""Clustering and hard negatives against plain loops."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import centroids, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, block string, place int, __v int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "c", "b", 1, 2) for r in rows], SCHEMA).repartition(parts)


def f32(x):
    return float(np.float32(x))


def vectors(seed, n, size, groups=0):
    """Random vectors; with ``groups`` they lie close around as many points."""
    rng = random.Random(seed)
    points = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(groups)]
    return [[f32((points[i % groups][d] if groups else 0) + rng.gauss(0, 0.05 if groups else 1)) for d in range(size)] for i in range(n)]


def plain_clusters(rows, k, rounds, size, scale, seed):
    live = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [q for _, q in sorted(live, key=key)[:k]]
    nearest = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [[q for _, q in live if nearest(q)[1] == j] for j in range(len(centres))]
        centres = [[sum(q[d] for q in o) // len(o) for d in range(size)] if o else c for o, c in zip(own, centres, strict=True)]
    out = [(i, *nearest(q)[::-1]) for i, q in live]
    inertia = [sum(d for _, j, d in out if j == c) for c in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(map(str, ((i, j, d, inertia[j], sum(inertia), digest[j]) for i, j, d in out)))


@pytest.mark.parametrize("groups, n, k, block", [(0, 60, 8, 7), (4, 90, 5, 4096), (1, 6, 8, 3)])
def test_clusters(spark, monkeypatch, groups, n, k, block):
    monkeypatch.setattr(centroids, "BLOCK", block)
    rows = [(i, v, 0) for i, v in enumerate(vectors(n, n, 6, groups))]
    rows += [(1000, None, 0), (1001, [], 0), (1002, [0.5] * 5, 0), (1003, [0.5] * 5 + [None], 0), (1004, [0.5] * 5 + [float("nan")], 0), (1005, [0.5] * 5 + [float("-inf")], 0)]
    rows += [(2, rows[2][1], 0), (2, rows[2][1], 5), (None, rows[3][1], None), (1006, rows[4][1], 1), (1007, [0.0] * 6, 1)]
    got = centroids.clusters(frame(spark, rows), k, 4, 6, 16, 3)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_clusters(rows, k, 4, 6, 16, 3)


def test_clusters_of_nothing_and_of_huge_components(spark):
    assert centroids.clusters(frame(spark, [(1, [1.0, 2.0], 0)])).count() == 0
    assert centroids.clusters(frame(spark, [(1, None, 0)]).where("false")).count() == 0
    with pytest.raises(Exception, match="beyond"):
        centroids.clusters(frame(spark, [(1, [1e30], 0)]), size=1).count()
    same = centroids.clusters(frame(spark, [(i, [1.0, 2.0], 0) for i in range(9)]), 3, 2, 2).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in same} == {(0, 0, 0)}


def plain_negatives(rows, modulus, scale=256, positives=5, negatives=5, share=80):
    live = [(i, kind, [math.floor(scale * x) for x in v]) for i, v, kind in rows if i is not None and kind is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, kind, q in live:
        if a % modulus:
            continue
        score = [(-sum(x * y for x, y in zip(q, p, strict=False)), i, k) for i, k, p in live if i != a]
        best = sorted((s, i) for s, i, k in score if k == kind)[:positives]
        for s, p in best:
            inside = sorted((t, i) for t, i, k in score if k != kind and share * -s <= 100 * -t <= 100 * -s)
            out += [(a, p, r, i, -s, -t) for r, (t, i) in enumerate(inside[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("groups, n, modulus, blocks", [(0, 150, 10, (4, 16)), (3, 150, 3, (8, 25)), (1, 80, 5, (256, 4096)), (0, 60, 1, (7, 9))])
def test_negatives(spark, monkeypatch, groups, n, modulus, blocks):
    monkeypatch.setattr(hard_negatives, "ANCHORS", blocks[0])
    monkeypatch.setattr(hard_negatives, "ROWS", blocks[1])
    rng = random.Random(n)
    rows = [(i, v, rng.choice([0, 0, 0, 1, 2, 7])) for i, v in enumerate(vectors(n, n, 5, groups))]
    rows += [(1000, None, 0), (1001, [], 0), (1002, [0.5] * 3, 1), (1003, [0.5, None], 0), (1004, [float("nan")] * 5, 0), (None, rows[0][1], 0), (1005, rows[1][1], None), (1010, [0.0] * 5, 0)]
    rows += [(n + i, rows[i][1], rows[i][2]) for i in range(0, 30)]  # ties by vector
    rows += [rows[0], rows[7], rows[10]]  # repeated rows, an anchor among them
    got = hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % modulus == 0, lanes=3)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows, modulus)


def test_no_anchors_no_rows(spark):
    df = frame(spark, [(1, [1.0], 0), (3, [2.0], 1)])
    assert hard_negatives.hard_negatives(df, F.col("vec_id") % 2 == 0).count() == 0
    assert hard_negatives.hard_negatives(df.where("false"), F.col("vec_id") % 1 == 0).count() == 0
    assert hard_negatives.hard_negatives(df, F.lit(None).cast("boolean")).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    base = rng.integers(-200, 200, 16)
    anchors = base + rng.integers(-3, 4, (20, 16))
    rows = np.concatenate((base + rng.integers(-3, 4, (50, 16)), rng.integers(-200, 200, (500, 16))))
    tree = hard_negatives.spanning_tree(anchors)
    order, parent, edge = tree
    assert sorted(order) == list(range(20)) and (parent >= 0).sum() == 19
    assert all(np.flatnonzero(order == parent[a])[0] < i for i, a in enumerate(order) if i)
    pair, seen = hard_negatives._Pair(anchors, tree, rows), 0
    exact = anchors @ rows.T
    top = int(exact.max())
    for a, own, score in pair.walk(lambda a, low, high: (high >= 0.9 * top) & (low <= top)):
        assert (score == exact[a, own]).all()
        assert set(np.flatnonzero(exact[a] >= 0.9 * top)) <= set(own)
        assert (pair.low[a] <= exact[a]).all() and (exact[a] <= pair.high[a]).all()
        seen += len(own)
    assert seen < 0.3 * exact.size


def test_spanning_tree_has_the_least_weight():
    v = np.random.default_rng(1).integers(-9, 9, (12, 3))
    order, parent, edge = hard_negatives.spanning_tree(v)
    pairs = sorted((float(np.sqrt(np.square(v[a] - v[b]).sum())), a, b) for a in range(12) for b in range(a))
    root, total = list(range(12)), 0.0
    find = lambda x: x if root[x] == x else find(root[x])
    for d, a, b in pairs:
        if find(a) != find(b):
            root[find(a)] = find(b)
            total += d
    assert edge.sum() == pytest.approx(total)
    assert hard_negatives.spanning_tree(np.zeros((1, 3), np.int64))[1].tolist() == [-1]
