"""Orientations of unequal sides, templates, proposals and contacts on small rasters."""

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import geometry, styles


def test_orientations_and_back(spark):
    for h, w in ((3, 5), (4, 2), (1, 6), (3, 3)):
        a = np.arange(h * w).reshape(h, w)
        rows = spark.createDataFrame([(y, x, int(a[y, x]), k) for k in range(8) for y in range(h) for x in range(w)], "y int, x int, v int, k int")
        oy, ox = geometry.orient_place(F.col("y"), F.col("x"), F.lit(h), F.lit(w), F.col("k"))
        at = rows.withColumn("oy", oy).withColumn("ox", ox)
        by, bx = geometry.restore_place(F.col("oy"), F.col("ox"), F.lit(h), F.lit(w), F.col("k"))
        got = at.withColumn("by", by).withColumn("bx", bx).collect()
        assert all((r.by, r.bx) == (r.y, r.x) for r in got)
        for k in range(8):
            want = np.rot90(a, k % 4)
            want = np.flip(want, 1) if k >= 4 else want
            assert all(want[r.oy, r.ox] == r.v for r in got if r.k == k)


def test_the_template_that_a_region_repeats_wins(spark):
    t = np.array([[1, 0, 0], [2, 2, 0]])
    templates = spark.createDataFrame([(i, y, x, int(m[y, x])) for i, m in enumerate((np.ones((2, 2), int), t)) for y in range(m.shape[0]) for x in range(m.shape[1])], "template long, y int, x int, code int")
    turned = np.flip(np.rot90(t, 1), 1)
    full = np.tile(turned, (2, 3))
    cells = [(7, 0, y + 2, x + 1, int(full[y, x])) for y in range(full.shape[0]) for x in range(full.shape[1])]
    cells += [(7, 1, 0, x, 1) for x in range(9)]  # one row: no box
    df = spark.createDataFrame(cells, "image_id long, region long, y int, x int, code int")
    got = styles.rank_templates(df, templates).collect()
    assert [(r.region, r.template, r.k, r.score) for r in got] == [(0, 1, 3, 1.0)]
    put = {(r.y, r.x): r.proposal for r in styles.propose(df, styles.rank_templates(df, templates), templates).collect()}
    assert put == {(y, x): c for _, region, y, x, c in cells if region == 0}
    assert styles.rank_templates(df.where("false"), templates).count() == 0


def test_edits_need_doubt_and_support(spark):
    rows = [(0, 0, 0, 5, True, 0, 1, [0.5, 0.4, 0.1]), (0, 0, 1, 5, True, 0, 1, [0.5, 0.3, 0.2]), (0, 0, 2, 5, True, 0, 1, [0.2, 0.75, 0.05]), (0, 1, 0, 6, False, 0, 1, [0.5, 0.49, 0.01]), (0, 1, 1, 5, True, 0, 9, [0.4, 0.4, 0.2]), (0, 1, 2, None, None, 0, 1, [0.5, 0.49, 0.01]), (0, 2, 0, 5, True, 1, 1, [0.5, 0.4, 0.1]), (0, 2, 1, 5, True, 2, 0, None)]
    df = spark.createDataFrame(rows, "image_id long, y int, x int, region int, reliable boolean, pred int, proposal int, s array<double>")
    own = styles.class_probabilities(df, "s", "pred", 3).checkpoint()
    by = lambda **k: {(r.y, r.x): r.by for r in styles.proposal_edits(own, "pred", "proposal", 3, **k).where("changed").collect()}
    assert by() == {}
    assert by(support=0.4) == {(0, 0): "supported"}
    assert by(influence=0.55, chosen=True) == {(0, 0): "supported", (0, 2): "assertive"}
    regions = spark.createDataFrame([(0, 5, True, ""), (0, 6, False, "small")], "image_id long, region int, reliable boolean, reason string")
    got = styles.region_edits(styles.proposal_edits(own, "pred", "proposal", 3, support=0.4), regions).orderBy("region").collect()
    assert [(r.region, r.changed, r.outcome) for r in got] == [(5, 1, "edited"), (6, 0, "small")]


def test_logits_become_shares(spark):
    df = spark.createDataFrame([(0, 0, 0, 1, [0.0, 1.0]), (0, 0, 1, 1, [3.0, 3.0]), (1, 0, 0, 1, [0.25, 0.75]), (1, 0, 1, 0, None)], "image_id long, y int, x int, pred int, s array<double>")
    got = {(r.image_id, r.x): list(r.probs) for r in styles.class_probabilities(df, "s", "pred", 2).collect()}
    assert got == {(0, 0): [round(1 / (1 + np.e), 9), round(np.e / (1 + np.e), 9)], (0, 1): [0.5, 0.5], (1, 0): [0.25, 0.75], (1, 1): [1.0, 0.0]}


def test_contacts_by_hand(spark):
    # A ring of region 0 around region 4, in a raster of 3 x 4 whose last column is region 3.
    region = [[0, 0, 0, 3], [0, 4, 0, 3], [0, 0, 0, 3]]
    rows = [(0, y, x, r % 2, r) for y, line in enumerate(region) for x, r in enumerate(line)]
    df = spark.createDataFrame(rows, "image_id long, y int, x int, code int, region int")
    got = {r.region: (r.area, r.contact, r.sides) for r in styles.region_contacts(df).collect()}
    assert got == {0: (8, 1.0, 9), 4: (1, 1.0, 0), 3: (3, 1.0, 5)}
    pairs = {(r.region, r.neighbour): (r.length, r.share) for r in styles.region_adjacency(df).collect()}
    assert pairs == {(0, 4): (4, 0.571429), (0, 3): (3, 0.428571), (4, 0): (4, 1.0), (3, 0): (3, 1.0)}
