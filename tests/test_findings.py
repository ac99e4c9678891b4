"""Small cases of findings: queries against their SQL on tables made for them, and the work that they may do."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.functions.texts import WHITE, simple_lower, simple_upper, trim_spaces
from tessella.operators.evaluation import inverse_consistency
from tessella.operators.geometry import offgrid_origins
from tessella.operators.vectors import clip_loss, knn
from tessella.plans import registry


def by_sql(name, tables):
    """The query's SQL over pandas frames, by table name."""
    c = duckdb.connect()
    for table, frame in tables.items():
        c.register(table, frame)
    return c.sql(registry.oracle_sql()[name]).df()


def test_every_character_has_the_case_and_white_space_of_sql(spark):
    every = pd.DataFrame({"i": [i for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]})
    every["c"] = every["i"].map(chr)
    c = F.col("c")
    got = spark.createDataFrame(every, "i int, c string").select("i", simple_lower(c).alias("l"), simple_upper(c).alias("u"), F.regexp_replace("c", WHITE, " ").alias("w"), trim_spaces(c).alias("t")).toPandas().sort_values("i")
    want = duckdb.sql(r"SELECT i, lower(c) AS l, upper(c) AS u, regexp_replace(c, '\s+', ' ', 'g') AS w, trim(c) AS t FROM every ORDER BY i").df()
    for k in "luwt":
        assert got[k].tolist() == want[k].tolist()


@pytest.mark.parametrize("text", ["Straße am See", "İzmir ΟΔΟΣ", "one\x0btwo Three", f"{chr(0x3000)}wide Space{chr(0xA0)}"])
def test_near_duplicate_groups_of_other_scripts_are_those_of_sql(spark, tmp_path, text):
    rows = pd.DataFrame({"doc_id": [9, 10, 11], "text": [text, "one two three", "wide space"], "source": ["a", "b", "c"], "lang": "en"})
    rows.to_parquet(tmp_path / "documents.parquet")
    got = registry.queries()["c2_near_duplicate_groups"](spark, str(tmp_path)).toPandas()
    want = by_sql("c2_near_duplicate_groups", {"documents": rows})
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(map(tuple, want.itertuples(index=False)))


def test_inverse_consistency_sends_no_table_through_the_driver(spark):
    cells = spark.range(2000).selectExpr("id div 20 as image_id", "cast(id % 20 div 5 as int) as y", "cast(id % 5 as int) as x", "cast(id % 3 as int) as target")
    preds = cells.where("y < 4").selectExpr("image_id", "0 as k", "y as oy", "x as ox", "target as pred")
    out = inverse_consistency(cells, preds, 3)
    rows = out.collect()
    assert len(rows) == 100 and all(r.transformed_miou == r.inverse_miou == 1.0 for r in rows)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_offgrid_origins_draw_no_more_than_they_need(spark):
    images = spark.range(300).selectExpr("id as image_id", "cast(900 + id as int) as width", "cast(512 + id % 3 * 384 as int) as height")
    store = spark.sparkContext._jsc.sc().statusStore()
    every = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    seen = {every().apply(i).stageId() for i in range(every().size())}
    rows = offgrid_origins(images, 512, 384, 64, 3, "interior", 5).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    now = every()
    shuffled = sum(s.shuffleWriteRecords() for s in (now.apply(i) for i in range(now.size())) if s.stageId() not in seen)
    assert len(rows) == 900 and 0 < shuffled <= 4 * 300, shuffled


def test_nearest_of_many_equal_scores_are_the_first_by_id(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, (700, 3)).astype(float)
    rows = spark.createDataFrame([(int(i), [float(x) for x in row], 0, int(i) % 2) for i, row in enumerate(v)], "id long, v array<float>, label int, half int")
    score = v @ v.T
    for k in (2, 30):
        got = {}
        for r in knn(rows, rows, k, "half").collect():
            got.setdefault((r.half, r.test_id), []).append((r["rank"], r.train_id))
        assert len(got) == 1400
        for (half, i), near in got.items():
            order = sorted(range(half, 700, 2), key=lambda j: (-score[i, j], j))[:k]
            assert [j for _, j in sorted(near)] == order


def test_clip_loss_makes_no_row_a_pair(spark):
    """A table of 1500 pairs of one batch, with a null and a short vector that are in no sum."""
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2, 1500, 4))
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    rows = [(i, [float(x) for x in p], [float(x) for x in q]) for i, (p, q) in enumerate(zip(a, b, strict=True))]
    pairs = spark.createDataFrame([*rows, (1500, None, None), (1501, [1.0], [1.0, None])], "i long, a array<double>, b array<double>")
    out = clip_loss(pairs.withColumn("k", F.lit(1)), "k", "i", "a", "b", 10.0)
    z = 10 * a @ b.T
    want = (np.log(np.exp(z).sum(axis=0)).sum() + np.log(np.exp(z).sum(axis=1)).sum() - 2 * np.trace(z)) / 1502 / 2
    assert abs(out.first().loss - want) < 2e-6
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "__j" not in plan and "FlatMapGroupsInArrow" in plan


def test_neighbours_copy_vectors_to_few_tasks(spark):
    """Before, each row of ``test`` went to as many lanes as there are shuffle partitions."""
    rows = spark.range(4000).selectExpr("id", "transform(sequence(1, 32), x -> cast(sin(id * x) as double)) as v", "0 as label").persist()
    rows.count()
    store = spark.sparkContext._jsc.sc().statusStore()
    every = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    seen = {every().apply(i).stageId() for i in range(every().size())}
    spark.conf.set("spark.sql.shuffle.partitions", "144")
    try:
        assert knn(rows, rows, 2).count() == 8000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    now = every()
    shuffled = sum(s.shuffleWriteBytes() for s in (now.apply(i) for i in range(now.size())) if s.stageId() not in seen)
    assert 0 < shuffled < 40 * 4000 * 32 * 8, shuffled
