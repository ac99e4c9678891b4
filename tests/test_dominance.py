"""Dominance without gathering a key's sizes."""

from tessella.operators import audits


def test_dominance(spark):
    rows = [("a", 100.0), ("a", 5.0), ("a", 5.0), ("b", 7.0), ("b", 7.0), ("b", 1.0), ("c", 3.0), ("d", None), ("d", 2.0), (None, 50.0), (None, 1.0), *[("hot", float(i)) for i in range(500)]]
    out = audits.dominance(spark.createDataFrame(rows, "k string, v double"), "k", "v")
    assert {tuple(r) for r in out.collect()} == {("a", 100.0, 5.0, True), ("b", 7.0, 7.0, False), (None, 50.0, 1.0, True), ("hot", 499.0, 498.0, False)}
    assert "collect_list" not in out._jdf.queryExecution().toString()
