"""Pairs, contracts, records, retention and class folders by hand."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import contracts as c
from tessella.sources.folders import read_class_folder
from tessella.sources.tables import read_dataset


def test_duplicates_make_no_pair(spark):
    kind = "stem string, path string"
    a = spark.createDataFrame([("x", "a/x"), ("y", "a/y"), ("y", "a/y2"), ("z", "a/z")], kind)
    b = spark.createDataFrame([("x", "b/x"), ("y", "b/y"), ("w", "b/w"), ("v", "b/v1"), ("v", "b/v2")], kind)
    got = sorted(tuple(r) for r in c.pair_files(a, b, "stem", "path").collect())
    assert got == [
        ("v", "duplicate", "target", "", "b/v1", 2), ("v", "duplicate", "target", "", "b/v2", 2), ("w", "missing", "input", "", "b/w", 1), ("x", "pair", "", "a/x", "b/x", 1),
        ("y", "duplicate", "input", "a/y", "", 2), ("y", "duplicate", "input", "a/y2", "", 2), ("z", "missing", "target", "a/z", "", 1),
    ]
    assert [r.stem for r in c.repeated_stems(a.withColumn("stem", F.upper("stem")), "stem", "path").collect()] == ["Y"]


def test_every_finding_of_a_pair(spark):
    kind = "image_id int, y int, x int, code int, alpha int"
    cell = lambda i, codes, alpha=255: [(i, 0, x, v, alpha) for x, v in enumerate(codes)]
    inputs = cell(0, [0, 1, 2]) + cell(1, [0, 1, 2]) + cell(2, [0, 1, 1]) + cell(3, [0, 1, 2], 7) + cell(4, [0, 1, 2]) + cell(5, [*range(20, 32)]) + cell(6, [0, 1, 2]) + cell(9, [0])
    targets = cell(0, [0, 1, 11]) + cell(1, [0, 1]) + cell(2, [0, 1, 1]) + cell(3, [0, 1, 12]) + cell(4, [1, 11, 1]) + cell(5, [0] * 12) + cell(6, [0, 1, 99])
    out = c.pair_contract(spark.createDataFrame(inputs, kind), spark.createDataFrame(targets, kind), 2, 0, 1, [10, 11, 12], "alpha")
    got = {r.image_id: r for r in out.collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 6}
    assert {i: r.status for i, r in got.items()} == {0: "valid", 1: "invalid", 2: "warning", 3: "invalid", 4: "invalid", 5: "invalid", 6: "invalid"}
    assert got[0].reason == "OK" and got[0].class_11 == 1
    assert got[1].reason == "sizes differ: 3x1 and 2x1" and got[1].candidates == 0
    assert got[2].reason == "no cell of the region" and got[3].reason == "alpha is not opaque"
    assert got[4].reason == "region and classes differ on 2 cells; outline or blank differs on 2 cells"
    assert got[5].reason == "input codes: " + ", ".join(f"({k})=1" for k in range(20, 28)) + ", and 4 more; no cell of the region"
    assert got[6].reason == "target codes: (99)=1; region and classes differ on 1 cells"
    files = spark.createDataFrame([("pair",), ("pair",), ("missing",)], "finding string")
    ready = lambda df: {(r.section, r.name): r.n for r in c.readiness_report(df, files).collect()}
    assert ready(out)["ready", "ready"] == 0 and ready(out)["status", "invalid"] == 5
    assert ready(out.where("status <> 'invalid'"))["ready", "ready"] == 1
    assert ready(out.where("false"))["ready", "ready"] == 0


def test_records_against_their_assets(spark):
    records = spark.createDataFrame([(1, "a" * 64, 4, 5), (2, "b" * 64, 9, 5), (3, None, None, None)], "id int, sha256 string, width int, height int")
    assets = spark.createDataFrame([(1, "source", "a" * 64, 4, 5, [0]), (1, "target", "z", 4, 5, [0, 2]), (2, "source", "c" * 64, 4, 5, [0]), (2, "target", "z", 5, 5, [9, 0, 7])], "id int, side string, sha256 string, width int, height int, codes array<int>")
    got = sorted((r.id, r.finding, r.severity, r.detail) for r in c.audit_records(records, assets, "id", [0, 1, 2]).collect())
    assert got == [
        (2, "codes", "error", "7,9"), (2, "hash", "warning", "bbbbbbbbbbbb and cccccccccccc"), (2, "shape", "error", "4x5 and 5x5"), (2, "size", "warning", "9x5 and 4x5"),
        (3, "missing_source", "error", ""), (3, "missing_target", "error", ""),
    ]


def test_tile_findings_of_an_empty_manifest(spark):
    kind = "sample string, scene int, uid string, k int, region string"
    none, scenes = spark.createDataFrame([], kind), spark.createDataFrame([(1,)], "scene int")
    got = c.audit_tiles(none, scenes, "scene", "sample", "uid", "k", "region", ["uid"]).collect()
    assert len(got) == 7 and all(r.n == 0 for r in got)
    rows = spark.createDataFrame([("a", 1, "u", 0, None), ("a", 2, "u", 1, "mid"), (None, None, None, None, "mid")], kind)
    got = {(r.finding, r.name): r.n for r in c.audit_tiles(rows, scenes, "scene", "sample", "uid", "k", "region", ["uid"], orientations=2).collect()}
    assert got["unknown_scene", ""] == got["no_sample_id", ""] == got["duplicate_sample", ""] == got["missing_field", ""] == got["duplicate_tile", ""] == 1
    assert got["rows_without_tile", ""] == 2 and got["missing_orientation", "0"] == got["missing_orientation", "1"] == 1 and got["region", "mid"] == 2 and got["region", "unknown"] == 1


def test_policies_keep_what_they_name(spark):
    names = ["0", "99", "199", "299", "best", "final", "draft"]
    df = spark.createDataFrame([(1, n) for n in names], "run int, name string")
    kept = lambda *a: {r.name for r in c.retention(df, "run", "name", *a).where("keep").collect()}
    assert kept("all") == set(names) and kept("none") == set()
    assert kept("best") == {"best", "299"} and kept("last_and_best", 3) == {"best", "final", "99", "199", "299"}
    with pytest.raises(ValueError, match="policy"):
        kept("some")


def test_class_folders_list_only_what_the_filter_picks(spark, tmp_path):
    for split, class_id, name, text in (("train", "cat", "b.txt", "12"), ("train", "cat", "a.TXT", "1"), ("train", "dog", "c.jpg", "123"), ("val", "cat", "d.txt", ""), ("val", ".hidden", "e.txt", "")):
        (tmp_path / split / class_id).mkdir(parents=True, exist_ok=True)
        (tmp_path / split / class_id / name).write_text(text)
    df = read_class_folder(spark, str(tmp_path))
    rows = lambda d: sorted((r.split, r.class_id, r.name, r.length) for r in d.collect())
    assert rows(df) == [("train", "cat", "a.TXT", 1), ("train", "cat", "b.txt", 2), ("train", "dog", "c.jpg", 3), ("val", "cat", "d.txt", 0)]
    some = df.where("split = 'train' and class_id in ('cat', 'cow') and length > 1")
    assert rows(some) == [("train", "cat", "b.txt", 2)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "class_folder" in plan and "Filter" in plan
    assert df.where("split = 'train'").rdd.getNumPartitions() == 2 and df.rdd.getNumPartitions() == 3
    assert rows(df.where("split = 'none'")) == []
    assert rows(read_dataset(spark, f"ClassFolder:root=file:{tmp_path}:split=val:extra=txt,bmp")) == [("val", "cat", "d.txt", 0)]
    with pytest.raises(ValueError, match="unknown dataset"):
        read_dataset(spark, "Nothing:root=x")
