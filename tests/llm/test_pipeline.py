"""The corpus pipeline against plain versions of its stages, on small tables with nulls, repeats and planted cases."""

import random
import re

import pytest

import corpus_pipeline


def words(n, rng):
    return [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(300)}" for _ in range(n)]


def plain_sets(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text.lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_stages_equal_plain_versions(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    rng = random.Random(11)
    item = " ".join(words(30, rng))
    texts = []
    for i in range(60):
        w = words(rng.randint(30, 120), rng)
        texts.append(" ".join(w))
        if i % 6 == 0:
            texts.append(" ".join(w).upper())
        if i % 7 == 0:
            texts.append(" ".join([*w[:-1], "changed"]))
        if i % 9 == 0:
            texts.append(" ".join(w[:20] + item.split(" ") + w[20:]))
    texts += ["$$$ ### @@@"] * 3 + [None, "", "", "word"]
    rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows + rows[:1], "doc_id long, text string, lang string, source string, n_chars long, keep string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(bool(t) and not t.startswith("$")), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stage(spark, docs, str(tmp_path))
        held[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == columns
            path = f"{tmp_path}/{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    ids = lambda name: sorted(r.doc_id for r in held[name][1])
    before = held["exact_dedup"][0]
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    last = {}
    for i, t in before:
        last[low(t)] = max(i, last.get(low(t), -1))
    assert ids("exact_dedup") == sorted(i for i, t in before if last[low(t)] == i)
    before = held["ngram_join"][0]
    sets = {i: plain_sets(t or "") for i, t in before}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert ids("ngram_join") == sorted(i for i, _ in before if find(i) == i)
    before = held["decontamination"][0]
    assert ids("decontamination") == sorted(i for i, t in before if item not in low(t))
    kept = {i for i, _ in held["packing"][0]}
    pieces = held["packing"][1]
    assert {r.doc_id for r in pieces} == kept
    assert {i: sum(r.length for r in pieces if r.doc_id == i) for i in kept} == {r.doc_id: r.doc_tokens for r in pieces}
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in final.collect()} == kept
    assert sum(r.length for r in final.collect()) == sum(r.length for r in pieces)


def test_empty_table(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "a b c d e f")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
