"""Exact dedup beyond the size up to which its filter is broadcast, with a text of many copies."""

import hashlib

from tessella.llm import common, exact_dedup


def test_filter_beyond_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FILTER_WORDS", 0)
    monkeypatch.setattr(common.hot_keys, "__defaults__", (4, 10))
    texts = ["many"] * 60 + [f"one {i}" for i in range(60)] + ["Two", "two", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs).collect()}
    low = [(t or "").lower() for t in texts]
    for i, t in enumerate(low):
        same = [j for j, u in enumerate(low) if u == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(same), len(same), i == max(same), hashlib.sha256(t.encode()).hexdigest())
