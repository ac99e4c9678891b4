"""Hashes of words, token ids, benchmark search and packing against plain versions."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import decontaminate, line_dedup, ngram_join, packing
from tessella.llm.textbytes import columns, hash_runs, same_runs, text_shingles


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_hashes_tell_patterns_apart():
    for n in (1024, 2048, 4096, 8192):
        a, b = thue_morse(n)
        data = np.frombuffer((a + b).encode(), np.uint8)
        x, y = hash_runs(data, np.array([0, n]), np.array([n, 2 * n]))
        assert x != y
    rng = random.Random(1)
    runs = ["".join(rng.choice("ab\x00") for _ in range(rng.randint(1, 20))) for _ in range(3000)]
    data = np.frombuffer("".join(runs).encode(), np.uint8)
    ends = np.cumsum([len(r) for r in runs])
    starts = ends - [len(r) for r in runs]
    hashes = hash_runs(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(runs))
    other = np.array([rng.randrange(len(runs)) for _ in runs])
    other[::3] = [runs.index(r) for r in runs[::3]]
    assert same_runs(data, starts, ends, other).tolist() == [r == runs[k] for r, k in zip(runs, other, strict=True)]


def test_words_of_one_pattern_stay_apart_in_operators(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = [w for n in (1024, 2048, 4096, 8192) for w in thue_morse(n)]
    rows = packing.pack(frame(spark, texts), path).collect()
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        for r in (r for r in rows if r.doc_id == i):
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert {r.n_class for r in ngram_join.jaccard_components(frame(spark, texts)).collect()} == {1}
    keys = line_dedup.measured(*columns(pa.array(texts)))[4]
    assert len(set(keys.tolist())) == len(texts)
    items = spark.createDataFrame([(0, texts[0])], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.contaminated_pairs(frame(spark, texts), items).collect()] == [0]


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(packing, "hash_runs", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    ids = packing.Ids(P.path("word_bpe_49k.json"))
    data, at = columns(pa.array(["alpha beta gamma alpha", "beta delta"]))
    flat, cut = ids.of(data, at)
    for k, text in enumerate(["alpha beta gamma alpha", "beta delta"]):
        assert flat[cut[k] : cut[k + 1]].tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


def words_of(text):
    import re

    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text))


def plain_pairs(docs, items, width=5, least=0.8):
    def grams(words, w):
        return {tuple(words[i : i + w]) for i in range(len(words) - w + 1)}

    out = set()
    for k, item in enumerate(items):
        own = words_of(item or "")
        w = min(width, len(own))
        wanted = grams(own, w) if w else set()
        for d, doc in enumerate(docs):
            shared = len(wanted & grams(words_of(doc or ""), w)) if wanted else 0
            if wanted and shared >= least * len(wanted):
                out.add((d, k, shared, len(wanted)))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [prose(n) for n in (1, 3, 5, 6, 9, 14, 30, 60, 200)] + [[]]
    docs = [prose(rng.choice([0, 2, 50, 400])) for _ in range(60)]
    for k, doc in enumerate(docs[::2]):
        item = list(items[k % 9])
        if k % 3 == 1 and len(item) > 20:
            item[len(item) // 2] = "other"
        at = rng.randint(0, len(doc))
        doc[at:at] = item
    docs, items = [" ".join(d) for d in docs] + [None, ""], [" ".join(i) for i in items] + [None]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.contaminated_pairs(frame(spark, docs), table)
    want = plain_pairs(docs, items)
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got.collect()} == want and len(want) > 20
    assert {r.doc_id for r in decontaminate.drop_contaminated(frame(spark, docs), table).collect()} == set(range(len(docs))) - {d for d, *_ in want}


def test_decontamination_memory_depends_neither_on_the_item_nor_on_the_document():
    rng = random.Random(3)
    item = "one two three four five"
    text = " ".join(rng.choice(["one", "two", "three", "four", "five", "six"]) for _ in range(20_000)) + " " + item
    wanted = decontaminate.Items([1], [item], 5, 0.8)
    data, at = columns(pa.array([text]))
    tracemalloc.start()
    assert [(d, k) for d, k, _, _ in wanted.search(data, at)] == [(0, 0)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20


def test_pools_hand_their_rest_on(spark, monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(packing, "POOL", 5000)
    texts = [" ".join(f"word{(i * j) % 97}" for j in range(40 + 13 * i % 700)) for i in range(80)]
    rows = packing.pack(frame(spark, texts).coalesce(1), P.path("word_bpe_49k.json")).collect()
    ends = {}
    for r in rows:
        ends[r.sequence_id] = max(ends.get(r.sequence_id, 0), r.offset + r.length)
    assert sum(n != 2048 for n in ends.values()) <= 11
    whole = {}
    for r in rows:
        whole.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for parts in whole.values():
        parts.sort()
        assert [s for s, _, _ in parts] == [sum(n for _, n, _ in parts[:i]) for i in range(len(parts))]
        assert {t for *_, t in parts} == {sum(n for _, n, _ in parts)}


def test_least_cost_with_room_takes_the_piece():
    lengths = np.array([1100, 1000, 600, 500, 448, 448])
    room, cost = [2048, 2048], [0.0, 0.0]
    want = []
    for doc, n in enumerate(lengths):
        s = min((k for k in range(2) if room[k] >= n), key=lambda k: cost[k])
        want.append((doc, s))
        room[s] -= n
        cost[s] += n + n * n / 2048
    assert sorted((d, s) for d, _, _, s, _ in packing.assign(lengths, 2048)) == want


def test_shingles_of_chunks_match_plain():
    texts = ["a b c d e f", "A b C d e f", "one", "", "x y z", None]
    sets = [s for _, part in text_shingles(pa.array(texts)) for s in part]
    assert [len(s) for s in sets] == [2, 2, 1, 0, 1, 0] and sets[0].tolist() == sets[1].tolist()
