"""Prefix token counts against the tokenizer's own encoding of every prefix."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tessella.llm import token_counts as t
from tessella.llm.textbytes import columns

PATH = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = "doc_id long, text string, first long, counts string, n_tokens int, __id int"
PLAIN = "abcdefghijklmnopqrstuvwxyzABCÉÜñßſ 0123456789.,!?'\"-<|>/\n\t _éüö×÷İĳŉ"
ODD = "ȩ́日本語한글한😀 　\u0085ΣσςА́Ж\x1c\x00​͸𝔘①½ﬁÅÅ'rvlesmtd"
WHOLE = ["<|endoftext|>", "<|startoftext|>", "don't", "we're", "they've", "it'll", "''s", "'re", "'r", "hello", "internationalization", "  ", "a" * 70]


@pytest.fixture(scope="module")
def prefixes():
    return t.Prefixes(PATH)


@pytest.fixture(scope="module")
def size(prefixes):
    return lambda text: len(prefixes.tokenizer.encode(text, add_special_tokens=False).ids)


def mixed(rng, most=25):
    return "".join(rng.choice(WHOLE) if rng.random() < 0.15 else rng.choice(PLAIN if rng.random() < 0.6 else ODD) for _ in range(rng.randint(0, most)))


def test_every_prefix(prefixes, size):
    rng = random.Random(5)
    texts = [mixed(rng) for _ in range(400)] + ["", " ", "<|endoftext|", "ab<|endoftext|><|startoftext|>c", "don't'll", "ẹ́x", "각"]
    data, at = columns(pa.array(texts))
    counts, first = prefixes.of(data, at)
    for i, text in enumerate(texts):
        assert counts[first[i] : first[i + 1]].tolist() == [size(text[:n]) for n in range(1, len(text) + 1)], text


def test_runs_of_one_hash_are_told_apart(monkeypatch, size):
    monkeypatch.setattr(t, "hash_runs", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    text = "one two three one's 12 two"
    data, at = columns(pa.array([text]))
    assert t.Prefixes(PATH).of(data, at)[0].tolist() == [size(text[:n]) for n in range(1, len(text) + 1)]


def test_boundaries_are_those_of_the_merges(prefixes):
    rng, words = random.Random(3), [*prefixes.vocab]
    inner = [w for w in words if not w.endswith(t.END)]
    short = [w for w in words if len(w.removesuffix(t.END)) < 4]
    for _ in range(4000):
        left, right = rng.choice(inner), rng.choice(short if rng.random() < 0.7 else words)
        if prefixes.merged([*left]) != [left]:
            continue
        body = [*right.removesuffix(t.END)]
        if right.endswith(t.END):
            body[-1] += t.END
        want = prefixes.merged([*left, *body]) == [left, right]
        assert prefixes.stays(prefixes.vocab[left], prefixes.vocab[right]) == want, (left, right)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    return [None, "", "   ", "Some words, twice.", "Some words, twice.", "x" * 3000, "日本" * 900, " ".join(mixed(rng, 9) for _ in range(600)), "word " * 5000, "don't <|endoftext|> stop"]


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, s, 1, "c", 2, 3) for i, s in zip(ids or range(len(texts)), texts, strict=True)], COLUMNS).repartition(3)


def test_counts_and_cuts(spark, texts, size):
    got = {r.doc_id: r for r in t.token_counts(frame(spark, texts), PATH, 50).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        own = text or ""
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(own.encode()), size(own), size(own) > 50)
        near = range(max(0, got[i].cut_chars - 3), min(len(own), got[i].cut_chars + 40) + 1)
        assert max(n for n in near if size(own[:n]) <= 50) == got[i].cut_chars
    cut = {r.doc_id: r for r in t.truncate(frame(spark, texts), PATH, 50).collect()}
    assert all(cut[i].text == (None if s is None else s[: got[i].cut_chars]) and cut[i].counts == "c" for i, s in enumerate(texts))
    assert t.truncate(frame(spark, ["Some words"]), PATH, 0).first().text == ""


def test_the_table_answers_without_encoding(spark, texts, size):
    table = t.prefix_counts(frame(spark, texts), PATH, piece=1000).checkpoint()
    held = {}
    for r in table.orderBy("doc_id", "first").collect():
        assert len(r["counts"]) <= 1000 and r.first == len(held.setdefault(r.doc_id, []))
        held[r.doc_id] += r["counts"]
    for i, s in enumerate(texts):
        assert len(held[i]) == len(s or "") + 1 and held[i][0] == 0 and held[i][-1] == size(s or "")
    asks = [(3, 0), (3, 7), (3, 18), (3, 19), (5, 999), (5, 1000), (5, 3000), (77, 1), (None, 1), (3, None), (3, -1), (3, 7)]
    got = t.tokens_at(table, spark.createDataFrame(asks, "doc_id long, chars long")).collect()
    want = {(i, n): size(texts[i][:n]) if i in (3, 5) and n is not None and 0 <= n <= len(texts[i]) else None for i, n in asks}
    assert len(got) == len(asks)
    assert all(r.n_tokens == want[r.doc_id, r.chars] for r in got)
    for budget in (0, 7, 50, 10**6):
        best = {r.doc_id: (r.chars, r.n_tokens) for r in t.longest_prefix(table, budget).collect()}
        for i in held:
            n = max(n for n, c in enumerate(held[i]) if c <= budget)
            assert best[i] == (n, held[i][n])
    assert t.longest_prefix(table, -1).count() == 0


def test_repeats_null_ids_and_empty_tables(spark):
    df = frame(spark, ["a b", "a b", "c"], [1, 1, None])
    assert sorted(map(str, ((r.doc_id, r.n_tokens) for r in t.token_counts(df, PATH).collect()))) == ["(1, 2)", "(1, 2)", "(None, 1)"]
    none = df.where("false")
    assert t.token_counts(none, PATH).count() == t.prefix_counts(none, PATH).count() == t.truncate(none, PATH, 5).count() == 0
