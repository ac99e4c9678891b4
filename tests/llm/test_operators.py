"""Operators against plain versions, on made rows with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import decontaminate, exact_dedup, license_scan, line_dedup, ngram_join, packing, quality, queries, secret_scan, surrogates, url_filter
from tessella.llm.textbytes import columns

UP = {i: i + 32 for i in range(65, 91)}
COLUMNS = "doc_id long, text string, key string, id int, n int, bucket string, __row int"


def prose(seed: int, n: int) -> str:
    state, out = seed * 7919 + 1, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % 2**31
        out.append("w" + format(state % 4000, "x"))
    return " ".join(out)


def frame(spark, texts, ids=None):
    rows = [(i, t, "k", 1, 2, "b", 3) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def texts():
    a, b = prose(1, 300), prose(2, 60)
    near = a.split(" ")
    near[50], near[200] = "x1", "x2"
    return [a, a.upper(), " ".join(near), b, b + " tail", "one two", "One  two", "", None, "   ", prose(3, 30000), "a b c d e", "a b c d f", *[b.replace("w", f"v{i}", 1) for i in range(12)], "ÉCOLE é", "école é"]


def plain_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    return {i: (len(s), comp[i]) for i, s in enumerate(sets)}


def test_ngram_components(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, texts)).collect()}
    assert got == plain_components(texts)


def test_ngram_repeats_nulls_and_empty(spark):
    t = prose(5, 40)
    got = ngram_join.jaccard_components(frame(spark, [t, t, t, ""], [7, 7, None, 9])).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.component_id if r.component_id is not None else -1) for r in got) == [(-1, -1), (7, 7), (7, 7), (9, 9)]
    assert ngram_join.jaccard_components(frame(spark, [])).count() == 0
    kept = ngram_join.keep_one_per_component(frame(spark, [t, t + " x", "other words are here now"], [3, 2, 1]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2] and kept.columns == COLUMNS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")


def test_exact_duplicates(spark, texts):
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(frame(spark, texts)).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault((t or "").translate(UP), []).append(i)
    for key, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(key.encode()).hexdigest())
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0
    again = exact_dedup.exact_duplicates(frame(spark, ["x", "X", "x"], [4, 4, None])).collect()
    assert [r.keep_id for r in again] == [4] * 3 and sorted(r.kept for r in again) == [False, True, True]
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_duplicates(frame(spark, ["x", "X", "y"])).collect()) == [1, 2]


def test_decontamination(spark):
    item, short = prose(9, 20), "only three words"
    long = prose(10, 20000) + " " + item.upper() + ", " + prose(11, 5000)
    half = " ".join(item.split(" ")[:10]) + " " + prose(12, 50)
    docs = frame(spark, [long, half, None, "", item, f"so {short} here", "only three other words", item], [1, 2, 3, 4, 5, 6, 7, 5])
    items = spark.createDataFrame([(100, item, 1), (101, short, 1), (102, None, 1), (103, "", 1)], "item_id long, text string, doc_id int")
    got = sorted((r.doc_id, r.item_id, r.containment) for r in decontaminate.contaminated_pairs(docs, items).collect())
    assert got == [(1, 100, 1.0), (5, 100, 1.0), (5, 100, 1.0), (6, 101, 1.0)]
    kept = decontaminate.drop_contaminated(docs, items)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 7] and kept.columns == docs.columns
    assert decontaminate.contaminated_pairs(docs, items.limit(0)).count() == 0 and decontaminate.drop_contaminated(docs, items.limit(0)).count() == 8


def test_packing_round_trip(spark, texts):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    more = [*texts, "don't we'll 's '", "<|endoftext|> a<|startoftext|>b", "tab\tnew\r\nline\x0bv\x1fu", "naïve — “quotes” … ½ x² ÀÉÎ×÷ İstanbul ΑΣ é 日本語 1234 a1b2", " nbsp em", "!!!??? ...a,b;c", "x" * 5000, "</w> ſ K"]
    path = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(more)}
    rows = packing.pack(frame(spark, more), path).collect()
    held, sequences = {i: [] for i in ids}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.length == len(part) > 0, more[r.doc_id][:60]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()), more[r.doc_id][:60]
        held[r.doc_id].append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, parts in held.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at == len(ids[i])
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack(frame(spark, []), path).count() == 0


def test_packing_balances_cost():
    placed = packing.assign(np.array([2000, 1500, 900, 600, 500, 400, 148, 96]), 2048)
    assert sum(p[2] for p in placed) == 6144 and {p[3] for p in placed} == {0, 1, 2}


def test_quality(spark, texts):
    docs = frame(spark, [*[prose(i, 80) for i in range(40)], *["!! $$$ " * 30 + prose(i, 5).upper() for i in range(40)], None, ""])
    labels = spark.createDataFrame([(i, int(i < 40), "x") for i in range(80)] + [(1, None, "x"), (2, 7, "x")], "doc_id long, quality int, text string")
    got = {r.doc_id: r for r in quality.scored(docs, labels).collect()}
    assert len(got) == 82 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [r for i, r in got.items() if i < 80 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert held and all(r.predicted == int(r.doc_id < 40) for r in held)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    assert quality.scored(docs.limit(0), labels).count() == 0 and quality.scored(docs, labels.limit(0)).count() == 82


def test_quality_matches_plain_density():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, len(quality.NAMES)))
    covs = [np.cov(rng.normal(size=(200, x.shape[1])).T) + np.eye(x.shape[1]) * k for k in (1, 2)]
    low = [np.linalg.cholesky(c) for c in covs]
    model = quality.Discriminant(np.zeros((2, x.shape[1])), np.array([np.linalg.inv(m) for m in low]), np.array([np.log(0.5) - np.log(np.diag(m)).sum() for m in low]))
    z = [-0.5 * np.einsum("ni,ij,nj->n", x, np.linalg.inv(c), x) - 0.5 * np.linalg.slogdet(c)[1] for c in covs]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(z[0] - z[1])))


def test_license(spark):
    texts = ["Released under the MIT License.\nunder THE mit license", "Licensed under the Apache License, Version 2.0.", "cc-by-nc x CC BY NC", None, "", "!!", "under the mit", "...x under the\tmit-license é",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this nice software and associated documentation files (the Software), to deal in the Software without restriction", "This work is licensed under the GNU General Public License, version 3."]
    got = {r.doc_id: r for r in license_scan.scan(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))
        places = [(p, label) for phrase, label in license_scan.PHRASES.items() for p in range(len(w)) if w[p : p + len(phrase.split(" "))] == phrase.split(" ")]
        starts = [p for p, _ in places]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({k for _, k in places}))), t
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert got[8].labels == "mit" and got[9].labels == "gpl" and got[6].labels == ""
    assert license_scan.scan(frame(spark, [])).count() == 0


def test_license_kin_are_told_apart(spark):
    gnu = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version 3."
    cases = {
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc",
        "Licensed under the GNU General Public License version 3": "gpl",
        "Licensed under the GNU Lesser General Public License version 3": "lgpl",
        "Licensed under the GNU Affero General Public License version 3": "agpl",
        gnu.format(""): "gpl",
        gnu.format("Affero "): "agpl",
        gnu.format("Lesser ").replace("program", "library"): "lgpl",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc",
        "Licensed under the GNU General Public License version 3. " + "x " * 9 + "Licensed under CC BY-NC 4.0": "cc-by-nc,gpl",
        "Licensed under the GNU Lesser General Public License version 3, also licensed under the GNU General Public License version 3": "gpl,lgpl",
        "This work is licensed under a Creative Commons license": "",
        "the software is free for any purpose": "",
    }
    got = {r.doc_id: r.labels for r in license_scan.scan(frame(spark, [*cases, *["words " + t + " more words" for t in cases]])).collect()}
    for i, want in enumerate([*cases.values()] * 2):
        assert got[i] == want, ([*cases] * 2)[i]


def test_secrets(spark):
    texts = [None, "", "password = 'hunter22x'", "API_KEY:abc", "token=abcdef token = AKIA" + "Z9" * 10, "é " + "0f" * 15 + " AKIA123", "pwd: Tr0ub4dor&3zQ9 and pwd = password", "paſſword = aaaaaaaa", "x" * 100_000 + " secret=" + "q1W" * 9]
    got = {r.doc_id: r for r in secret_scan.scan(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), t[:50]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
    assert got[6].n_guess == 1 and "guess:5:" in got[6].spans
    assert secret_scan.guess_cost("password") < 1 < secret_scan.guess_cost("qwertyuiop") < 6 < secret_scan.guess_cost("Tr0ub4dor&3zQ9")
    assert secret_scan.guess_cost("aaaaaaaaaaaaaaaa") < 4 and secret_scan.guess_cost("") == 0


PROSE = ["my password is important to me", "the token is required here", "auth: required", "The secret is kindness.", "Her passphrase is well-known, sadly", "authorization: required for everyone", "token: optional", "a password is something personal", "basic understanding of authentication: needed", "credentials: provided separately", "the secret is that nothing happens", "passcode is mandatory", "your password is forgotten?", "Secret: unknown", "access key: none, private key: unavailable", "pass: everything", "the bearer understands", "tokens: several", "pwd is wrongly typed", "authorization is l'autorisation"]
PLANTED = {"DB_PASS: Xk29!vQz7Lm": "Xk29!vQz7Lm", "the passphrase is 7hG$kk2pQx9z": "7hG$kk2pQx9z", "pwd: qpxzvkwjhtrmb": "qpxzvkwjhtrmb", "authHeader: kJh87sdfQQw21": "kJh87sdfQQw21", "credentials: Zx9-Qw8-Pl7-Mn6": "Zx9-Qw8-Pl7-Mn6"}


def test_prose_has_no_secrets_and_planted_ones_are_found(spark):
    # Words of the corpus are those that stand in three places outside of values.
    corpus = ["it is important, required, optional, needed, provided, separately, mandatory, unavailable, unknown, none, everything, several; forgotten, wrongly"] * 3
    texts = [*PROSE, *PLANTED, *corpus, None, ""]
    got = {r.doc_id: r for r in secret_scan.scan(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        added = [s.split(":") for s in got[i].spans.split(",") if s.startswith("guess")]
        assert [t[int(a) : int(b)] for _, a, b in added] == ([PLANTED[t]] if t in PLANTED else []), t
    # The value of a copied text isn't a word of the corpus.
    copies = [f"note {i}, pwd: qpxzvkwjhtrmb" for i in range(9)]
    assert {r.n_guess for r in secret_scan.scan(frame(spark, copies)).collect()} == {1}
    assert "qpxzvkwjhtrmb" not in secret_scan.corpus_ranks(frame(spark, copies))
    empty = frame(spark, ["x"]).where("false")
    assert secret_scan.scan(empty).count() == 0
    twice = secret_scan.scan(frame(spark, ["pwd: qpxzvkwjhtrmb"] * 2, [1, None]).union(frame(spark, ["pwd: qpxzvkwjhtrmb"], [1]))).collect()
    assert sorted(str(r.doc_id) for r in twice) == ["1", "1", "None"] and {r.n_guess for r in twice} == {1}


def plain_cost(value, ranks):
    """The cheapest of all ways to cut a value, by trying every one."""
    import itertools
    import math

    kinds = sum(bool(re.search(c, value)) * k for c, k in (("[a-z]", 26), ("[A-Z]", 26), ("[0-9]", 10), ("[^A-Za-z0-9]", 33)))
    step, n = math.log10(max(kinds, 10)), len(value)

    def part(a, b):
        s = value[a:b]
        low = s.lower()
        plain = low.translate(str.maketrans("@4301$57!", "aaeolssti"))
        costs = [step * len(s)]
        if plain in ranks and len(s) >= 3:
            costs.append(math.log10(ranks[plain] + 1) + 0.5 * (s != low) + 0.5 * (plain != low))
        for size in (1, 2, 3, 4):
            if len(s) >= 2 * size and len(s) % size == 0 and low == low[:size] * (len(s) // size):
                costs.append(size * step + math.log10(len(s) // size))
        return min(costs)

    return min(sum(part(a, b) for a, b in itertools.pairwise((0, *cut, n))) + math.log10(2) * len(cut) for k in range(n) for cut in itertools.combinations(range(1, n), k))


def test_guess_cost_is_the_cheapest_segmentation():
    ranks = {"cat": 3, "cats": 40, "sand": 7, "dog": 1, "and": 2}
    for value in ("cat", "catsand", "Cats", "c4tdog", "xcat", "aaaa", "ababab", "dogdogx", "qzcatsandq", "Zdog9", "aab", "xyxyxyxy", "cat!dog"):
        assert secret_scan.guess_cost(value, ranks) == pytest.approx(plain_cost(value, ranks)), value


def test_secrets_under_longer_names():
    value = "wJalrXUtnFEMI/K7MDENG"
    for form in ("aws_secret_access_key = {}", "DB_PWD={}", "db_pass: {}", "SECRET_KEY_BASE={}", "Authorization: Bearer {}", "Bearer {}", "Authorization: Basic {}", "dbPassword={}", '"secretAccessKey": "{}",', "PGPASSWORD={}", "my-api-key: {}, next", "pwd is {}"):
        text = "some text\n" + form.format(value) + " tail"
        assert [text[a:b] for a, b, _ in secret_scan.costly_values(text, 8.0)] == [value], form
    for text in ("a basic understanding of things", "monkey = wJalrXUtnFEMI", "compass: wJalrXUtnFEMI", "author: wJalrXUtnFEMI", "passage: wJalrXUtnFEMI", "the bearer understands"):
        assert secret_scan.costly_values(text, 8.0) == [], text


def test_surrogates(spark):
    key = b"k"
    texts = ["Mail Jo.72@mail3.example.com or +1 (017) 555-7713, Dr. Jane Smith met Mr Smith; card 4111 1111 1111 1111 and 4111111111111112, host 10.0.0.1.", "jo.72@MAIL3.example.com again 10.0.0.1", "clean text of 12 words", None, ""]
    got = {r.doc_id: r for r in surrogates.with_surrogates(frame(spark, texts), key).collect()}
    a, b = got[0].text, got[1].text
    for old in ("72@mail3", "555-7713", "Jane", "Smith", "4111", "10.0.0.1"):
        assert old not in a
    assert got[2].text == texts[2] and got[3].text is None and got[4].text == ""
    assert re.search(r"\S+@\S+\.example", a)[0].lower() == re.search(r"\S+@\S+\.example", b)[0].lower()
    assert re.search(r"\+\d \(\d{3}\) \d{3}-\d{4}", a) and surrogates.luhn(re.sub(" ", "", re.search(r"\d{4} \d{4} \d{4} \d{4}", a)[0]))
    one, two = re.search(r"Dr\. \w+ (\w+) met Mr (\w+);", a).groups()
    assert one == two
    assert sorted(surrogates.permuted(key, v, 1000, "t") for v in range(1000)) == list(range(1000))


def test_surrogates_of_names_without_title():
    text = "Dr. Jane Smith came. Smith said: JANE, the smith. Mrs Jane Smith's car; Smithson, Jane_1 and smith.x@mail.org"
    found = [(text[a:b], k, c) for a, b, k, c in surrogates.entities(text)]
    jane, smith = ("given_f", "jane"), ("family", "smith")
    assert found == [("Jane", *jane), ("Smith", *smith), ("Smith", *smith), ("JANE", *jane), ("Jane", *jane), ("Smith", *smith), ("Jane", *jane), ("smith.x@mail.org", "email", "smith.x@mail.org")]
    assert {k for _, _, k, c in surrogates.entities("Mr Kim Poe, Dr Kim Poe and Mrs Kim Doe. Kim") if c == "kim"} == {"given_n"}
    assert surrogates.entities("Jane met Smith") == []


def test_surrogate_collisions(spark, monkeypatch):
    real = surrogates.surrogate
    known = spark.createDataFrame([("family", n) for n in ("ann", "bob", "cyd", "dan")], "kind string, entity string")
    odd = {(r.kind, r.entity): r.attempt for r in surrogates.exceptions(known, b"k").collect()}
    names = [real(b"k", "family", n, odd.get(("family", n), 0)) for n in ("ann", "bob", "cyd", "dan")]
    assert len(set(names)) == 4
    taken = real(b"k", "family", "ann").lower()
    odd = surrogates.exceptions(known.union(spark.createDataFrame([("family", taken)], known.schema)), b"k").collect()
    assert [(r.entity, r.attempt) for r in odd] == [("ann", 1)]


def test_lines(spark):
    body = "the quick brown fox jumps over the lazy dog near the river bank today and then it rests for a long while under a tree"
    near = body.replace("today", "todays")
    docs = frame(spark, [f"{body}\nok\n\n{prose(1, 30)}", f"ok\n{body.upper()}!", f"{near}\nok", None, "", body], [1, 2, 3, 4, 5, 1])
    got = {(r.doc_id, r.line): r for r in line_dedup.line_groups(docs).collect()}
    assert got[1, 0].kept and not got[2, 1].kept and got[2, 1].group_id == got[1, 0].group_id
    assert all(r.kept for (d, n), r in got.items() if r.n_words < 3)
    assert (4, 0) in got and (5, 0) in got and line_dedup.line_groups(frame(spark, [])).count() == 0
    out = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs).where("doc_id > 1").collect()}
    assert out[2] == "ok" and out[4] is None and out[5] == ""


def test_long_lines_are_compared_on_characters(spark):
    words = prose(21, 600).split(" ")
    letters = " ".join(w[:-1] + "z" if i % 4 == 0 else w for i, w in enumerate(words))
    heavy = " ".join("q" * 45 if i % 60 == 0 else w for i, w in enumerate(words))
    swapped = " ".join("x" * 28 if i % 10 == 0 else w for i, w in enumerate(words))
    plain = lambda x, y: line_dedup.distance(x, y) / max(len(x), len(y)) <= 0.2
    assert len(" ".join(words)) > 2000 and plain(" ".join(words), letters) and plain(" ".join(words), heavy) and not plain(" ".join(words), swapped)
    one = lambda x: next(line_dedup._measure(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([x])], ["i", "t"])])))
    assert one(swapped).column("text")[0].as_py() == swapped.translate({i: 48 for i in range(48, 58)})
    got = {r.doc_id: r for r in line_dedup.line_groups(frame(spark, [" ".join(words), heavy, swapped])).collect()}
    assert got[0].group_id == got[1].group_id != got[2].group_id
    rng = np.random.default_rng(3)
    for _ in range(50):
        x, y = ("".join(rng.choice(list("abé日"), rng.integers(0, 12))) for _ in range(2))
        row = list(range(len(y) + 1))
        for i, c in enumerate(x):
            row = _next_row(row, i, c, y)
        assert line_dedup.distance(x, y) == row[-1], (x, y)


def test_short_lines(spark, tmp_path):
    lines = ["ok", "OK!", "x", "", "日本語の文章です", "日本語の文章です。", "日本語の文書です", "abcdefghij", "abXdefgYij", "abcdeZZZij"]
    frame(spark, ["\n".join(lines), "ok\n\nabcdefghi"]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.line): r for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()}
    group = {k: r.group_id for k, r in got.items()}
    assert group[0, 0] == group[0, 1] == group[1, 0] != group[0, 2] and not got[1, 0].kept and got[0, 0].group_size == 3
    assert got[0, 3].kept and got[1, 1].kept and got[0, 3].group_size == 1
    assert group[0, 4] == group[0, 6] and got[0, 6].kept is False
    assert group[0, 7] == group[0, 8] == group[1, 2] != group[0, 9]


def test_lines_with_one_word_replaced(spark):
    pairs = []
    for seed, n in enumerate([4, 5, 6, 8, 10, 15, 20, 30] * 4):
        words = (prose(100 + seed, 40).replace("w", "syl") + " ").split(" ")[:n]
        other = list(words)
        other[(seed * 7) % n] = "q" + words[(seed * 7) % n][1:-1] + "z"
        pairs += [" ".join(words), " ".join(other)]
    pairs = [p for i in range(0, len(pairs), 2) for p in pairs[i : i + 2] if line_dedup.distance(*pairs[i : i + 2]) <= 0.2 * len(pairs[i])]
    got = {r.line: r.group_id for r in line_dedup.line_groups(frame(spark, ["\n".join(pairs)])).collect()}
    assert len(pairs) > 50 and all(got[i] == got[i + 1] for i in range(0, len(pairs), 2))


def _next_row(row, i, c, y):
    new = [i + 1]
    for j, d in enumerate(y):
        new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (c != d)))
    return new


def test_urls(spark):
    urls = [f"https://a.example.net/en/{i}" for i in range(30)] + [f"http://b.EXAMPLE.net/es/{i}?q" for i in range(30)]
    odd = [None, "", "nothing", "http://x.com", "http://www.example.com/en/1#a", "ftp://sub.example.com/en/", "http://com/x", "http://badcom/x", "://", "http://h?x/y"]
    pages = spark.createDataFrame([(i, u, "h", "x", 1) for i, u in enumerate(urls + odd)], "page_id long, url string, html string, path string, b int")
    got = {r.page_id: r for r in url_filter.judge(pages, url_filter.RULES).collect()}
    for i, u in enumerate(urls + odd):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match("[^/?#]*", rest)[0]
            path = re.match("[^?#]*", rest[len(host) :])[0] if True else ""
            host = host.translate(UP)
        fits = [(len(r), r, v) for r, v in url_filter.RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None), u
        if fits:
            assert r.verdict == max(fits)[2], u
    assert url_filter.judge(pages.limit(0), url_filter.RULES).count() == 0


def test_stages_carry_columns_of_any_name(spark):
    t = prose(4, 60)
    texts = [t, t.upper(), t + " tail", "", None, prose(8, 50)]
    kind = "doc_id long, text string, __drop long, __gone string, __gone_id int, __id int, __text int, __x int, y int, key int, component_id long, kept boolean"
    rows = [(i, s, i, "g", 1, 2, 3, 4, 5, 6, 7, True) for i, s in enumerate(texts)]
    df = spark.createDataFrame(rows, kind).repartition(2)
    ids = lambda out: sorted(r.doc_id for r in out.collect())
    out = exact_dedup.drop_exact_duplicates(df)
    assert out.columns == df.columns and ids(out) == [1, 2, 4, 5]
    out = ngram_join.keep_one_per_component(df)
    assert out.columns == df.columns and ids(out) == [0, 3, 4, 5]
    out = line_dedup.drop_repeated_lines(df)
    assert out.columns == df.columns and ids(out) == list(range(6)) and out.where("doc_id = 4").first().text is None
    items = spark.createDataFrame([(1, " ".join(t.split(" ")[5:30])), (2, None), (3, "")], "item_id long, text string")
    out = decontaminate.drop_contaminated(df, items)
    assert out.columns == df.columns and ids(out) == [3, 4, 5]
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    assert quality.keep_good(df, labels).columns == df.columns
    for out in (exact_dedup.drop_exact_duplicates(df.where("false")), ngram_join.keep_one_per_component(df.where("false")), decontaminate.drop_contaminated(df.where("false"), items), quality.keep_good(df.where("false"), labels)):
        assert out.columns == df.columns and out.count() == 0
