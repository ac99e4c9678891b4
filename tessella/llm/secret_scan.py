"""Secret scan: fixed patterns, and guess costs of values that stand where credentials do.

A value's guess cost is found by dynamic programming over its characters: the cheapest way to put it together from common
words, dates, repeats, walks on a keyboard and stretches guessed by brute force. Words are those of a short list of password
parts, then the corpus's own: Spark counts the words of all texts outside such values, and the most frequent are ranked. A
value that costs 10^``least`` guesses or more, and enough for its length, is reported.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: The three base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words that announce a credential, and a value behind them. The word may be a part of a longer name: parts are set off by
#: underscores, dots, hyphens or capitals, and before long words by nothing. After bearer or basic a space is enough if
#: the value has a digit or a capital behind a small letter, as prose ("a basic understanding") has the same form.
_START = r"(?:(?<![A-Za-z0-9])|(?-i:(?<=[a-z0-9])(?=[A-Z])))"
_NAME = rf"(?:{_START}(?:pwd|pass|auth|authorization|bearer|token)|passwd|password|passphrase|passcode|secret|credentials?|private[_-]?key|access[_-]?key|api[_-]?key)"
_REST = r"(?:s?[0-9]{0,4}(?:[_.-][A-Za-z0-9_.-]{0,200}|(?-i:(?<=[a-z0-9])[A-Z][A-Za-z0-9_.-]{0,200}))?)"
CONTEXT = re.compile(rf"""(?:{_NAME}{_REST}["']?\x20*(?:[:=]|\x20is\x20)\x20*["']?(?:(?:bearer|basic|token)\x20+["']?)?|{_START}(?:bearer|basic)\x20+["']?(?=[^\s"'<>]*(?-i:[0-9]|[a-z][A-Z])))([^\s"'<>]{{6,}})""", re.I | re.A)
#: What ``is`` stands before in prose: letters alone, or with an apostrophe or hyphens between them.
_PROSE = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*[.,;:!?)]*")
_IS = re.compile(r"\x20is\x20+[\"']?$", re.I)
#: Words that are counted: runs of letters of ASCII, as values are put together from them.
_WORD = re.compile(r"[a-z]{4,20}")
#: How many of the corpus's words are ranked, in how many places a word has to stand, and decimal digits of cost a character.
RANKED, SEEN, EACH = 50_000, 3, 0.6
_HINT = re.compile(r"pass|secret|token|api_?key", re.I | re.A)
_MORE = re.compile(r"pwd|pass|auth|bearer|basic|credential|key|secret|token", re.I | re.A)
#: Common parts of passwords, the most common first.
WORDS = "password love admin welcome login master dragon monkey qwerty letmein hello secret summer winter spring autumn shadow sunshine princess football baseball hunter soccer batman superman michael jordan charlie thomas robert daniel jessica ashley test user root guest changeme default access server data house happy money flower tiger eagle silver golden orange purple yellow black white green blue star moon pass word key token".split()
_RANK = {w: i + 1 for i, w in enumerate(WORDS)}
_LONGEST = 20
_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_NEXT = {(a, b) for row in _ROWS for a, b in zip(row, row[1:], strict=False)} | {(b, a) for row in _ROWS for a, b in zip(row, row[1:], strict=False)}
_NEXT |= {(a, b) for up, down in zip(_ROWS[1:], _ROWS[2:], strict=False) for i, a in enumerate(up) for b in down[max(0, i - 1) : i + 1]}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-./]?[01]\d[-./]?[0-3]\d)?|[0-3]?\d[-./][01]?\d[-./](?:19|20)?\d\d")
_LEET = str.maketrans("@4301$57!", "aaeolsst" + "i")
_TURN = math.log10(2)


def guess_cost(value: str, ranks: dict[str, int] = _RANK) -> float:
    """The decimal logarithm of the guesses that the cheapest segmentation takes. Empty values cost 0.

    ``ranks`` has words in lower case. Work grows with the value's length times the longest word (20 characters); repeats and
    walks are followed to their end.
    """
    n = len(value)
    if not n:
        return 0.0
    low = value.lower()
    plain = low.translate(_LEET)
    best = [0.0] + [math.inf] * n
    kinds = sum(bool(re.search(c, value)) * k for c, k in (("[a-z]", 26), ("[A-Z]", 26), ("[0-9]", 10), ("[^A-Za-z0-9]", 33)))
    step = math.log10(max(kinds, 10))
    brute = math.inf
    for i in range(n):
        here = best[i] + (_TURN if i else 0)
        brute = min(brute, here) + step
        best[i + 1] = min(best[i + 1], brute)
        for j in range(i + 3, min(n, i + _LONGEST) + 1):
            rank = ranks.get(plain[i:j])
            if rank:
                cost = math.log10(rank + 1) + (0.5 if value[i:j] != low[i:j] else 0) + (0.5 if plain[i:j] != low[i:j] else 0)
                best[j] = min(best[j], here + cost)
        if value[i].isdigit():
            found = _DATE.match(value, i)
            if found:
                best[found.end()] = min(best[found.end()], here + (4.6 if found.end() - i > 4 else 2.1))
        for size in (1, 2, 3, 4):
            if i + 2 * size <= n and low[i : i + size] == low[i + size : i + 2 * size] and not (i >= size and low[i - size : i] == low[i : i + size]):
                k = 2
                while low.startswith(low[i : i + size], i + k * size) and i + (k + 1) * size <= n:
                    k += 1
                best[i + k * size] = min(best[i + k * size], here + size * step + math.log10(k))
        if not (i and (low[i - 1], low[i]) in _NEXT):
            j = i + 1
            while j < n and (low[j - 1], low[j]) in _NEXT:
                j += 1
            if j - i >= 4:
                best[j] = min(best[j], here + math.log10(94 * (j - i)))
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the base patterns, by start, then in the order assign, access, hex."""
    out = []
    if _HINT.search(text):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(out, key=lambda s: (s[0], order[s[2]]))


def _values(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each value behind a word that announces a credential."""
    if _MORE.search(text):
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip(",;)")
            if len(value) >= 6 and not (_PROSE.fullmatch(value) and _IS.search(text, m.start(), m.start(1))):
                yield m.start(1), m.start(1) + len(value)


def costly_values(text: str, least: float, ranks: dict[str, int] = _RANK) -> list[tuple[int, int, float]]:
    """``(start, end, cost)`` of values behind a word that announces a credential, of ``least`` and EACH a character or more.

    What stands behind ``is`` and has letters alone is prose.
    """
    costs = ((a, b, guess_cost(text[a:b], ranks)) for a, b in _values(text))
    return [(a, b, c) for a, b, c in costs if c >= max(least, EACH * (b - a))]


def word_counts(docs: DataFrame, text_col: str, flush: int = 200_000) -> DataFrame:
    """``word, n`` over all texts: words in lower case outside of values that stand where credentials do."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return found

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for a, b in reversed([(m.start(1), m.end(1)) for m in CONTEXT.finditer(text)] if text and _MORE.search(text) else []):
                    text = text[:a] + " " + text[b:]
                held.update(_WORD.findall((text or "").lower()))
                if len(held) > flush:
                    yield out()
        if held:
            yield out()

    return docs.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def corpus_ranks(docs: DataFrame, text_col: str = "text", most: int = RANKED, seen: int = SEEN) -> dict[str, int]:
    """Ranks of password parts, then of the ``most`` most frequent words of the corpus that stand in ``seen`` places or more, ties by word.

    The list is bounded: at most ``most`` words of up to 20 letters reach the driver and go to tasks, whatever the corpus.
    """
    rows = word_counts(docs, text_col).where(F.col("n") >= seen).orderBy(F.desc("n"), "word").limit(most).collect()
    out = dict(_RANK)
    for r in rows:
        out.setdefault(r.word, len(out) + 1)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 8.0) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess, max_cost``: one row per row of ``docs``.

    Texts are read twice: for the corpus's words, then for spans.

    Spans are ``kind:start:end`` in code points, the whole match for base kinds and the value for kind guess (added where
    no assign span covers it). ``max_cost`` is the largest guess cost of a value of kind assign or guess, 0 without one.
    Null and empty texts have no spans. Repeated rows are scanned each, a null id is carried, other columns aren't read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    sent = docs.sparkSession.sparkContext.broadcast(corpus_ranks(docs, text_col))
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "max_cost"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = sent.value
        for batch in batches:
            out = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                more = costly_values(text, least, ranks)
                assigned = [(a, b) for a, b, k in base if k == "assign"]
                added = [(a, b, "guess") for a, b, _ in more if not any(x <= a and b <= y for x, y in assigned)]
                costs = [c for _, _, c in more] + [guess_cost(ASSIGN.match(text, a)[2], ranks) for a, _ in assigned]
                order = {"assign": 0, "access": 1, "hex": 2, "guess": 3}
                every = sorted(base + added, key=lambda s: (s[0], order[s[2]]))
                write = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
                count = lambda kind: sum(k == kind for _, _, k in base)
                out.append((count("assign"), count("access"), count("hex"), hashlib.sha256(write(base).encode()).hexdigest(), write(every), len(added), max(costs, default=0.0)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return rows.mapInArrow(look, f"doc_id {dict(rows.dtypes)['__id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, max_cost double")
