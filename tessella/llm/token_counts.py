"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

Byte-pair merges give each prefix of a piece one last token: the token that ends there and that the merges leave apart
from the last token of what stands before it. So the count at a prefix is one more than the count before its last token,
and a table of counts answers how many tokens a prefix has, where a budget ends and what is left, without encoding again.

A piece that ends in a prefix carries the mark of a word's end, so every place has two states: the last token inside a
piece, and the last token if the piece ended there.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .packing import _KIND, _SPACE
from .textbytes import LOWER, chunks, columns, hash_runs, mix, same_runs

END = "</w>"
#: Runs, pairs of tokens and characters that a task remembers.
CACHE, PAIRS, CHARS = 200_000, 1_000_000, 100_000
#: Pairs in the table by hash.
SLOTS = 1 << 21
#: Prefixes in a row of the stored table.
PIECE = 1 << 16
#: Longer stretches aren't remembered.
SHORT = 64


def _byte_letters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [chr(b) for b in range(256)], 256
    for b in range(256):
        if b not in own:
            out[b] = chr(more)
            more += 1
    return out


class _Piece:
    """The states of one piece: its letters, and for each prefix the last token inside and the count."""

    __slots__ = ("letters", "last", "count")

    def __init__(self) -> None:
        self.letters: list[str] = []
        self.last = [-1]
        self.count = [0]


class Prefixes:
    """Token counts of every prefix, for a tokenizers file of byte-level pairs with word ends."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END:
            raise ValueError("prefix counts need pairs with word ends")
        self.vocab: dict[str, int] = model["vocab"]
        self.name = {i: w for w, i in self.vocab.items()}
        self.rank = {tuple(m): i for i, m in enumerate(model["merges"])}
        # Of each token that a merge makes: the merge's place, and its parts. Single letters have neither.
        self.made = {self.vocab[a + b]: (i, self.vocab[a], self.vocab[b]) for (a, b), i in self.rank.items()}
        self.pair = {(a, b): i for i, a, b in self.made.values()}
        self.longest = max(len(w.removesuffix(END)) for w in self.vocab)
        self.letters = _byte_letters()
        self.apart: dict[int, bool] = {}
        self.known: dict[bytes, np.ndarray] = {}
        self.kinds: dict[str, str] = {}
        self.plain: dict[str, str] = {}
        names = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.joins: set[str] | None = None
        self.met, self.fits = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)
        self._tree()

    def _tree(self) -> None:
        """The tokens' bytes as a tree: sorted edges ``node * 256 + byte``, and the token inside and at an end for each node."""
        byte = {c: b for b, c in enumerate(self.letters)}
        edges: dict[int, int] = {}
        inner, ended = [-1], [-1]
        for word, token in self.vocab.items():
            body, node = word.removesuffix(END), 0
            for c in body:
                key = node * 256 + byte[c]
                if key not in edges:
                    edges[key] = len(inner)
                    inner.append(-1)
                    ended.append(-1)
                node = edges[key]
            (inner if body == word else ended)[node] = token
        self.edge = np.array(sorted(edges), np.int64)
        self.goes = np.array([edges[k] for k in self.edge.tolist()], np.int64)
        self.tokens = np.array([inner, ended], np.int64)

    # The merges.

    def merged(self, symbols: list[str]) -> list[str]:
        """``symbols`` after all merges, the lowest rank first."""
        while len(symbols) > 1:
            best = min(zip(symbols, symbols[1:], strict=False), key=lambda p: self.rank.get(p, 1 << 60))
            if best not in self.rank:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == best:
                    out.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def stays(self, left: int, right: int) -> bool:
        """Whether the merges of both tokens' letters end in these two; ``left`` is -1 where ``right`` begins the piece.

        The later of the two outermost merges is undone again and again. If the letters beside the boundary would have
        merged before the step undone, the boundary doesn't stand. Equal merges go from left to right.
        """
        key = (left + 1) << 32 | right
        found = self.apart.get(key)
        if found is None:
            if left < 0:
                word = self.name[right]
                body = [*word.removesuffix(END)]
                if word.endswith(END):
                    body[-1] += END
                found = self.merged(body) == [word]
            else:
                found = self.stays(-1, right)
                a, b, none = left, right, (-1, -1, -1)
                until = 1 << 60
                while found:
                    if self.pair.get((a, b), 1 << 60) < until:
                        found = False
                    (i, _, x), (j, y, _) = self.made.get(a, none), self.made.get(b, none)
                    if i < 0 and j < 0:
                        break
                    if i > j:
                        a, until = x, i
                    else:
                        b, until = y, j + 1
            if len(self.apart) > PAIRS:
                self.apart.clear()
            self.apart[key] = found
        return found

    def _token(self, piece: _Piece, end: str) -> tuple[int, int]:
        """The last token of all letters of ``piece``, with ``end`` behind it, and the count with it."""
        tail = "".join(piece.letters[-self.longest :])
        n = len(piece.letters)
        for size in range(len(tail), 0, -1):
            token = self.vocab.get(tail[-size:] + end, -1)
            if token >= 0 and self.stays(piece.last[n - size], token):
                return token, piece.count[n - size] + 1
        raise ValueError(f"no token ends {tail!r}")

    def _add(self, piece: _Piece, char: str) -> None:
        for b in char.encode("utf-8", "surrogatepass"):
            piece.letters.append(self.letters[b])
            token, count = self._token(piece, "")
            piece.last.append(token)
            piece.count.append(count)

    def _ended(self, piece: _Piece | None) -> int:
        return self._token(piece, END)[1] if piece is not None and piece.letters else 0

    def runs(self, texts: list[bytes]) -> list[np.ndarray]:
        """Counts at each prefix of each short run that is one piece, by character: all runs go through the places together.

        Places come in order, so that what ends at a place is settled when tokens that begin there are tried, and the
        longest token that ends at a place is tried first.
        """
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-size, kind="stable")
        width = int(size.max())
        text = np.zeros((len(texts), width), np.int64)
        text[np.arange(width) < size[order][:, None]] = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        # By place and state (inside, ended): the last token, and the tokens so far.
        last, count = (np.full((2, width + 1, len(texts)), -1, np.int64) for _ in range(2))
        count[0, 0] = 0
        reach = np.searchsorted(-size[order], -np.arange(width), "left")
        for i in range(width):
            rows = np.arange(reach[i])
            node = np.zeros(len(rows), np.int64)
            for j in range(i, min(width, i + self.longest)):
                live = rows < reach[j]
                rows, node = rows[live], node[live]
                key = node * 256 + text[rows, j]
                at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
                live = self.edge[at] == key
                rows, node = rows[live], self.goes[at[live]]
                if not len(rows):
                    break
                for state in (0, 1):
                    token = self.tokens[state, node]
                    open_ = np.flatnonzero((token >= 0) & (last[state, j + 1, rows] < 0))
                    if not len(open_):
                        continue
                    own, token = rows[open_], token[open_]
                    fits = self._stay((last[0, i, own] + 1) << 32 | token)
                    own, token = own[fits], token[fits]
                    last[state, j + 1, own] = token
                    count[state, j + 1, own] = count[0, i, own] + 1
        # Of each character the count at its last byte.
        close = np.arange(width) < size[order][:, None]
        close[:, :-1] &= (text[:, 1:] & 0xC0) != 0x80
        flat, stop = count[1, 1:].T[close].astype(np.int32), np.cumsum(close.sum(1))
        out: list[np.ndarray] = [flat] * len(texts)
        for i, x, y in zip(order.tolist(), [0, *stop.tolist()], stop.tolist(), strict=False):
            out[i] = flat[x:y]
        return out

    def _stay(self, keys: np.ndarray) -> np.ndarray:
        """``stays`` of many pairs, ``(left + 1) << 32 | right``: those met before are read from a table by hash."""
        slot = (mix(keys.view(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)
        new = self.met[slot] != keys
        if new.any():
            pairs, first = np.unique(keys[new], return_index=True)
            fits = np.fromiter((self.stays((p >> 32) - 1, p & 0xFFFFFFFF) for p in pairs.tolist()), bool, len(pairs))
            out = self.fits[slot]
            out[new] = fits[np.searchsorted(pairs, keys[new])]
            at = slot[new][first]
            self.met[at], self.fits[at] = pairs, fits
            # Where two of these pairs share a slot, one key and one answer were written, but maybe not of the same pair.
            self.fits[at[self.met[at] == pairs]] = fits[self.met[at] == pairs]
            return out
        return self.fits[slot]

    def run(self, text: str) -> list[int]:
        """Counts at each prefix of a run that is one piece, of any length, by character."""
        piece, out = _Piece(), []
        for c in text.lower():
            self._add(piece, c)
            out.append(self._ended(piece))
        return out

    # Any other stretch without white space of ASCII.

    def _kind(self, char: str) -> str:
        """``L``, ``N``, ``S`` or ``P``: letter, number, space, other, as the tokenizer's own split tells them apart."""
        found = self.kinds.get(char)
        if found is None:
            split = lambda s: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(s))
            found = "S" if not split(char) else "L" if split("a" + char) == 1 else "P" if split("!" + char) == 1 else "N"
            if len(self.kinds) > CHARS:
                self.kinds.clear()
            self.kinds[char] = found
        return found

    def _normal(self, text: str) -> str:
        if len(text) > 1:
            return self.tokenizer.normalizer.normalize_str(text)
        found = self.plain.get(text)
        if found is None:
            found = self.tokenizer.normalizer.normalize_str(text)
            if len(self.plain) > CHARS:
                self.plain.clear()
            self.plain[text] = found
        return found

    def _blocks(self, text: str) -> Iterator[str]:
        """``text`` cut before each character that can't be composed with, or ordered against, what stands before."""
        if self.joins is None:
            pairs = (unicodedata.decomposition(chr(c)) for c in range(0x110000))
            self.joins = {chr(int(d.split()[1], 16)) for d in pairs if d and d[0] != "<" and " " in d}
            self.joins |= {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
        at = 0
        for i in range(1, len(text)):
            if not unicodedata.combining(text[i]) and text[i] not in self.joins:
                yield text[at:i]
                at = i
        if text:
            yield text[at:]

    def stretch(self, text: str) -> list[int]:
        """Counts at each prefix of any text, by character."""
        out: list[int] = []
        at, base = 0, 0
        for m in self.special.finditer(text) if self.special else ():
            # Inside a special token's string a prefix is ordinary text; the whole string is one token.
            part = self._segment(text[at : m.end() - 1], base)
            before = part[m.start() - at - 1] if m.start() > at else base
            out += part
            base = before + 1
            out.append(base)
            at = m.end()
        return out + self._segment(text[at:], base)

    def _segment(self, text: str, base: int) -> list[int]:
        walk = _Walk(self, base)
        out = []
        for block in self._blocks(text):
            for k in range(1, len(block)):
                # A prefix may end inside a composed character: try it, then go back.
                mark = walk.mark()
                for c in self._normal(block[:k]):
                    walk.push(c)
                out.append(walk.count())
                walk.back(mark)
            for c in self._normal(block):
                walk.push(c)
            out.append(walk.count())
        return out

    # Whole chunks of documents.

    def of(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each character of all documents, the tokens of its document up to and with it; and each one's first character."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        lead = (data & 0xC0) != 0x80
        place = np.concatenate(([0], np.cumsum(lead)))
        first_char = place[at]
        starts, ends, opaque = _runs(data, at)
        if not len(starts):
            return np.zeros(place[-1], np.int32), first_char
        own = LOWER[data]
        codes, found = pd.factorize(hash_runs(own, starts, ends))
        sample = np.empty(len(found), np.int64)
        sample[codes[::-1]] = np.arange(len(codes))[::-1]
        lower, raw = own.tobytes(), data.tobytes()
        if not same_runs(own, starts, ends, sample[codes]).all():
            # Two runs of one hash: tell the runs of this chunk apart by their bytes.
            codes, found = pd.factorize(np.array([lower[a:b] for a, b in zip(starts, ends, strict=True)], object))
            sample = np.empty(len(found), np.int64)
            sample[codes[::-1]] = np.arange(len(codes))[::-1]
        tables = self._tables([(lower[a:b], raw[a:b], odd) for a, b, odd in zip(starts[sample].tolist(), ends[sample].tolist(), opaque[sample].tolist(), strict=True)])
        size = np.fromiter(map(len, tables), np.int64, len(tables))
        pool, begin = np.concatenate(tables), np.cumsum(size) - size
        size, begin = size[codes], begin[codes]
        total = np.concatenate(([0], np.cumsum(pool[begin + size - 1], dtype=np.int64)))
        # A run reaches over the white space behind it, where its count stands still.
        char = place[starts]
        mark = np.zeros(place[-1], np.int64)
        mark[char] = 1
        run = np.cumsum(mark) - 1
        held = np.maximum(run, 0)
        inside = np.minimum(np.arange(len(run)) - char[held], size[held] - 1)
        before = np.repeat(total[np.searchsorted(starts, at[:-1])], np.diff(first_char))
        out = pool[begin[held] + np.maximum(inside, 0)] + total[held] - before
        # Before a document's first run there is nothing.
        out[run < np.repeat(np.searchsorted(starts, at[:-1]), np.diff(first_char))] = 0
        return out.astype(np.int32), first_char

    def _tables(self, asked: list[tuple[bytes, bytes, bool]]) -> list[np.ndarray]:
        """Counts of distinct runs, given by a key, their bytes and whether they need their own split."""
        if len(self.known) > CACHE:
            self.known.clear()
        found = {k: self.known[k] for k, _, _ in asked if k in self.known}
        new = {k: raw.decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass") for k, raw, odd in asked if k not in found and not odd and len(k) <= SHORT}
        learnt = dict(zip(new, self.runs(list(new.values())), strict=True)) if new else {}
        self.known |= learnt
        found |= learnt
        for k, raw, odd in asked:
            if k not in found:
                text = raw.decode("utf-8", "surrogatepass")
                found[k] = np.array(self.stretch(text) if odd else self.run(text), np.int32)
                if len(k) <= SHORT:
                    self.known[k] = found[k]
        return [found[k] for k, _, _ in asked]


@lru_cache(1)
def _prefixes(path: str) -> Prefixes:
    """One for all tasks of a worker."""
    return Prefixes(path)


class _Walk:
    """Splits normalised text into pieces as it comes, and counts the tokens so far."""

    __slots__ = ("of", "base", "kind", "piece", "text", "quote")

    def __init__(self, of: Prefixes, base: int):
        self.of, self.base = of, base
        self.kind, self.piece, self.text = "", None, ""
        #: Tokens before an apostrophe that one letter follows so far: with another it may be one of the split's endings.
        self.quote: int | None = None

    def mark(self) -> tuple:
        return self.base, self.kind, self.piece, self.text, self.quote, len(self.piece.letters) if self.piece else 0

    def back(self, mark: tuple) -> None:
        self.base, self.kind, self.piece, self.text, self.quote, n = mark
        if self.piece:
            del self.piece.letters[n:], self.piece.last[n + 1 :], self.piece.count[n + 1 :]

    def count(self) -> int:
        return self.base + self.of._ended(self.piece)

    def _open(self, kind: str, text: str) -> None:
        self.kind, self.piece, self.text = kind, _Piece(), text
        for c in text:
            self.of._add(self.piece, c)

    def push(self, char: str) -> None:
        kind, quote = self.of._kind(char), self.quote
        self.quote = None
        if kind == "L" and self.kind == "P" and self.text == "'":
            if char in "stmd":
                self._open("C", "'" + char)
                return
            self.quote = self.base
        elif kind == "L" and quote is not None and self.text + char in ("re", "ve", "ll"):
            self.base = quote
            self._open("C", "'" + self.text + char)
            return
        elif kind == self.kind and kind in "LP":
            self.of._add(self.piece, char)
            self.text = self.text[:1] + char
            return
        self.base = self.count()
        if kind == "S":
            self.kind, self.piece, self.text = "", None, ""
        else:
            self._open(kind, char)


def _runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs that the tokenizer treats apart, and whether each needs its own split.

    Runs of letters up to U+017F, single digits and runs of other marks of ASCII are pieces. A stretch without white
    space that has anything else, or an apostrophe, or the start of a special token, is one run.
    """
    space, kind = _SPACE[data], _KIND[LOWER[data]].copy()
    low = (data >= 0x80) & (data < 0xC0)
    after = np.zeros(len(data), np.uint8)
    after[1:] = data[:-1]
    bad = (kind == 4) & ~space
    bad |= low & ((after < 0xC3) | (after > 0xC5))
    # Signs of multiplication and division are no letters, and a dotted capital I is two characters in lower case.
    bad |= (after == 0xC3) & ((data == 0x97) | (data == 0xB7)) | (after == 0xC4) & (data == 0xB0)
    bad |= (after == ord("<")) & (data == ord("|"))
    cut = np.zeros(len(data), bool)
    cut[0] = True
    cut[at[at < len(data)]] = True
    cut[1:] |= space[1:] != space[:-1]
    stretch = np.cumsum(cut) - 1
    odd = np.zeros(stretch[-1] + 1, bool)
    odd[stretch[bad]] = True
    odd = odd[stretch]
    kind[kind == 3] = 0
    cut[1:] |= ~odd[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 1))
    edges = np.flatnonzero(cut)
    live = ~space[edges]
    return edges[live], np.append(edges[1:], len(data))[live], odd[edges[live]]


def _counted(batches: Iterator[pa.RecordBatch], tokenizer: str, text_at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the batches, with bytes of each text, counts by character and each text's first character."""
    counts = _prefixes(tokenizer)
    for batch in batches:
        data, at = columns(batch.column(text_at))
        for i, j in chunks(at):
            yield batch.slice(i, j - i), np.diff(at[i : j + 1]), *counts.of(data[at[i] : at[j]], at[i : j + 1] - at[i])


def _within(counts: np.ndarray, first: np.ndarray, budget: int) -> np.ndarray:
    """The characters of each text's longest prefix of at most ``budget`` tokens."""
    size = np.diff(first)
    whole = np.zeros(len(size), np.int64)
    whole[size > 0] = counts[first[1:][size > 0] - 1]
    out = size.copy()
    for d in np.flatnonzero(whole > budget):
        fits = np.flatnonzero(counts[first[d] : first[d + 1]] <= budget)
        out[d] = fits[-1] + 1 if len(fits) else 0
    return out


def token_counts(docs: DataFrame, tokenizer: str, budget: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, cut_chars`` for each row of ``docs``.

    ``n_tokens`` is the count at the whole text, ``cut_chars`` the length of the longest prefix of at most ``budget``
    tokens, in characters; both are read off the counts of all prefixes. A null text is empty and has none. Repeated rows
    and null ids are counted each; other columns aren't read. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, size, counts, first in _counted(batches, tokenizer, 1):
            n = np.where(np.diff(first) > 0, counts[np.maximum(first[1:] - 1, 0)], 0) if len(counts) else np.zeros(part.num_rows)
            cols = [size, n.astype(np.int64), n > budget, _within(counts, first, budget)]
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, cols)], ["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars"])

    return rows.mapInArrow(measure, f"doc_id {dict(rows.dtypes)['__id']}, n_bytes long, n_tokens long, over_limit boolean, cut_chars long")


def prefix_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """``doc_id, first, counts``: the tokens of the first ``first + i`` characters at place i of ``counts``, from 0 to the whole text.

    A long text has several rows of at most ``piece`` counts. A null or empty text has one count, 0. Repeated rows have
    rows each. The table is as large as four bytes a character before Parquet packs it.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, counts, first in _counted(batches, tokenizer, 1):
            owner, begin, held = [], [], []
            for d in range(part.num_rows):
                own = np.concatenate((np.zeros(1, np.int32), counts[first[d] : first[d + 1]]))
                for at in range(0, len(own), piece):
                    owner.append(d)
                    begin.append(at)
                    held.append(own[at : at + piece])
            ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held)))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(begin, pa.int64()), lists], ["doc_id", "first", "counts"])

    return rows.mapInArrow(store, f"doc_id {dict(rows.dtypes)['__id']}, first long, counts array<int>")


def tokens_at(table: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (``doc_id, chars``) with ``n_tokens``: of the text's first ``chars`` characters, from a table of prefix counts.

    Null where the text is shorter, the id unknown or ``chars`` null or negative.
    """
    ask = asked.withColumn("__n", F.monotonically_increasing_id())
    hit = ask.join(table, "doc_id").where((F.col("chars") >= F.col("first")) & (F.col("chars") < F.col("first") + F.size("counts")))
    found = hit.select("__n", F.get("counts", (F.col("chars") - F.col("first")).cast("int")).alias("n_tokens"))
    return ask.join(found.groupBy("__n").agg(F.max("n_tokens").alias("n_tokens")), "__n", "left").drop("__n")


def longest_prefix(table: DataFrame, budget: int | Column) -> DataFrame:
    """``doc_id, chars, n_tokens``: each text's longest prefix of at most ``budget`` tokens, from a table of prefix counts.

    A negative budget gives no row. ``budget`` may be a column of the table.
    """
    limit = F.lit(budget) if isinstance(budget, int) else budget
    last = F.aggregate(F.transform("counts", lambda c, i: F.when(c <= limit, i)), F.lit(-1), lambda s, i: F.greatest(s, F.coalesce(i, F.lit(-1))))
    hit = table.withColumn("__at", last).where("__at >= 0")
    best = F.max(F.struct((F.col("first") + F.col("__at")).alias("chars"), F.get("counts", F.col("__at")).alias("n_tokens")))
    return hit.groupBy("doc_id").agg(best.alias("__b")).select("doc_id", "__b.chars", "__b.n_tokens")


def truncate(docs: DataFrame, tokenizer: str, budget: int, text_col: str = "text") -> DataFrame:
    """``docs`` with each text cut to its longest prefix of at most ``budget`` tokens; a null text stays null, texts don't shuffle."""
    small_batches(docs.sparkSession)
    text_at = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, counts, first in _counted(batches, tokenizer, text_at):
            old = part.column(text_at)
            stop = _within(counts, first, budget)
            texts = pa.array([None if t is None else t[:n] for t, n in zip(old.to_pylist(), stop.tolist(), strict=True)], old.type)
            yield part.set_column(text_at, part.schema.field(text_at), texts)

    return docs.mapInArrow(cut, docs.schema)
