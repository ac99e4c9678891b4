"""Cost-balanced packing of tokenised documents into sequences.

A task reads its documents in order and packs them in pools of about POOL tokens: it opens as many sequences as the pool
fills exactly, takes documents by descending length and gives each to the sequence of least attention cost (linear plus
quadratic in the pieces' lengths) that has room for all of it; where none has, the one with most room takes what fits and
the rest goes on. What is left over when all are full waits for the next pool. What is left of a task's last pool fills
sequences whose lengths are powers of two, which need no padding. Nothing shuffles, and a task holds one pool at a time.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .textbytes import LOWER, chunks, columns, hash_runs, same_runs

POOL = 1 << 21
#: Runs of characters whose ids a task remembers, and their bytes in all.
CACHE, CACHE_BYTES = 200_000, 16 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Letters, digits and other marks of ASCII; 3 for the lead and tail of letters from U+00C0 to U+017F; 4 needs the tokenizer's own split.
_KIND = np.full(256, 4, np.uint8)
_KIND[33:127], _KIND[48:58], _KIND[65:91], _KIND[97:123] = 2, 1, 0, 0
_KIND[ord("'")] = 4
_KIND[0xC3:0xC6] = 3
_KIND[0x80:0xC0] = 3


class Ids:
    """Token ids of whole texts, as the tokenizer gives them for each text, with its runs of characters remembered.

    The tokenizer splits a text at white space, and there between letters, single digits and other marks, before it looks
    for tokens; so the ids of a text are those of its runs in order. White-space-separated stretches with an apostrophe,
    control characters, special tokens' brackets or characters beyond U+017F are given to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.held = 0
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(1 + max(self.tokenizer.get_vocab().values()), bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True

    def of(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents, one after another, and each one's first (n + 1 offsets)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        own = LOWER[data]
        space = _SPACE[own]
        kind = _KIND[own]
        low = (own >= 0x80) & (own < 0xC0)
        after = np.zeros(len(own), np.uint8)
        after[1:] = own[:-1]
        bad = (kind == 4) & ~space
        bad |= low & ((after < 0xC3) | (after > 0xC5))
        bad |= (after == 0xC3) & ((own == 0x97) | (own == 0xB7)) | (after == 0xC4) & (own == 0xB0)
        bad |= (after == ord("<")) & (own == ord("|"))
        edge = np.zeros(len(own), bool)
        edge[at[at < len(own)]] = True
        cut = edge.copy()
        cut[0] = True
        cut[1:] |= space[1:] != space[:-1]
        stretch = np.cumsum(cut) - 1
        opaque = np.zeros(stretch[-1] + 1, bool)
        opaque[stretch[bad]] = True
        opaque = opaque[stretch]
        kind[kind == 3] = 0
        cut[1:] |= ~opaque[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 1))
        starts = np.flatnonzero(cut & ~space)
        ends = np.append(np.flatnonzero(cut)[1:], len(own))[(~space)[np.flatnonzero(cut)]]
        first = np.searchsorted(starts, at)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        codes, found = pd.factorize(hash_runs(own, starts, ends))
        sample = np.empty(len(found), np.int64)
        sample[codes[::-1]] = np.arange(len(codes))[::-1]
        lower, raw = own.tobytes(), data.tobytes()
        if not same_runs(own, starts, ends, sample[codes]).all():
            # Two runs of one hash: tell the runs of this chunk apart by their bytes.
            codes, found = pd.factorize(np.array([lower[a:b] for a, b in zip(starts, ends, strict=True)], object))
            sample = np.empty(len(found), np.int64)
            sample[codes[::-1]] = np.arange(len(codes))[::-1]
        bounds = list(zip(starts[sample].tolist(), ends[sample].tolist(), strict=True))
        keys = [lower[a:b] for a, b in bounds]
        if len(self.known) > CACHE or self.held > CACHE_BYTES:
            self.known.clear()
            self.held = 0
        new = [i for i, k in enumerate(keys) if k not in self.known]
        if new:
            plain, odd = [], []
            for i in new:
                a, b = bounds[i]
                self.held += b - a
                (odd if opaque[a] else plain).append((keys[i], raw[a:b].decode("utf-8", "replace")))
            self._learn(plain, odd)
        found = [self.known[k] for k in keys]
        lens = np.fromiter(map(len, found), np.int64, len(found)) // 2
        pool = np.frombuffer(b"".join(found), np.uint16)
        begin = np.cumsum(lens) - lens
        each = lens[codes]
        total = np.concatenate(([0], np.cumsum(each)))
        out = pool[np.arange(total[-1]) + np.repeat(begin[codes] - total[:-1], each)]
        return out, total[first]

    def _learn(self, plain: list[tuple[bytes, str]], odd: list[tuple[bytes, str]]) -> None:
        for i in range(0, len(plain), 5000):
            part = plain[i : i + 5000]
            ids = np.array(self.tokenizer.encode(" ".join(w for _, w in part), add_special_tokens=False).ids, np.uint16)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(part):
                odd = odd + part
                continue
            raw, b = ids.tobytes(), [0, *(cut * 2).tolist()]
            for (k, _), x, y in zip(part, b[:-1], b[1:], strict=True):
                self.known[k] = raw[x:y]
        for i in range(0, len(odd), 2000):
            part = odd[i : i + 2000]
            for (k, _), e in zip(part, self.tokenizer.encode_batch([w for _, w in part], add_special_tokens=False), strict=True):
                self.known[k] = np.array(e.ids, np.uint16).tobytes()


def assign(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> list[tuple[int, int, int, int, int]]:
    """The pieces of ``place`` where nothing follows."""
    return place(lengths, capacity, linear, quadratic)[0]


def place(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 2048, last: bool = True) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int]]]:
    """``(document, start, length, sequence, offset)`` of pieces that fill sequences of ``capacity``; and what is left over.

    With ``last`` the rest fills sequences of powers of two; else it comes back as ``(document, start)``, in no order.
    Documents go by descending length, ties by position; sequences by cost, ties by number.
    """
    total = int(lengths.sum())
    rooms = [capacity] * (total // capacity)
    if last:
        rooms += [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if (total % capacity) >> b & 1]
    room, cost, used = np.array(rooms, np.int64), np.zeros(len(rooms)), np.zeros(len(rooms), np.int64)
    waiting = [(-int(n), i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(waiting)
    out, free = [], int(room.sum())
    while waiting and free:
        n, doc, start = heapq.heappop(waiting)
        fits = np.flatnonzero(room >= -n)
        s = int(fits[np.argmin(cost[fits])]) if len(fits) else int(np.argmax(room))
        take = min(-n, int(room[s]))
        out.append((doc, start, take, s, int(used[s])))
        room[s] -= take
        used[s] += take
        free -= take
        cost[s] += linear * take + quadratic * take * take
        if take < -n:
            heapq.heappush(waiting, (n + take, doc, start + take))
    return out, [(doc, start) for _, doc, start in waiting]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``tokenizer`` is the path of a tokenizers file on every machine. A document's ids end with ``end_id``, so null and
    empty texts are one token; an id beyond 65535 isn't supported. ``sequence_id`` is the task's number times 2^32 plus a
    count. Repeated rows are packed each; a null id is carried; other columns aren't read. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, opened = Ids(tokenizer), TaskContext.get().partitionId() << 32
        # Names and token ids of the documents at hand, what earlier pools have placed of each, and its length in all.
        names: list[pa.Array] = []
        tokens: list[np.ndarray] = []
        placed_before: list[int] = []
        held = 0

        def packed(last: bool) -> pa.RecordBatch:
            nonlocal opened, held, names, tokens, placed_before
            ids_of = pa.concat_arrays(names)
            before, rest = np.array(placed_before, np.int64), np.array([len(t) for t in tokens], np.int64)
            placed, over = place(rest, capacity, last=last)
            doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*placed, strict=True))
            crc = [zlib.crc32(tokens[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in placed]
            sequence += opened
            opened = int(sequence.max()) + 1
            whole = before + rest
            out = pa.RecordBatch.from_arrays([ids_of.take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (before[doc] + start, length, crc, whole[doc], sequence, offset))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            over.sort()
            names = [ids_of.take(pa.array([d for d, _ in over], pa.int64()))]
            placed_before = [int(before[d]) + s for d, s in over]
            tokens = [tokens[d][s:] for d, s in over]
            held = sum(map(len, tokens))
            return out

        for batch in batches:
            data, at = columns(batch.column(1))
            for i, j in chunks(at):
                flat, cut = ids.of(data[at[i] : at[j]], at[i : j + 1] - at[i])
                names.append(batch.column(0).slice(i, j - i))
                tokens += [np.append(flat[a:b], np.uint16(end_id)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                placed_before += [0] * (j - i)
                held += int(cut[-1]) + j - i
                if held >= POOL:
                    yield packed(False)
        if tokens:
            yield packed(True)

    kind = dict(rows.dtypes)["__id"]
    return rows.mapInArrow(pieces, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
