"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items fall into bands by their number of 5-word shingles. For each band, a document is cut into blocks as long as the
band's largest item and searched in windows of two blocks, so that any run as long as the item lies within one window and
window and item are of like size, however long the document. Both get a one-permutation MinHash: shingles fall into BINS
bins by hash and each bin keeps its smallest one. A window is a candidate for every item with which it agrees on a bin;
candidates are verified on the whole document's shingles, exactly. Only windows that hold some item's smallest shingle are
measured, WINDOWS at a time, so that memory depends neither on a document's length nor on the size of the smallest item.

Documents never shuffle. Items go to the tasks in blocks of bounded size, one scan of the documents for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stash
from .textbytes import ALNUM, LOWER, U, chunks, columns, hash_runs, mix, words

BINS, GROWTH = 64, 1.5
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
#: Windows that are measured at once, and shingles in them (one window at least).
WINDOWS, SHINGLES = 4096, 1 << 17
_NONE = U(2**64 - 1)
_STEP = U(0xD1342543DE82EF95)


def _rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` words, in order; runs over a document's end are for the caller to leave out."""
    n = len(hashes) - width + 1
    out = np.zeros(max(0, n), U)
    for k in range(width if n > 0 else 0):
        out *= _STEP
        out += hashes[k : n + k]
    return mix(out + U(width))


def _hashed(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = LOWER[data]
    starts, ends, first = words(own, at, ALNUM)
    return hash_runs(own, starts, ends), first


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted known ones."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _candidates(value: np.ndarray, doc: np.ndarray, place: np.ndarray, size: int, low: np.ndarray, item: np.ndarray) -> Iterator[tuple[int, int]]:
    """``(document, item)`` of windows of two blocks of ``size`` shingles that agree with an item on a bin's minimum.

    ``value, doc, place`` are all shingles in order, with their document and place there; ``low`` are the items' minima,
    sorted, and ``item`` whose they are.
    """
    hits = np.flatnonzero(_among(value, np.unique(low)))
    if not len(hits):
        return
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] % size == 0)
    block = np.cumsum(new) - 1
    begin = np.append(np.flatnonzero(new), len(doc))
    owner = doc[begin[:-1]]
    own = block[hits]
    before = own[(own > 0) & (owner[own] == owner[own - 1])] - 1
    windows = np.unique(np.concatenate((own, before)))
    after = np.minimum(windows + 1, len(owner) - 1)
    first, end = begin[windows], begin[np.where(owner[after] == owner[windows], after, windows) + 1]
    total = np.concatenate(([0], np.cumsum(end - first)))
    i = 0
    while i < len(windows):
        j = min(i + WINDOWS, max(i + 1, int(np.searchsorted(total, total[i] + SHINGLES, "right")) - 1))
        count = end[i:j] - first[i:j]
        window = np.repeat(np.arange(j - i), count)
        own = value[np.arange(total[j] - total[i]) - np.repeat(total[i:j] - total[i], count) + np.repeat(first[i:j], count)]
        minima = np.full((j - i) * BINS, _NONE)
        np.minimum.at(minima, window * BINS + (own % U(BINS)).astype(np.int64), own)
        agree = np.flatnonzero(_among(minima, low) & (minima != _NONE))
        left, right = np.searchsorted(low, minima[agree], "left"), np.searchsorted(low, minima[agree], "right")
        for d, a, b in zip(owner[windows[i + agree // BINS]].tolist(), left.tolist(), right.tolist(), strict=True):
            yield from ((d, k) for k in item[a:b].tolist())
        i = j


class Items:
    """A block of items, ready to be searched for: shingle sets and, by band, bins' minima."""

    def __init__(self, ids: list, texts: list[str], width: int, least: float):
        self.ids, self.least, self.width = ids, least, width
        data, at = columns(pa.array([t or "" for t in texts], pa.large_string()))
        hashes, first = _hashed(data[at[0] : at[-1]], at - at[0])
        self.sets: list[np.ndarray] = []
        self.wide: list[int] = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            w = int(min(width, b - a))
            self.wide.append(w)
            self.sets.append(np.unique(_rolled(hashes[a:b], w)) if w else np.zeros(0, U))
        self.bands: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for k, s in enumerate(self.sets):
            if len(s):
                size = int(np.ceil(GROWTH ** np.ceil(np.log(len(s)) / np.log(GROWTH) - 1e-9)))
                bins = (s % U(BINS)).astype(np.int64)
                low = np.full(BINS, _NONE)
                np.minimum.at(low, bins, s)
                found.setdefault((self.wide[k], size), []).extend((int(low[b]), b, k) for b in np.unique(bins))
        for band, rows in found.items():
            rows.sort()
            self.bands[band] = np.array([r[0] for r in rows], U), np.array([r[2] for r in rows], np.int64)

    def search(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
        """``(document, item, containment, shared)`` of documents that hold at least the wanted share of an item."""
        hashes, first = _hashed(data, at)
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for wide in {w for w, _ in self.bands}:
            rolled = _rolled(hashes, wide)
            n = np.maximum(0, np.diff(first) - wide + 1)
            doc = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(doc)) - np.repeat(np.concatenate(([0], np.cumsum(n)))[:-1], n)
            held[wide] = rolled[first[doc] + place] if len(doc) else rolled[:0], doc, place
        pairs = set()
        for (wide, size), (low, item) in self.bands.items():
            value, doc, place = held[wide]
            if not len(value):
                continue
            pairs.update(_candidates(value, doc, place, size, low, item))
        whole: dict[tuple[int, int], np.ndarray] = {}
        for d, k in sorted(pairs):
            wide = self.wide[k]
            if (d, wide) not in whole:
                value, doc, _ = held[wide]
                a, b = np.searchsorted(doc, [d, d + 1])
                whole[d, wide] = np.unique(value[a:b])
            shared = int(_among(self.sets[k], whole[d, wide]).sum())
            if shared >= self.least * len(self.sets[k]):
                yield d, k, shared / len(self.sets[k]), shared


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items in blocks of at most BLOCK_ITEMS rows and about BLOCK_BYTES (one item at least), read as they are needed."""
    block, size = [], 0
    for r in items.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("t")).toLocalIterator():
        if block and (len(block) == BLOCK_ITEMS or size + len(r[1]) > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    if block:
        yield block


def contaminated_pairs(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """``doc_id, item_id, containment, n_shared, n_item``: documents that hold ``least`` or more of an item's shingles.

    Words are runs of ASCII letters and digits and of all characters outside ASCII, A-Z lower-cased. An item of fewer than
    ``width`` words is one shingle of that many words. Items without words, null or empty texts match nothing. Repeated
    rows of either table repeat their pairs; a null id is carried as it is. Other columns aren't read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kinds = dict(rows.dtypes)["__id"], dict(items.dtypes)[item_id]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, containment double, n_shared long, n_item long"

    def one(block: list[tuple]) -> DataFrame:
        # Written, so that no block's items stay in memory behind the next one's.
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = Items([k for k, _ in sent.value], [t for _, t in sent.value], width, least)
            for batch in batches:
                data, at = columns(batch.column(1))
                for i, j in chunks(at):
                    hits = list(wanted.search(data[at[i] : at[j]], at[i : j + 1] - at[i]))
                    if hits:
                        d, k, c, n = zip(*hits, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array([i + x for x in d])), pa.array([wanted.ids[x] for x in k]), pa.array(c), pa.array(n, pa.int64()), pa.array([len(wanted.sets[x]) for x in k], pa.int64())],
                            ["doc_id", "item_id", "containment", "n_shared", "n_item"],
                        )

        found = stash(rows.mapInArrow(search, schema))
        sent.destroy()
        return found

    found = [one(block) for block in item_blocks(items, item_id, item_text)]
    return reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold less than ``least`` of every item; nothing shuffles.

    Null and empty texts hold nothing and stay; items without words are held by none; repeated rows share their verdict and
    null ids are carried. Without items or rows nothing changes.
    """
    small_batches(docs.sparkSession)
    text_at = docs.columns.index(text_col)
    kept = docs
    for block in item_blocks(items, item_id, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            wanted = Items([k for k, _ in sent.value], [t for _, t in sent.value], width, least)
            for batch in batches:
                data, at = columns(batch.column(text_at))
                keep = np.ones(batch.num_rows, bool)
                for i, j in chunks(at):
                    keep[[i + h[0] for h in wanted.search(data[at[i] : at[j]], at[i : j + 1] - at[i])]] = False
                yield batch.filter(pa.array(keep))

        kept = kept.mapInArrow(clean, docs.schema)
    return kept
