"""Hard negatives of anchors: rows of another label whose score lies just below that of a positive.

Anchors are packed into blocks of near ones, each block with a spanning tree of least edges; all rows are packed into
blocks too. Every block of anchors meets every block of rows as a pair of packed rows, so that the search is spread over
tasks and a task holds one pair at a time. In a pair the root's scores are exact. A child's scores lie within the edge's
length times the row's norm of its parent's, so its interval is its parent's, widened; only rows whose interval reaches
what is searched for are scored again. For positives that is what is at least the worst of the best so far, for negatives
the windows below the positives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, stash

ANCHORS, ROWS = 256, 4096
#: Over how many keys blocks of rows are dealt, at most; each takes all blocks of anchors once.
LANES = 1024
#: Whole numbers beyond it are an error, so that products fit a long.
MOST = 1 << 24
#: Products of whole numbers are exact in doubles as long as their sums stay below it.
EXACT = 1 << 53
NONE = np.iinfo(np.int64).min


def whole(vector: Column) -> Column:
    """Whether an array is there and has no null or non-finite component."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def _matrix(col: pa.ListArray, scale: int) -> np.ndarray:
    """The vectors as rows of whole numbers, shorter ones filled up with zeros."""
    at = col.offsets.to_numpy().astype(np.int64)
    flat = np.floor(scale * col.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(flat) and np.abs(flat).max() > MOST:
        raise ValueError(f"a component times {scale} is beyond {MOST}")
    size = np.diff(at)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the vectors, each one's parent (-1 for the first) and its edge's length: a tree of least edges."""
    n = len(vectors)
    v = vectors.astype(np.float64)
    norm = np.square(v).sum(1)
    order, parent = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    best, out = np.full(n, np.inf), np.zeros(n, bool)
    for i in range(n):
        at = int(np.where(out, np.inf, best).argmin()) if i else 0
        order[i], out[at] = at, True
        d = norm + norm[at] - 2 * (v @ v[at])
        near = ~out & (d < best)
        best[near], parent[near] = d[near], at
    edge = np.array([np.sqrt(float(np.square(vectors[i] - vectors[p]).sum())) if p >= 0 else 0.0 for i, p in enumerate(parent)])
    return order, parent, edge


def _packed(rows: DataFrame, size: int, scale: int, prefix: str, tree: bool = False) -> DataFrame:
    """``rows(__id, __label, __v)`` in blocks of at most ``size``: number, ids, labels, components and their width, and the spanning tree if asked for."""
    small_batches(rows.sparkSession)
    names = ["block", "ids", "labels", "v", "width"] + ["order", "parent", "edge"] * tree

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []

        def block(count: int) -> pa.RecordBatch:
            nonlocal number, held
            table = pa.Table.from_batches(held)
            own, held = table.slice(0, count).combine_chunks(), table.slice(count).to_batches()
            ids, labels = (own.column(c).to_numpy().astype("<i8").tobytes() for c in (0, 1))
            q = _matrix(own.column(2).chunk(0), scale)
            cols = [ids, labels, q.astype("<i4").tobytes(), q.shape[1]]
            if tree:
                order, parent, edge = spanning_tree(q)
                cols += [order.astype("<i8").tobytes(), parent.astype("<i8").tobytes(), edge.astype("<f8").tobytes()]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([x]) if isinstance(x, bytes) else pa.array([x], pa.int32()) if i == 4 else pa.array([x], pa.int64()) for i, x in enumerate([number - 1, *cols])], [prefix + n for n in names])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            while sum(b.num_rows for b in held) >= size:
                yield block(size)
        if left := sum(b.num_rows for b in held):
            yield block(left)

    kinds = ["long", "binary", "binary", "binary", "int", "binary", "binary", "binary"]
    return rows.mapInArrow(pack, ", ".join(f"{prefix}{n} {k}" for n, k in zip(names, kinds, strict=False)))


class _Pair:
    """A block of anchors before a block of rows: intervals of scores along the anchors' tree."""

    def __init__(self, anchors: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray):
        width = max(anchors.shape[1], rows.shape[1])
        pad = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
        anchors, rows = pad(anchors), pad(rows)
        top = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(width, 1)
        kind = np.float64 if top < EXACT else np.int64
        self.anchors, self.rows = anchors.astype(kind), rows.astype(kind)
        self.order, self.parent, self.edge = tree
        # Far above what rounding takes from a product of two square roots, or from a sum of few of them.
        self.norm = np.sqrt(np.square(rows.astype(np.float64)).sum(1)) * (1 + 1e-9)
        self.slack = 1e-6 + 1e-12 * top
        self.low, self.high = (np.zeros((len(anchors), len(rows))) for _ in range(2))

    def walk(self, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each anchor, parents first, with the rows that ``wanted(anchor, low, high)`` marks and their exact scores."""
        for a in self.order.tolist():
            p = self.parent[a]
            reach = self.edge[a] * self.norm + self.slack if p >= 0 else 0.0
            root = self.rows @ self.anchors[a] if p < 0 else None
            self.low[a], self.high[a] = (root - self.slack, root + self.slack) if p < 0 else (self.low[p] - reach, self.high[p] + reach)
            own = np.flatnonzero(wanted(a, self.low[a], self.high[a]))
            score = root[own] if p < 0 else self.rows[own] @ self.anchors[a]
            self.low[a, own], self.high[a, own] = score - self.slack, score + self.slack
            yield a, own, score.astype(np.int64)


class _Best:
    """The ``k`` best scores and ids of each place, ties by id."""

    def __init__(self, k: int):
        self.k = k
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, place: int, score: np.ndarray, ids: np.ndarray) -> None:
        if place in self.held:
            s, i = self.held[place]
            score, ids = np.concatenate((s, score)), np.concatenate((i, ids))
        if len(score) > 4 * self.k:
            # What is worse than the k-th best can't stay; ties at it are told apart below.
            least = np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, ids = score[score >= least], ids[score >= least]
        top = np.lexsort((ids, -score))[: self.k]
        self.held[place] = score[top], ids[top]

    def least(self, place: int) -> int:
        """What a score has to reach."""
        s = self.held.get(place, (np.zeros(0),))[0]
        return int(s[-1]) if len(s) == self.k else NONE

    def batch(self, block: int, names: np.ndarray, per: int) -> pa.RecordBatch:
        """All places' rows; ``per`` places belong to an anchor."""
        size = [len(s) for s, _ in self.held.values()]
        score, ids = (np.concatenate([x[c] for x in self.held.values()] or [np.zeros(0)]).astype(np.int64) for c in (0, 1))
        place = np.repeat(np.array(list(self.held), np.int64), np.array(size, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(place), block)), *map(pa.array, (place, names[place // per], ids, score))], ["block", "place", "anchor_id", "id", "score"])


def _search(pairs: DataFrame, k: int, seek, per: int = 1, extra: str | None = None) -> DataFrame:
    """``block, place, anchor_id, id, score, rank``: the ``k`` best of each place over all pairs of blocks.

    ``seek(pair, ids, labels, (anchors' ids, labels), best, extra)`` adds a pair's rows to ``best``.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best, own, tree = None, _Best(k), None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["a_block"] != at:
                    # Pairs of a block come behind each other; were they mixed, more rows would go on and none be lost.
                    if at is not None:
                        yield best.batch(at, own[0], per)
                    at, best = r["a_block"], _Best(k)
                    own = np.frombuffer(r["a_ids"], "<i8"), np.frombuffer(r["a_labels"], "<i8")
                    tree = np.frombuffer(r["a_order"], "<i8"), np.frombuffer(r["a_parent"], "<i8"), np.frombuffer(r["a_edge"], "<f8")
                ids, labels = np.frombuffer(r["r_ids"], "<i8"), np.frombuffer(r["r_labels"], "<i8")
                anchors, rows = (np.frombuffer(r[f"{x}_v"], "<i4").reshape(n, r[f"{x}_width"]) for x, n in (("a", len(own[0])), ("r", len(ids))))
                seek(_Pair(anchors, tree, rows), ids, labels, own, best, r[extra] if extra else None)
        if at is not None:
            yield best.batch(at, own[0], per)

    found = pairs.mapInArrow(find, "block long, place long, anchor_id long, id long, score long")
    rank = F.row_number().over(W.partitionBy("block", "place").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _positives(pair: _Pair, ids: np.ndarray, labels: np.ndarray, own: tuple, best: _Best, _) -> None:
    """Of each anchor, rows of its label and another id that reach its worst best so far."""
    names, kinds = own
    for a, at, score in pair.walk(lambda a, low, high: (labels == kinds[a]) & (ids != names[a]) & (high >= best.least(a))):
        if len(at):
            best.add(a, score, ids[at])


def _negatives(share: int, most: int):
    """Of each anchor's positive, rows of another label in its window: ``share * positive <= 100 * score <= 100 * positive``."""

    def seek(pair: _Pair, ids: np.ndarray, labels: np.ndarray, own: tuple, best: _Best, windows: list) -> None:
        _, kinds = own
        tops: dict[int, list[tuple[int, int]]] = {}
        for w in windows:
            if w["score"] >= 0:
                tops.setdefault(w["place"], []).append((w["rank"], w["score"]))

        def overlaps(a: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            out = np.zeros(len(ids), bool)
            for rank, top in tops.get(a, ()):
                floor = max(-(-share * top // 100), best.least(a * most + rank - 1))
                out |= (high >= floor) & (low <= top)
            return out & (labels != kinds[a])

        for a, at, score in pair.walk(overlaps):
            for rank, top in tops.get(a, ()) if len(at) else ():
                inside = (100 * score >= share * top) & (score <= top)
                if inside.any():
                    best.add(a * most + rank - 1, score[inside], ids[at[inside]])

    return seek


def hard_negatives(rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: str | Column = "label", positives: int = 5, negatives: int = 5, share: int = 80, scale: int = 256, lanes: int = LANES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of the rows that ``anchors`` marks.

    A component x is taken as floor(scale * x), a score is the product of two rows' components. An anchor's positives are
    the best rows of its label and another id; for each, the best rows of another label come whose scores lie between
    ``share`` hundredths of the positive's and the positive's. Higher scores come first, ties by smaller id. A positive of
    a negative score has no such rows.

    Rows with a null id, label or vector, or any null or non-finite component take no part; a vector that is shorter than
    another counts as filled up with zeros. Repeated rows each take part: a repeated anchor has its rows again, and a
    repeated row takes as many places. A component beyond MOST is an error. Other columns aren't read.
    """
    kind = F.col(label) if isinstance(label, str) else label
    names = [F.col(id_col).cast("long").alias("__id"), kind.cast("long").alias("__label"), F.col(vector_col).alias("__v"), F.coalesce(anchors, F.lit(False)).alias("__anchor")]
    live = rows.select(*names).where(F.col("__id").isNotNull() & F.col("__label").isNotNull() & whole(F.col("__v")))
    cols = ["__id", "__label", "__v"]
    r = stash(_packed(live.select(*cols), ROWS, scale, "r_"), dictionary=False)
    # Anchors of one label whose first components have like signs are near more often than others.
    near = F.concat_ws("", F.transform(F.slice("__v", 1, 16), lambda x: F.when(x < 0, "0").otherwise("1")))
    order = ["__label", "__near", "__id"]
    picked = live.where("__anchor").withColumn("__near", near).repartitionByRange(*order).sortWithinPartitions(*order)
    a = stash(_packed(picked.select(*cols), ANCHORS, scale, "a_", tree=True), dictionary=False)
    n = max(1, min(lanes, r.count()))
    r = r.withColumn("lane", F.pmod(F.xxhash64("r_block"), F.lit(n)).cast("int"))

    def pairs(blocks: DataFrame) -> DataFrame:
        # Merged, so that one block of anchors after another meets a lane's blocks of rows, which may spill.
        return blocks.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(r.hint("merge"), "lane").drop("lane")

    best = stash(_search(pairs(a), positives, _positives))
    windows = best.groupBy(F.col("block").alias("a_block")).agg(F.collect_list(F.struct("place", "rank", "score")).alias("windows"))
    found = _search(pairs(a.join(windows, "a_block")), negatives, _negatives(share, positives), positives, "windows")
    hit = found.select("block", F.expr(f"place div {positives}").alias("place"), F.expr(f"place % {positives} + 1").alias("p"), "anchor_id", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = hit.join(best.select("block", "place", F.col("rank").cast("long").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["block", "place", "p"])
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
