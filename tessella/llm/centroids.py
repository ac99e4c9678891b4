"""Centroid clustering of whole-numbered vectors with lookup tables of squared differences.

Vectors are written once as blocks of at most BLOCK rows: for each dimension the block's occurring values and, for each
row, the place of its value among them. In a round a task tabulates, for each dimension, the squared difference of every
occurring value to every centroid; distances are gathers from these tables, added up. Only sums by centroid and dimension
leave a task, so a round shuffles as many numbers as centroids have, a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stash

BLOCK = 4096
#: Whole numbers beyond it are an error: 64 squared differences must fit a long.
MOST = 1 << 27


def usable(vector: Column, size: int) -> Column:
    """Whether an array has exactly ``size`` components, none null or non-finite."""
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == size) & fits, F.lit(False))


def _blocks(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """``ids, values, ends, codes``: blocks of rows, with the occurring values of all dimensions behind each other."""
    small_batches(rows.sparkSession)
    kind = dict(rows.dtypes)["__id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        held: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            q = np.concatenate(held)
            values, codes = zip(*(np.unique(q[:, d], return_inverse=True) for d in range(size)), strict=True)
            ends = np.cumsum([len(v) for v in values]).astype("<i4").tobytes()
            names = pa.concat_arrays(ids)
            lists = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
            cols = [np.concatenate(values).astype("<i8").tobytes(), ends, np.array(codes).astype("<u2").tobytes()]
            return pa.RecordBatch.from_arrays([lists, *(pa.array([c], pa.binary()) for c in cols)], ["ids", "values", "ends", "codes"])

        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, size)
            q = np.floor(scale * flat)
            if batch.num_rows and np.abs(q).max() > MOST:
                raise ValueError(f"a component times {scale} is beyond {MOST}")
            at = 0
            while at < batch.num_rows:
                take = min(BLOCK - sum(map(len, held)), batch.num_rows - at)
                ids.append(batch.column(0).slice(at, take))
                held.append(q[at : at + take].astype(np.int64))
                at += take
                if sum(map(len, held)) == BLOCK:
                    yield block()
                    ids.clear()
                    held.clear()
        if held:
            yield block()

    return rows.mapInArrow(pack, f"ids array<{kind}>, values binary, ends binary, codes binary")


class _Block:
    """One block's values by dimension and its rows' codes."""

    def __init__(self, values: bytes, ends: bytes, codes: bytes, rows: int):
        ends_ = np.frombuffer(ends, "<i4")
        self.values = np.split(np.frombuffer(values, "<i8"), ends_[:-1])
        self.codes = np.frombuffer(codes, "<u2").reshape(len(ends_), rows)

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        """Squared distance of every row to every centroid, gathered from the tables of the dimensions."""
        out = np.zeros((self.codes.shape[1], len(centroids)), np.int64)
        for d, (values, codes) in enumerate(zip(self.values, self.codes, strict=True)):
            table = np.square(values[:, None] - centroids[None, :, d])
            out += table[codes]
        return out

    def sums(self, nearest: np.ndarray, k: int) -> np.ndarray:
        """By centroid and dimension, the sum of its rows' values: rows are counted by code, and counts weigh the values."""
        out = np.empty((k, len(self.values)), np.int64)
        for d, (values, codes) in enumerate(zip(self.values, self.codes, strict=True)):
            counts = np.bincount(nearest * len(values) + codes, minlength=k * len(values)).reshape(k, len(values))
            out[:, d] = counts @ values
        return out


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[pa.Array, _Block, np.ndarray, np.ndarray]]:
    """Each block's ids, itself, its rows' nearest centroid (the smaller number of equals) and distance."""
    for batch in batches:
        for r in range(batch.num_rows):
            ids = batch.column(0).slice(r, 1).flatten()
            block = _Block(*(batch.column(c)[r].as_py() for c in (1, 2, 3)), len(ids))
            distance = block.distances(centroids)
            nearest = distance.argmin(1)
            yield ids, block, nearest, distance[np.arange(len(nearest)), nearest]


def _totals(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """By centroid: rows, summed distance, then the sum of each component. As many numbers as centroids have reach the driver."""
    k, size = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((k, size + 2), np.int64)
        for _, block, nearest, distance in _assigned(batches, centroids):
            out[:, 0] += np.bincount(nearest, minlength=k)
            np.add.at(out[:, 1], nearest, distance)
            out[:, 2:] += block.sums(nearest, k)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(list(out), pa.list_(pa.int64()))], ["k", "m"])

    # Decimals, so that sums over all rows can't overflow.
    each = blocks.mapInArrow(add, "k int, m array<long>").select("k", F.posexplode("m").alias("i", "v"))
    out = np.zeros((k, size + 2), object)
    for r in each.groupBy("k", "i").agg(F.sum(F.col("v").cast("decimal(28,0)")).alias("v")).collect():
        out[r.k, r.i] = int(r.v)
    return out


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for each usable vector of ``size`` components.

    A component x is taken as floor(scale * x). Centroids start as the ``k`` vectors of the smallest sha256 of
    ``seed:id`` (ids that are null come last; of rows that repeat an id the smaller vector first) and are replaced, in each
    of the rounds, by the floor of their vectors' means; a centroid without vectors stays. Ties go to the smaller number.
    Fewer than ``k`` vectors give as many centroids; equal ones leave the later without vectors. Null vectors, other sizes
    and null or non-finite components are left out; repeated rows and null ids take part each; other columns aren't read.
    A component beyond MOST is an error. No usable vector gives no rows.
    """
    kept = vectors.where(usable(F.col(vector_col), size)).select(F.col(id_col).alias("__id"), F.col(vector_col).alias("__v"))
    kind = dict(kept.dtypes)["__id"]
    blocks = stash(_blocks(kept, size, scale), dictionary=False)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("__id").cast("string")), 256)
    first = kept.orderBy(order.asc_nulls_last(), "__v").limit(k).collect()
    centroids = np.array([[int(np.floor(scale * float(x))) for x in r["__v"]] for r in first], np.int64).reshape(-1, size)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        total = _totals(blocks, centroids)
        centroids = np.array([[s // m[0] for s in m[2:]] if m[0] else c.tolist() for m, c in zip(total, centroids, strict=True)], np.int64)
    inertia = _totals(blocks, centroids)[:, 1]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, nearest, distance in _assigned(batches, centroids):
            yield pa.RecordBatch.from_arrays([ids, pa.array(nearest.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    rows = blocks.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long")
    own = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("cluster"))
    return rows.select("*", own([int(x) for x in inertia]).cast("long").alias("cluster_inertia"), F.lit(int(sum(inertia))).cast("long").alias("inertia"), own(digest).alias("centroid_sha256"))
