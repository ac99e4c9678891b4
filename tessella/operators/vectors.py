"""Embeddings: normalisation, exact neighbours, votes."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, log, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2_normalize(df: DataFrame, col: str, eps: float = 1e-12) -> DataFrame:
    norm = F.greatest(F.sqrt(dot(col, col)), F.lit(eps))
    return df.withColumn("__n", norm).withColumn(col, F.transform(col, lambda x: x.cast("double") / F.col("__n"))).drop("__n")


#: Rows of a block of test vectors, and of train vectors.
TEST, TRAIN = 1024, 4096


#: Lanes times groups at least, columns of a group of scores of which the best is looked at first, and scores at a time.
MEETINGS, COLUMNS, SLICE = 64, 32, 1 << 15


def _held(rows: DataFrame) -> str:
    """The numbers that hold the vectors ``v``: as wide as they came."""
    return "<f4" if rows.schema["v"].dataType == ArrayType(FloatType(), rows.schema["v"].dataType.containsNull) else "<f8"


def _blocks(rows: DataFrame, size: int, prefix: str, lanes: int) -> DataFrame:
    """``rows(id, v, label, by)`` packed in blocks of at most ``size``, each dealt to one of the lanes."""
    kind = _held(rows)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, []

        def block(count: int) -> pa.RecordBatch:
            nonlocal number, held
            table = pa.Table.from_batches(held)
            own, held = table.slice(0, count).combine_chunks(), table.slice(count).to_batches()
            v = own.column(1).chunk(0).flatten().to_numpy().astype(kind)
            ids, label, by = (own.column(c).to_numpy().astype(t).tobytes() for c, t in ((0, "<i8"), (2, "<i4"), (3, "<i4")))
            number += 1
            values = [pa.array([part << 32 | number], pa.int64()), pa.array([(part + number) % lanes], pa.int32()), *(pa.array([x], pa.binary()) for x in (ids, v.tobytes(), label, by))]
            return pa.RecordBatch.from_arrays(values, [prefix + n for n in ("block", "lane", "ids", "v", "label", "by")])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            while sum(b.num_rows for b in held) >= size:
                yield block(size)
        if left := sum(b.num_rows for b in held):
            yield block(left)

    return rows.mapInArrow(pack, f"{prefix}block long, {prefix}lane int, {prefix}ids binary, {prefix}v binary, {prefix}label binary, {prefix}by binary")


def _leading(m: np.ndarray, v: np.ndarray, k: int, least: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and scores of the products that may be among their row's k best at six places, those equal to the last included.

    The k-th best of the maxima of groups of columns bounds the k-th best from below, as does ``least``, the k-th of blocks before.
    Products of single precision with as much slack as they may be off pick the pairs, whose scores are of double precision.
    """
    with np.errstate(all="ignore"):
        s = m.astype("<f4") @ v.astype("<f4").T
        slack = (m.shape[1] + 4) * 2.0**-24 * np.linalg.norm(m, axis=1) * np.linalg.norm(v, axis=1).max()
        n = s.shape[1] // COLUMNS
        if n >= k:
            tops = s[:, : n * COLUMNS].reshape(len(s), COLUMNS, n).max(axis=1)
            low = np.partition(tops, n - k, axis=1)[:, n - k].astype(float) - slack
        elif s.shape[1] > k:
            low = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k].astype(float) - slack
        else:
            low = np.full(len(s), -np.inf)
        least = (low if least is None else np.fmax(low, least)) - slack - 2e-6
        least = np.nextafter(least.astype("<f4"), np.float32(-np.inf))
        row, col = np.divmod(np.flatnonzero(~(s < least[:, None])), s.shape[1])
        # In slices: of equal vectors all pairs come.
        score = [np.einsum("ij,ij->i", m[row[i : i + SLICE]], v[col[i : i + SLICE]]) for i in range(0, len(row), SLICE)]
        return row, col, np.round(np.concatenate([np.zeros(0), *score]), 6)


def _merged(rank: tuple[np.ndarray, ...] | None, more: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The k best of each row of flat tables of rows, scores, ids and labels, in their order; ties by id."""
    row, s, i, c = more if rank is None else (np.concatenate(x) for x in zip(rank, more, strict=True))
    order = np.lexsort((i, -s, row))
    row = row[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    order = order[kept]
    return row[kept], s[order], i[order], c[order]


def knn(test: DataFrame, train: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """``test_id, train_id, label, score, rank``: the k nearest by inner product, scores rounded to six places, ties by id.

    ``test(id, v)`` and ``train(id, v, label)``; with ``by``, a whole number of train rows, there are k for each of its
    values, and the column comes first. Null labels are -1.

    Both sides are packed in blocks of bounded size. Train blocks are dealt over lanes and test blocks over groups, about as many
    of each as the root of the number of shuffle partitions, and every group meets every lane: a task meets one pair of blocks
    after another, keeps the k best of the test block at hand over its lane's train rows, and a window picks the k of all lanes.
    Nothing goes through the driver. All pairs are compared, so that the work grows with the product of both sides.
    """
    spark = train.sparkSession
    lanes = ceil(sqrt(max(MEETINGS, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    key = F.col(by).cast("int") if by else F.lit(0)
    own = train.select(F.col("id").cast("long").alias("id"), "v", F.coalesce(F.col("label").cast("int"), F.lit(-1)).alias("label"), key.alias("by"))
    asked = test.select(F.col("id").cast("long").alias("id"), "v", F.lit(0).alias("label"), F.lit(0).alias("by"))
    every = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))
    right = _blocks(own, TRAIN, "r_", lanes).withColumnRenamed("r_lane", "lane").withColumn("group", every)
    left = _blocks(asked, TEST, "t_", lanes).drop("t_label", "t_by").withColumnRenamed("t_lane", "group").withColumn("lane", every)
    t_kind, r_kind = _held(asked), _held(own)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, m, held = None, None, None, {}

        def found() -> Iterator[pa.RecordBatch]:
            for value, (row, s, i, c) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), value, np.int32)), *(pa.array(x) for x in (ids[row], i, c, s))], ["by", "test_id", "train_id", "label", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["t_block"] != at:
                    # Pairs of a test block come behind each other; were they mixed, more rows would go on and none be lost.
                    yield from found()
                    at, held, ids = r["t_block"], {}, np.frombuffer(r["t_ids"], "<i8")
                    m = np.frombuffer(r["t_v"], t_kind).astype("<f8").reshape(len(ids), -1)
                names, labels, keys = np.frombuffer(r["r_ids"], "<i8"), np.frombuffer(r["r_label"], "<i4"), np.frombuffer(r["r_by"], "<i4")
                v = np.frombuffer(r["r_v"], r_kind).astype("<f8").reshape(len(names), -1)
                for value in np.unique(keys).tolist():
                    mine = np.flatnonzero(keys == value)
                    mine = mine[np.argsort(names[mine], kind="stable")]
                    rank, least = held.get(value), None
                    if rank is not None and len(rank[0]) == len(ids) * k:
                        least = rank[1].reshape(len(ids), k)[:, -1]
                    row, col, score = _leading(m, v[mine], k, least)
                    held[value] = _merged(rank, (row, score, names[mine][col], labels[mine][col]), k)
        yield from found()

    each = left.join(right.hint("merge"), ["group", "lane"]).drop("group", "lane").mapInArrow(near, "by int, test_id long, train_id long, label int, score double")
    rank = F.row_number().over(W.partitionBy("by", "test_id").orderBy(F.desc("score"), "train_id"))
    out = each.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.withColumnRenamed("by", by) if by else out.drop("by")


def knn_evaluation(test: DataFrame, train: DataFrame, ks: list[int], tries: str, temperature: float = 0.07, tops: tuple[int, ...] = (1, 5)) -> DataFrame:
    """``k, tries, top1_mean, top1_std, ...``: accuracy in hundredths of votes of the k nearest, over tries of train rows.

    ``test`` has ``id, v, label``, ``train`` also the number of its try; a row may be in several. A k beyond a try's train
    rows is their number, and counts once. Deviations are of the sample, null for one try.
    """
    size = train.groupBy(F.col(tries).cast("int").alias("try")).agg(F.count(F.lit(1)).alias("n"))
    want = size.select("try", F.explode(F.array_distinct(F.transform(F.array(*[F.lit(k) for k in sorted(set(ks))]), lambda k: F.least(k.cast("long"), F.col("n")).cast("int")))).alias("k"))
    nearest = knn(test, train.withColumn("try", F.col(tries).cast("int")), max(ks), "try")
    group = W.partitionBy("try", "test_id")
    weight = F.exp((F.col("score") - F.max("score").over(group)) / temperature)
    each = nearest.withColumn("w", weight).join(F.broadcast(want), "try").where("rank <= k").groupBy("try", "k", "test_id", "label").agg(F.sum("w").alias("w"))
    order = F.row_number().over(W.partitionBy("try", "k", "test_id").orderBy(F.desc(F.round("w", 6)), "label"))
    target = test.select(F.col("id").alias("test_id"), F.coalesce(F.col("label").cast("int"), F.lit(-1)).alias("target"))
    ranked = each.withColumn("place", order).join(target, "test_id")
    hits = ranked.groupBy("try", "k", "test_id").agg(*[F.max(((F.col("label") == F.col("target")) & (F.col("place") <= n)).cast("int")).alias(f"top{n}") for n in tops])
    per = hits.groupBy("try", "k").agg(*[(100 * F.avg(f"top{n}")).alias(f"top{n}") for n in tops])
    stats = [f(f"top{n}").alias(f"top{n}_{name}") for n in tops for name, f in (("mean", F.avg), ("std", F.stddev_samp))]
    out = per.groupBy("k").agg(F.count(F.lit(1)).alias("tries"), *stats)
    return out.select("k", "tries", *[F.round(f"top{n}_{name}", 6).alias(f"top{n}_{name}") for n in tops for name in ("mean", "std")])


def knn_vote(nearest: DataFrame, ks: list[int], temperature: float) -> DataFrame:
    """``test_id, k, label, vote``: a softmax over the most neighbours, of which each smaller k takes its prefix."""
    top = F.max("score").over(W.partitionBy("test_id"))
    weight = F.exp((F.col("score") - top) / temperature)
    share = nearest.withColumn("w", weight).withColumn("w", F.col("w") / F.sum("w").over(W.partitionBy("test_id")))
    each = share.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("rank <= k")
    return each.groupBy("test_id", "k", "label").agg(F.round(F.sum("w"), 6).alias("vote"))


MOST_ANCHORS = 10_000


def similarity_map(features: DataFrame, anchors: DataFrame) -> DataFrame:
    """``anchor_id, id, cosine`` of unit vectors to each of few anchors, which are broadcast; more than MOST_ANCHORS is an error."""
    a = anchors.select(F.col("id").alias("anchor_id"), F.col("v").alias("av"))
    if len(a.limit(MOST_ANCHORS + 1).select("anchor_id").collect()) > MOST_ANCHORS:
        raise ValueError(f"more than {MOST_ANCHORS} anchors: call with some at a time")
    held = a.groupBy().agg(F.collect_list(F.struct("anchor_id", "av")).alias("__a"))
    each = features.join(F.broadcast(held)).select("id", "v", F.inline("__a"))
    return each.select("anchor_id", "id", F.round(dot("v", "av"), 6).alias("cosine"))


def probe_input(df: DataFrame, blocks: list[str], patches: str | None = None) -> DataFrame:
    """``probe``: the class tokens of the given blocks behind each other, then the mean of the patch tokens (an array of arrays) if named."""
    parts = [F.transform(b, lambda x: x.cast("double")) for b in blocks]
    if patches:
        n = F.size(patches)
        size = F.size(F.get(F.col(patches), F.lit(0)))
        zero = F.array_repeat(F.lit(0.0), size)
        total = F.aggregate(patches, zero, lambda s, p: F.zip_with(s, p, lambda a, b: a + b.cast("double")))
        parts.append(F.transform(total, lambda x: x / n))
    return df.withColumn("probe", F.concat(*parts))


def topn_nms(sims: DataFrame, key: str, n: int, radius: int, row: str = "y", col: str = "x", score: str = "score", exclude: tuple[str, str] | None = None) -> DataFrame:
    """``key, place, row, col, score``: the best cells of a map, each at more than ``radius`` rows or columns from those before it; ties by row, then column.

    ``exclude`` names columns of a cell around which none is taken. A key's map is folded in one row.
    """
    far = lambda r1, c1, r2, c2: (F.abs(r1 - r2) > radius) | (F.abs(c1 - c2) > radius)
    live = sims.where(far(F.col(row), F.col(col), F.col(exclude[0]), F.col(exclude[1]))) if exclude else sims
    cell = F.struct((-F.col(score)).alias("s"), F.col(row).cast("int").alias("r"), F.col(col).cast("int").alias("c"))
    maps = live.groupBy(key).agg(F.array_sort(F.collect_list(cell)).alias("m"))
    none = F.filter("m", lambda x: F.lit(False))
    picked = F.aggregate("m", none, lambda got, x: F.when((F.size(got) < n) & F.forall(got, lambda g: far(g["r"], g["c"], x["r"], x["c"])), F.concat(got, F.array(x))).otherwise(got))
    each = maps.select(key, F.posexplode(picked).alias("p", "x"))
    return each.select(key, (F.col("p") + 1).alias("place"), F.col("x.r").alias("row"), F.col("x.c").alias("col"), (-F.col("x.s")).alias("score"))


def koleo(nearest: DataFrame, topk: int = 1, eps: float = 1e-8) -> DataFrame:
    """``spread``: minus the mean log of the distances to the ``topk`` nearest others, of ``knn`` of unit vectors among themselves."""
    others = nearest.where("test_id <> train_id")
    place = F.row_number().over(W.partitionBy("test_id").orderBy("rank"))
    d = F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0)))
    return others.withColumn("place", place).where(F.col("place") <= topk).agg(F.round(-F.avg(F.ln(d + eps)), 6).alias("spread"))


def gram_mse(patches: DataFrame, key: str, place: str, a: str, b: str, negatives: str = "keep") -> DataFrame:
    """``key, mse`` between the similarity matrices of two sets of unit vectors of each key.

    ``negatives``: ``keep`` them, set all to 0 (``drop``), or the second set's, and the first's where both are (``drop_second``).
    A key's vectors meet each other: its pairs are the size of the answer.
    """
    if negatives not in ("keep", "drop", "drop_second"):
        raise ValueError(f"unknown mode: {negatives}")
    rows = patches.select(key, F.col(place).alias("__i"), F.col(a).alias("__a"), F.col(b).alias("__b"))
    other = rows.select(key, F.col("__i").alias("__j"), F.col("__a").alias("__c"), F.col("__b").alias("__d"))
    both = rows.join(other, key)
    x, y = dot("__a", "__c"), dot("__b", "__d")
    both = both.select(key, x.alias("x"), y.alias("y"))
    p, q = F.col("x"), F.col("y")
    if negatives == "drop":
        p, q = F.greatest(p, F.lit(0.0)), F.greatest(q, F.lit(0.0))
    elif negatives == "drop_second":
        p, q = F.when((p < 0) & (q <= 0), 0.0).otherwise(p), F.greatest(q, F.lit(0.0))
    return both.groupBy(key).agg(F.round(F.avg((p - q) * (p - q)), 6).alias("mse"))


def sinkhorn(rows: DataFrame, id_col: str, scores: str, temperature: float, rounds: int = 3, where: str | None = None) -> DataFrame:
    """``id, shares``: soft assignment of rows to as many prototypes as a row has scores, each prototype of like total weight.

    ``where`` is a condition: other rows take no part. Each round adds the prototypes' weights up over all rows (as many
    numbers as prototypes pass the driver) and divides rows by them.
    """
    live = rows.where(where) if where else rows
    q = live.select(id_col, F.transform(scores, lambda s: F.exp(s.cast("double") / temperature)).alias("q")).checkpoint()
    first = q.select(F.size("q")).first()
    if first is None:
        return q.withColumnRenamed("q", "shares")
    k = first[0]
    for _ in range(rounds):
        sums = q.agg(*[F.sum(F.get("q", F.lit(i))).alias(f"s{i}") for i in range(k)]).first()
        weights = F.array(*[F.lit(float(v)) for v in sums])
        scaled = F.zip_with("q", weights, lambda x, w: x / w / k)
        q = q.select(id_col, scaled.alias("q"))
        total = F.aggregate("q", F.lit(0.0), lambda s, v: s + v)
        q = q.withColumn("__t", total).select(id_col, F.transform("q", lambda x: x / F.col("__t")).alias("q"))
    return q.withColumnRenamed("q", "shares")


#: Pairs of a piece of a batch, and of those that meet another piece at a time.
PIECE, ROWS = 4096, 256


def _matrix(lists: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, with zeros behind shorter ones, and their lengths: -1 for one that is null or holds a null."""
    lists = lists.combine_chunks()
    n = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    values, row = lists.flatten(), np.repeat(np.arange(len(n)), n)
    out = np.zeros((len(n), width))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = values.to_numpy(zero_copy_only=False)
    n[np.asarray(lists.is_null())] = -1
    gone = row[np.asarray(values.is_null())]
    out[gone], n[gone] = 0.0, -1
    return out, n


def clip_loss(pairs: DataFrame, batch: str, place: str, a: str, b: str, scale: float) -> DataFrame:
    """``batch, loss``: of each batch of pairs, the mean of both directions' log-sum-exp of scaled products, less the pair's own.

    A batch's rows meet each other, piece by piece, so that its products grow with its square and a task's memory doesn't. A
    product of vectors of unequal lengths or with a null counts in no sum.
    """
    rows = pairs.select(F.col(batch).alias("__k"), F.col(place).alias("__i"), F.transform(a, lambda x: x.cast("double")).alias("a"), F.transform(b, lambda x: x.cast("double")).alias("b"))
    sizes = rows.groupBy("__k").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("__n"))
    cut = rows.join(sizes, "__k").withColumn("__p", F.pmod(F.xxhash64("__i"), F.col("__n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("__n") - 1))
    left = cut.select("__k", F.col("__p").alias("__x"), every.alias("__y"), F.lit(True).alias("first"), "__i", F.col("a").alias("v"))
    right = cut.select("__k", every.alias("__x"), F.col("__p").alias("__y"), F.lit(False).alias("first"), "__i", F.col("b").alias("v"))
    types = dict(rows.dtypes)

    def meet(table: pa.Table) -> pa.Table:
        first = table.column("first").combine_chunks()
        x, y = table.filter(first), table.filter(pc.invert(first))
        width = pc.max(pc.list_value_length(table.column("v"))).as_py() or 0
        (p, m), (q, n) = (_matrix(t.column("v"), width) for t in (x, y))
        sums, seen = [np.zeros(len(p)), np.zeros(len(q))], [np.zeros(len(p), bool), np.zeros(len(q), bool)]
        with np.errstate(all="ignore"):
            for k in range(0, len(p), ROWS):
                part = slice(k, k + ROWS)
                real = (m[part, None] == n) & (n >= 0)
                # Scaled products of unit vectors are at most ``scale``: taking it off keeps exponentials in range.
                e = np.where(real, np.exp(scale * (p[part] @ q.T) - scale), 0.0)
                sums[0][part], seen[0][part] = e.sum(axis=1), real.any(axis=1)
                sums[1] += e.sum(axis=0)
                seen[1] |= real.any(axis=0)
        both = pa.concat_tables([x, y]).select(["__k", "first", "__i"])
        return both.append_column("sum", pa.array(np.concatenate(sums), mask=~np.concatenate(seen)))

    met = left.union(right).groupBy("__k", "__x", "__y").applyInArrow(meet, f"__k {types['__k']}, first boolean, __i {types['__i']}, sum double")
    each = met.groupBy("__k", "first", "__i").agg((F.ln(F.sum("sum")) + scale).alias("lse"))
    sums = each.groupBy("__k").agg(F.sum("lse").alias("lse"))
    itself = rows.select("__k", "__i", "a").join(rows.select("__k", "__i", "b").hint("merge"), ["__k", "__i"])
    own = itself.groupBy("__k").agg(F.sum(scale * dot("a", "b")).alias("own"), F.count(F.lit(1)).alias("n"))
    return own.join(sums, "__k").select(F.col("__k").alias(batch), F.round((F.col("lse") - 2 * F.col("own")) / F.col("n") / 2, 6).alias("loss"))


def align_results(rows: DataFrame, index: str, order: str, columns: list[str]) -> DataFrame:
    """One row an index, that of the largest ``order``: later results take the place of earlier ones."""
    return rows.groupBy(index).agg(F.max_by(F.struct(*columns), order).alias("__r")).select(index, *[F.col(f"__r.{c}").alias(c) for c in columns])


def soft_bins(rows: DataFrame, id_col: str, logits: str, low: float, high: float, bins: int) -> DataFrame:
    """``id, value``: the mean of bin centres between ``low`` and ``high / 8``, weighted by the positive part of the logits, times 8.

    Centres go from logarithmic to linear steps; each weight has 1e-8 added.
    """
    top = high / 8
    share = [1 - i / (bins - 1) for i in range(bins)]
    centres = [t * exp(log(low) + (log(top) - log(low)) * i / (bins - 1)) + (1 - t) * (low + (top - low) * i / (bins - 1)) for i, t in enumerate(share)]
    y = F.transform(logits, lambda v: F.greatest(v.cast("double"), F.lit(0.0)) + 1e-8)
    own = rows.select(id_col, y.alias("__y"))
    total = F.aggregate("__y", F.lit(0.0), lambda s, v: s + v)
    mean = F.aggregate(F.zip_with("__y", F.array(*[F.lit(max(c, 1e-12)) for c in centres]), lambda w, c: w * c), F.lit(0.0), lambda s, v: s + v) / F.greatest(total, F.lit(1e-12))
    return own.select(id_col, F.round(8 * F.greatest(mean, F.lit(1e-12)), 6).alias("value"))
