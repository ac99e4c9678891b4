"""Connected components of links, and linking inside buckets without emitting all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import spread_join, stash

#: Members of a piece of a large bucket, rows of a group of cells on average, and members compared with a piece at a time.
CELL, ROWS, STRIP = 8192, 400_000, 64


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """``(id, comp)`` of every id in ``links(a, b)``; comp is the smallest id that links reach.

    Minimum labels pass along links, with pointer jumping, until nothing changes; each round is a written table.
    Nulls link nothing; a link of an id to itself makes a component of one. Raises if ``rounds`` don't suffice.
    """
    links = links.where("a is not null and b is not null")
    edges = stash(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = stash(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")))
    for _ in range(rounds):
        near = spread_join(edges.withColumnRenamed("b", "id"), labels, "id", F.col("a")).groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        new = stash(spread_join(near, labels, "id", F.col("m")).select("id", F.least("comp", "m").alias("comp"), F.col("comp").alias("was")))
        root = new.select(F.col("id").alias("comp"), F.col("comp").alias("root"))
        new = stash(spread_join(new, root, "comp", F.col("id")).select("id", F.least("comp", "root").alias("comp"), "was"))
        labels = new.select("id", "comp")
        if new.where("comp <> was").isEmpty():
            return labels
    raise RuntimeError(f"components need more than {rounds} rounds")


def bucket_components(members: DataFrame, traits: DataFrame, near: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame], size: Column, orders: int = 8, finer: Callable[[DataFrame], DataFrame] | None = None, coarse: tuple[Column, Callable[[str, str], Column]] | None = None) -> DataFrame:
    """``(id, comp)`` of the components that links make between ids that share a bucket; ids without a link are left out.

    ``members(bucket, id)`` and ``traits(id, trait)`` are written tables; ``near(x, y)`` is a cheap condition on two traits
    that some traits of every true link meet; ``verify`` keeps the true links of ``(a, b)``; ``size`` is a whole number of
    a trait that differs by one at most between linked ids.

    First each bucket's members are compared with one of them, the first in one of ``orders`` pseudo-random orders of all
    ids that the bucket picks, so that a family of copies meets a few common heads. A bucket whose members are then in one
    component is done: any further link would join what is joined. In the others, the members outside the largest component
    are compared with all members of other components. So no link between different components is lost, and a bucket of
    copies costs as many comparisons as it has members.

    Buckets where many unrelated ids meet would cost all their pairs; ``finer`` takes the ids of the mixed buckets, a written
    table ``(id)``, and returns other members ``(bucket, id)`` such that linked ones of these ids share a bucket there. The
    mixed ones of those buckets then take the place of the first. ``coarse`` is a short form of the trait and a condition on
    two of them that ``near`` ones meet; the last comparisons use it before ``near``, as they read many pairs.
    """
    brief, close = coarse or (F.col("trait"), near)
    order = F.xxhash64(F.pmod("bucket", F.lit(orders)), "id")
    heads = stash(members.groupBy("bucket").agg(F.min_by("id", order).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    shared = stash(spread_join(members, heads, "bucket", F.col("id")))
    pairs = stash(shared.where("id <> head").select(F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b")).distinct())
    comps = components(stash(verify(_near(pairs, traits, near))))
    at = stash(spread_join(shared, comps, "id", F.col("bucket"), "left").select("bucket", "id", "head", F.coalesce("comp", "id").alias("comp")))
    left = _mixed(at)
    if finer is not None:
        ids = stash(left.groupBy("id").agg(F.first("comp").alias("comp")))
        left = _mixed(stash(spread_join(finer(ids.select("id")), ids, "id", F.col("bucket"))))
    left = stash(left.join(traits.select("id", brief.alias("trait")), "id"))
    odd = left.where("comp <> main").select("bucket", F.col("id").alias("a"), F.col("trait").alias("x"), F.col("comp").alias("ca"), F.explode(F.array(size - 1, size, size + 1)).alias("size"))
    every = left.select("bucket", F.col("id").alias("b"), F.col("trait").alias("y"), F.col("comp").alias("cb"), size.alias("size"))
    rest = odd.join(every, ["bucket", "size"]).where((F.col("ca") != F.col("cb")) & close("x", "y"))
    rest = stash(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if coarse is not None:
        rest = stash(_near(rest, traits, near))
    return joined_components(comps, rest, verify)


def joined_components(comps: DataFrame, pairs: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``comps(id, comp)``, a written table, with the true ones of ``pairs(a, b)``, another, added."""
    if pairs.isEmpty():
        return comps
    more = stash(verify(pairs))
    if more.isEmpty():
        return comps
    known = stash(comps.union(more.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(comps, "id", "left_anti").select("id", F.col("id").alias("comp"))))
    ca, cb = (known.select(F.col("id").alias(k), F.col("comp").alias(f"c{k}")) for k in "ab")
    over = components(stash(spread_join(spread_join(more, ca, "a", F.col("b")), cb, "b", F.col("a")).select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
    return stash(spread_join(known, over.select(F.col("id").alias("comp"), F.col("comp").alias("top")), "comp", F.col("id"), "left").select("id", F.coalesce("top", "comp").alias("comp")))


def first_pairs(members: DataFrame, traits: list[str], near: Callable[[Callable[[str], Column], Callable[[str], Column]], Column], orders: int) -> tuple[DataFrame, DataFrame]:
    """Near pairs ``(a, b)`` of each bucket's first member with its others, and the members of buckets that have several.

    For buckets that many of the rows of ``members(bucket, id, traits...)``, a written table, share: the first ones (in one of
    ``orders`` pseudo-random orders that the bucket picks) are found by a partial aggregation, and rows are dealt over partitions.
    """
    of = lambda name: lambda c: F.col(f"{name}.{c}")
    first = F.struct(F.xxhash64(F.pmod("bucket", F.lit(orders)), "id").alias("o"), "id", *traits)
    heads = stash(members.groupBy("bucket").agg(F.min(first).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    shared = spread_join(members, heads, "bucket", F.col("id"))
    close = shared.where((F.col("id") != F.col("head.id")) & near(F.col, of("head")))
    return close.select(F.least("head.id", "id").alias("a"), F.greatest("head.id", "id").alias("b")), shared.select("bucket", "id", *traits)


def mixed_buckets(members: DataFrame, comps: DataFrame, traits: list[str], close: Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], np.ndarray], verify: Callable[[DataFrame], DataFrame], finer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``comps(id, comp)``, a written table, with the links added that large buckets of several components hold.

    ``members(bucket, id, traits...)``, another, has each pair of id and bucket once. The traits are whole numbers; the first is a
    length, and linked ids' lengths lie within a factor of 0.8. ``close(x, y)`` is a cheap condition on two sets of traits, arrays by
    name, that linked ids meet; ``verify`` keeps the true links of ``(a, b)``. Ids without a link may be left out.

    All close pairs of different components of a bucket are verified, also of the buckets ``(bucket, id)`` that ``finer`` gives for the
    ids of mixed ones. One of such two is outside the bucket's largest component:
    pieces of those members meet pieces of all members, of about CELL each, as cells that are dealt over tasks.
    """
    if members.isEmpty():
        return comps
    at = stash(spread_join(members, comps, "id", F.col("bucket"), "left").withColumn("comp", F.coalesce("comp", "id")))
    left = _mixed(at, traits)
    if left.isEmpty():
        return comps
    ids = stash(left.dropDuplicates(["id"]).select("id", "comp", *traits))
    more = _mixed(stash(spread_join(finer(ids.select("id")), ids, "id", F.col("bucket"))), traits)
    left = left.unionByName(more)
    pieces = lambda n: F.ceil(n / CELL).cast("int")
    odd = F.col("comp") != F.col("main")
    sizes = stash(left.groupBy("bucket").agg(pieces(F.count_if(odd)).alias("px"), pieces(F.count(F.lit(1))).alias("py")))
    left = stash(spread_join(left, sizes, "bucket", F.col("id")).withColumn("odd", odd))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    xs = left.where("odd").select("bucket", own("px").alias("i"), every("py").alias("j"), F.lit(True).alias("first"), "odd", "id", "comp", *traits)
    ys = left.select("bucket", every("px").alias("i"), own("py").alias("j"), F.lit(False).alias("first"), "odd", "id", "comp", *traits)
    total = left.agg(F.sum(F.col("px") + F.when(F.col("odd"), F.col("py")).otherwise(0))).first()[0]
    parts = max(8, total // ROWS)
    cells = xs.unionByName(ys).select(F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(parts)).alias("part"), F.xxhash64("bucket", "i", "j").alias("cell"), "first", "odd", "id", "comp", *traits)

    def meet(table: pa.Table) -> pa.Table:
        rows = {n: table.column(n).to_numpy() for n in table.column_names if n != "part"}
        order = np.lexsort((rows[traits[0]], ~rows["first"], rows["cell"]))
        rows = {n: v[order] for n, v in rows.items()}
        start = np.flatnonzero(np.append(True, rows["cell"][1:] != rows["cell"][:-1]))
        found = [np.zeros((0, 2), np.int64)]
        for i, end in zip(start.tolist(), np.append(start[1:], len(order)).tolist(), strict=True):
            middle = i + int(rows["first"][i:end].sum())
            length = rows[traits[0]][middle:end]
            for k in range(i, middle, STRIP):
                x = {n: v[k : min(k + STRIP, middle), None] for n, v in rows.items()}
                a, b = x[traits[0]][0, 0], x[traits[0]][-1, 0]
                lo, hi = middle + np.searchsorted(length, a * 0.8 - 1), middle + np.searchsorted(length, b / 0.8 + 1, "right")
                y = {n: v[None, lo:hi] for n, v in rows.items()}
                # Two outside the largest component meet twice, of which one is enough.
                hit = close(x, y) & (x["comp"] != y["comp"]) & (~y["odd"] | (x["id"] < y["id"]))
                p, q = np.nonzero(hit)
                found.append(np.stack((x["id"][p, 0], y["id"][0, q]), axis=1))
        pairs = np.sort(np.concatenate(found), axis=1)
        return pa.table([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], ["a", "b"])

    rest = stash(cells.groupBy("part").applyInArrow(meet, "a long, b long").distinct())
    return joined_components(comps, rest, verify)


def _mixed(at: DataFrame, more: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The rows of buckets with several components, and each bucket's largest one as ``main``; ``at(bucket, id, comp, more...)`` is written."""
    sizes = at.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    return stash(spread_join(at.select("bucket", "id", "comp", *more), stash(mixed.select("bucket", "main")), "bucket", F.col("id")))


def _near(pairs: DataFrame, traits: DataFrame, near: Callable[[str, str], Column]) -> DataFrame:
    """The ``pairs(a, b)`` of which some traits are near."""
    x, y = (traits.select(F.col("id").alias(k), F.col("trait").alias(t)) for k, t in (("a", "x"), ("b", "y")))
    found = spread_join(pairs, x, "a", F.col("b"), small=0).join(y, "b")
    return stash(found.where(near("x", "y")).select("a", "b").distinct())
