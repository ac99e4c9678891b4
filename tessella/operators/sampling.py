"""Splits, samples, quotas and plans; random choice is by hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.hashing import hash_order
from tessella.functions.ordering import number_by_hash, number_sorted, number_within


def split_sizes(n: int, ratios: tuple[float, float, float]) -> tuple[int, int, int]:
    """Groups for train, val and test: the first two are rounded half to even and test is the rest.

    With three groups or more and no ratio of 0, each split has one at least, taken from the larger of the other two.
    """
    if abs(sum(ratios) - 1) > 1e-6 or min(ratios) < 0:
        raise ValueError("ratios must be 0 or more and sum to 1")
    train, val = round(n * ratios[0]), round(n * ratios[1])
    over = max(0, train + val - n)
    val, train = max(0, val - over), train - max(0, over - val)
    sizes = [train, val, n - train - val]
    if n >= 3 and min(ratios) > 0:
        for k, (a, b) in enumerate(((2, 1), (0, 2), (0, 1))):
            if sizes[k] == 0:
                sizes[k] = 1
                sizes[a if sizes[a] > sizes[b] else b] -= 1
    return tuple(sizes)


def assign_splits(df: DataFrame, group: str, ratios: tuple[float, float, float], seed: int) -> DataFrame:
    """``group, split``: whole groups to train, val and test, in hash order, as many as ``split_sizes`` says."""
    groups = df.select(group).distinct()
    train, val, _ = split_sizes(groups.count(), ratios)
    placed = number_by_hash(groups, seed, group, "__p")
    return placed.select(group, F.when(F.col("__p") < train, "train").when(F.col("__p") < train + val, "val").otherwise("test").alias("split"))


def stratified_holdout(df: DataFrame, label: str, id_col: str, share: float, seed: int) -> DataFrame:
    """``id, label, split``: of each class of n > 1, max(1, floor(share * n)) rows are held out, the first by hash.

    A class of any size is counted by the hash's first digits; only rows are ordered whose digits the cut falls on.
    """
    own = df.select(id_col, label, hash_order(seed, id_col).alias("__h")).withColumn("__b", F.substring("__h", 1, 3))
    sizes = own.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__c"))
    order = W.partitionBy(label).orderBy("__b")
    before = F.coalesce(F.sum("__c").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    n = F.sum("__c").over(W.partitionBy(label))
    take = F.when(n > 1, F.greatest(F.lit(1), F.floor(n * share))).otherwise(0)
    cut = sizes.select(F.col(label).alias("__l"), "__b", (take - before).alias("__left"))
    rank = F.row_number().over(W.partitionBy(label, "__b").orderBy("__h", id_col))
    own = own.withColumn("__r", rank).withColumnRenamed("__b", "__d")
    both = own.join(cut, own[label].eqNullSafe(F.col("__l")) & (F.col("__d") == F.col("__b")))
    return both.select(id_col, label, F.when(F.col("__r") <= F.col("__left"), "val").otherwise("train").alias("split"))


def few_shot(df: DataFrame, label: str, id_col: str, k: int, tries: int) -> DataFrame:
    """``try, label, id``: k rows of each class for each try, ordered by a hash that the try seeds."""
    each = df.select(id_col, label, F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("try"))
    rank = F.row_number().over(W.partitionBy("try", label).orderBy(F.sha2(F.concat_ws(":", "try", id_col), 256), id_col))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("try", label, id_col)


def round_robin_sample(df: DataFrame, family: str, id_col: str, cap: int, seed: int) -> DataFrame:
    """``cap`` rows, one of each family in turn, families and members in hash order."""
    rank = F.row_number().over(W.partitionBy(family).orderBy(hash_order(seed, id_col), id_col))
    first = df.select(id_col, family, rank.alias("turn")).where(F.col("turn") <= cap)
    return first.orderBy("turn", hash_order(seed, family), family).limit(cap)


def epoch_plan(df: DataFrame, id_col: str, seed: int, epoch: int, world: int) -> DataFrame:
    """``id, position, rank``: an epoch's order and the worker of each position."""
    placed = number_by_hash(df.select(id_col), f"{seed}:{epoch}", id_col, "position")
    return placed.withColumn("rank", F.pmod("position", F.lit(world)))


def pick_one(df: DataFrame, key: str, child: str, seed: int) -> DataFrame:
    """One child of each key: that of the smallest hash."""
    h = hash_order(seed, key, child)
    return df.groupBy(key).agg(F.min_by(child, F.struct(h, F.col(child))).alias("picked"))


def allocate_quota(df: DataFrame, key: str, total: str, weights: dict[str, float]) -> DataFrame:
    """``key, name, quota``: largest remainders, ties by name; quotas of a key sum to its total."""
    all_weight = sum(weights.values())
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w / all_weight).alias("w")) for n, w in weights.items()])
    each = df.select(key, F.col(total).alias("total"), F.inline(rows))
    share = F.round(F.col("total") * F.col("w"), 9)
    each = each.withColumn("low", F.floor(share)).withColumn("rest", F.round(share - F.floor(share), 9))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("rest"), "name"))
    left = F.col("total") - F.sum("low").over(W.partitionBy(key))
    return each.select(key, "name", (F.col("low") + F.when(rank <= left, 1).otherwise(0)).cast("long").alias("quota"))


def multi_hot(df: DataFrame, key: str, code: str, n: int) -> DataFrame:
    """``key, code, hit`` of each of n codes: 1 where the key has it."""
    sets = df.groupBy(key).agg(F.collect_set(code).alias("have"))
    return sets.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains("have", i).cast("int"))).alias("code", "hit"))


def grouped_batches(df: DataFrame, source: str, id_col: str, size: int, most: int, seed: int) -> DataFrame:
    """``id, source, batch``: waves of at most ``most`` rows a source, cut into batches."""
    own = number_within(df.select(id_col, source), source, seed, id_col, "__n")
    waves = own.select(id_col, source, F.floor(F.col("__n") / most).alias("wave"), hash_order(seed, id_col).alias("__h"))
    placed = number_sorted(waves, ["wave", "__h", id_col], "__p")
    return placed.select(id_col, source, F.floor(F.col("__p") / size).alias("batch"))


def batches_over(batches: DataFrame, source: str, most: int) -> DataFrame:
    """``batch, source, n``: batches with more than ``most`` rows of one source."""
    return batches.groupBy("batch", source).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
