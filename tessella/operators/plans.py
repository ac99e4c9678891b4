"""Splits of linked scenes, and plans of what is read when: epochs, shards, mixes, budgets, masks, pairs."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.hashing import derive_seed, hash_order
from tessella.functions.ordering import number_by_hash, number_sorted, number_within, running_sums

from .identity import split_units

UNIT_KEYS = ["group_id", "source_sha256", "family_id", "design_id"]


def unit_links(scenes: DataFrame, keys: list[str] = UNIT_KEYS[1:], group: str = "group_id") -> DataFrame:
    """``key, value, groups``: values of a key that more than one group has, and so force them into one split."""
    each = scenes.select(group, F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys]))).where("value is not null")
    return each.groupBy("key", "value").agg(F.count_distinct(group).alias("groups")).where("groups > 1")


def split_unit_records(scenes: DataFrame, units: DataFrame, id_col: str = "scene_id") -> DataFrame:
    """Per unit: its scenes and how many groups, families and designs they have."""
    both = scenes.join(units, id_col)
    return both.groupBy("unit_id").agg(F.count(F.lit(1)).alias("scenes"), *[F.count_distinct(k).alias(f"n_{k}") for k in ("group_id", "family_id", "design_id")])


def assign_scene_splits(scenes: DataFrame, seed: int, share: float = 0.2, keys: list[str] = UNIT_KEYS, id_col: str = "scene_id") -> DataFrame:
    """``id, unit_id, split, policy``: whole units go to val, the first ones by hash; raises if none is left to train.

    One unit trains alone; of two to four one is held out; else ``max(1, round(n * share))``.
    """
    units = split_units(scenes, keys, id_col).checkpoint()
    each = units.select("unit_id").distinct()
    n = each.count()
    policy = "intra_scene_spatial_only" if n == 1 else "leave_one_group_out" if n <= 4 else "group_holdout_fraction"
    held = 0 if n == 1 else 1 if n <= 4 else max(1, round(n * share))
    if n > 1 and held >= n:
        raise ValueError(f"no unit of {n} is left to train")
    placed = number_by_hash(each, seed, "unit_id", "__place")
    return units.join(placed, "unit_id").select(id_col, "unit_id", F.when(F.col("__place") < held, "val").otherwise("train").alias("split"), F.lit(policy).alias("policy"))


def split_records(df: DataFrame, splits: DataFrame, key: str, order: str) -> DataFrame:
    """``df`` with its key's split, and each row's place in its split by ``order``."""
    place = F.row_number().over(W.partitionBy("split", key).orderBy(order))
    starts = df.join(splits, key).groupBy("split", key).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("split").orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("split", key, before.alias("__start"))
    return df.join(splits, key).withColumn("__row", place).join(starts, ["split", key]).withColumn("place", F.col("__start") + F.col("__row")).drop("__start", "__row")


def splits_summary(records: DataFrame, key: str, id_col: str) -> DataFrame:
    """Per split: rows, keys, and the first and last id."""
    return records.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id"))


def split_manifest(df: DataFrame, id_col: str, seed: int, ratios: tuple[float, float, float]) -> DataFrame:
    """``id, split, place`` of a permutation by hash: train and val are rounded shares (half to even), test is the rest."""
    if abs(sum(ratios) - 1) > 1e-6:
        raise ValueError("ratios must sum to 1")
    n = df.count()
    train = min(n, round(n * ratios[0]))
    val = min(round(n * ratios[1]), n - train)
    placed = number_by_hash(df.select(id_col), seed, id_col, "place")
    return placed.select(id_col, F.when(F.col("place") < train, "train").when(F.col("place") < train + val, "val").otherwise("test").alias("split"), "place")


def select_split(df: DataFrame, manifest: DataFrame, id_col: str, split: str) -> DataFrame:
    """The rows of one split; an unknown name is an error."""
    if split not in ("train", "val", "test"):
        raise KeyError(f"unknown split: {split}")
    return df.join(manifest.where(F.col("split") == split).select(id_col), id_col, "left_semi")


def class_share(df: DataFrame, label: str, id_col: str, share: float, seed: object) -> DataFrame:
    """``label, id``: of each class's n rows the first max(1, floor(share * n)) by hash."""
    own = df.select(label, id_col, hash_order(seed, id_col).alias("__h"))
    n = own.groupBy(label).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * share)).alias("__take"))
    # A class of any size: count it by the hash's first digits, and order only the digits on which the cut falls.
    bucket = F.substring("__h", 1, 3)
    sizes = own.groupBy(label, bucket.alias("__b")).agg(F.count(F.lit(1)).alias("__c"))
    before = F.coalesce(F.sum("__c").over(W.partitionBy(label).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = sizes.withColumn("__before", before).join(n, label).select(label, "__b", (F.col("__take") - F.col("__before")).alias("__left"))
    rank = F.row_number().over(W.partitionBy(label, "__b").orderBy("__h", id_col))
    return own.withColumn("__b", bucket).withColumn("__r", rank).join(cut, [label, "__b"]).where(F.col("__r") <= F.col("__left")).select(label, id_col)


def multilabel_few_shot(rows: DataFrame, id_col: str, label: str, share: float, seed: int) -> DataFrame:
    """``id`` of rows with several labels, ``rows(id, label)``: a share of each label's rows; the share is then lowered by how many labels too many that selects."""
    total = rows.count()
    wanted = int(total * share)
    first = class_share(rows, label, id_col, share, seed).select(id_col).distinct()
    held = rows.join(first, id_col, "left_semi").count()
    again = share / (held / wanted) if held and wanted else share
    return class_share(rows, label, id_col, again, seed).select(id_col).distinct()


def preview_sample(df: DataFrame, strategy: str, id_col: str, n: int, seed: int) -> DataFrame:
    """``n`` rows, one of each strategy in turn, strategies by name and their rows by hash: ``strategy, id, turn``."""
    rank = F.row_number().over(W.partitionBy(strategy).orderBy(hash_order(seed, id_col), id_col))
    first = df.select(strategy, id_col, rank.alias("turn")).where(F.col("turn") <= n)
    return first.orderBy("turn", strategy).limit(n)


def eval_list(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """``id, split, full_eval``: the first ``n`` ids are val and evaluated whole; with ``n`` = 0 all train and all are."""
    ids = df.select(id_col).distinct()
    first = ids.orderBy(id_col).limit(n).withColumn("__val", F.lit(True)) if n else None
    if first is None:
        return ids.select(id_col, F.lit("train").alias("split"), F.lit(True).alias("full_eval"))
    held = F.coalesce("__val", F.lit(False))
    return ids.join(first, id_col, "left").select(id_col, F.when(held, "val").otherwise("train").alias("split"), held.alias("full_eval"))


def tiled_plan(df: DataFrame, id_col: str, size: int, seed: int, epoch: int, world: int) -> DataFrame:
    """``position, id, copy, rank``: ids repeated as often as ``size`` asks for, in hash order, cut at ``size``; a worker takes every world-th position."""
    n = df.count()
    copies = ceil(size / n) if n else 0
    each = df.select(id_col, F.explode(F.sequence(F.lit(0), F.lit(max(copies - 1, 0)))).alias("copy"))
    each = each.withColumn("__key", F.concat_ws("#", F.col(id_col).cast("string"), "copy"))
    placed = number_by_hash(each, f"{seed}:{epoch}", "__key", "position").where(F.col("position") < size)
    return placed.select("position", id_col, "copy", F.pmod("position", F.lit(world)).alias("rank"))


def sharded_plan(df: DataFrame, id_col: str, seed: int, world: int, start: int, horizon: int) -> DataFrame:
    """``rank, step, round, id`` of steps ``start`` to ``start + horizon - 1``: an endless order of permutations, of which only the needed ones are made.

    Each round permutes all ids by a hash of seed and round; a worker takes every world-th place, so a round gives rank r
    ``ceil((n - r) / world)`` steps.
    """
    n = df.count()
    per = [len(range(r, n, world)) for r in range(world)]
    if not all(per):
        raise ValueError("more workers than rows")
    rounds = range(min(start // p for p in per), max((start + horizon - 1) // p for p in per) + 1)
    parts = None
    for k in rounds:
        one = number_by_hash(df.select(id_col), f"{seed}:{k}", id_col, "__p").select(id_col, F.lit(k).alias("round"), "__p")
        parts = one if parts is None else parts.union(one)
    rank = F.pmod("__p", F.lit(world)).cast("int")
    size = F.element_at(F.array(*[F.lit(p) for p in per]), rank + 1)
    out = parts.select(rank.alias("rank"), (F.col("round") * size + F.floor(F.col("__p") / world)).alias("step"), "round", id_col)
    return out.where((F.col("step") >= start) & (F.col("step") < start + horizon))


def pad_shards(df: DataFrame, order: str, world: int) -> DataFrame:
    """``place, index, id, rank``: the table filled up from its beginning to a multiple of ``world``; filled places have index -1."""
    n = df.count()
    more = -n % world
    placed = number_sorted(df.select(order), [order], "place").select("place", F.col("place").alias("index"), F.col(order))
    again = placed.where(F.col("place") < more).select((F.col("place") + n).alias("place"), F.lit(-1).cast("long").alias("index"), F.col(order))
    return placed.union(again).withColumn("rank", F.pmod("place", F.lit(world)))


def drop_padding(df: DataFrame) -> DataFrame:
    """Without the rows that only fill shards up."""
    return df.where("index >= 0")


def mix_sources(df: DataFrame, source: str, id_col: str, ratios: dict[str, float], size: int, batches: int, seed: int) -> DataFrame:
    """``batch, source, id, slot``: each batch draws a source by the ratios and takes its next ``size`` rows in hash order; a source without a whole batch ends the plan.

    Draws are a hash of the batch's number, so they don't depend on partitions; the plan has ``batches`` batches at most.
    """
    spark = df.sparkSession
    draw = derive_seed(seed, "batch", modulus=1_000_000) / F.lit(1_000_000.0)
    total, low, pick = sum(ratios.values()), 0.0, F.lit(None).cast("string")
    names = sorted(ratios)
    for name in names:
        high = low + ratios[name] / total
        pick = F.when((draw >= low) & (draw < high), F.lit(name)).otherwise(pick)
        low = high
    plan = spark.range(batches).select(F.col("id").alias("batch")).withColumn("source", F.coalesce(pick, F.lit(names[-1])))
    plan = plan.withColumn("nth", F.row_number().over(W.partitionBy("source").orderBy("batch")) - 1)
    rows = df.where(F.col(source).isin(names)).select(F.col(source).alias("source"), id_col)
    rows = number_within(rows, "source", seed, id_col, "__p").select("source", id_col, F.floor(F.col("__p") / size).alias("nth"), (F.col("__p") % size).alias("slot"))
    whole = rows.groupBy("source").agg(F.floor(F.count(F.lit(1)) / size).alias("has"))
    ends = plan.join(F.broadcast(whole), "source", "left").where(F.col("nth") >= F.coalesce("has", F.lit(0))).agg(F.coalesce(F.min("batch"), F.lit(batches)).alias("__end"))
    live = plan.crossJoin(F.broadcast(ends)).where(F.col("batch") < F.col("__end")).drop("__end")
    return live.join(rows, ["source", "nth"]).select("batch", "source", id_col, "slot")


def ratio_monitor(plan: DataFrame, every: int) -> DataFrame:
    """``batch, source, share``: the share of batches of each source so far, at every ``every``-th batch."""
    drawn = plan.select("batch", "source").distinct()
    marks = drawn.where((F.col("batch") + 1) % every == 0).select(F.col("batch").alias("mark"))
    # Counts per stretch first, so that the running sums are over stretches and not over batches.
    stretch = drawn.groupBy(F.floor(F.col("batch") / every).alias("s"), "source").agg(F.count(F.lit(1)).alias("n"))
    names = drawn.select("source").distinct()
    grid = marks.select("mark", F.floor(F.col("mark") / every).alias("s")).crossJoin(names).join(stretch, ["s", "source"], "left")
    so_far = F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy("source").orderBy("s"))
    return grid.select(F.col("mark").alias("batch"), "source", F.round(so_far / (F.col("mark") + 1), 6).alias("share"))


def scale_budgets(df: DataFrame, id_col: str, raw: Column, target: int, least: int, most: int) -> DataFrame:
    """``id, budget``: raw budgets scaled to ``target`` in all, at least ``least``; what rounding leaves over or short is taken from the largest or given to the smallest, one by one.

    The repair is found by counting: budgets of one size are moved together, as taking ones in turn would.
    """
    rows = df.select(F.col(id_col), raw.cast("long").alias("raw"))
    n, total = rows.agg(F.count(F.lit(1)), F.sum("raw")).first()
    goal = max(n, target)
    cap = max(most, goal)
    scaled = F.least(F.greatest(F.lit(least), F.bround(F.col("raw") * F.lit(float(goal)) / F.lit(float(total or 1)), 0)), F.lit(cap)).cast("long")
    rows = rows.select(id_col, scaled.alias("b")).checkpoint()
    found = _level(rows, goal, least, cap)
    if found is None:
        return rows.select(id_col, F.col("b").alias("budget"))
    level, extra, step = found
    return _moved(rows, id_col, F.col("b") >= level if step < 0 else F.col("b") <= level, level, extra, step)


def _level(rows: DataFrame, goal: int, least: int, cap: int) -> tuple[int, int, int] | None:
    """The level that budgets ``b`` beyond it take so that they add up to ``goal``, how many go one step on, and the step; None if they do.

    What lies beyond a budget follows from running sums over the distinct ones; only the one to start from is read.
    """
    counts = rows.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    at = running_sums(counts.withColumn("s", F.col("b") * F.col("n")), "b", ["n", "s"])
    whole = counts.agg(F.sum("n").alias("n"), F.sum(F.col("b") * F.col("n")).alias("s")).first()
    if not whole.n or whole.s == goal:
        return None
    drift = abs(whole.s - goal)
    if whole.s > goal:
        beyond, over = whole.n - F.col("n_before"), (whole.s - F.col("s_before")) - F.col("b") * (whole.n - F.col("n_before"))
        b, k, gone = at.where(over <= drift).agg(F.min(F.struct("b", beyond.alias("k"), over.alias("o"))).alias("x")).select("x.b", "x.k", "x.o").first()
        level, extra = b - (drift - gone) // k, (drift - gone) % k
        return (level, extra, -1) if level > least or level == least and not extra else (least, 0, -1)
    n, s = F.col("n_before") + F.col("n"), F.col("s_before") + F.col("s")
    b, k, gone = at.where(F.col("b") * n - s <= drift).agg(F.max(F.struct("b", n.alias("k"), (F.col("b") * n - s).alias("o"))).alias("x")).select("x.b", "x.k", "x.o").first()
    level, extra = b + (drift - gone) // k, (drift - gone) % k
    return (level, extra, 1) if level < cap or level == cap and not extra else (cap, 0, 1)


def _moved(rows: DataFrame, id_col: str, some: Column, level: int, extra: int, step: int) -> DataFrame:
    """The budgets of ``some`` set to ``level``, the first ``extra`` of them by id one step on."""
    if not extra:
        return rows.select(id_col, F.when(some, F.lit(level)).otherwise(F.col("b")).cast("long").alias("budget"))
    numbered = number_sorted(rows.where(some), [id_col], "__n").select(id_col, F.when(F.col("__n") < extra, level + step).otherwise(level).cast("long").alias("budget"))
    return rows.where(~some).select(id_col, F.col("b").alias("budget")).union(numbered)



def rare_class_order(df: DataFrame, split: str, code: str, codes: list[str]) -> DataFrame:
    """``class, n, place``: the named classes from rare to frequent, by the rows of the train split alone; ties by the given order."""
    counts = df.where(F.col(split) == "train").groupBy(F.col(code).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    named = df.sparkSession.createDataFrame(list(enumerate(codes)), "k int, class string")
    out = named.join(counts, "class", "left").select("class", "k", F.coalesce("n", F.lit(0)).alias("n"))
    return out.select("class", "n", F.row_number().over(W.orderBy("n", "k")).alias("place"))


def expand_variants(df: DataFrame, id_col: str, recipes: list[tuple[str, str, bool]], seed: int) -> DataFrame:
    """``id, variant, difficulty, supervised, seed``: each row with each recipe (name, difficulty, whether targets still hold) and a seed of its own."""
    table = F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(d).alias("difficulty"), F.lit(s).alias("supervised")) for n, d, s in recipes])
    each = df.select(id_col, F.inline(table))
    return each.withColumn("seed", derive_seed(seed, id_col, "variant"))


def mask_plan(df: DataFrame, id_col: str, tokens: int, low: float, high: float, share: float, seed: int) -> DataFrame:
    """``id, masked, cells, weight``: the first ``int(n * share)`` rows by hash get linearly growing mask sizes, the rest none.

    A row's masked cells are the first of its cells by hash; ``weight`` is 1 / max(cells, 1).
    """
    n = df.count()
    some = int(n * share)
    placed = number_by_hash(df.select(id_col), seed, id_col, "__p")
    ratio = F.lit(low) + (F.lit(high) - F.lit(low)) * (F.col("__p") + 1) / F.lit(max(some, 1))
    size = F.when(F.col("__p") < some, F.floor(tokens * ratio + 1e-9)).otherwise(0).cast("int")
    each = placed.select(id_col, size.alias("masked"))
    spots = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(tokens - 1)), lambda c: F.struct(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), c.cast("string")), 256).alias("h"), c.alias("c"))))
    taken = F.array_sort(F.transform(F.slice(spots, F.lit(1), F.col("masked")), lambda s: s["c"]))
    return each.select(id_col, "masked", F.when(F.col("masked") > 0, taken).otherwise(F.array().cast("array<int>")).alias("cells"), F.round(1 / F.greatest("masked", F.lit(1)), 6).alias("weight"))


def affinity_pairs(cells: DataFrame, offsets: tuple[int, ...], most: int, seed: int) -> DataFrame:
    """``image_id, y, x, dy, dx, same``: pairs of cells at these offsets right and down, per image at most half of ``most`` that agree and half that differ, by hash.

    Cells of code below 0 are in no pair. Where one kind has fewer than half, the other isn't raised.
    """
    row, col = W.partitionBy("image_id", "y").orderBy("x"), W.partitionBy("image_id", "x").orderBy("y")
    code = F.when(F.col("code") >= 0, F.col("code"))
    live = cells.select("image_id", "y", "x", code.alias("code"))
    other = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lead("code", d).over(row if dx else col).alias("q")) for d in offsets for dy, dx in ((0, d), (d, 0))])
    each = live.withColumn("__o", other).select("image_id", "y", "x", "code", F.inline("__o")).where("code is not null and q is not null").select("image_id", "y", "x", "dy", "dx", (F.col("code") == F.col("q")).alias("same"))
    rank = F.row_number().over(W.partitionBy("image_id", "same").orderBy(hash_order(seed, "image_id", "y", "x", "dy", "dx")))
    return each.withColumn("__r", rank).where(F.col("__r") <= most // 2).drop("__r")


def pad_lists(df: DataFrame, batch: str, id_col: str, values: str, fill: object) -> DataFrame:
    """``batch, id, padded, mask``: lists filled up to the longest of their batch; 1 where the value is the row's own."""
    longest = df.groupBy(batch).agg(F.max(F.size(values)).alias("__m"))
    both = df.join(longest, batch)
    n, short = F.size(values), F.col("__m") - F.size(values)
    return both.select(batch, id_col, F.concat(values, F.array_repeat(F.lit(fill), short)).alias("padded"), F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), short)).alias("mask"))
