"""Pairing, validation and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_by_stem(left: DataFrame, right: DataFrame, stem: str) -> DataFrame:
    """``stem, status``: pair, missing_left, missing_right, or duplicate where a side has the stem more than once."""
    a = left.groupBy(stem).agg(F.count(F.lit(1)).alias("na"))
    b = right.groupBy(stem).agg(F.count(F.lit(1)).alias("nb"))
    na, nb = F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))
    return a.join(b, stem, "full_outer").select(stem, F.when((na > 1) | (nb > 1), "duplicate").when(na == 0, "missing_left").when(nb == 0, "missing_right").otherwise("pair").alias("status"))


def pair_first_wins(left: DataFrame, right: DataFrame, stem: str, path: str) -> DataFrame:
    """Case-insensitive pairs; the first path of a stem wins; ``extra`` counts the others of both sides."""
    one = lambda df, p: df.groupBy(F.lower(stem).alias("stem")).agg(F.min(path).alias(f"{p}_path"), F.count(F.lit(1)).alias(f"{p}_n"))
    n = F.greatest(F.coalesce("left_n", F.lit(0)) - 1, F.lit(0)) + F.greatest(F.coalesce("right_n", F.lit(0)) - 1, F.lit(0))
    return one(left, "left").join(one(right, "right"), "stem", "full_outer").select("stem", "left_path", "right_path", n.alias("extra"))


def check_allowed_values(cells: DataFrame, image: str, code: str, allowed: list[int]) -> DataFrame:
    """Per image: cells, unexpected ones and their share, and whether there are none."""
    bad = ~F.col(code).isin(allowed)
    return cells.groupBy(image).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("unexpected")).withColumn("share", F.round(F.col("unexpected") / F.col("n"), 6)).withColumn("ok", F.col("unexpected") == 0)


def readiness(statuses: DataFrame, status: str = "status") -> DataFrame:
    return statuses.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def audit_manifest(tiles: DataFrame, scenes: DataFrame, key: str, tile: list[str], expected: int) -> DataFrame:
    """Findings ``kind, severity, n``: unknown keys, duplicate ids, keys that lack some of the expected parts."""
    unknown = tiles.join(scenes.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unknown_key").alias("kind"), F.lit("error").alias("severity"), "n")
    dup = tiles.groupBy(*tile).agg(F.count(F.lit(1)).alias("c")).where("c > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate_id"), F.lit("error"), "n")
    part = tile[-1]
    lack = tiles.groupBy(key).agg(F.count_distinct(part).alias("c")).where(F.col("c") < expected).agg(F.count(F.lit(1)).alias("n")).select(F.lit("missing_part"), F.lit("warning"), "n")
    return unknown.union(dup).union(lack)


def split_leakage(df: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """Values of any key that lie in more than one split."""
    each = df.select(split, F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])))
    return each.where("value is not null").groupBy("key", "value").agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def finite_guard(df: DataFrame, cols: list[str]) -> DataFrame:
    """Nulls, NaNs and infinities of each column."""
    each = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in cols])))
    v = F.col("v")
    return each.groupBy("col").agg(F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("nulls"), F.count_if(F.isnan(v)).alias("nans"), F.count_if(F.abs(v) == float("inf")).alias("infs"))


def preflight_cardinality(df: DataFrame, key: str, limits: tuple[int, ...]) -> DataFrame:
    """How many keys have more rows than each limit."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("keys"), F.max("n").alias("most"), *[F.count_if(F.col("n") > m).alias(f"over_{m}") for m in limits])


def dominance(df: DataFrame, key: str, size: str, factor: float = 10.0) -> DataFrame:
    """Keys whose largest size is more than ``factor`` times the second one."""
    sizes = df.where(F.col(size).isNotNull()).groupBy(key, size).agg(F.count(F.lit(1)).alias("__n"))
    # Partial maxima only: a key of any number of rows keeps two sizes a task.
    most = sizes.groupBy(key).agg(F.max(F.struct(F.col(size).alias("v"), F.col("__n").alias("n"))).alias("__top"))
    most = most.select(F.col(key).alias("__key"), "__top")
    below = sizes.join(most, F.col(key).eqNullSafe(F.col("__key"))).where(F.col(size) < F.col("__top.v")).groupBy(F.col(key).alias("__own")).agg(F.max(size).alias("__below"))
    top = most.join(below, F.col("__key").eqNullSafe(F.col("__own")), "left")
    top = top.select(F.col("__key").alias(key), F.col("__top.v").alias("first"), F.when(F.col("__top.n") > 1, F.col("__top.v")).otherwise(F.col("__below")).alias("second"))
    return top.where("second is not null").select(key, "first", "second", (F.col("first") > factor * F.col("second")).alias("dominant"))


def match_substring(samples: DataFrame, guides: DataFrame, id_col: str, stem: str, least: int = 2) -> DataFrame:
    """``id, guide``: the first guide by name whose stem holds the id, or is held in it; null without one.

    Both sides are joined on equal strings: the pieces of the longer name that are as long as some name of the other side.
    Names of fewer than ``least`` characters match whole ones only.
    """
    ids, stems = samples.select(F.col(id_col).alias("id")).distinct(), guides.select(F.col(stem).alias("guide")).distinct()

    def pieces(df: DataFrame, col: str) -> DataFrame:
        n = F.length(col)
        at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
        parts = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(least), F.greatest(n, F.lit(least))), lambda k: F.when(i + k - 1 <= n, F.substring(F.col(col), i, k)))))
        return df.select(col, F.explode(F.array_distinct(F.array_append(F.array_compact(parts), F.col(col)))).alias("piece"))

    inside = pieces(stems, "guide").join(ids, F.col("piece") == F.col("id")).select("id", "guide")
    around = pieces(ids, "id").join(stems, F.col("piece") == F.col("guide")).select("id", "guide")
    found = inside.union(around).groupBy("id").agg(F.min("guide").alias("guide"))
    return samples.select(F.col(id_col)).join(found.withColumnRenamed("id", "__id"), F.col(id_col) == F.col("__id"), "left").drop("__id")


def validate_annotations(df: DataFrame, stem: str = "stem", sample: str = "sample_id", count: str = "num_colors", rgb: str = "rgb", hexes: str = "hex") -> DataFrame:
    """``stem, errors, warnings, duplicate, ok``: each row's findings in order.

    The stem must be the number of the sample; then both lists must be as long as the count says, colours three whole numbers of 0
    to 255 and none twice, and the names of colours theirs. Later checks are left out where the first ones fail.
    """
    s, n = F.col(stem), F.col(count)
    numeric = s.rlike("^[0-9]+$")
    first = F.array_compact(F.array(
        F.when(~numeric, F.concat(s, F.lit(": stem is no number"))),
        F.when(numeric & ~F.coalesce(s.cast("long") == F.col(sample), F.lit(False)), F.concat(s, F.lit(": sample_id differs"))),
        F.when(numeric & (n.isNull() | F.col(rgb).isNull() | F.col(hexes).isNull()), F.concat(s, F.lit(": a field is missing"))),
    ))
    sizes = F.when((n != F.size(rgb)) | (n != F.size(hexes)), F.concat(s, F.lit(": lengths differ")))
    legal = lambda c: (F.size(c) == 3) & F.forall(c, lambda v: v.between(0, 255))
    name = lambda c: F.concat(F.lit("#"), *[F.lpad(F.hex(F.get(c, F.lit(k)).cast("long")), 2, "0") for k in range(3)])
    place = lambda i: i.cast("string")
    bad = F.transform(rgb, lambda c, i: F.when(~legal(c), F.concat(s, F.lit(": rgb["), place(i), F.lit("] is not legal"))))
    twice = F.transform(rgb, lambda c, i: F.when(legal(c) & (F.array_position(F.col(rgb), c) - 1 < i), F.concat(s, F.lit(": rgb["), place(i), F.lit("] repeats"))))
    other = F.transform(hexes, lambda h, i: F.when(legal(F.get(F.col(rgb), i)) & (F.upper(h) != name(F.get(F.col(rgb), i))), F.concat(s, F.lit(": hex["), place(i), F.lit("] differs"))))
    repeats = F.array_compact(twice)
    rest = F.array_compact(F.concat(F.array(sizes), bad, twice, other))
    errors = F.when(F.size(first) > 0, first).otherwise(rest)
    warnings = F.when(F.size(first) > 0, F.array().cast("array<string>")).otherwise(repeats)
    out = df.select(s.alias("stem"), n.alias("num_colors"), errors.alias("errors"), warnings.alias("warnings"))
    return out.withColumn("duplicate", F.size("warnings") > 0).withColumn("ok", F.size("errors") == 0)


def palette_report(images: DataFrame, checked: DataFrame, stem: str, cap: int) -> DataFrame:
    """One row: images, palettes, pairs, what either side lacks, rows with errors, repeated colours, counts above the cap, and what can be trained on."""
    a, b = images.select(F.col(stem).alias("k")).distinct().withColumn("a", F.lit(1)), checked.withColumnRenamed("stem", "k").withColumn("b", F.lit(1))
    both = a.join(b, "k", "full_outer")
    pair = F.col("a").isNotNull() & F.col("b").isNotNull()
    return both.agg(
        F.count("a").alias("images"), F.count("b").alias("palettes"), F.count_if(pair).alias("pairs"), F.count_if(F.col("a").isNull()).alias("missing_images"), F.count_if(F.col("b").isNull()).alias("missing_palettes"),
        F.count_if(pair & ~F.col("ok")).alias("invalid"), F.count_if(pair & F.col("duplicate")).alias("repeated"), F.count_if(pair & F.col("ok") & (F.col("num_colors") > cap)).alias("over_cap"), F.count_if(pair & F.col("ok") & (F.col("num_colors") <= cap)).alias("trainable"),
    )


def audit_subscenes(rows: DataFrame, scenes: DataFrame, kind: str, scene: str, sample: str, tile_fields: list[str]) -> DataFrame:
    """Findings ``finding, n``: rows of another kind, rows with tile fields, unknown scenes, and repeats of a sample beyond its first row."""
    tile = F.lit(False)
    for c in tile_fields:
        tile = tile | F.col(c).isNotNull()
    first = rows.agg(F.count_if(F.col(kind) != "subscene").alias("wrong_kind"), F.count_if(tile).alias("tile_fields"))
    unknown = rows.where(F.col(scene).isNotNull()).join(scenes.select(scene).distinct(), scene, "left_anti").agg(F.count(F.lit(1)).alias("n"))
    twice = rows.groupBy(sample).agg((F.count(F.lit(1)) - 1).alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    own = first.select(F.inline(F.array(*[F.struct(F.lit(c).alias("finding"), F.col(c).alias("n")) for c in ("wrong_kind", "tile_fields")])))
    return own.union(unknown.select(F.lit("unknown_scene"), "n")).union(twice.select(F.lit("duplicate_sample"), "n"))


def audit_dataset(parts: dict[str, DataFrame], critical: set[str]) -> DataFrame:
    """``part, finding, n, critical, status``: all findings of named parts (``finding, n``) in one table; a critical finding with rows fails the whole set."""
    out = None
    for part, found in parts.items():
        one = found.select(F.lit(part).alias("part"), "finding", "n", F.col("finding").isin(sorted(critical)).alias("critical"))
        out = one if out is None else out.union(one)
    total = out.agg(F.coalesce(F.sum(F.when(F.col("critical"), F.col("n"))), F.lit(0)).alias("__bad"))
    return out.crossJoin(F.broadcast(total)).select("part", "finding", "n", "critical", F.when(F.col("__bad") > 0, "fail").otherwise("ok").alias("status"))  # one row


def cross_split_hashes(df: DataFrame, sha: str, split: str, id_col: str) -> DataFrame:
    """``sha, split, n, first_id, splits``: the entries per split of contents that lie in several splits."""
    each = df.groupBy(F.col(sha).alias("sha"), F.col(split).alias("split")).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id"))
    many = each.groupBy("sha").agg(F.concat_ws(",", F.sort_array(F.collect_set("split"))).alias("splits"), F.count(F.lit(1)).alias("__k")).where("__k > 1").drop("__k")
    return each.join(many, "sha")


def identifiability(df: DataFrame, sha: str, split: str, id_col: str, family: str, pattern: str, sizes: DataFrame) -> DataFrame:
    """One row: rows, repeated contents and their rows, rows whose family fits a pattern, contents in several splits, and keys of ``sizes`` that one part dominates."""
    groups = df.groupBy(sha).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(split).alias("s"))
    a = groups.agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated_rows"), F.count_if(F.col("s") > 1).alias("cross_split"))
    b = df.agg(F.count_if(F.col(family).rlike(pattern)).alias("flagged"))
    c = dominance(sizes, "key", "size").agg(F.count_if("dominant").alias("dominated"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))  # one row each


def invariants(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """``name, status, detail``: named conditions over all rows; FAIL where a row doesn't meet one (null counts as not met)."""
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(k) for k, c in checks.items()])
    each = counts.select("__n", F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("bad")) for k in checks])))
    return each.select("name", F.when(F.col("bad") == 0, "PASS").otherwise("FAIL").alias("status"), F.concat(F.col("bad"), F.lit(" of "), F.col("__n")).alias("detail"))
