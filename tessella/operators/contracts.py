"""Contracts of paired images and their manifests: what pairs, what lacks, what differs, and whether it may be used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .raster import PLACE


def _no() -> Column:
    return F.lit("")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def pair_files(inputs: DataFrame, targets: DataFrame, stem: str, path: str) -> DataFrame:
    """``stem, finding, side, input_path, target_path, n``: pairs, what lacks, and duplicates, a row each.

    A stem that a side has several times (``n``) is a duplicate, of which each path of that side has a row; it makes no pair,
    nor does the other side lack it. ``side`` says which side lacks or repeats; paths that don't apply are empty.
    """
    rows = [df.select(F.col(stem).alias("stem"), F.col(path).alias("path")) for df in (inputs, targets)]
    per = [df.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")) for df in rows]
    both = per[0].select("stem", F.col("n").alias("a"), F.col("path").alias("input_path")).join(per[1].select("stem", F.col("n").alias("b"), F.col("path").alias("target_path")), "stem", "full_outer")
    single = both.where("coalesce(a, 1) = 1 and coalesce(b, 1) = 1")
    lacks = F.when(F.col("a").isNull(), "input").when(F.col("b").isNull(), "target").otherwise("")
    text = lambda c: F.coalesce(F.col(c), _no()).alias(c)
    found = single.select("stem", F.when(lacks == "", "pair").otherwise("missing").alias("finding"), lacks.alias("side"), text("input_path"), text("target_path"), F.lit(1).cast("long").alias("n"))
    for side, df, count in (("input", rows[0], per[0]), ("target", rows[1], per[1])):
        twice = df.join(count.where("n > 1").select("stem", "n"), "stem")
        paths = (F.col("path"), _no()) if side == "input" else (_no(), F.col("path"))
        found = found.union(twice.select("stem", F.lit("duplicate"), F.lit(side), *paths, "n"))
    return found


def repeated_stems(df: DataFrame, stem: str, path: str) -> DataFrame:
    """The stems, as written, of paths that aren't the first of their stem in any case."""
    first = df.groupBy(F.lower(stem).alias("__k")).agg(F.min(path).alias("__first"))
    return df.join(first, F.lower(stem) == F.col("__k")).where(F.col(path) > F.col("__first")).select(F.col(stem).alias("stem")).distinct()


def _unexpected(cells: DataFrame, side: str, allowed: list[int], shown: int = 8) -> DataFrame:
    """``image_id, {side}``: codes that aren't allowed with their cells, the most frequent first, and how many more there are."""
    counts = cells.where(~F.col("code").isin(allowed)).groupBy("image_id", "code").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("image_id").orderBy(F.desc("n"), "code")
    top = counts.withColumn("place", F.row_number().over(w)).groupBy("image_id").agg(F.count(F.lit(1)).alias("k"), F.array_sort(F.collect_list(F.when(F.col("place") <= shown, F.struct("place", F.concat(F.lit("("), F.col("code"), F.lit(")="), F.col("n")).alias("t"))))).alias("top"))
    more = F.when(F.col("k") > shown, F.concat(F.lit(", and "), F.col("k") - shown, F.lit(" more"))).otherwise("")
    return top.select("image_id", F.concat(F.array_join(F.transform("top", lambda x: x["t"]), ", "), more).alias(side))


def pair_contract(inputs: DataFrame, targets: DataFrame, region: int, outline: int, blank: int, classes: list[int], alpha: str | None = None) -> DataFrame:
    """Per image of both sides: ``width, height, candidates, class_*, mismatches, inconsistent, status, reason``.

    Both sides have ``image_id, y, x, code``, and ``alpha`` if named. Findings, in this order: an alpha that isn't 255, sizes
    that differ, codes of the input beyond region, outline and blank, codes of the target beyond outline, blank and classes,
    cells where exactly one of the input's region and the target's classes is, outline or blank cells that the target hasn't
    as they are, and an input without a cell of the region. All make an image invalid but the last, which is a warning.
    Cells are compared only where sizes are the same. ``reason`` joins the findings, or is OK.
    """

    def side(df: DataFrame, p: str) -> DataFrame:
        bad = F.count_if(F.col(alpha) != 255) if alpha else F.lit(0)
        return df.groupBy("image_id").agg((F.max("y") + 1).alias(f"h{p}"), (F.max("x") + 1).alias(f"w{p}"), bad.alias(f"alpha{p}"))

    size = side(inputs, 1).join(side(targets, 2), "image_id")
    same = (F.col("h1") == F.col("h2")) & (F.col("w1") == F.col("w2"))
    both = inputs.select(*PLACE, F.col("code").alias("a")).join(targets.select(*PLACE, F.col("code").alias("b")), PLACE)
    a, b = F.col("a"), F.col("b")
    named = b.isin(classes)
    counts = both.groupBy("image_id").agg(F.count_if(a == region).alias("candidates"), *[F.count_if(b == c).alias(f"class_{c}") for c in classes], F.count_if((a == region) != named).alias("mismatches"), F.count_if((a == outline) & (b != outline) | (a == blank) & (b != blank)).alias("inconsistent"))
    out = size.join(counts, "image_id", "left").join(_unexpected(inputs, "odd1", [region, outline, blank]), "image_id", "left").join(_unexpected(targets, "odd2", [outline, blank, *classes]), "image_id", "left")
    n = lambda c: F.when(same, F.coalesce(c, F.lit(0))).otherwise(0)
    cols = ["candidates", *[f"class_{c}" for c in classes], "mismatches", "inconsistent"]
    out = out.select("*", same.alias("same")).withColumns({c: n(F.col(c)) for c in cols})
    dims = lambda p: F.concat(F.col(f"w{p}"), F.lit("x"), F.col(f"h{p}"))
    findings = [
        F.when(F.col("alpha1") + F.col("alpha2") > 0, "alpha is not opaque"), F.when(~F.col("same"), F.concat(F.lit("sizes differ: "), dims(1), F.lit(" and "), dims(2))),
        F.when(F.col("odd1").isNotNull(), F.concat(F.lit("input codes: "), "odd1")), F.when(F.col("odd2").isNotNull(), F.concat(F.lit("target codes: "), "odd2")),
        F.when(F.col("mismatches") > 0, F.concat(F.lit("region and classes differ on "), F.col("mismatches"), F.lit(" cells"))), F.when(F.col("inconsistent") > 0, F.concat(F.lit("outline or blank differs on "), F.col("inconsistent"), F.lit(" cells"))),
    ]
    none = F.col("same") & (F.col("candidates") == 0)
    out = out.withColumn("found", F.array_compact(F.array(*findings))).withColumn("none", none)
    status = F.when(F.size("found") > 0, "invalid").when(F.col("none"), "warning").otherwise("valid")
    every = F.when(F.col("none"), F.array_append("found", F.lit("no cell of the region"))).otherwise(F.col("found"))
    reason = F.when(F.size(every) > 0, F.array_join(every, "; ")).otherwise("OK")
    return out.select("image_id", F.col("w1").alias("width"), F.col("h1").alias("height"), *cols, status.alias("status"), reason.alias("reason"))


def readiness_report(results: DataFrame, files: DataFrame) -> DataFrame:
    """``section, name, n`` of ``pair_contract``'s rows and ``pair_files``' findings: counts by status, finding and reason, and whether the set is ready.

    It is (1, else 0) if some pair is valid and none invalid. Reasons are those of invalid pairs and warnings.
    """
    of = lambda df, section, c: df.groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), "name", "n")
    ready = results.agg(((F.count_if(F.col("status") == "valid") > 0) & (F.count_if(F.col("status") == "invalid") == 0)).cast("long").alias("n")).select(F.lit("ready").alias("section"), F.lit("ready").alias("name"), "n")
    return _union([of(results, "status", "status"), of(files, "files", "finding"), of(results.where("status <> 'valid'"), "reason", "reason"), ready])


def audit_tiles(rows: DataFrame, scenes: DataFrame, scene: str, sample: str, uid: str, orientation: str, region: str, required: list[str], record: str | None = None, orientations: int = 8) -> DataFrame:
    """``finding, name, severity, n`` of a tile manifest: what is wrong with it, and how its rows are distributed.

    Rows of unknown scenes, without a sample id, that repeat one, that lack a required field, that are of another record kind
    than tile, that repeat a tile id; whether rows and distinct tile ids differ; scenes that lack an orientation, by which
    they lack. Then the rows by orientation and by region (``unknown`` for none), of severity ``info``.
    """
    lacks = reduce(lambda x, y: x | y, [F.col(c).isNull() for c in required], F.lit(False))
    counts = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(sample).isNull()).alias("no_sample_id"), F.count_if(lacks).alias("missing_field"), F.count_if(F.coalesce(F.col(record) != "tile", F.lit(False)) if record else F.lit(False)).alias("wrong_record"),
    )
    repeats = lambda c: rows.where(F.col(c).isNotNull()).groupBy(c).agg((F.count(F.lit(1)) - 1).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("k"), F.count(F.lit(1)).alias("d"))
    known = scenes.select(F.col(scene).alias("__s")).distinct().withColumn("__known", F.lit(True))
    unknown = rows.where(F.col(scene).isNotNull()).join(known, F.col(scene) == F.col("__s"), "left").agg(F.count_if(F.col("__known").isNull()).alias("unknown_scene"))
    s, u = repeats(sample).select(F.col("k").alias("duplicate_sample")), repeats(uid).select(F.col("k").alias("duplicate_tile"), F.col("d").alias("tiles"))
    wide = counts.crossJoin(F.broadcast(unknown)).crossJoin(F.broadcast(s)).crossJoin(F.broadcast(u))  # one row each
    differ = F.when((F.col("rows") > 0) & (F.col("rows") != F.col("tiles")), F.abs(F.col("rows") - F.col("tiles"))).otherwise(0)
    names = ["unknown_scene", "no_sample_id", "duplicate_sample", "missing_field", "wrong_record", "duplicate_tile"]
    own = F.array(*[F.struct(F.lit(c).alias("finding"), _no().alias("name"), F.lit("error").alias("severity"), F.col(c).cast("long").alias("n")) for c in names], F.struct(F.lit("rows_without_tile").alias("finding"), _no().alias("name"), F.lit("error").alias("severity"), differ.cast("long").alias("n")))
    turned = rows.where(F.col(scene).isNotNull() & F.col(orientation).isNotNull()).groupBy(scene).agg(F.collect_set(F.col(orientation).cast("int")).alias("k"))
    want = F.array(*[F.lit(k) for k in range(orientations)])
    gone = turned.select(F.explode(F.array_except(want, "k")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    spread = lambda kind, c: rows.groupBy(c.alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("finding"), "name", F.lit("info").alias("severity"), "n")
    parts = [wide.select(F.inline(own)), gone.select(F.lit("missing_orientation").alias("finding"), F.col("k").cast("string").alias("name"), F.lit("error").alias("severity"), "n")]
    parts += [spread("orientation", F.col(orientation).cast("string")).where("name is not null"), spread("region", F.coalesce(F.col(region).cast("string"), F.lit("unknown")))]
    return _union(parts)


def audit_records(records: DataFrame, assets: DataFrame, key: str, allowed: list[int]) -> DataFrame:
    """``key, finding, severity, detail``: a row for each thing that a record of ``records`` gets wrong about its assets.

    ``records`` has ``sha256, width, height`` as they are written down; ``assets`` has ``side`` (source, target), ``sha256,
    width, height, codes`` (the distinct ones) as they are. An asset that isn't there, a target of another size than its
    source, and codes that aren't allowed in the target are errors; a hash or size that isn't the source's a warning.
    """
    of = lambda side, p: assets.where(F.col("side") == side).select(key, *[F.col(c).alias(f"{p}_{c}") for c in ("sha256", "width", "height", "codes")], F.lit(True).alias(f"{p}_there"))
    both = records.join(of("source", "s"), key, "left").join(of("target", "t"), key, "left")
    size = lambda w, h: F.concat(F.col(w), F.lit("x"), F.col(h))
    pair = lambda x, y: F.concat(x, F.lit(" and "), y)
    there = lambda p: F.col(f"{p}_there").isNotNull()
    odd = F.array_sort(F.filter("t_codes", lambda c: ~c.isin(allowed)))
    row = lambda when, finding, severity, detail: F.when(when, F.struct(F.lit(finding).alias("finding"), F.lit(severity).alias("severity"), detail.alias("detail")))
    found = [
        row(~there("s"), "missing_source", "error", _no()), row(~there("t"), "missing_target", "error", _no()),
        row(F.col("sha256") != F.col("s_sha256"), "hash", "warning", pair(F.substring("sha256", 1, 12), F.substring("s_sha256", 1, 12))),
        row((F.col("s_width") != F.col("t_width")) | (F.col("s_height") != F.col("t_height")), "shape", "error", pair(size("s_width", "s_height"), size("t_width", "t_height"))),
        row((F.col("width") != F.col("s_width")) | (F.col("height") != F.col("s_height")), "size", "warning", pair(size("width", "height"), size("s_width", "s_height"))),
        row(F.size(odd) > 0, "codes", "error", F.array_join(odd.cast("array<string>"), ",")),
    ]
    return both.select(key, F.inline(F.array_compact(F.array(*found))))


def cardinality_report(df: DataFrame, key: str, limits: tuple[int, ...] = (16, 32, 64, 128), cap: int = 12, examples: int = 20) -> DataFrame:
    """``section, name, n``: keys with more rows than each limit and than the cap, and the first ``examples`` keys beyond the cap with their rows."""
    n = df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    over = n.agg(*[F.count_if(F.col("n") > m).alias(f"gt_{m}") for m in limits], F.count_if(F.col("n") > cap).alias("over_cap"), F.count(F.lit(1)).alias("keys"))
    names = [*[f"gt_{m}" for m in limits], "over_cap", "keys"]
    counts = over.select(F.inline(F.array(*[F.struct(F.lit("counts").alias("section"), F.lit(c).alias("name"), F.col(c).alias("n")) for c in names])))
    shown = n.where(F.col("n") > cap).orderBy("key").limit(examples).select(F.lit("example").alias("section"), F.col("key").cast("string").alias("name"), "n")
    return counts.union(shown)


#: What a policy keeps: named entries, and how many numbered ones (all for None).
POLICIES = {"all": ([], None), "best": (["best"], 1), "last": (["final"], 1), "last_and_best": (["final", "best"], 1), "none": ([], 0)}


def retention(entries: DataFrame, run: str, name: str, policy: str, numbered: int | None = None) -> DataFrame:
    """``entries`` with ``keep``: named ones that the policy keeps, and of those whose name is a whole number the highest.

    ``numbered`` is how many of these, in place of the policy's number. ``all`` keeps everything.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy: {policy}")
    names, most = POLICIES[policy]
    most = most if numbered is None else numbered
    if policy == "all" and numbered is None:
        return entries.withColumn("keep", F.lit(True))
    number = F.when(F.col(name).rlike(r"^\d{1,18}$"), F.col(name)).cast("long")
    rank = F.row_number().over(W.partitionBy(run, number.isNull()).orderBy(number.desc_nulls_last()))
    named = F.lit(True) if policy == "all" else F.col(name).isin(names) if names else F.lit(False)
    return entries.withColumn("keep", F.when(number.isNotNull(), rank <= most).otherwise(named))
