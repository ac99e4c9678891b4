"""Evaluation of label rasters over scenes, orientations, splits and suites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .geometry import orient_place, restore_place
from .metrics import confusion_summary
from .raster import boundary_f1, region_scores, tiny_agreement

#: What each part weighs in a score over orientations.
PARTS = {"miou": 0.25, "worst": 0.25, "boundary": 0.20, "small": 0.15, "seam": 0.15}
#: Which suite counts, by mode; the first that has rows.
PRIMARY = {"generalization": ["scene"], "capacity": ["capacity", "spatial", "scene"], "held_out": ["scene", "spatial", "capacity"]}
PREFIX = {"capacity": "cap", "spatial": "spat", "scene": "scene"}


def tile_metrics(cells: DataFrame, target: str, pred: str, supervised: Column, classes: int, halo: int, core: int) -> DataFrame:
    """``image_id, region, n, acc, miou, miou_present, miou_fp`` of tiles ``cells``: all of it, its core behind ``halo``, and the halo.

    The core is of at most ``core`` rows and columns; tiles of no more than two halos have none, and cells may be in both.
    """
    size = cells.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    inside = lambda c, n: (F.col(c) >= halo) & (F.col(c) < halo + F.least(F.lit(core), F.col(n) - 2 * halo))
    outer = lambda c, n: (F.col(c) < halo) | (F.col(c) >= F.col(n) - halo)
    regions = {"global": supervised, "core": supervised & inside("y", "h") & inside("x", "w"), "halo": supervised & (outer("y", "h") | outer("x", "w"))}
    return region_scores(cells.join(size, "image_id"), regions, target, pred, classes)


def inverse_consistency(targets: DataFrame, preds: DataFrame, classes: int) -> DataFrame:
    """``image_id, k, transformed_miou, inverse_miou, delta``: the mean IoU of turned targets and predictions, and of targets and predictions turned back.

    ``targets`` has ``image_id, y, x, target``, full rectangles of any sides; ``preds`` has ``image_id, k, oy, ox, pred`` in
    places of the turned image. A place without a prediction is wrong on both sides; predictions beyond the image don't
    count. Both sides meet by place alone, by merge joins: rasters pack so well that Spark would take them for small and send
    them through the driver.
    """
    size = targets.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    keys = preds.select("image_id", "k").distinct()
    every = targets.join(size.join(keys.hint("merge"), "image_id").hint("merge"), "image_id")
    y, x, h, w, k = (F.col(c) for c in ("y", "x", "h", "w", "k"))
    oy, ox = orient_place(y, x, h, w, k)
    there = every.withColumn("oy", oy).withColumn("ox", ox).join(preds.hint("merge"), ["image_id", "k", "oy", "ox"], "left")
    by, bx = restore_place(F.col("oy"), F.col("ox"), h, w, k)
    back = preds.join(size.hint("merge"), "image_id").select("image_id", "k", by.alias("y"), bx.alias("x"), "pred")
    here = every.join(back.hint("merge"), ["image_id", "k", "y", "x"], "left")
    score = lambda df, name: region_scores(df.withColumn("pred", F.coalesce("pred", F.lit(-1))), {"global": F.lit(True)}, "target", "pred", classes, ("image_id", "k")).select("image_id", "k", F.col("miou_present").alias(name))
    both = score(there, "transformed_miou").join(score(here, "inverse_miou").hint("merge"), ["image_id", "k"])
    return both.withColumn("delta", F.round(F.abs(F.col("transformed_miou") - F.col("inverse_miou")), 6))


def orientation_scores(rows: DataFrame, keys: list[str], required: list[int] | None = None) -> DataFrame:
    """Per key: ``n, found, missing, miou, worst_k, worst, boundary, small, seam, score``.

    ``rows`` has ``k, miou, boundary, small, seam``. Values are means over rows that have them; ``worst`` is the least of the
    orientations' means of ``miou`` (ties to the smaller). ``missing`` lists the required orientations without a row, joined by
    commas: a key that lacks one has no score. The score weighs its parts by PARTS; where no row has ``small`` its place is
    taken by ``miou``, and other parts without a value count as 0.
    """
    means = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("miou", "boundary", "small", "seam")])
    each = rows.where("k is not null").groupBy(*keys, "k").agg(F.avg("miou").alias("m"))
    turned = each.groupBy(*keys).agg(F.sort_array(F.collect_list("k")).alias("found"), F.min(F.when(F.col("m").isNotNull(), F.struct("m", "k"))).alias("w"))
    both = means.join(turned, keys, "left") if keys else means.crossJoin(F.broadcast(turned))  # one row each
    want = F.array(*[F.lit(k) for k in required or []]).cast("array<int>")
    missing = F.array_except(want, F.coalesce("found", F.array().cast("array<int>")))
    part = {"miou": F.col("miou"), "worst": F.col("w.m"), "boundary": F.col("boundary"), "small": F.coalesce("small", "miou"), "seam": F.col("seam")}
    score = reduce(lambda a, b: a + b, [weight * F.coalesce(part[name], F.lit(0.0)) for name, weight in PARTS.items()])
    r = lambda c: F.round(c, 12)
    return both.select(*keys, "n", F.size(F.coalesce("found", F.array().cast("array<int>"))).alias("found"), F.concat_ws(",", missing.cast("array<string>")).alias("missing"), r(F.col("miou")).alias("miou"), F.col("w.k").alias("worst_k"), r(F.col("w.m")).alias("worst"), r(F.col("boundary")).alias("boundary"), r(F.col("small")).alias("small"), r(F.col("seam")).alias("seam"), F.when(F.size(missing) == 0, r(score)).alias("score"))


def split_images(cells: DataFrame, target: str, pred: str, supervised: Column, tolerances: tuple[int, ...] = (1, 2, 3), tiny: int = 64) -> DataFrame:
    """A row an image: ``acc``, boundary F1 at each tolerance, and the agreement on tiny components of the supervised cells (1 without one)."""
    t, p = F.col(target), F.col(pred)
    out = cells.where(supervised).groupBy("image_id").agg(F.round(F.avg((t == p).cast("int")), 6).alias("acc"))
    for n in tolerances:
        out = out.join(boundary_f1(cells, target, pred, supervised, n).withColumnRenamed("bf1", f"bf1_{n}"), "image_id")
    small = tiny_agreement(cells, target, pred, supervised, tiny).select("image_id", F.col("agreement").alias("small"))
    return out.join(small, "image_id", "left").withColumn("small", F.coalesce("small", F.lit(1.0)))


def split_report(cells: DataFrame, images: DataFrame, target: str, pred: str, supervised: Column, classes: int, weights: tuple[float, float, float] = (0.55, 0.30, 0.15)) -> DataFrame:
    """One row: ``miou, f1, accuracy, n, dropped`` of all cells pooled, the means of ``split_images``, and the weighted score of mean IoU, boundary F1 at 2 and small components."""
    pooled = confusion_summary(cells.where(supervised), target, pred, classes)
    cols = [c for c in images.columns if c.startswith("bf1_") or c == "small"]
    means = images.agg(F.count(F.lit(1)).alias("images"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in cols])
    both = pooled.crossJoin(F.broadcast(means))  # one row each
    bf1 = F.col("bf1_2") if "bf1_2" in cols else F.lit(0.0)
    return both.withColumn("score", F.round(weights[0] * F.coalesce("miou", F.lit(0.0)) + weights[1] * bf1 + weights[2] * F.col("small"), 6))


def suite_summary(rows: DataFrame, mode: str) -> DataFrame:
    """``name, value``: each suite's parts and score under its prefix, the primary suite's without one, and ``evaluated`` (1 or 0).

    ``rows`` has ``suite`` (capacity, spatial, scene) and the columns of ``orientation_scores``. The primary suite is the first
    of the mode's that has rows; generalisation counts held-out scenes alone, so without them nothing is evaluated.
    """
    if mode not in PRIMARY:
        raise ValueError(f"unknown mode: {mode}")
    scores = orientation_scores(rows.where(F.col("suite").isin(list(PREFIX))), ["suite"]).drop("found", "missing", "worst_k").checkpoint()
    order = F.array_position(F.array(*[F.lit(s) for s in PRIMARY[mode]]), F.col("suite"))
    names = ["n", "miou", "worst", "boundary", "small", "seam", "score"]
    prefix = F.array_join(F.array(*[F.when(F.col("suite") == s, F.lit(p)) for s, p in PREFIX.items()]), "")
    all_ = F.array(*[F.struct(F.lit(n).alias("n"), F.col(n).cast("double").alias("value")) for n in names])
    own = scores.select(prefix.alias("p"), F.inline(all_)).select(F.concat("p", F.lit("_"), "n").alias("name"), "value")
    first = scores.withColumn("order", order).where("order > 0").withColumn("place", F.row_number().over(W.orderBy("order"))).where("place = 1")
    main = first.select(F.inline(all_)).select(F.col("n").alias("name"), "value")
    status = first.agg(F.lit("evaluated").alias("name"), F.count(F.lit(1)).cast("double").alias("value"))
    return own.union(main).union(status).where("value is not null")
