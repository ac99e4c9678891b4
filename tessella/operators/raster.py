"""Label rasters as rows ``(image, y, x, code)``: layers, neighbourhoods, components, and scores by region.

Work on neighbours stays within an image: cells send themselves to the places around them and meet by place, or follow each
other in a row or column. Components are found over runs of cells in a row, so that links don't grow with area.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .identity import components

PLACE = ["image_id", "y", "x"]


def square(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]


def diamond(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy, dx in square(radius) if abs(dy) + abs(dx) <= radius]


def disc(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy, dx in square(radius) if dy * dy + dx * dx <= radius * radius]


def around(cells: DataFrame, offsets: list[tuple[int, int]], values: list[str], aggs: list[Column], own: list[str] | None = None) -> DataFrame:
    """``image_id, y, x``, the own columns of each cell, and ``aggs`` over the ``values`` of the cells at these offsets (the own one if listed)."""
    spots = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in sorted({*offsets, (0, 0)})])
    here = (F.col("o.dy") == 0) & (F.col("o.dx") == 0)
    near = here.isNotNull() if (0, 0) in offsets else ~here
    kept = [F.when(here, F.col(c)).alias(f"__own_{c}") for c in own or []]
    sent = cells.select("image_id", "y", "x", *{*values, *(own or [])}, F.explode(spots).alias("o"))
    sent = sent.select("image_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), here.alias("__here"), *kept, *[F.when(near, F.col(c)).alias(c) for c in values])
    out = sent.groupBy(*PLACE).agg(F.max("__here").alias("__here"), *[F.max(f"__own_{c}").alias(f"__own_{c}") for c in own or []], *aggs)
    out = out.where("__here").drop("__here")
    for c in own or []:
        out = out.withColumnRenamed(f"__own_{c}", c)
    return out


def recode(cells: DataFrame, codes: dict[int, int], default: int | None, code: str = "code") -> DataFrame:
    """``code`` by a map of values; others become ``default``, or raise when it is None."""
    new = F.lit(default).cast("int") if default is not None else F.raise_error(F.concat(F.lit("no code for "), F.col(code).cast("string"))).cast("int")
    for old, to in codes.items():
        new = F.when(F.col(code) == old, to).otherwise(new)
    return cells.withColumn(code, new)


def levels(cells: DataFrame, code: str = "code") -> DataFrame:
    """Level of classes 1, 2, 3 (0, 1, 2; else -100) and its cumulative flags ``at_least_1, at_least_2``."""
    level = F.when(F.col(code).between(1, 3), F.col(code) - 1).otherwise(-100)
    return cells.withColumn("level", level).withColumn("at_least_1", (F.col("level") >= 1).cast("int")).withColumn("at_least_2", (F.col("level") >= 2).cast("int"))


def derive_layers(cells: DataFrame, code: str, lock: str) -> DataFrame:
    """Layers of a class raster: ``source`` (0 where locked, else 255), ``valid``, ``shade`` (classes 1 to 3 outside the lock), ``level`` (255 outside), ``oracle`` gray."""
    gray = F.element_at(F.array(*[F.lit(g) for g in (255, 200, 150, 100)]), F.col(code) + 1)
    shade = ~F.col(lock) & F.col(code).between(1, 3)
    return cells.select(*PLACE, F.when(F.col(lock), 0).otherwise(255).alias("source"), (~F.col(lock)).alias("valid"), shade.alias("shade"), F.when(shade, F.col(code) - 1).otherwise(255).alias("level"), F.when(F.col(lock), 0).otherwise(gray).alias("oracle"))


def rebuild_mismatch(layers: DataFrame, cells: DataFrame, code: str) -> DataFrame:
    """Per image: cells whose class, rebuilt from ``source`` and ``level``, isn't the one they had (locked cells have none)."""
    built = F.when(F.col("source") == 0, -1).when(F.col("level") == 255, 0).otherwise(F.col("level") + 1)
    both = layers.join(cells.select(*PLACE, F.col(code).alias("__code")), PLACE)
    return both.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.count_if((built >= 0) & (built != F.col("__code"))).alias("mismatches"))


def wrapped_boundary(cells: DataFrame, code: str = "code") -> DataFrame:
    """``edge`` and the classes ``class_a < class_b`` of it, where rows and columns go on at the other side; -1 without an edge to the left or above.

    The pair is that with the cell above if they differ, else with the one to the left.
    """
    row, col = W.partitionBy("image_id", "y").orderBy("x"), W.partitionBy("image_id", "x").orderBy("y")
    c = F.col(code)

    def beside(w, step, end):
        whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        return F.coalesce(step(code).over(w), end(code).over(whole))

    left, right, up, down = beside(row, F.lag, F.last), beside(row, F.lead, F.first), beside(col, F.lag, F.last), beside(col, F.lead, F.first)
    at = cells.select(*PLACE, c.alias("code"), left.alias("left"), right.alias("right"), up.alias("up"), down.alias("down"))
    c = F.col("code")
    differs = lambda n: (F.col(n) != c) & (F.col(n) >= 0) & (c >= 0)
    edge = differs("left") | differs("right") | differs("up") | differs("down")
    other = F.when(edge & (F.col("up") != c), F.col("up")).when(edge & (F.col("left") != c), F.col("left"))
    return at.select(*PLACE, "code", edge.alias("edge"), F.coalesce(F.least(other, F.when(other.isNotNull(), c)), F.lit(-1)).alias("class_a"), F.coalesce(F.greatest(other, F.when(other.isNotNull(), c)), F.lit(-1)).alias("class_b"))


def dilate(cells: DataFrame, mask: str, radius: int, shape: str = "square") -> DataFrame:
    """``image_id, y, x, mask, grown``: whether a cell of the mask lies within a square or a diamond of this radius."""
    offsets = square(radius) if shape == "square" else diamond(radius)
    return around(cells, offsets, [mask], [F.coalesce(F.bool_or(F.col(mask)), F.lit(False)).alias("grown")], [mask] if mask else []) if radius > 0 else cells.select(*PLACE, mask, F.col(mask).alias("grown"))


def label_components(cells: DataFrame, code: str = "code", diagonal: bool = False) -> DataFrame:
    """``image_id, y, x, code, root_y, root_x``: cells of one code that touch share a root, their first cell by row. Null codes stay out.

    Links are taken between runs of a row that touch; cells on top of each other are found by a lag, without a join.
    """
    live = cells.where(F.col(code).isNotNull()).select(*PLACE, F.col(code).alias("code"))
    row = W.partitionBy("image_id", "y").orderBy("x")
    new = F.coalesce((F.lag("code").over(row) != F.col("code")) | (F.lag("x").over(row) != F.col("x") - 1), F.lit(True))
    runs = live.withColumn("__new", F.when(new, F.col("x"))).withColumn("run", F.max("__new").over(row.rowsBetween(W.unboundedPreceding, 0))).drop("__new").checkpoint()
    node = lambda y, x: F.struct(F.col("image_id").alias("i"), y.alias("y"), x.alias("x"))
    lines = [F.col("x")] + ([F.col("x") - F.col("y"), F.col("x") + F.col("y")] if diagonal else [])
    edges = None
    for line in lines:
        w = W.partitionBy("image_id", line).orderBy("y")
        above = runs.select("image_id", "y", "run", ((F.lag("code").over(w) == F.col("code")) & (F.lag("y").over(w) == F.col("y") - 1)).alias("same"), F.lag("run").over(w).alias("up"))
        found = above.where("same").select(node(F.col("y") - 1, F.col("up")).alias("a"), node(F.col("y"), F.col("run")).alias("b")).distinct()
        edges = found if edges is None else edges.union(found)
    roots = components(edges).select(F.col("node.i").alias("image_id"), F.col("node.y").alias("y"), F.col("node.x").alias("run"), F.col("root.y").alias("root_y"), F.col("root.x").alias("root_x"))
    out = runs.join(roots, ["image_id", "y", "run"], "left")
    return out.select(*PLACE, "code", F.coalesce("root_y", "y").alias("root_y"), F.coalesce("root_x", "run").alias("root_x"))


COMPONENT = ["image_id", "code", "root_y", "root_x"]


def component_stats(labelled: DataFrame, tiny: int = 64) -> DataFrame:
    """Per component: area, box, centroid, sides that face another component or the outside, whether it is tiny, and its place by size in its image."""
    row, col = W.partitionBy("image_id", "y").orderBy("x"), W.partitionBy("image_id", "x").orderBy("y")
    own = F.struct("code", "root_y", "root_x")
    cells = labelled.withColumn("__c", own)
    open_ = lambda step, w, axis, by: (~F.coalesce((step("__c").over(w) == F.col("__c")) & (step(axis).over(w) == F.col(axis) + by), F.lit(False))).cast("int")
    sides = open_(F.lag, row, "x", -1) + open_(F.lead, row, "x", 1) + open_(F.lag, col, "y", -1) + open_(F.lead, col, "y", 1)
    s = cells.withColumn("__s", sides).groupBy(*COMPONENT).agg(
        F.count(F.lit(1)).alias("area"), F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"), F.round(F.avg("y"), 6).alias("cy"), F.round(F.avg("x"), 6).alias("cx"), F.sum("__s").alias("perimeter")
    )
    box = (F.col("y1") - F.col("y0") + 1) * (F.col("x1") - F.col("x0") + 1)
    place = F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("area"), "cy", "cx", "root_y", "root_x"))
    return s.select("*", F.round(F.col("area") / box, 6).alias("fill"), (F.col("area") <= tiny).alias("tiny"), place.alias("place"))


def largest_components(stats: DataFrame, least: int = 64, most: int = 256) -> DataFrame:
    """Each image's ``most`` largest components of ``least`` cells or more."""
    return stats.where((F.col("area") >= least) & (F.col("place") <= most))


def region_reliability(labelled: DataFrame, least: int = 16) -> DataFrame:
    """Per component: ``area, reliable, reason``; too small, or touching the image's border, isn't reliable. Sizes come first."""
    size = labelled.groupBy("image_id").agg(F.max("y").alias("__h"), F.max("x").alias("__w"))
    touch = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == F.col("__h")) | (F.col("x") == F.col("__w"))
    s = labelled.join(size, "image_id").groupBy(*COMPONENT).agg(F.count(F.lit(1)).alias("area"), F.max(touch).alias("touches"))
    reason = F.when(F.col("area") < least, F.concat(F.lit("too_small("), F.col("area"), F.lit(f"<{least})"))).when(F.col("touches"), "open_outline_or_border_spill").otherwise("")
    return s.select(*COMPONENT, "area", (reason == "").alias("reliable"), reason.alias("reason"))


def index_contract(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Per image: codes beyond 0 to 2 in the input and beyond 0 to 4 in the output, cells outside code 2 that differ, cells inside it below 2, and ``ok``."""
    a, b = F.col(x), F.col(y)
    out = pairs.groupBy("image_id").agg(F.count_if(~a.between(0, 2)).alias("bad_input"), F.count_if(~b.between(0, 4)).alias("bad_output"), F.count_if((a != 2) & (a != b)).alias("outside"), F.count_if((a == 2) & b.between(0, 1)).alias("inside"))
    return out.withColumn("ok", (F.col("bad_input") + F.col("bad_output") + F.col("outside") + F.col("inside")) == 0)


def input_from_target(cells: DataFrame, y: str, x: str = "input") -> DataFrame:
    """The input codes of a target: 3 and 4 become 2."""
    return cells.withColumn(x, F.when(F.col(y).isin(3, 4), 2).otherwise(F.col(y)))


def compose_output(cells: DataFrame, x: str, pred: str, out: str = "output") -> DataFrame:
    """The input with code 2 replaced by 2 plus the predicted level; all else is locked."""
    return cells.withColumn(out, F.when(F.col(x) == 2, F.col(pred) + 2).otherwise(F.col(x)))


def soft_boundary(cells: DataFrame, probs: str) -> DataFrame:
    """``boundary``: the largest 1 - sum of p * q over the four neighbours; 0 without one."""
    row, col = W.partitionBy("image_id", "y").orderBy("x"), W.partitionBy("image_id", "x").orderBy("y")
    apart = lambda step, w: 1 - F.aggregate(F.zip_with(probs, step(probs).over(w), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    sides = cells.select(*PLACE, F.array(apart(F.lag, row), apart(F.lead, row), apart(F.lag, col), apart(F.lead, col)).alias("__d"))
    return sides.select(*PLACE, F.round(F.greatest(F.coalesce(F.array_max("__d"), F.lit(0.0)), F.lit(0.0)), 6).alias("boundary"))


def thin_structure(cells: DataFrame, code: str = "code", radius: int = 2, least: int = 4) -> DataFrame:
    """``thin, endpoint, junction``: a cell is thin if another class lies within ``radius`` (Euclidean) or its class has fewer than ``least`` cells.

    A thin cell with at most two thin ones in its 3 x 3 square is an endpoint, with four or more a junction.
    """
    near = around(cells, disc(radius), [code], [F.min(code).alias("__lo"), F.max(code).alias("__hi")], [code])
    few = F.count(F.lit(1)).over(W.partitionBy("image_id", code)) < least
    thin = near.select(*PLACE, ((F.col("__lo") != F.col("__hi")) | few).alias("thin"))
    out = around(thin, square(1), ["thin"], [F.count_if(F.col("thin")).alias("__n")], ["thin"])
    return out.select(*PLACE, "thin", (F.col("thin") & (F.col("__n") <= 2)).alias("endpoint"), (F.col("thin") & (F.col("__n") >= 4)).alias("junction"))


def nearest_squares(xs: list[int], heights: list[int | None]) -> list[float | None]:
    """For each x the least of (x - x')^2 + h'^2 over all places that have a height; None without one. Both are in order of x.

    Each height is a parabola; those of the lower envelope are found in one pass, with where each begins to be the lowest.
    """
    held: list[tuple[int, int, float]] = []
    for x, h in zip(xs, heights, strict=True):
        if h is None:
            continue
        begins = float("-inf")
        while held:
            u, g, start = held[-1]
            begins = ((x * x + h * h) - (u * u + g * g)) / (2 * (x - u))
            if begins > start:
                break
            held.pop()
            begins = float("-inf")
        held.append((x, h, begins))
    out: list[float | None] = []
    at = 0
    for x in xs:
        while at + 1 < len(held) and held[at + 1][2] < x:
            at += 1
        out.append(float((x - held[at][0]) ** 2 + held[at][1] ** 2) if held else None)
    return out


def distance_to(cells: DataFrame, mask: str) -> DataFrame:
    """``distance``: exact Euclidean distance to the nearest cell of the mask; null in images without one.

    First along columns, by windows; then along rows, by the lower envelope of each row's parabolas, in time and memory of
    the row's length.
    """
    col = W.partitionBy("image_id", "x").orderBy("y")
    at = F.when(F.col(mask), F.col("y"))
    up, down = F.last(at, True).over(col.rowsBetween(W.unboundedPreceding, 0)), F.first(at, True).over(col.rowsBetween(0, W.unboundedFollowing))
    g = cells.select(*PLACE, F.least(F.col("y") - up, down - F.col("y")).alias("g"))
    rows = g.groupBy("image_id", "y").agg(F.sort_array(F.collect_list(F.struct("x", "g"))).alias("row"))
    rows = rows.select("image_id", "y", F.transform("row", lambda r: r["x"]).alias("x"), F.transform("row", lambda r: r["g"]).alias("g"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [nearest_squares(x, h) for x, h in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(best, pa.list_(pa.float64()))], ["image_id", "y", "x", "d"])

    kinds = dict(rows.dtypes)
    each = rows.mapInArrow(measure, f"image_id {kinds['image_id']}, y {kinds['y']}, x {kinds['x']}, d array<double>")
    each = each.select("image_id", "y", F.inline(F.arrays_zip("x", "d")))
    return each.select(*PLACE, F.round(F.sqrt("d"), 6).alias("distance"))


def eligible_cells(cells: DataFrame, outline: Column, index: str | None = None, editable: str | None = None, locked: str | None = None, explicit: bool = False) -> DataFrame:
    """``eligible``: code 2 of an index if there is one, else the editable flag, else all but the outline (none with ``explicit``); never outline or locked cells."""
    free = F.col(index) == 2 if index else F.col(editable) if editable else F.lit(not explicit)
    return cells.withColumn("eligible", free & ~outline & (~F.col(locked) if locked else F.lit(True)))


def apply_constraints(cells: DataFrame, before: str, after: str, eligible: str, allowed: list[int]) -> DataFrame:
    """``final``: the edit where it is eligible and an allowed code, else what was; and whether the cell changed."""
    ok = F.col(eligible) & F.col(after).isin(allowed)
    return cells.withColumn("final", F.when(ok, F.col(after)).otherwise(F.col(before))).withColumn("changed", F.col("final") != F.col(before))


def majority_cleanup(cells: DataFrame, code: str, confidence: str, threshold: float, radius: int = 1, protect: str | None = None) -> DataFrame:
    """``cleaned``: a cell of less confidence takes the most frequent code of its square (ties by code), unless it is protected."""
    near = around(cells, square(radius), [code], [F.collect_list(code).alias("__near")], [code, confidence, *([protect] if protect else [])])
    counts = F.transform(F.array_sort(F.array_distinct("__near")), lambda c: F.struct(F.size(F.filter("__near", lambda v: v == c)).alias("n"), (-c).alias("c")))
    low = (F.col(confidence) < threshold) & (~F.col(protect) if protect else F.lit(True))
    return near.select(*PLACE, code, F.when(low, -F.array_max(counts)["c"]).otherwise(F.col(code)).alias("cleaned"))


def edit_report(cells: DataFrame, before: str, after: str) -> DataFrame:
    """Per image: cells, changed ones and their share."""
    return cells.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(before) != F.col(after)).alias("changed")).withColumn("share", F.round(F.col("changed") / F.col("n"), 6))


def window_sums(cells: DataFrame, mask: str, size: int, stride: int) -> DataFrame:
    """``image_id, y0, x0, n``: cells of the mask in each window of ``size``, at every ``stride`` and flush with the end.

    A cell adds itself to the windows that cover it, summed before the shuffle: work grows with cells, not with window areas.
    """
    size_of = cells.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")).where((F.col("h") >= size) & (F.col("w") >= size))
    origins = lambda n: F.array_union(F.sequence(F.lit(0), n - size, F.lit(stride)), F.array(n - size))
    windows = size_of.select("image_id", F.explode(origins(F.col("h"))).alias("y0"), "w").select("image_id", "y0", F.explode(origins(F.col("w"))).alias("x0"))
    on = cells.where(F.col(mask)).join(size_of, "image_id")
    cover = lambda n, at: F.filter(origins(F.col(n)), lambda o: (o <= F.col(at)) & (F.col(at) < o + size))
    hits = on.select("image_id", F.explode(cover("h", "y")).alias("y0"), "w", "x").select("image_id", "y0", F.explode(cover("w", "x")).alias("x0"))
    sums = hits.groupBy("image_id", "y0", "x0").agg(F.count(F.lit(1)).alias("n"))
    return windows.join(sums, ["image_id", "y0", "x0"], "left").select("image_id", "y0", "x0", F.coalesce("n", F.lit(0)).alias("n"))


def score_windows(cells: DataFrame, masks: dict[str, str], size: int, stride: int) -> DataFrame:
    """``image_id, category, y0, x0, score, place``: each window's share of each mask, and its place in its image by score, then x and y."""
    out = None
    for category, mask in masks.items():
        one = window_sums(cells, mask, size, stride).select("image_id", F.lit(category).alias("category"), "y0", "x0", F.round(F.col("n") / (size * size), 6).alias("score"))
        out = one if out is None else out.union(one)
    return out.withColumn("place", F.row_number().over(W.partitionBy("image_id", "category").orderBy(F.desc("score"), "x0", "y0")))


def cell_weights(cells: DataFrame, core: Column, valid: Column, halo: float = 1.0, transition: Column | None = None, level: Column | None = None, boosts: tuple[float, float, float] = (1.5, 2.0, 1.25)) -> DataFrame:
    """``weight``: 1 in the core, ``halo`` around it, 0 where not valid; times boosts for transitions, the darkest level and any level."""
    w = F.when(~valid, 0.0).when(core, 1.0).otherwise(halo)
    if transition is not None:
        w = w * F.when(transition, boosts[0]).otherwise(1.0)
    if level is not None:
        w = w * F.when(level == 2, boosts[1]).otherwise(1.0) * F.when(level.between(0, 2), boosts[2]).otherwise(1.0)
    return cells.withColumn("weight", F.round(w, 6))


def seg_areas(cells: DataFrame, target: str, pred: str, classes: int, ignore: int = 255, reduce_zero: bool = False) -> DataFrame:
    """``class, intersect, union, predicted, labelled`` of all classes; cells with the ignored label are left out.

    ``reduce_zero`` ignores label 0 and moves the others down by one.
    """
    t = F.when((F.col(target) == ignore) | (F.lit(reduce_zero) & (F.col(target) == 0)), None).otherwise(F.col(target) - (1 if reduce_zero else 0))
    counts = cells.select(t.alias("t"), F.col(pred).alias("p")).where("t is not null").groupBy("t", "p").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    zero = F.lit(0).cast("long")
    each = counts.select(F.inline(F.array(F.struct(F.col("t").cast("int").alias("class"), F.when(F.col("t") == F.col("p"), n).otherwise(zero).alias("i"), zero.alias("p"), n.alias("l")), F.struct(F.col("p").cast("int").alias("class"), zero.alias("i"), n.alias("p"), zero.alias("l")))))
    every = cells.sparkSession.range(classes).select(F.col("id").cast("int").alias("class"), zero.alias("i"), zero.alias("p"), zero.alias("l"))
    s = each.where((F.col("class") >= 0) & (F.col("class") < classes)).union(every).groupBy("class").agg(F.sum("i").alias("intersect"), F.sum("p").alias("predicted"), F.sum("l").alias("labelled"))
    return s.select("class", "intersect", (F.col("predicted") + F.col("labelled") - F.col("intersect")).alias("union"), "predicted", "labelled")


def seg_metrics(areas: DataFrame, beta: float = 1.0) -> DataFrame:
    """One row: means over the classes that a ratio exists for, of IoU, accuracy, dice, F score, precision and recall; and ``a_acc`` of all cells."""
    i, u, p, t = (F.col(c) for c in ("intersect", "union", "predicted", "labelled"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    precision, recall = ratio(i, p), ratio(i, t)
    f = ratio((1 + beta**2) * precision * recall, beta**2 * precision + recall)
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return areas.agg(mean(ratio(i, u), "miou"), mean(recall, "acc"), F.round(F.sum(i) / F.sum(t), 6).alias("a_acc"), mean(ratio(2 * i, p + t), "dice"), mean(f, "fscore"), mean(precision, "precision"), mean(recall, "recall"))


def region_scores(cells: DataFrame, regions: dict[str, Column], target: str, pred: str, classes: int, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Per key and region: cells, accuracy, and mean IoU over all classes, over those in the target, and over those in either; 0 for regions without cells.

    One aggregation for all regions and classes; predictions beyond the classes don't count.
    """
    live = F.col(pred).between(0, classes - 1) & F.col(target).between(0, classes - 1)
    flags = F.array(*[F.struct(F.lit(n).alias("region"), (c & live).alias("on"), (c & F.col(target).between(0, classes - 1)).alias("seen")) for n, c in regions.items()])
    each = cells.select(*keys, F.col(target).alias("t"), F.col(pred).alias("p"), F.inline(flags))
    t, p, on = F.col("t"), F.col("p"), F.col("on")
    aggs = [f(c) for c in range(classes) for f in (lambda c: F.count_if(on & (t == c) & (p == c)).alias(f"i{c}"), lambda c: F.count_if(on & (t == c)).alias(f"t{c}"), lambda c: F.count_if(on & (p == c)).alias(f"p{c}"), lambda c: F.max(F.col("seen") & (t == c)).alias(f"s{c}"))]
    s = each.groupBy(*keys, "region").agg(F.count_if("seen").alias("n"), F.count_if("on").alias("m"), *aggs)
    iou = [F.col(f"i{c}") / F.greatest(F.col(f"t{c}") + F.col(f"p{c}") - F.col(f"i{c}"), F.lit(1)) for c in range(classes)]
    total = lambda cols: sum(cols, F.lit(0.0))
    mean = lambda flags: F.round(F.coalesce(total(F.when(f, v).otherwise(0.0) for f, v in zip(flags, iou, strict=True)) / F.nullif(total(f.cast("int") for f in flags), F.lit(0.0)), F.lit(0.0)), 6)
    has = [F.coalesce(F.col(f"s{c}"), F.lit(False)) for c in range(classes)]
    acc = F.round(total(F.col(f"i{c}") for c in range(classes)) / F.greatest(F.col("m"), F.lit(1)), 6)
    return s.select(*keys, "region", "n", acc.alias("acc"), F.round(total(iou) / classes, 6).alias("miou"), mean(has).alias("miou_present"), mean([h | (F.col(f"p{c}") > 0) for c, h in enumerate(has)]).alias("miou_fp"))


def edges(cells: DataFrame, codes: dict[str, str]) -> DataFrame:
    """``cells`` with a flag for each ``name: code column``: a 4-neighbour has another code, both at least 0."""
    row, col = W.partitionBy("image_id", "y").orderBy("x"), W.partitionBy("image_id", "x").orderBy("y")
    out = cells
    for name, code in codes.items():
        differs = lambda step, w, code=code: F.coalesce((step(code).over(w) != F.col(code)) & (step(code).over(w) >= 0) & (F.col(code) >= 0), F.lit(False))
        out = out.withColumn(name, differs(F.lag, row) | differs(F.lead, row) | differs(F.lag, col) | differs(F.lead, col))
    return out


def boundary_f1(cells: DataFrame, target: str, pred: str, supervised: Column, tolerance: int = 2) -> DataFrame:
    """``bf1`` per image: boundaries of one side within ``tolerance`` steps of the other's; 1 if both have none, 0 if one has none."""
    marked = edges(cells, {"__gt": target, "__pr": pred}).select(*PLACE, (F.col("__gt") & supervised).alias("gt"), (F.col("__pr") & supervised).alias("pr"))
    near = around(marked, diamond(tolerance), ["gt", "pr"], [F.coalesce(F.bool_or("gt"), F.lit(False)).alias("gt_near"), F.coalesce(F.bool_or("pr"), F.lit(False)).alias("pr_near")], [])
    both = marked.join(near, PLACE)
    s = both.groupBy("image_id").agg(F.count_if("gt").alias("g"), F.count_if("pr").alias("p"), F.count_if(F.col("pr") & F.col("gt_near")).alias("hp"), F.count_if(F.col("gt") & F.col("pr_near")).alias("hg"))
    precision, recall = F.col("hp") / F.greatest("p", F.lit(1)), F.col("hg") / F.greatest("g", F.lit(1))
    f = F.when((F.col("g") == 0) & (F.col("p") == 0), 1.0).when((F.col("g") == 0) | (F.col("p") == 0) | (precision + recall < 1e-8), 0.0).otherwise(2 * precision * recall / (precision + recall))
    return s.select("image_id", F.round(f, 6).alias("bf1"))


def boundary_regions(cells: DataFrame, target: str, transition: str, supervised: Column, radius: int = 2) -> DataFrame:
    """``cells`` with ``supervised, near_boundary``: within ``radius`` of a transition or half of that of a class boundary, by squares."""
    marked = edges(cells, {"__edge": target}).withColumn("supervised", supervised)
    grown = dilate(marked, transition, radius).select(*PLACE, F.col("grown").alias("__a"))
    inner = dilate(marked, "__edge", max(1, radius // 2)).select(*PLACE, F.col("grown").alias("__b"))
    out = marked.join(grown, PLACE).join(inner, PLACE)
    return out.withColumn("near_boundary", (F.col("__a") | F.col("__b")) & F.col("supervised")).drop("__a", "__b", "__edge")


def boundary_eval(cells: DataFrame, target: str, pred: str, transition: str, supervised: Column, classes: int, radius: int = 2, tolerance: int = 2) -> DataFrame:
    """Per image: mean IoU and accuracy of all supervised cells, of those near boundaries and of the rest; counts; boundary F1."""
    marked = boundary_regions(cells, target, transition, supervised, radius)
    near = F.col("near_boundary")
    s = region_scores(marked, {"global": F.col("supervised"), "boundary": near, "interior": F.col("supervised") & ~near}, target, pred, classes)
    pick = lambda region, col, name: F.max(F.when(F.col("region") == region, F.col(col))).alias(name)
    wide = s.groupBy("image_id").agg(*[pick(r, c, f"{r}_{c}") for r in ("global", "boundary", "interior") for c in ("miou", "acc")], pick("boundary", "n", "boundary_n"), pick("interior", "n", "interior_n"))
    return wide.join(boundary_f1(cells, target, pred, supervised, tolerance), "image_id")


def average_eval(rows: DataFrame) -> DataFrame:
    """The means over images of ``boundary_eval``'s scores, and the sums of its counts."""
    scores = ["global_miou", "global_acc", "boundary_miou", "boundary_acc", "interior_miou", "interior_acc", "bf1"]
    return rows.agg(*[F.round(F.avg(c), 6).alias(c) for c in scores], F.sum("boundary_n").alias("boundary_n"), F.sum("interior_n").alias("interior_n"))


def small_component_scores(cells: DataFrame, target: str, pred: str, supervised: Column, classes: list[int], most: int = 256) -> DataFrame:
    """Per image: mean recall and F1 of the target's components of at most ``most`` cells, against the predicted component of their class that overlaps most.

    Ties go to the component that begins first. Images without such components have no row.
    """
    live = cells.where(supervised)
    part = lambda col, p: label_components(live.where(F.col(col).isin(classes)), col).select(*PLACE, F.col("code").alias(f"{p}_code"), F.struct("root_y", "root_x").alias(f"{p}_root"))
    gt, pr = part(target, "g"), part(pred, "p")
    sizes = pr.groupBy("image_id", "p_code", "p_root").agg(F.count(F.lit(1)).alias("size"))
    both = gt.join(pr, PLACE, "left").groupBy("image_id", "g_code", "g_root", "p_code", "p_root").agg(F.count(F.lit(1)).alias("n"))
    area = F.sum("n").over(W.partitionBy("image_id", "g_code", "g_root"))
    both = both.withColumn("area", area).where(F.col("area") <= most).join(sizes, ["image_id", "p_code", "p_root"], "left")
    same = F.col("p_code") == F.col("g_code")
    best = both.groupBy("image_id", "g_code", "g_root").agg(F.max("area").alias("area"), F.max(F.when(same, F.col("n"))).alias("overlap"), F.min_by("size", F.when(same, F.struct((-F.col("n")).alias("n"), "p_root"))).alias("size"))
    overlap, size = F.coalesce("overlap", F.lit(0)), F.when(F.col("overlap").isNotNull(), F.col("size")).otherwise(0)
    recall, precision = overlap / F.greatest("area", F.lit(1)), overlap / F.greatest(size, F.lit(1))
    each = best.select("image_id", recall.alias("r"), (2 * precision * recall / F.greatest(precision + recall, F.lit(1e-8))).alias("f"))
    return each.groupBy("image_id").agg(F.count(F.lit(1)).alias("parts"), F.round(F.avg("r"), 12).alias("recall"), F.round(F.avg("f"), 12).alias("f1"))


def tiny_agreement(cells: DataFrame, target: str, pred: str, mask: Column, tiny: int = 64) -> DataFrame:
    """Per image: mean share of right cells over the mask's components (8 neighbours) of at most ``tiny`` cells; images with none have no row."""
    inside = cells.where(mask)
    labelled = label_components(inside.withColumn("__one", F.lit(1)), "__one", diagonal=True)
    both = labelled.join(inside.select(*PLACE, (F.col(target) == F.col(pred)).alias("right")), PLACE)
    each = both.groupBy("image_id", "root_y", "root_x").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("right").cast("int")).alias("a")).where(F.col("n") <= tiny)
    return each.groupBy("image_id").agg(F.count(F.lit(1)).alias("parts"), F.round(F.avg("a"), 6).alias("agreement"))


def square_regions(cells: DataFrame, core: int, seam: int, border: int, corner: int) -> dict[str, Column]:
    """Regions of an image by place, for cells that have ``h`` and ``w``: within seams of tiles of ``core``, along the outside, in the corners."""
    y, x, h, w = (F.col(c) for c in ("y", "x", "h", "w"))
    near = lambda v, n: (F.pmod(v, F.lit(core)) < seam) & (v >= core - 0) | (F.pmod(v, F.lit(core)) >= core - seam) & ((F.floor(v / core) + 1) * core < n)
    outer = lambda v, n, band: (v < F.least(F.lit(band), n)) | (v >= n - F.least(F.lit(band), n))
    return {"core": F.lit(True), "seam": near(y, h) | near(x, w), "border": outer(y, h, border) | outer(x, w, border), "corner": outer(y, h, corner) & outer(x, w, corner)}


def region_metrics(cells: DataFrame, target: str, pred: str, supervised: Column, classes: int, core: int, seam: int, border: int, corner: int, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """One row per image and region (global, core, seam, border, corner) of ``region_scores``."""
    size = cells.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    regions = {n: c & supervised for n, c in square_regions(cells, core, seam, border, corner).items()}
    return region_scores(cells.join(size, "image_id"), {"global": supervised, **regions}, target, pred, classes, keys)


def aggregate_regions(rows: DataFrame, orientation: str = "k") -> DataFrame:
    """Per region: means over rows with cells, and the least of the orientations' means (over the first eight)."""
    each = rows.where(F.col(orientation).between(0, 7)).groupBy("region", orientation).agg(F.avg("miou_present").alias("m"), F.avg("miou_fp").alias("f"))
    worst = each.groupBy("region").agg(F.round(F.min("m"), 6).alias("worst_miou"), F.round(F.min("f"), 6).alias("worst_miou_fp"))
    means = rows.groupBy("region").agg(F.round(F.avg(F.when(F.col("n") > 0, F.col("miou_present"))), 6).alias("miou"), F.round(F.avg(F.when(F.col("n") > 0, F.col("miou_fp"))), 6).alias("miou_fp"), F.round(F.avg(F.when(F.col("n") > 0, F.col("acc"))), 6).alias("acc"))
    return means.join(worst, "region", "left")


#: Weights of the composite scores by kind.
COMPOSITES = {"small_parts": {"miou": 0.55, "bf1": 0.30, "small_f1": 0.15}, "boundary": {"miou": 0.35, "boundary_miou": 0.35, "bf1": 0.20, "boundary_acc": 0.10}}


def composite_score(rows: DataFrame, kind: str, name: str = "score") -> DataFrame:
    """The weighted sum of the kind's columns; a missing value makes the rest's weights count in its place."""
    weights = COMPOSITES[kind]
    total = sum((F.when(F.col(c).isNotNull(), w * F.col(c)).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    held = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return rows.withColumn(name, F.round(total / F.nullif(held, F.lit(0.0)), 12))
