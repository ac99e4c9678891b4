"""Tiles and boxes as arithmetic on columns."""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def core_tiles(images: DataFrame, core: int, halo: int) -> DataFrame:
    """A grid of clipped cores per image, each with its halo window."""
    at = images.withColumn("core_y", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(core)))).withColumn("core_x", F.explode(F.sequence(F.lit(0), F.col("width") - 1, F.lit(core))))
    w, h = F.least(F.lit(core), F.col("width") - F.col("core_x")), F.least(F.lit(core), F.col("height") - F.col("core_y"))
    return at.select("image_id", "core_x", "core_y", w.alias("core_w"), h.alias("core_h"), (F.col("core_x") - halo).alias("in_x"), (F.col("core_y") - halo).alias("in_y"), F.round(F.col("core_x") / F.col("width"), 6).alias("nx"), F.round(F.col("core_y") / F.col("height"), 6).alias("ny"))


def overlap_tiles(images: DataFrame, tile: int, stride: int) -> DataFrame:
    """Starts at every stride and one flush with the far edge, each once."""
    starts = lambda n: F.array_union(F.filter(F.sequence(F.lit(0), n, F.lit(stride)), lambda s: s + tile <= n), F.array(F.greatest(n - tile, F.lit(0))))
    return images.select("image_id", "width", "height", F.explode(starts(F.col("height"))).alias("y")).select("image_id", F.explode(starts(F.col("width"))).alias("x"), "y")


def box_iou(boxes: DataFrame, least: float = 0.0, spread: int = 8) -> DataFrame:
    """Pairs of one image's boxes with their IoU, where it exceeds ``least`` (0 or more).

    A box's level is the power of two at or above its longer side, and blocks of a level are ``spread`` times that: a box
    lies in four blocks at most. A pair meets at the larger box's level, so a box also goes to its image's higher levels, and
    counts in the first block that both cover. Boxes without area overlap nothing.
    """
    level = F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(F.greatest("w", "h").cast("double"))), F.lit(0))).cast("long") * spread
    own = boxes.where("w > 0 and h > 0").select("image_id", "n", "x", "y", "w", "h", level.alias("level"))
    levels = own.groupBy("image_id").agg(F.collect_set("level").alias("levels"))  # a few whole numbers an image
    cover = lambda c, s: F.sequence(F.floor(F.col(c) / F.col("at")), F.floor((F.col(c) + F.col(s) - 1e-9) / F.col("at")))
    spots = lambda df: df.withColumn("bx", F.explode(cover("x", "w"))).withColumn("by", F.explode(cover("y", "h")))
    low = spots(own.join(levels, "image_id").withColumn("at", F.explode(F.filter("levels", lambda v: v >= F.col("level")))).drop("levels"))
    high = spots(own.withColumn("at", F.col("level")))
    key = ["image_id", "at", "bx", "by"]
    one = lambda df, k: df.select(*key, *[F.col(c).alias(f"{c}{k}") for c in ("n", "x", "y", "w", "h", "level")])
    first = (F.col("bx") == F.floor(F.greatest("x1", "x2") / F.col("at"))) & (F.col("by") == F.floor(F.greatest("y1", "y2") / F.col("at")))
    once = (F.col("level1") < F.col("level2")) | (F.col("n1") < F.col("n2"))
    both = one(low, 1).join(one(high, 2), key).where(once & first)
    shared = lambda p, s: F.greatest(F.lit(0), F.least(F.col(f"{p}1") + F.col(f"{s}1"), F.col(f"{p}2") + F.col(f"{s}2")) - F.greatest(f"{p}1", f"{p}2"))
    inter = shared("x", "w") * shared("y", "h")
    iou = F.round(inter / (F.col("w1") * F.col("h1") + F.col("w2") * F.col("h2") - inter), 6)
    return both.select("image_id", F.least("n1", "n2").alias("n1"), F.greatest("n1", "n2").alias("n2"), iou.alias("iou"), (iou >= 0.9).alias("same")).where(F.col("iou") > least)


def box_convert(boxes: DataFrame, size: int) -> DataFrame:
    """Centre form, clamped corners and their share of the size."""
    clamp = lambda c: F.greatest(F.lit(0), F.least(c, F.lit(size)))
    x2, y2 = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    return boxes.select("image_id", "n", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"), clamp(x2).alias("x2"), clamp(y2).alias("y2"), F.round(clamp(x2) / size, 6).alias("nx2"), F.round(clamp(y2) / size, 6).alias("ny2"))


def orient_cells(cells: DataFrame, size: int) -> DataFrame:
    """Eight orientations of square rasters: k quarter turns, then a mirror from k = 4 on."""
    at = cells.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    y, x, m = F.col("y"), F.col("x"), F.lit(size - 1)
    turn = F.col("k") % 4
    ny = F.when(turn == 0, y).when(turn == 1, m - x).when(turn == 2, m - y).otherwise(x)
    nx = F.when(turn == 0, x).when(turn == 1, y).when(turn == 2, m - x).otherwise(m - y)
    return at.withColumn("oy", ny).withColumn("ox", F.when(F.col("k") >= 4, m - nx).otherwise(nx))


def orient_place(y: Column, x: Column, h: Column, w: Column, k: Column) -> tuple[Column, Column]:
    """Where a cell of an image of ``h`` rows and ``w`` columns goes: k quarter turns, then a mirror from k = 4 on."""
    turn = k % 4
    oy = F.when(turn == 0, y).when(turn == 1, w - 1 - x).when(turn == 2, h - 1 - y).otherwise(x)
    ox = F.when(turn == 0, x).when(turn == 1, y).when(turn == 2, w - 1 - x).otherwise(h - 1 - y)
    return oy, F.when(k >= 4, F.when(turn % 2 == 1, h).otherwise(w) - 1 - ox).otherwise(ox)


def restore_place(oy: Column, ox: Column, h: Column, w: Column, k: Column) -> tuple[Column, Column]:
    """Where a cell of an oriented image comes from; ``h`` and ``w`` are those of the image before it was turned."""
    turn = k % 4
    ox = F.when(k >= 4, F.when(turn % 2 == 1, h).otherwise(w) - 1 - ox).otherwise(ox)
    y = F.when(turn == 0, oy).when(turn == 1, ox).when(turn == 2, h - 1 - oy).otherwise(h - 1 - ox)
    x = F.when(turn == 0, ox).when(turn == 1, w - 1 - oy).when(turn == 2, w - 1 - ox).otherwise(oy)
    return y, x


def region_flags(cells: DataFrame, size: int, band: int) -> DataFrame:
    """Border, corner and core cells of square rasters."""
    near = lambda c: (F.col(c) < band) | (F.col(c) >= size - band)
    return cells.withColumn("border", near("y") | near("x")).withColumn("corner", near("y") & near("x")).withColumn("core", ~(near("y") | near("x")))


def orient_boxes(boxes: DataFrame) -> DataFrame:
    """Normalised boxes ``x, y, w, h`` under eight orientations ``k``: the box itself, mirrors, half turns and the four with sides swapped."""
    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    u, v = 1 - x - w, 1 - y - h
    ways = [(x, y, w, h), (u, y, w, h), (x, v, w, h), (u, v, w, h), (y, u, h, w), (u, v, w, h), (v, x, h, w), (v, u, h, w)]
    each = F.array(*[F.struct(F.lit(k).alias("k"), *[F.round(c, 6).alias(n) for c, n in zip(way, ("ox", "oy", "ow", "oh"), strict=True)]) for k, way in enumerate(ways)])
    return boxes.select("image_id", "n", F.inline(each))


def box_encode(boxes: DataFrame) -> DataFrame:
    """``dx, dy, dw, dh`` of a wanted centre box ``g*`` against a proposal ``p*``; the proposal's sides have 0.1 added."""
    r = lambda c: F.round(c, 6)
    w, h = F.col("pw") + 0.1, F.col("ph") + 0.1
    return boxes.select("*", r((F.col("gx") - F.col("px")) / w).alias("dx"), r((F.col("gy") - F.col("py")) / h).alias("dy"), r(F.ln(F.col("gw") / w)).alias("dw"), r(F.ln(F.col("gh") / h)).alias("dh"))


def box_decode(boxes: DataFrame, width: float, height: float, least_ratio: float = 16 / 1000) -> DataFrame:
    """Corners of proposals ``p*`` moved by ``d*``: the logs of side ratios are cut at that of ``least_ratio``, corners at the image."""
    top = abs(log(least_ratio))
    cut = lambda c: F.greatest(F.least(c, F.lit(top)), F.lit(-top))
    cx, cy = F.col("px") + F.col("pw") * F.col("dx"), F.col("py") + F.col("ph") * F.col("dy")
    w, h = F.col("pw") * F.exp(cut(F.col("dw"))), F.col("ph") * F.exp(cut(F.col("dh")))
    side = lambda c, most: F.round(F.greatest(F.least(c, F.lit(float(most))), F.lit(0.0)), 4)
    return boxes.select("*", side(cx - w / 2, width).alias("x1"), side(cy - h / 2, height).alias("y1"), side(cx + w / 2, width).alias("x2"), side(cy + h / 2, height).alias("y2"))


def decode_detections(preds: DataFrame, key: str, k: int) -> DataFrame:
    """``key, place, label, score, x1, y1, x2, y2`` of ``preds(key, query, logits, cx, cy, w, h, width, height)``: the k best of all queries and classes, ties by query, then class."""
    each = preds.select(key, "query", "cx", "cy", "w", "h", "width", "height", F.posexplode("logits").alias("label", "z"))
    each = each.withColumn("score", F.round(1 / (1 + F.exp(-F.col("z").cast("double"))), 6))
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "query", "label"))
    best = each.withColumn("place", place).where(F.col("place") <= k)
    at = lambda c, s, sign, size: F.round((F.col(c) + sign * F.col(s) / 2) * F.col(size), 4)
    return best.select(key, "place", "label", "score", at("cx", "w", -1, "width").alias("x1"), at("cy", "h", -1, "height").alias("y1"), at("cx", "w", 1, "width").alias("x2"), at("cy", "h", 1, "height").alias("y2"))


def letterbox(images: DataFrame, size: int) -> DataFrame:
    """``scale, content_w, content_h, offset_x, offset_y`` of images fitted into a square; sizes are rounded half to even, offsets floored."""
    scale = F.least(size / F.col("height"), size / F.col("width"))
    fit = lambda c: F.least(F.greatest(F.lit(1), F.bround(F.col(c) * scale, 0)), F.lit(size)).cast("int")
    out = images.select("*", scale.alias("scale"), fit("width").alias("content_w"), fit("height").alias("content_h"))
    return out.withColumn("offset_x", F.floor((size - F.col("content_w")) / 2)).withColumn("offset_y", F.floor((size - F.col("content_h")) / 2))


def crop_to_letterbox(points: DataFrame, size: int) -> DataFrame:
    """``lx, ly``: points ``u, v`` of a normalised crop ``x, y, w, h`` of an image, in its letterbox."""
    at = lambda c, s, p, n, off: F.round((F.col(off) + (F.col(c) + F.col(p) * F.col(s)) * F.col(n) * F.col("scale")) / size, 6)
    return points.withColumn("lx", at("x", "w", "u", "width", "offset_x")).withColumn("ly", at("y", "h", "v", "height", "offset_y"))


def uv_to_cell(u: Column, v: Column, rows: int, cols: int) -> tuple[Column, Column]:
    """Row and column of a normalised point, within the grid."""
    cell = lambda c, n: F.greatest(F.least(F.floor(c * n), F.lit(n - 1)), F.lit(0))
    return cell(v, rows), cell(u, cols)


def cell_to_xy(row: Column, col: Column, rows: int, cols: int, width: Column, height: Column) -> tuple[Column, Column]:
    """The pixel in the middle of a cell."""
    return (col + 0.5) / cols * width, (row + 0.5) / rows * height


def coverage(images: DataFrame, tiles: DataFrame) -> DataFrame:
    """``image_id, holes, over``: pixels that no tile ``x, y, w, h`` covers, and those that several do. Tiles are cut at the image.

    An image's tiles cut it into rectangles; those are counted, so work grows with tiles and not with pixels.
    """
    inner = tiles.join(images.select("image_id", "width", "height"), "image_id")
    clip = lambda c, n: F.greatest(F.least(c, F.col(n)), F.lit(0))
    t = inner.select("image_id", clip(F.col("x"), "width").alias("x0"), clip(F.col("x") + F.col("w"), "width").alias("x1"), clip(F.col("y"), "height").alias("y0"), clip(F.col("y") + F.col("h"), "height").alias("y1")).where("x1 > x0 and y1 > y0")

    def strips(a: str, b: str, n: str, lo: str, hi: str) -> DataFrame:
        cuts = images.select("image_id", F.explode(F.array(F.lit(0), F.col(n))).alias("c")).union(t.select("image_id", F.explode(F.array(a, b)).alias("c"))).distinct()
        after = F.lead("c").over(W.partitionBy("image_id").orderBy("c"))
        return cuts.select("image_id", F.col("c").alias(lo), after.alias(hi)).where(F.col(hi).isNotNull())

    xs, ys = strips("x0", "x1", "width", "u0", "u1"), strips("y0", "y1", "height", "v0", "v1")
    # Tiles in each strip across, then a running count down the strip: no pair of a rectangle and a tile that misses its strip.
    per = t.join(xs, "image_id").where("x0 <= u0 and x1 >= u1").select("image_id", "u0", "u1", F.inline(F.array(F.struct(F.col("y0").alias("at"), F.lit(1).alias("step")), F.struct(F.col("y1").alias("at"), F.lit(-1).alias("step")))))
    rows = xs.join(ys, "image_id").select("image_id", "u0", "u1", F.col("v0").alias("at"), F.lit(0).alias("step"), F.col("v1"))
    steps = rows.unionByName(per.withColumn("v1", F.lit(None).cast("int")))
    at = steps.groupBy("image_id", "u0", "u1", "at").agg(F.sum("step").alias("step"), F.max("v1").alias("v1"))
    held = F.sum("step").over(W.partitionBy("image_id", "u0", "u1").orderBy("at"))
    area = (F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("at"))
    counted = at.withColumn("n", held).where("v1 is not null").withColumn("area", area.cast("long"))
    sums = counted.groupBy("image_id").agg(F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("area"))), F.lit(0)).alias("holes"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("area"))), F.lit(0)).alias("over"))
    return images.select("image_id").join(sums, "image_id", "left").select("image_id", F.coalesce("holes", F.lit(0)).alias("holes"), F.coalesce("over", F.lit(0)).alias("over"))


#: Tries of an image before all of them are gone through one by one.
FIRST_TRIES = 16


def offgrid_origins(images: DataFrame, size: int, core: int, halo: int, n: int, region: str, seed: int) -> DataFrame:
    """``image_id, ox, oy, place``: ``n`` window origins per image inside, at an edge or in a corner, none of them on the grid.

    Origins are drawn by a hash of seed, image and try; of ``max(80 n, 200)`` tries the first good ones count, and none is drawn
    behind them. Windows lie in the image where it is large enough; canonical origins are those of cores less the halo, and both
    multiples of ``core``.
    """
    if region not in ("interior", "edge", "corner"):
        raise ValueError(f"unknown region: {region}")
    tries = max(n * 80, 200)
    draw = lambda t, k, most: F.pmod(F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(region), F.col("image_id").cast("string"), t.cast("string"), F.lit(k)), 256), 1, 12), 16, 10).cast("long"), most)
    each = images.select("image_id", F.greatest(F.col("width") - size, F.lit(0)).cast("long").alias("mx"), F.greatest(F.col("height") - size, F.lit(0)).cast("long").alias("my"))
    # A table of a few numbers a row is read by few tasks, but draws take long.
    spark = images.sparkSession
    each = each.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "image_id")
    free = lambda t, k, m: draw(t, k, F.col(m) + 1)
    ends = lambda t, k, m: F.when(draw(t, k, F.lit(2)) == 0, F.lit(0)).otherwise(F.col(m))
    ox = free if region == "interior" else ends
    oy = ends if region == "corner" else free
    at = lambda t: F.struct(ox(t, "x", "mx").cast("long").alias("ox"), oy(t, "y", "my").cast("long").alias("oy"), t.alias("t"))
    grid = lambda c: F.pmod(c + halo, F.lit(core)) == 0
    good = lambda o: ~(grid(o["ox"]) & grid(o["oy"])) & ~((o["ox"] % core == 0) & (o["oy"] % core == 0))
    new = lambda got, o: ~F.exists(got, lambda g: (g["ox"] == o["ox"]) & (g["oy"] == o["oy"]))
    # A draw is made when its turn comes and origins are still missing; the filter holds it, so that it's made once.
    more = lambda got, t: F.when(F.size(got) >= n, got).otherwise(F.concat(got, F.filter(F.array(at(t)), lambda o: good(o) & new(got, o))))
    none = F.array().cast("array<struct<ox: bigint, oy: bigint, t: int>>")
    some = F.aggregate(F.sequence(F.lit(0), F.lit(FIRST_TRIES - 1)), none, more)
    found = F.transform(F.array(some), lambda got: F.when(F.size(got) >= n, got).otherwise(F.aggregate(F.sequence(F.lit(FIRST_TRIES), F.lit(tries - 1)), got, more)))
    # Windows as large as the image have the one origin 0, 0, which is on the grid.
    first = each.where("mx > 0 or my > 0").select("image_id", F.inline(F.get(found, F.lit(0))))
    once = first.groupBy("image_id", "ox", "oy").agg(F.min("t").alias("t"))
    return once.withColumn("place", F.row_number().over(W.partitionBy("image_id").orderBy("t"))).where(F.col("place") <= n).select("image_id", "ox", "oy", "place")


def capacity_manifest(images: DataFrame, core: int, halo: int, size: int, offgrid: int, seed: int) -> DataFrame:
    """``image_id, k, core_x, core_y, region, tile_uid``: grid tiles and off-grid ones of each of eight orientations (odd ones have sides swapped); the first of a uid stays.

    Grid tiles come before off-grid ones.
    """
    turned = images.select("image_id", "width", "height", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    swap = F.col("k") % 2 == 1
    turned = turned.select(F.concat_ws("|", F.col("image_id").cast("string"), F.col("k").cast("string")).alias("image_id"), F.when(swap, F.col("height")).otherwise(F.col("width")).alias("width"), F.when(swap, F.col("width")).otherwise(F.col("height")).alias("height"))
    grid = core_tiles(turned, core, halo).select("image_id", F.col("core_x").cast("long").alias("core_x"), F.col("core_y").cast("long").alias("core_y"), F.lit("grid").alias("region"), F.lit(0).alias("o"))
    parts = [offgrid_origins(turned, size, core, halo, offgrid, r, seed).select("image_id", (F.col("ox") + halo).alias("core_x"), (F.col("oy") + halo).alias("core_y"), F.lit(r).alias("region"), F.lit(i + 1).alias("o")) for i, r in enumerate(("interior", "edge", "corner"))]
    for p in parts:
        grid = grid.union(p)
    ids = F.split("image_id", r"\|")
    rows = grid.select(ids[0].cast("long").alias("image_id"), ids[1].cast("int").alias("k"), "core_x", "core_y", "region", "o")
    uid = F.concat(F.col("image_id").cast("string"), F.lit("__t"), F.col("k").cast("string"), F.lit("__"), F.col("core_x").cast("string"), F.lit("_"), F.col("core_y").cast("string"))
    return rows.groupBy("image_id", "k", "core_x", "core_y").agg(F.min_by("region", "o").alias("region")).withColumn("tile_uid", uid)


def subscenes(images: DataFrame, sizes: tuple[int, ...] = (512, 768, 1024)) -> DataFrame:
    """``image_id, size, x, y, w, h``: a centred window of each size, cut at the image; sizes beyond the image's longer side are left out after the first that holds it."""
    each = images.select("image_id", "width", "height", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size"))
    longest = F.greatest("width", "height")
    smaller = F.coalesce(F.lag("size").over(W.partitionBy("image_id").orderBy("size")), F.lit(0))
    each = each.withColumn("__s", smaller).where(F.col("__s") < longest)
    w, h = F.least("size", "width"), F.least("size", "height")
    return each.select("image_id", "size", F.floor((F.col("width") - w) / 2).alias("x"), F.floor((F.col("height") - h) / 2).alias("y"), w.alias("w"), h.alias("h"))


def manifest_summary(rows: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """Per kind of row: how many there are, of how many images, and a fingerprint of the keys in any order."""
    from tessella.sources.manifests import fingerprint

    counts = rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("image_id").alias("images"))
    return counts.crossJoin(F.broadcast(fingerprint(rows, [kind, *keys])))  # one row


def training_manifest(crops: DataFrame, size: int, least: float, score: str, category: str, rich: str, holdout: int) -> DataFrame:
    """``image_id, n, k, mode, split, group_id``: square crops of ``size`` with a score of ``least`` or of the rich category, in eight orientations and two input modes.

    The first ``holdout`` images by id that have such crops of that size are val.
    """
    own = crops.where((F.col("w") == size) & (F.col("h") == size))
    held = own.select("image_id").distinct().orderBy("image_id").limit(holdout).withColumn("__v", F.lit(True))
    kept = own.where((F.col(score) >= least) | (F.col(category) == rich)).join(held, "image_id", "left")
    group = F.concat(F.col("image_id").cast("string"), F.lit("__"), F.col("x").cast("string"), F.lit("_"), F.col("y").cast("string"))
    each = kept.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("mode", F.explode(F.array(F.lit("bw"), F.lit("guide"))))
    return each.select("image_id", "n", "k", "mode", F.when(F.col("__v"), "val").otherwise("train").alias("split"), group.alias("group_id"))


def extract_tiles(cells: DataFrame, tiles: DataFrame, pad: int, fill: int) -> DataFrame:
    """``image_id, tile, ty, tx, code, inside``: each tile's cells and ``pad`` around it, in its own places; ``fill`` beyond the image.

    Cells are found by place, of tiles of bounded size: a tile sends its places to the image's cells.
    """
    span = lambda c: F.sequence(F.lit(-pad), F.col(c) - 1 + pad)
    spots = tiles.select("image_id", "tile", "x", "y", "w", F.explode(span("h")).alias("ty")).select("image_id", "tile", "x", "y", "ty", F.explode(span("w")).alias("tx"))
    spots = spots.select("image_id", "tile", "ty", "tx", (F.col("y") + F.col("ty")).alias("__y"), (F.col("x") + F.col("tx")).alias("__x"))
    own = cells.select("image_id", F.col("y").alias("__y"), F.col("x").alias("__x"), "code")
    return spots.join(own, ["image_id", "__y", "__x"], "left").select("image_id", "tile", "ty", "tx", F.coalesce("code", F.lit(fill)).alias("code"), F.col("code").isNotNull().alias("inside"))


def crop_stats(cells: DataFrame, tiles: DataFrame, margin: int, codes: list[int], edge: str, region: str) -> DataFrame:
    """Per tile: cells of the region, those in its centre, edge cells of the region, and cells of each code in the region."""
    inside = cells.join(tiles.select("image_id", "tile", "x0", "y0", "w", "h"), "image_id").where("x >= x0 and x < x0 + w and y >= y0 and y < y0 + h")
    r = F.col(region)
    mid = (F.col("x") >= F.col("x0") + margin) & (F.col("x") < F.col("x0") + F.col("w") - margin) & (F.col("y") >= F.col("y0") + margin) & (F.col("y") < F.col("y0") + F.col("h") - margin)
    return inside.groupBy("image_id", "tile").agg(F.count_if(r).alias("region"), F.count_if(r & mid).alias("center"), F.count_if(r & F.col(edge)).alias("edges"), *[F.count_if(r & (F.col("code") == c)).alias(f"code_{c}") for c in codes])


def hann(place: Column, size: Column) -> Column:
    """The window's weight at a place from 0; 1 for a size of 1."""
    return F.when(size > 1, 0.5 - 0.5 * F.cos(2 * pi * place / (size - 1))).otherwise(1.0)


def blend_tiles(preds: DataFrame, mode: str = "hann") -> DataFrame:
    """``image_id, y, x, value`` of ``preds(image_id, y, x, ty, tx, size, value)``: the weighted mean of tiles that overlap.

    Weights are a Hann window (at least 1e-3), a raised cosine over places (tx + 0.5), or 1 (``count``).
    """
    size = F.col("size")
    if mode == "hann":
        w = F.greatest(hann(F.col("ty"), size) * hann(F.col("tx"), size), F.lit(1e-3))
    elif mode == "cosine":
        w = F.sin(pi * (F.col("ty") + 0.5) / size) * F.sin(pi * (F.col("tx") + 0.5) / size)
    elif mode == "count":
        w = F.lit(1.0)
    else:
        raise ValueError(f"unknown mode: {mode}")
    return preds.withColumn("__w", w).groupBy("image_id", "y", "x").agg(F.round(F.sum(F.col("value") * F.col("__w")) / F.greatest(F.sum("__w"), F.lit(1e-6)), 6).alias("value"))


def tta_average(preds: DataFrame, classes: int) -> DataFrame:
    """``image_id, y, x, pred, confidence`` of ``preds(image_id, y, x, probs)``, several rows a cell: the class of the largest mean, ties to the smaller."""
    means = preds.groupBy("image_id", "y", "x").agg(*[F.round(F.avg(F.get("probs", F.lit(c))), 6).alias(f"c{c}") for c in range(classes)])
    each = F.array(*[F.col(f"c{c}") for c in range(classes)])
    return means.select("image_id", "y", "x", (F.array_position(each, F.array_max(each)) - 1).cast("int").alias("pred"), F.array_max(each).alias("confidence"))


def valid_cells(cells: DataFrame, value: str, low: float, high: float, crop: tuple[int, int, int, int], size: tuple[int, int]) -> DataFrame:
    """``valid``: the value lies within (low, high) and the cell in the crop ``y1, y2, x1, x2`` of a ``size`` (height, width), scaled to the image's own."""
    own = cells.groupBy("image_id").agg((F.max("y") + 1).alias("__h"), (F.max("x") + 1).alias("__w"))
    y1, y2, x1, x2 = crop
    edge = lambda v, n, c: F.floor(F.lit(v / n) * F.col(c))
    inside = (F.col("y") >= edge(y1, size[0], "__h")) & (F.col("y") < edge(y2, size[0], "__h")) & (F.col("x") >= edge(x1, size[1], "__w")) & (F.col("x") < edge(x2, size[1], "__w"))
    return cells.join(own, "image_id").withColumn("valid", inside & (F.col(value) > low) & (F.col(value) < high)).drop("__h", "__w")
