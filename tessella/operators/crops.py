"""Crops of labelled images: sampled by quotas of strategies, or the best window of each category."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.hashing import hash_order

from .geometry import crop_stats
from .raster import component_stats, edges, label_components

# The strategies' shares without and with a grid.
SHARES = {"shade_boundary": 0.45, "candidate_component": 0.30, "rare_class": 0.15, "uniform_candidate": 0.10}
GRID_SHARES = {"spatial_grid": 0.40, "edge_candidate": 0.20, "shade_boundary": 0.20, "candidate_component": 0.10, "rare_class": 0.05, "uniform_candidate": 0.05}
# End of fixed values.

ORDER = ["spatial_grid", "edge_candidate", "shade_boundary", "candidate_component", "rare_class", "uniform_candidate"]
CROP = "array<struct<x:int,y:int,strategy:string,forced:boolean,tiny:boolean>>"


def quotas(total: int, shares: dict[str, float]) -> dict[str, int]:
    """``total`` dealt by shares: whole parts first, what is left to the largest fractions, ties by name."""
    out = {s: math.floor(v * total) for s, v in shares.items()}
    rest = sorted(shares, key=lambda s: (out[s] - shares[s] * total, s))
    for s in rest[: total - sum(out.values())]:
        out[s] += 1
    return out


def _origins(length: Column, size: int, stride: int) -> Column:
    """Starts at every stride and one flush with the end; 0 where the image is no larger than the window."""
    last = F.greatest(length - size, F.lit(0))
    return F.array_union(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last))


def grid_boxes(images: DataFrame, size: int, stride: int) -> DataFrame:
    """``image_id, x, y, n``: a dense grid by rows, then corners and the middles of sides that it lacks, numbered from 0."""
    at = images.select("image_id", F.greatest(F.col("width") - size, F.lit(0)).alias("lx"), F.greatest(F.col("height") - size, F.lit(0)).alias("ly"), _origins(F.col("width"), size, stride).alias("xs"), _origins(F.col("height"), size, stride).alias("ys"))
    box = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    grid = F.flatten(F.transform("ys", lambda y: F.transform("xs", lambda x: box(x, y))))
    lx, ly, zero = F.col("lx"), F.col("ly"), F.lit(0)
    mx, my = F.floor(lx / 2), F.floor(ly / 2)
    ends = [(zero, zero), (lx, zero), (zero, ly), (lx, ly), (mx, zero), (mx, ly), (zero, my), (lx, my)]
    return at.select("image_id", F.posexplode(F.array_union(grid, F.array(*[box(x, y) for x, y in ends]))).alias("n", "b")).select("image_id", "b.x", "b.y", "n")


def _placed(rows: DataFrame, size: int, outside: bool) -> DataFrame:
    """``rows`` with the origin ``x, y`` of the window around the point ``px, py``, inside the image or overhanging it."""

    def at(point: str, length: str) -> Column:
        start = F.bround(F.col(point) - size / 2, 0).cast("int")
        if outside:
            return F.greatest(F.lit(1 - size), F.least(start, F.col(length) - 1))
        return F.when(F.col(length) <= size, 0).otherwise(F.greatest(F.lit(0), F.least(start, F.col(length) - size))).cast("int")

    return rows.withColumn("x", at("px", "width")).withColumn("y", at("py", "height"))


def _hits(windows: DataFrame, region: DataFrame, size: int) -> DataFrame:
    """The windows ``image_id, x, y`` that hold a cell of the region. They meet in blocks of the window's size, four at most."""
    block = lambda c: F.floor(F.col(c) / size)
    cover = lambda c: F.sequence(block(c), F.floor((F.col(c) + size - 1) / size))
    at = windows.select("image_id", "x", "y").distinct().withColumn("bx", F.explode(cover("x"))).withColumn("by", F.explode(cover("y")))
    own = region.select("image_id", F.col("x").alias("cx"), F.col("y").alias("cy"), block("x").alias("bx"), block("y").alias("by"))
    inside = (F.col("cx") >= F.col("x")) & (F.col("cx") < F.col("x") + size) & (F.col("cy") >= F.col("y")) & (F.col("cy") < F.col("y") + size)
    same = ["image_id", "bx", "by"]
    a, b = at.alias("a"), own.alias("b")
    return a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in same] + [inside], "left_semi").select("image_id", "x", "y").distinct()


def crop_candidates(images: DataFrame, cells: DataFrame, seed: object, size: int, rare: list[int], stride: int = 256, band: int = 64, most: int = 64, tiny: int = 64, outside: bool = False) -> DataFrame:
    """Every window that the sampler may try: ``image_id, phase, kind, rank, py, px, x, y, forced, tiny, hit``.

    ``cells`` has ``image_id, y, x, code, region`` (whether a cell may be a crop's reason). Points of a strategy are drawn by
    hash order, at most ``5 * most`` an image, strategy and class: more can't be tried. Phases are the places of ORDER; 6 is
    the refill from all cells, 7 that from the finer grid; corners' nearest cells stand in phase 1 with ``kind`` 1.
    """
    side = images.select("image_id", "width", "height")
    live = edges(cells.withColumn("label", F.when(F.col("region"), F.col("code")).otherwise(-1)), {"edge": "label"}).where("region").select("image_id", "y", "x", "code", "edge").join(side, "image_id").checkpoint()

    def drawn(rows: DataFrame, phase: int, times: int, kind: Column | None = None) -> DataFrame:
        salt = ORDER[phase] if phase < len(ORDER) else "refill"
        own = rows.withColumn("kind", F.lit(0) if kind is None else kind).withColumn("__h", hash_order(seed, "image_id", F.lit(salt), "y", "x"))
        rank = F.row_number().over(W.partitionBy("image_id", "kind").orderBy("__h", "y", "x"))
        return own.withColumn("rank", rank).where(F.col("rank") <= times * most).select("image_id", F.lit(phase).alias("phase"), "kind", "rank", F.col("y").cast("double").alias("py"), F.col("x").cast("double").alias("px"), "width", "height", F.lit(phase in (1, 2)).alias("forced"), F.lit(False).alias("tiny"))

    near = (F.col("y") < band) | (F.col("x") < band) | (F.col("y") >= F.col("height") - band) | (F.col("x") >= F.col("width") - band)
    ends = F.array(*[F.struct(F.lit(i).alias("i"), (cx * (F.col("width") - 1)).alias("ex"), (cy * (F.col("height") - 1)).alias("ey")) for i, (cx, cy) in enumerate([(0, 0), (1, 0), (0, 1), (1, 1)])])
    far = (F.col("x") - F.col("e.ex")) * (F.col("x") - F.col("e.ex")) + (F.col("y") - F.col("e.ey")) * (F.col("y") - F.col("e.ey"))
    corner = live.withColumn("e", F.explode(ends)).groupBy("image_id", "width", "height", "e.i").agg(F.min(F.struct(far.alias("d"), "y", "x")).alias("c"))
    corner = corner.select("image_id", F.lit(1).alias("phase"), F.lit(1).alias("kind"), (F.col("i") + 1).alias("rank"), F.col("c.y").cast("double").alias("py"), F.col("c.x").cast("double").alias("px"), "width", "height", F.lit(True).alias("forced"), F.lit(False).alias("tiny"))

    parts = component_stats(label_components(live.withColumn("one", F.lit(1)), "one", diagonal=True), tiny).join(side, "image_id")
    large = (F.col("x1") - F.col("x0") >= size) | (F.col("y1") - F.col("y0") >= size)
    step = max(size // 2, 1)
    point = lambda y, x: F.struct(y.cast("double").alias("py"), x.cast("double").alias("px"))
    inner = F.flatten(F.transform(F.sequence("y0", "y1", F.lit(step)), lambda y: F.transform(F.sequence("x0", "x1", F.lit(step)), lambda x: point(y, x))))
    centres = F.concat(F.array(point(F.col("cy"), F.col("cx"))), F.when(large, inner).otherwise(F.array().cast("array<struct<py:double,px:double>>")))
    order = [F.desc("tiny"), F.desc("area"), "cy", "cx", "root_y", "root_x", "i"]
    comp = parts.select("*", F.posexplode(centres).alias("i", "p")).withColumn("rank", F.row_number().over(W.partitionBy("image_id").orderBy(*order)))
    comp = comp.select("image_id", F.lit(3).alias("phase"), F.lit(0).alias("kind"), "rank", "p.py", "p.px", "width", "height", F.col("tiny").alias("forced"), "tiny")

    place = F.array_position(F.array(*[F.lit(c) for c in rare]), F.col("code")).cast("int") - 1
    points = [drawn(live.where(near), 1, 4), corner, drawn(live.where("edge"), 2, 3), comp, drawn(live.where(F.col("code").isin(rare)), 4, 2, place), drawn(live, 5, 3), drawn(live, 6, 5)]
    out = points[0]
    for p in points[1:]:
        out = out.union(p)
    cols = ["image_id", "phase", "kind", "rank", "py", "px", "x", "y", "forced", "tiny"]
    out = _placed(out, size, outside).select(*cols)
    for phase, by in ((0, stride), (7, max(1, min(64, stride), stride // 2))):
        box = grid_boxes(side, size, by).select("image_id", F.lit(phase).alias("phase"), F.lit(0).alias("kind"), (F.col("n") + 1).alias("rank"), F.lit(0.0).alias("py"), F.lit(0.0).alias("px"), "x", "y", F.lit(phase == 0).alias("forced"), F.lit(False).alias("tiny"))
        out = out.union(box)
    out = out.checkpoint()
    hit = _hits(out, live, size).withColumn("hit", F.lit(True))
    return out.join(hit, ["image_id", "x", "y"], "left").select(*cols, F.coalesce("hit", F.lit(False)).alias("hit"))


class _Sampler:
    """Accepts one image's windows one after another, and counts."""

    def __init__(self, size: int, limit: float):
        self.size, self.limit = size, limit
        self.taken: dict[tuple[int, int], None] = {}
        self.crops: list[dict] = []
        self.count = dict.fromkeys(("generated", "accepted", "no_candidate", "duplicate", "high_iou"), 0)

    def overlap(self, x: int, y: int) -> float:
        """The largest IoU with an accepted window."""
        shared = max((max(0, self.size - abs(x - a)) * max(0, self.size - abs(y - b)) for a, b in self.taken), default=0)
        return shared / (2 * self.size * self.size - shared)

    def offer(self, row: dict, strategy: str) -> bool:
        self.count["generated"] += 1
        at = row["x"], row["y"]
        refused = "no_candidate" if not row["hit"] else "duplicate" if at in self.taken else "high_iou" if not row["forced"] and self.taken and self.overlap(*at) >= self.limit else None
        self.count[refused or "accepted"] += 1
        if refused:
            return False
        self.taken[at] = None
        self.crops.append({"x": at[0], "y": at[1], "strategy": strategy, "forced": row["forced"], "tiny": row["tiny"]})
        return True

    def fill(self, rows: list[dict], strategy: str, most: int) -> int:
        """Takes ``most`` windows of the rows, in their order; how many it got."""
        got = 0
        for row in rows:
            if got >= most:
                break
            got += self.offer(row, strategy)
        return got


def _drawn(rows: list[dict], n: int) -> list[dict]:
    """The first ``n`` by draw, in the order of rows and columns."""
    return sorted((r for r in rows if r["rank"] <= n), key=lambda r: (r["py"], r["px"]))


def _sampled(rows: list[dict], total: int, size: int, shares: dict[str, float], limit: float) -> _Sampler:
    """One image's crops: strategy after strategy up to its quota, then the refills up to ``total``."""
    by: dict[tuple[int, int], list[dict]] = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        by.setdefault((r["phase"], r["kind"]), []).append(r)
    out, quota = _Sampler(size, limit), quotas(total, shares)
    grid, edge, border, comp, rare, uniform = (quota.get(s, 0) for s in ORDER)
    out.fill(by.get((0, 0), []), ORDER[0], grid)
    if edge and not out.fill(_drawn(by.get((1, 0), []), 4 * edge), ORDER[1], edge):
        out.fill(by.get((1, 1), []), ORDER[1], edge)
    out.fill(_drawn(by.get((2, 0), []), 3 * border), ORDER[2], border)
    out.fill(by.get((3, 0), []), ORDER[3], comp)
    got = 0
    for kind in sorted(k for p, k in by if p == 4):
        if got < rare:
            got += out.fill(_drawn(by[4, kind], max(2 * (rare - got), 1)), ORDER[4], rare - got)
    out.fill(_drawn(by.get((5, 0), []), 3 * uniform), ORDER[5], uniform)
    left = total - len(out.crops)
    out.fill(_drawn(by.get((6, 0), []), 5 * left), ORDER[5], left)
    if "spatial_grid" in shares:
        out.fill(by.get((7, 0), []), ORDER[0], total - len(out.crops))
    return out


def sample_crops(images: DataFrame, cells: DataFrame, seed: object, size: int = 512, rare: list[int] | None = None, shares: dict[str, float] | None = None, stride: int = 256, band: int = 64, least: int = 8, most: int = 64, tiny: int = 64, iou: float = 0.7, outside: bool = False, count_stride: int | None = None) -> DataFrame:
    """One row an image with cells of the region: ``image_id, generated, accepted, no_candidate, duplicate, high_iou, crops``.

    An image is to have as many crops as a grid of ``count_stride`` has places, between ``least`` and ``most``. Each
    strategy of ``shares`` fills its quota in turn: the grid, cells near the edge (else those nearest to the corners),
    class boundaries, components (tiny ones first), ``rare`` classes in their order, any cell. What is missing is drawn from
    all cells, then taken from a finer grid. A window is refused if it holds no cell of the region, was taken before, or
    overlaps a taken one by ``iou`` or more; grid, edge, boundary and tiny windows are kept in spite of overlap.

    Windows are found relationally and bounded by quotas; the greedy choice sees one image's windows at a time.
    """
    shares = shares or GRID_SHARES
    rows = crop_candidates(images, cells, seed, size, rare or [], stride, band, most, tiny, outside)
    by = count_stride or stride
    n = F.least(F.greatest(F.ceil(F.col("height") / by) * F.ceil(F.col("width") / by), F.lit(least)), F.lit(most))
    # Images without a cell of the region have no crops.
    some = rows.where("phase = 6").select("image_id").distinct()
    todo = rows.join(some, "image_id", "left_semi").join(images.select("image_id", n.cast("int").alias("total")), "image_id")
    kind = dict(images.dtypes)["image_id"]

    def choose(key: tuple, table: pa.Table) -> pa.Table:
        found = table.to_pylist()
        out = _sampled(found, found[0]["total"], size, shares, iou)
        return pa.Table.from_pylist([{"image_id": key[0].as_py(), **out.count, "crops": out.crops}], pa.schema([("image_id", table.schema.field("image_id").type), *((c, pa.int64()) for c in out.count), ("crops", pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32()), ("strategy", pa.string()), ("forced", pa.bool_()), ("tiny", pa.bool_())])))]))

    return todo.groupBy("image_id").applyInArrow(choose, f"image_id {kind}, generated long, accepted long, no_candidate long, duplicate long, high_iou long, crops {CROP}")


def crop_records(sampled: DataFrame, images: DataFrame, cells: DataFrame, codes: list[int], size: int, margin: int, variants: tuple[int, ...] = (0,)) -> DataFrame:
    """A row a crop and orientation: its id, place, normalised box, strategy, and its cells of the region, centre, boundary and each code."""
    tiles = sampled.select("image_id", F.posexplode("crops").alias("tile", "c")).select("image_id", "tile", F.col("c.x").alias("x0"), F.col("c.y").alias("y0"), F.lit(size).alias("w"), F.lit(size).alias("h"), "c.strategy", "c.forced", "c.tiny").checkpoint()
    own = edges(cells.withColumn("label", F.when(F.col("region"), F.col("code")).otherwise(-1)), {"edge": "label"})
    stats = crop_stats(own, tiles, margin, codes, "edge", "region")
    out = tiles.join(stats, ["image_id", "tile"]).join(images.select("image_id", "width", "height"), "image_id").withColumn("k", F.explode(F.array(*[F.lit(k) for k in variants])))
    part = lambda a, b: F.round(F.col(a) / F.col(b), 6)
    name = F.concat(F.col("image_id").cast("string"), F.lit("__x"), "x0", F.lit("_y"), "y0", F.lit("_k"), "k")
    return out.select("image_id", name.alias("sample_id"), F.col("x0").alias("x"), F.col("y0").alias("y"), "k", "strategy", "forced", "tiny", "region", "center", "edges", *[f"code_{c}" for c in codes], part("x0", "width").alias("nx"), part("y0", "height").alias("ny"), part("w", "width").alias("nw"), part("h", "height").alias("nh"))


CATEGORIES = ["transition_rich", "shade_rich", "dark_rare", "negative", "mixed_random"]


def window_contents(cells: DataFrame, masks: dict[str, str], content: list[str], size: int, stride: int) -> DataFrame:
    """``image_id, x, y``, the cells of each mask and a ``print`` of the content, for every window inside its image.

    ``content`` names whole numbers; a window's print is the exclusive or of the hashes of its cells' places in it and their
    content, where that isn't all 0. A cell adds itself to the windows that cover it, before the shuffle.
    """
    side = cells.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")).where((F.col("h") >= size) & (F.col("w") >= size))
    starts = lambda n: _origins(F.col(n), size, stride)
    windows = side.select("image_id", F.explode(starts("h")).alias("y"), "w").select("image_id", "y", F.explode(starts("w")).alias("x"))
    some = F.array_contains(F.array(*[F.col(m) for m in masks.values()], *[F.col(c) != 0 for c in content]), True)
    on = cells.where(some).select("image_id", F.col("y").alias("cy"), F.col("x").alias("cx"), *{*masks.values()}, *[F.col(c).alias(f"__{c}") for c in content]).join(side, "image_id")
    cover = lambda n, at: F.filter(starts(n), lambda o: (o <= F.col(at)) & (F.col(at) < o + size))
    each = on.withColumn("y", F.explode(cover("h", "cy"))).withColumn("x", F.explode(cover("w", "cx")))
    marked = F.array_contains(F.array(*[F.col(f"__{c}") != 0 for c in content]), True)
    own = F.when(marked, F.xxhash64(F.lit(size), F.col("cy") - F.col("y"), F.col("cx") - F.col("x"), *[F.col(f"__{c}") for c in content]))
    sums = each.groupBy("image_id", "x", "y").agg(F.bit_xor(own).alias("print"), *[F.count_if(F.col(m)).alias(n) for n, m in masks.items()])
    return windows.join(sums, ["image_id", "x", "y"], "left").select("image_id", "x", "y", F.coalesce("print", F.lit(0)).alias("print"), *[F.coalesce(n, F.lit(0)).alias(n) for n in masks])


def select_crops(cells: DataFrame, seed: object, sizes: list[int], transition: str = "transition", shade: str = "shade", dark: str = "dark", line: str = "line", iou: float = 0.85, most: int = 32, least_stride: int = 32) -> DataFrame:
    """``image_id, place, size, category, x, y, score``: of each size and category the best window that is new.

    Sizes go up, categories go by CATEGORIES: shares of transitions, shade and dark cells; lines without shade (at most a
    thousandth, lines over a hundredth); and hash order. Of a category the first ``most`` windows by score, x and y are
    tried. One is taken if no window of its size that was taken overlaps it by ``iou`` or more, and none, of any size, has
    the same transitions and shade in the same places. An image's windows to try are bounded, and folded in one row.
    """
    masks = {"t": transition, "s": shade, "d": dark, "n": line}
    number = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    own = cells.select("image_id", "y", "x", *[number(c).cast("boolean").alias(c) for c in masks.values()], number(transition).alias("__t"), number(shade).alias("__s"))
    out = None
    for size in sorted(sizes):
        w = window_contents(own, masks, ["__t", "__s"], size, max(size // 4, least_stride)).checkpoint()
        share = lambda c, size=size: F.round(F.col(c) / (size * size), 6)
        draw = hash_order(seed, "image_id", F.lit(size), "x", "y")
        plain = (F.col("s") <= 0.001 * size * size) & (F.col("n") > 0.01 * size * size)
        for c, (score, where, order) in enumerate([(share("t"), None, None), (share("s"), None, None), (share("d"), None, None), (share("n"), plain, None), (F.lit(0.0), None, draw)]):
            some = w if where is None else w.where(where)
            rank = F.row_number().over(W.partitionBy("image_id").orderBy(order if order is not None else F.desc("score"), "x", "y"))
            some = some.withColumn("score", score).withColumn("rank", rank).where(F.col("rank") <= most).select("image_id", F.struct(F.lit(size).alias("size"), F.lit(c).alias("c"), "rank", "x", "y", "print", "score").alias("w"))
            out = some if out is None else out.union(some)
    groups = out.groupBy("image_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    side = lambda a, b, s: F.greatest(F.lit(0), s - F.abs(a - b))

    def taken(got: Column, w: Column) -> Column:
        s = w["size"]
        shared = lambda g: side(g["x"], w["x"], s) * side(g["y"], w["y"], s)
        same = lambda g: g["size"] == s
        return F.exists(got, lambda g: (same(g) & (g["c"] == w["c"])) | (same(g) & (g["print"] == w["print"])) | (same(g) & (shared(g) >= iou * (2 * s * s - shared(g)))))

    picks = F.aggregate("w", F.filter("w", lambda x: F.lit(False)), lambda got, w: F.when(taken(got, w), got).otherwise(F.concat(got, F.array(w))))
    each = groups.select("image_id", F.posexplode(picks).alias("place", "w"))
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    return each.select("image_id", "place", "w.size", F.get(names, F.col("w.c")).alias("category"), "w.x", "w.y", "w.score")
