"""Colours as columns: OKLab, Lab and CIEDE2000, palettes decoded, matched and scored. All of it is built from SQL functions."""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.hashing import derive_seed
from tessella.functions.quantiles import count_rows, mean_value, percentile, ranked_values

#: The rows of the matrices from linear RGB to cone responses, from those to OKLab, and from linear RGB to XYZ (D65).
RGB_TO_CONES = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
CONES_TO_OKLAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def _let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _named(names: str, values: list[Column]) -> Column:
    return F.struct(*[v.alias(n) for n, v in zip(names, values, strict=True)])


def _linear(byte: Column) -> Column:
    return _let(F.greatest(F.least(byte / 255.0, F.lit(1.0)), F.lit(0.0)), lambda c: F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4))))


def _times(rows, v: Column, names: str) -> list[Column]:
    return [sum((F.lit(w) * v[n] for w, n in zip(row, names, strict=True)), F.lit(0.0)) for row in rows]


def oklab(r: Column, g: Column, b: Column) -> Column:
    """``struct(l, a, b)`` of bytes."""
    cones = lambda v: _named("xyz", [F.pow(F.greatest(c, F.lit(1e-8)), F.lit(1.0 / 3.0)) for c in _times(RGB_TO_CONES, v, "rgb")])
    return _let(_let(_named("rgb", [_linear(x) for x in (r, g, b)]), cones), lambda k: _named("lab", _times(CONES_TO_OKLAB, k, "xyz")))


def lab(r: Column, g: Column, b: Column) -> Column:
    """``struct(l, a, b)`` of bytes, CIE Lab under D65."""
    edge = 6 / 29
    root = lambda c: F.when(c > edge**3, F.cbrt(c)).otherwise(c / (3 * edge * edge) + 4 / 29)
    xyz = lambda v: _named("xyz", [_let(c / w, root) for c, w in zip(_times(RGB_TO_XYZ, v, "rgb"), WHITE, strict=True)])
    return _let(_let(_named("rgb", [_linear(x) for x in (r, g, b)]), xyz), lambda f: _named("lab", [116 * f["y"] - 16, 500 * (f["x"] - f["y"]), 200 * (f["y"] - f["z"])]))


def rgb_from_lab(color: Column) -> Column:
    """``struct(r, g, b)`` of bytes, rounded and cut to 0 to 255."""
    edge = 6 / 29
    (a, b, c), (d, e, g), (h, i, j) = RGB_TO_XYZ
    det = a * (e * j - g * i) - b * (d * j - g * h) + c * (d * i - e * h)
    inverse = (((e * j - g * i) / det, (c * i - b * j) / det, (b * g - c * e) / det), ((g * h - d * j) / det, (a * j - c * h) / det, (c * d - a * g) / det), ((d * i - e * h) / det, (b * h - a * i) / det, (a * e - b * d) / det))
    cube = lambda v: F.when(v > edge, v * v * v).otherwise(3 * edge * edge * (v - 4 / 29))
    gamma = lambda v: F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)
    byte = lambda v: F.round(255 * _let(F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0)), gamma), 0).cast("int")

    def of(k):
        fy = (k["l"] + 16) / 116
        return _named("xyz", [_let(f, cube) * w for f, w in zip((fy + k["a"] / 500, fy, fy - k["b"] / 200), WHITE, strict=True)])

    return _let(_let(color, of), lambda v: _named("rgb", [byte(c) for c in _times(inverse, v, "xyz")]))


def delta_e(x: Column, y: Column) -> Column:
    """CIEDE2000 between two Lab structs."""
    seven = lambda c: _let(F.pow(c, F.lit(7.0)), lambda p: p / (p + 25.0**7 + 1e-12))
    root = lambda a, b: F.sqrt(a * a + b * b)
    rad = lambda d: d * (pi / 180)
    turn = lambda b, a: F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0))
    put = lambda **k: F.struct(*[v.alias(n) for n, v in k.items()])

    def stretch(p):
        x, y = p["x"], p["y"]
        return _let(0.5 * (1 - F.sqrt(seven((root(x["a"], x["b"]) + root(y["a"], y["b"])) / 2))), lambda g: put(l1=x["l"], l2=y["l"], b1=x["b"], b2=y["b"], a1=(1 + g) * x["a"], a2=(1 + g) * y["a"]))

    polar = lambda v: put(l1=v["l1"], l2=v["l2"], c1=root(v["a1"], v["b1"]), c2=root(v["a2"], v["b2"]), h1=turn(v["b1"], v["a1"]), h2=turn(v["b2"], v["a2"]))

    def means(v):
        none = v["c1"] * v["c2"] == 0
        gap = v["h2"] - v["h1"]
        gap = F.when(none, 0.0).when(gap > 180, gap - 360).when(gap < -180, gap + 360).otherwise(gap)
        mid = (v["h1"] + v["h2"]) / 2
        hm = F.when(none, v["h1"] + v["h2"]).otherwise(F.pmod(F.when(F.abs(v["h1"] - v["h2"]) > 180, mid + 180).otherwise(mid), F.lit(360.0)))
        return put(dl=v["l2"] - v["l1"], dc=v["c2"] - v["c1"], dh=2 * F.sqrt(v["c1"] * v["c2"]) * F.sin(rad(gap / 2)), off=(v["l1"] + v["l2"]) / 2 - 50, cm=(v["c1"] + v["c2"]) / 2, hm=hm)

    def scaled(v):
        hm, off = v["hm"], v["off"]
        t = 1 - 0.17 * F.cos(rad(hm - 30)) + 0.24 * F.cos(rad(2 * hm)) + 0.32 * F.cos(rad(3 * hm + 6)) - 0.20 * F.cos(rad(4 * hm - 63))
        swing = 30 * F.exp(-((hm - 275) / 25) * ((hm - 275) / 25))
        return put(u=v["dl"] / (1 + 0.015 * off * off / F.sqrt(20 + off * off)), v=v["dc"] / (1 + 0.045 * v["cm"]), w=v["dh"] / (1 + 0.015 * v["cm"] * t), r=-F.sin(rad(2 * swing)) * 2 * F.sqrt(seven(v["cm"])))

    last = lambda v: F.sqrt(F.greatest(v["u"] * v["u"] + v["v"] * v["v"] + v["w"] * v["w"] + v["r"] * v["v"] * v["w"], F.lit(0.0)))
    return _let(_let(_let(_let(_let(put(x=x, y=y), stretch), polar), means), scaled), last)


def delta_e_stats(df: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean, percentiles 50, 90 and 95, and maximum of a column of differences."""
    r = lambda c, n: F.round(c, 4).alias(n)
    shares = (("p50", 0.5), ("p90", 0.9), ("p95", 0.95))
    return ranked_values(df, value, keys).groupBy(*keys).agg(count_rows().alias("n"), r(mean_value(), "mean"), *[r(percentile(q), n) for n, q in shares], r(F.max("value"), "most"))


def color_visibility(targets: DataFrame, seen: DataFrame, key: str, limits: tuple[int, ...] = (1, 2, 5, 10)) -> DataFrame:
    """Per key: target colours, and the share of them that some seen colour of the key comes within each limit of. Both have ``r, g, b``.

    Equal colours of a key meet once; a key is one image's palette and its distinct colours. Each side's colours are turned
    into Lab before they meet.
    """

    def one(df: DataFrame, name: str) -> DataFrame:
        own = df.select(key, F.struct("r", "g", "b").alias(name)).distinct()
        return own.withColumn(f"{name}_lab", lab(F.col(f"{name}.r"), F.col(f"{name}.g"), F.col(f"{name}.b")))

    both = one(targets, "t").join(one(seen, "s"), key, "left")
    best = both.groupBy(key, "t").agg(F.min(delta_e(F.col("t_lab"), F.col("s_lab"))).alias("d"))
    return best.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg((F.coalesce("d", F.lit(1e9)) <= m).cast("int")), 6).alias(f"within_{m}") for m in limits])


#: How far a palette shift moves lightness and each of a and b, by band.
BANDS = {"mild": (2.0, 3.0), "moderate": (5.0, 8.0), "strong": (10.0, 16.0), "stress": (20.0, 32.0)}


def palette_shift(palette: DataFrame, key: str, band: str, seed: int) -> DataFrame:
    """``palette`` with ``new_r, new_g, new_b``: each colour moved in Lab by sha256 of seed, part, key and colour, within the band."""
    if band not in BANDS:
        raise ValueError(f"unknown band: {band}")
    part = lambda k: derive_seed(seed, F.lit(k), key, "r", "g", "b", modulus=20001) / 10000.0 - 1.0
    light, tint = BANDS[band]
    own = lab(F.col("r"), F.col("g"), F.col("b"))
    moved = palette.withColumn("__l", own)
    moved = moved.withColumn("__l", F.struct((F.col("__l.l") + light * part(0)).alias("l"), (F.col("__l.a") + tint * part(1)).alias("a"), (F.col("__l.b") + tint * part(2)).alias("b")))
    moved = moved.withColumn("__n", rgb_from_lab(F.col("__l")))
    return moved.select(*palette.columns, *[F.col(f"__n.{c}").alias(f"new_{c}") for c in "rgb"])


def variant_diff(rows: DataFrame, key: str, before: tuple[str, str, str], after: tuple[str, str, str]) -> DataFrame:
    """Per key: colours, the share that changed, mean and largest difference."""
    a, b = (lab(*[F.col(c) for c in cols]) for cols in (before, after))
    differs = F.lit(False)
    for x, y in zip(before, after, strict=True):
        differs = differs | (F.col(x) != F.col(y))
    d = rows.select(key, differs.cast("int").alias("c"), delta_e(a, b).alias("d"))
    return d.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 6).alias("changed"), F.round(F.avg("d"), 4).alias("mean"), F.round(F.max("d"), 4).alias("most"))


def decode_palettes(preds: DataFrame, key: str) -> DataFrame:
    """``key, colors, hex, warning`` of ``preds(key, n_wanted, colors array<struct<r, g, b, presence>>)``.

    Colours go by presence, ties by place; each is taken once, until there are as many as wanted; then sorted by Lab. The
    warning tells when there are too few.
    """
    ranked = F.array_sort(F.transform("colors", lambda c, i: F.struct((-c["presence"]).alias("p"), i.alias("i"), F.struct(c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b")).alias("c"))))
    once = F.array_distinct(F.transform(ranked, lambda c: c["c"]))
    taken = preds.select(key, "n_wanted", F.slice(once, F.lit(1), F.col("n_wanted")).alias("t"))
    ordered = F.array_sort(F.transform("t", lambda c: F.struct(lab(c["r"], c["g"], c["b"]).alias("lab"), c.alias("c"))))
    taken = taken.select(key, "n_wanted", F.transform(ordered, lambda c: c["c"]).alias("colors"))
    two = lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")
    hexes = F.transform("colors", lambda c: F.concat(F.lit("#"), two(c["r"]), two(c["g"]), two(c["b"])))
    short = F.size("colors") < F.col("n_wanted")
    return taken.select(key, "colors", hexes.alias("hex"), F.when(short, F.concat(F.lit("only "), F.size("colors"), F.lit(" of "), "n_wanted")).alias("warning"))


def cheapest_pairing(cost: np.ndarray) -> np.ndarray:
    """The column that each row takes in the cheapest pairing of all rows; there are at least as many columns as rows.

    Rows come in turn. A new row looks for the cheapest path of takings and givings to a free column, by costs less the
    prices of rows and columns, which keep all of them at 0 or more; along the path the takings change.
    """
    n, m = cost.shape
    of_row, of_col = np.zeros(n), np.zeros(m)
    holder = np.full(m, -1)
    for new in range(n):
        best, before, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col, so_far = new, -1, 0.0
        while True:
            way = so_far + cost[row] - of_row[row] - of_col
            nearer = ~done & (way < best)
            best[nearer], before[nearer] = way[nearer], col
            col = int(np.where(done, np.inf, best).argmin())
            so_far, done[col] = best[col], True
            if holder[col] < 0:
                break
            row = int(holder[col])
        of_row[new] += so_far
        held = done & (holder >= 0)
        of_row[holder[held]] += so_far - best[held]
        of_col[held] -= so_far - best[held]
        while col >= 0:
            last = int(before[col])
            holder[col] = holder[last] if last >= 0 else new
            col = last
    out = np.empty(n, np.int64)
    out[holder[holder >= 0]] = np.flatnonzero(holder >= 0)
    return out


def match_palettes(pairs: DataFrame, key: str, rgb_weight: float = 1.0, seen_weight: float = 1.0, presence_weight: float = 0.1) -> DataFrame:
    """``key, target, pred, cost`` of the cheapest pairing of ``pairs(key, preds array<struct<r, g, b, presence>>, targets array<struct<r, g, b>>)``.

    Cost is mean difference of RGB, OKLab distance and minus the log of the sigmoid of presence, weighted. The pairing is
    exact, for palettes of any length; where there are fewer predictions than targets, some targets stay without one. Costs
    are columns; a row's table of them is matched where it lies. ``key`` has one row a value.
    """
    each = pairs.select(key, "preds", F.posexplode("targets").alias("target", "t")).select(key, "target", "t", F.posexplode("preds").alias("pred", "p"))
    ok = lambda c: oklab(F.col(f"{c}.r"), F.col(f"{c}.g"), F.col(f"{c}.b"))
    each = each.withColumn("x", ok("p")).withColumn("y", ok("t"))
    l1 = sum((F.abs(F.col(f"p.{c}") - F.col(f"t.{c}")) for c in "rgb"), F.lit(0)) / (3 * 255.0)
    far = F.sqrt(sum(((F.col(f"x.{c}") - F.col(f"y.{c}")) * (F.col(f"x.{c}") - F.col(f"y.{c}")) for c in "lab"), F.lit(0.0)))
    sure = -F.log1p(F.exp(-F.col("p.presence")))
    costs = each.select(key, "target", "pred", (rgb_weight * l1 + seen_weight * far - presence_weight * sure).alias("cost"))
    table = costs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("target", "pred", "cost"))).alias("c"))
    rows = table.select(key, F.transform("c", lambda x: x["cost"]).alias("cost"), (F.array_max(F.transform("c", lambda x: x["pred"])) + 1).alias("n"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, target, pred, price = [], [], [], []
            for r, (flat, n) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                cost = np.array(flat).reshape(-1, n)
                flip = len(cost) > n
                own = cheapest_pairing(cost.T if flip else cost)
                rows_, cols = (own, np.arange(len(own))) if flip else (np.arange(len(own)), own)
                order = np.argsort(rows_)
                owner += [r] * len(own)
                target += rows_[order].tolist()
                pred += cols[order].tolist()
                price += cost[rows_[order], cols[order]].tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(target, pa.int32()), pa.array(pred, pa.int32()), pa.array(price, pa.float64())], [key, "target", "pred", "cost"])

    out = rows.mapInArrow(match, f"{key} {dict(pairs.dtypes)[key]}, target int, pred int, cost double")
    return out.withColumn("cost", F.round("cost", 6))


def palette_metrics(rows: DataFrame, matched: DataFrame, key: str, slots: int) -> DataFrame:
    """One row of scores of ``rows(key, n_pred, n_true)`` and ``matched(key, mae, de)``, one row a matched colour.

    Shares are over keys, but for those of differences, which are over matched colours; ``set_error`` caps a difference at 10
    and counts 10 for each colour too many or too few.
    """
    cap = 10.0
    matched = matched.checkpoint()
    per = matched.groupBy(key).agg(F.count(F.lit(1)).alias("m"), F.sum(F.least("de", F.lit(cap))).alias("s"), F.max("de").alias("x"))
    both = rows.join(per, key, "left")
    p, t = F.col("n_pred"), F.col("n_true")
    gap = F.abs(p - t)
    error = (F.coalesce("s", F.lit(0.0)) + cap * gap) / F.greatest(p, t, F.lit(1))
    r = lambda c, n: F.round(c, 6).alias(n)
    share = lambda c: F.avg(c.cast("int"))
    one = both.agg(
        r(share(p == t), "count_accuracy"), r(F.avg(gap), "count_mae"), r(share((p == t) & (F.col("x") <= 1)), "success"), r(F.avg(F.greatest(p - t, F.lit(0)) / slots), "false_positives"),
        r(F.sum(F.greatest(t - p, F.lit(0))) / F.greatest(F.sum(t), F.lit(1)), "false_negatives"), r(F.avg(error), "set_error"),
    )
    two = matched.agg(r(F.avg("mae"), "mae"), r(F.avg("de"), "de_mean"), *[r(share(F.col("de") <= m), f"de_within_{m}") for m in (1, 2, 5)])
    three = ranked_values(matched, "de").agg(*[r(percentile(q), f"de_{n}") for n, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95))])
    return one.crossJoin(F.broadcast(two)).crossJoin(F.broadcast(three))  # one row each


def patch_stats(cells: DataFrame, patch: int) -> DataFrame:
    """Per image and square patch: mean, deviation (at least 1e-8), least and largest of r, g, b, and mean OKLab; cells not ``valid`` don't count.

    A patch without valid cells has 1 as least, 0 as largest value and mean 0.
    """
    v = F.col("valid")
    own = cells.withColumn("__ok", oklab(F.col("r"), F.col("g"), F.col("b")))
    keys = [F.floor(F.col("y") / patch).alias("py"), F.floor(F.col("x") / patch).alias("px")]
    c = lambda n: F.when(v, F.col(n) / 255.0)
    aggs = []
    for n in "rgb":
        aggs += [F.round(F.coalesce(F.avg(c(n)), F.lit(0.0)), 6).alias(f"{n}_mean"), F.round(F.greatest(F.coalesce(F.stddev_pop(c(n)), F.lit(0.0)), F.lit(1e-8)), 6).alias(f"{n}_std"), F.round(F.coalesce(F.min(c(n)), F.lit(1.0)), 6).alias(f"{n}_low"), F.round(F.coalesce(F.max(c(n)), F.lit(0.0)), 6).alias(f"{n}_high")]
    aggs += [F.round(F.coalesce(F.avg(F.when(v, F.col(f"__ok.{n}"))), F.lit(0.0)), 6).alias(f"ok_{n}") for n in "lab"]
    return own.groupBy("image_id", *keys).agg(F.count_if(v).alias("n"), *aggs)
