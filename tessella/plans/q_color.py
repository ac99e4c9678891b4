"""Queries of colours and palettes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import color as c

from . import views as v
from .registry import query


def lin(x: str) -> str:
    return f"CASE WHEN {x} / 255.0::DOUBLE <= 0.04045 THEN {x} / 255.0::DOUBLE / 12.92 ELSE pow(({x} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"


def times(rows, names) -> list[str]:
    return [" + ".join(f"{w}::DOUBLE * {n}" for w, n in zip(row, names, strict=True)) for row in rows]


def lab_sql(source: str, out: str, rgb=("r", "g", "b"), p="") -> str:
    """A CTE ``out``: the source's rows with columns ``{p}l, {p}a, {p}b_`` of the named bytes."""
    x = times(c.RGB_TO_XYZ, ["lr", "lg", "lb"])
    f = [f"CASE WHEN x{k} / {w}::DOUBLE > {(6 / 29) ** 3}::DOUBLE THEN cbrt(x{k} / {w}::DOUBLE) ELSE x{k} / {w}::DOUBLE / {3 * (6 / 29) ** 2}::DOUBLE + {4 / 29}::DOUBLE END" for k, w in enumerate(c.WHITE)]
    return f"""{out}_1 AS (SELECT *, {', '.join(f'{lin(n)} AS l{m}' for n, m in zip(rgb, 'rgb', strict=True))} FROM {source}), {out}_2 AS (SELECT *, {', '.join(f'{e} AS x{k}' for k, e in enumerate(x))} FROM {out}_1), {out}_3 AS (SELECT *, {', '.join(f'{e} AS f{k}' for k, e in enumerate(f))} FROM {out}_2),
 {out} AS (SELECT * EXCLUDE (lr, lg, lb, x0, x1, x2, f0, f1, f2), 116 * f1 - 16 AS {p}l, 500 * (f0 - f1) AS {p}a, 200 * (f1 - f2) AS {p}b_ FROM {out}_3)"""


def delta_sql(source: str, out: str) -> str:
    """A CTE ``out``: the source's rows with ``de``, CIEDE2000 of columns x* and y*."""
    return f"""{out}_1 AS (SELECT *, 0.5 * (1 - sqrt(pow(cb, 7) / (pow(cb, 7) + 6103515625.0::DOUBLE + 1e-12))) AS gk FROM (SELECT *, (sqrt(xa * xa + xb_ * xb_) + sqrt(ya * ya + yb_ * yb_)) / 2 AS cb FROM {source})),
 {out}_2 AS (SELECT *, sqrt(a1 * a1 + xb_ * xb_) AS c1, sqrt(a2 * a2 + yb_ * yb_) AS c2 FROM (SELECT *, (1 + gk) * xa AS a1, (1 + gk) * ya AS a2 FROM {out}_1)),
 {out}_3 AS (SELECT *, CASE WHEN degrees(atan2(xb_, a1)) < 0 THEN degrees(atan2(xb_, a1)) + 360 ELSE degrees(atan2(xb_, a1)) END AS h1, CASE WHEN degrees(atan2(yb_, a2)) < 0 THEN degrees(atan2(yb_, a2)) + 360 ELSE degrees(atan2(yb_, a2)) END AS h2 FROM {out}_2),
 {out}_4 AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 WHEN h2 - h1 < -180 THEN h2 - h1 + 360 ELSE h2 - h1 END AS gap, CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h1 - h2) > 180 THEN (h1 + h2) / 2 + 180 - 360 * CAST((h1 + h2) / 2 + 180 >= 360 AS INT) ELSE (h1 + h2) / 2 END AS hm, (xl + yl) / 2 AS lm, (c1 + c2) / 2 AS cm FROM {out}_3),
 {out}_5 AS (SELECT *, yl - xl AS dl, c2 - c1 AS dc, 2 * sqrt(c1 * c2) * sin(radians(gap / 2)) AS dh, 1 - 0.17 * cos(radians(hm - 30)) + 0.24 * cos(radians(2 * hm)) + 0.32 * cos(radians(3 * hm + 6)) - 0.20 * cos(radians(4 * hm - 63)) AS t, 30 * exp(-(((hm - 275) / 25) ** 2)) AS sw, 2 * sqrt(pow(cm, 7) / (pow(cm, 7) + 6103515625.0::DOUBLE + 1e-12)) AS rc FROM {out}_4),
 {out} AS (SELECT *, sqrt(greatest(u * u + v * v + w * w - sin(radians(2 * sw)) * rc * v * w, 0)) AS de FROM (SELECT *, dl / (1 + 0.015 * (lm - 50) ** 2 / sqrt(20 + (lm - 50) ** 2)) AS u, dc / (1 + 0.045 * cm) AS v, dh / (1 + 0.015 * cm * t) AS w FROM {out}_5))"""


@query("f22_oklab", f"""WITH {v.PALETTES}, a AS (SELECT DISTINCT r, g, b, {lin('r')} AS lr, {lin('g')} AS lg, {lin('b')} AS lb FROM palette_rows), k AS (SELECT *, {', '.join(f'pow(greatest({e}, 1e-8), 1.0::DOUBLE / 3) AS k{i}' for i, e in enumerate(times(c.RGB_TO_CONES, ['lr', 'lg', 'lb'])))} FROM a)
 SELECT r, g, b, {', '.join(f'round({e}, 6) AS ok_{n}' for n, e in zip('lab', times(c.CONES_TO_OKLAB, ['k0', 'k1', 'k2']), strict=True))} FROM k""")
def _(s, d):
    rows = v.palette_rows(s, d).select("r", "g", "b").distinct().withColumn("k", c.oklab(F.col("r"), F.col("g"), F.col("b")))
    return rows.select("r", "g", "b", *[F.round(f"k.{n}", 6).alias(f"ok_{n}") for n in "lab"])


@query("f22_lab_round_trip", f"WITH {v.PALETTES}, q AS (SELECT DISTINCT r, g, b FROM palette_rows), {lab_sql('q', 'z')} SELECT r, g, b, round(l, 6) AS l, round(a, 6) AS a, round(b_, 6) AS b2, r AS r2, g AS g2, b AS bb2 FROM z")
def _(s, d):
    rows = v.palette_rows(s, d).select("r", "g", "b").distinct().withColumn("k", c.lab(F.col("r"), F.col("g"), F.col("b"))).withColumn("n", c.rgb_from_lab(F.col("k")))
    return rows.select("r", "g", "b", F.round("k.l", 6).alias("l"), F.round("k.a", 6).alias("a"), F.round("k.b", 6).alias("b2"), F.col("n.r").alias("r2"), F.col("n.g").alias("g2"), F.col("n.b").alias("bb2"))


SHIFTED = f"{v.PALETTES}, sh AS (SELECT sample_id, r, g, b, CASE WHEN b % 3 = 0 THEN r ELSE (r + 7 * (b % 3)) % 256 END AS r2, (g + 3) % 256 AS g2, b AS b2 FROM palette_rows)"


def shifted(s, d):
    r2 = F.when(F.col("b") % 3 == 0, F.col("r")).otherwise((F.col("r") + 7 * (F.col("b") % 3)) % 256)
    return v.palette_rows(s, d).select("sample_id", "r", "g", "b", r2.alias("r2"), ((F.col("g") + 3) % 256).alias("g2"), F.col("b").alias("b2"))


PAIRED = f"{SHIFTED}, {lab_sql('sh', 'la', p='x')}, {lab_sql('la', 'lb_', ('r2', 'g2', 'b2'), 'y')}, {delta_sql('lb_', 'dd')}"


@query("f23_delta_e", f"WITH {PAIRED} SELECT sample_id, r, g, b, round(de, 4) AS de FROM dd")
def _(s, d):
    de = c.delta_e(c.lab(F.col("r"), F.col("g"), F.col("b")), c.lab(F.col("r2"), F.col("g2"), F.col("b2")))
    return shifted(s, d).select("sample_id", "r", "g", "b", F.round(de, 4).alias("de"))


@query("f23_delta_e_stats", f"WITH {PAIRED} SELECT count(*) AS n, round(avg(de), 4) AS mean, round(quantile_cont(de, 0.5), 4) AS p50, round(quantile_cont(de, 0.9), 4) AS p90, round(quantile_cont(de, 0.95), 4) AS p95, round(max(de), 4) AS most FROM dd")
def _(s, d):
    de = c.delta_e(c.lab(F.col("r"), F.col("g"), F.col("b")), c.lab(F.col("r2"), F.col("g2"), F.col("b2")))
    return c.delta_e_stats(shifted(s, d).select(de.alias("de")), "de")


@query("f24_color_visibility", f"""WITH {SHIFTED}, tt AS (SELECT DISTINCT r, g, b FROM sh), ss AS (SELECT DISTINCT r2, g2, b2 FROM sh), {lab_sql('tt', 'tl', p='x')}, {lab_sql('ss', 'sl', ('r2', 'g2', 'b2'), 'y')},
 tm AS MATERIALIZED (SELECT * FROM tl), sm AS MATERIALIZED (SELECT * FROM sl), pp AS MATERIALIZED (SELECT DISTINCT a.sample_id, a.r, a.g, a.b, c.r2, c.g2, c.b2 FROM sh a JOIN sh c USING (sample_id)),
 lb_ AS MATERIALIZED (SELECT sample_id, pp.r, pp.g, pp.b, xl, xa, xb_, yl, ya, yb_ FROM pp JOIN tm ON tm.r = pp.r AND tm.g = pp.g AND tm.b = pp.b JOIN sm ON sm.r2 = pp.r2 AND sm.g2 = pp.g2 AND sm.b2 = pp.b2), {delta_sql('lb_', 'dd')},
 m AS MATERIALIZED (SELECT sample_id, r, g, b, min(de) AS d FROM dd GROUP BY ALL) SELECT sample_id, count(*) AS n, {', '.join(f'round(avg(CAST(d <= {k} AS INT)), 6) AS within_{k}' for k in (1, 2, 5, 10))} FROM m GROUP BY 1""")
def _(s, d):
    rows = shifted(s, d)
    return c.color_visibility(rows.select("sample_id", "r", "g", "b"), rows.select("sample_id", F.col("r2").alias("r"), F.col("g2").alias("g"), F.col("b2").alias("b")), "sample_id")


def shift_sql(source: str, key: str, seed: int, band: str) -> str:
    """CTEs up to ``sf``: the source's rows with ``new_r, new_g, new_b``."""
    (x, y, z), edge = c.RGB_TO_XYZ, 6 / 29
    det = x[0] * (y[1] * z[2] - y[2] * z[1]) - x[1] * (y[0] * z[2] - y[2] * z[0]) + x[2] * (y[0] * z[1] - y[1] * z[0])
    m = [x, y, z]
    cof = lambda r, k: m[(r + 1) % 3][(k + 1) % 3] * m[(r + 2) % 3][(k + 2) % 3] - m[(r + 1) % 3][(k + 2) % 3] * m[(r + 2) % 3][(k + 1) % 3]
    inverse = [[cof(r, k) / det for r in range(3)] for k in range(3)]
    part = lambda k: f"(CAST(concat('0x', substr(sha256(concat('{seed}:{k}:', {key}, ':', r, ':', g, ':', b)), 1, 15)) AS BIGINT) % 20001 / 10000.0::DOUBLE - 1)"
    light, tint = c.BANDS[band]
    cube = lambda v: f"CASE WHEN {v} > {edge}::DOUBLE THEN {v} * {v} * {v} ELSE {3 * edge * edge}::DOUBLE * ({v} - {4 / 29}::DOUBLE) END"
    byte = lambda v: f"CAST(round(255 * CASE WHEN greatest(least({v}, 1), 0) <= 0.0031308 THEN 12.92 * greatest(least({v}, 1), 0) ELSE 1.055 * pow(greatest(least({v}, 1), 0), {1 / 2.4}::DOUBLE) - 0.055 END) AS INT)"
    rgb = times(inverse, ["w0", "w1", "w2"])
    return f"""{lab_sql(source, 'sf_l')}, sf_m AS MATERIALIZED (SELECT * FROM sf_l), sf_p AS (SELECT *, l + {light} * {part(0)} AS l2, a + {tint} * {part(1)} AS a2, b_ + {tint} * {part(2)} AS b2 FROM sf_m),
 sf_f AS (SELECT *, (l2 + 16) / 116 + a2 / 500 AS f0, (l2 + 16) / 116 AS f1, (l2 + 16) / 116 - b2 / 200 AS f2 FROM sf_p), sf_w AS MATERIALIZED (SELECT *, {', '.join(f"({cube(f'f{k}')}) * {w}::DOUBLE AS w{k}" for k, w in enumerate(c.WHITE))} FROM sf_f),
 sf_c AS MATERIALIZED (SELECT *, {', '.join(f'{e} AS c{n}' for n, e in zip('rgb', rgb, strict=True))} FROM sf_w), sf AS (SELECT {key}, r, g, b, {', '.join(f"{byte(f'c{n}')} AS new_{n}" for n in 'rgb')} FROM sf_c)"""


@query("f25_palette_shift", f"WITH {v.PALETTES}, {shift_sql('palette_rows', 'sample_id', 7, 'moderate')} SELECT * FROM sf")
def _(s, d):
    return c.palette_shift(v.palette_rows(s, d), "sample_id", "moderate", 7)


@query("f26_variant_diff", f"WITH {PAIRED} SELECT sample_id, count(*) AS n, round(avg(CAST(r <> r2 OR g <> g2 OR b <> b2 AS INT)), 6) AS changed, round(avg(de), 4) AS mean, round(max(de), 4) AS most FROM dd GROUP BY 1")
def _(s, d):
    return c.variant_diff(shifted(s, d), "sample_id", ("r", "g", "b"), ("r2", "g2", "b2"))


@query("h24_decode_palettes", f"""WITH {SHIFTED}, w AS (SELECT sample_id, 1 + sample_id % 3 AS n_wanted, count(*) AS k FROM sh GROUP BY ALL), rk AS (SELECT sample_id, r, g, b, min(o) AS o FROM (SELECT sample_id, r % 64 AS r, g % 16 AS g, b, row_number() OVER (PARTITION BY sample_id ORDER BY r % 10 DESC, r, g, b) AS o FROM sh) GROUP BY ALL),
 tk AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY o) AS q FROM rk), ok AS (SELECT sample_id, r, g, b FROM tk JOIN w USING (sample_id) WHERE q <= n_wanted), {lab_sql('ok', 'z')}
 SELECT sample_id, string_agg(printf('#%02X%02X%02X', r, g, b), ',' ORDER BY l, a, b_) AS hex, CASE WHEN count(*) < any_value(n_wanted) THEN 'only ' || count(*) || ' of ' || any_value(n_wanted) END AS warning FROM z JOIN w USING (sample_id) GROUP BY 1""")
def _(s, d):
    own = F.array_sort(F.collect_list(F.struct((-(F.col("r") % 10)).alias("p"), "r", "g", "b")))
    rows = v.palette_rows(s, d).groupBy("sample_id").agg(own.alias("o"))
    colors = F.transform("o", lambda x: F.struct((x["r"] % 64).alias("r"), (x["g"] % 16).alias("g"), x["b"].alias("b"), (-x["p"]).alias("presence")))
    out = c.decode_palettes(rows.select("sample_id", (1 + F.col("sample_id") % 3).cast("int").alias("n_wanted"), colors.alias("colors")), "sample_id")
    return out.select("sample_id", F.concat_ws(",", "hex").alias("hex"), "warning")


def _sets(s, d):
    rows = shifted(s, d).groupBy((F.col("sample_id") * 3 + F.col("r") % 3).alias("sample_id")).agg(F.array_sort(F.collect_list(F.struct("r", "g", "b", "r2", "g2", "b2"))).alias("o"))
    targets = F.transform("o", lambda x: F.struct(x["r"].alias("r"), x["g"].alias("g"), x["b"].alias("b")))
    preds = F.transform("o", lambda x: F.struct(x["r2"].alias("r"), x["g2"].alias("g"), x["b2"].alias("b"), (x["g"] / 64.0).alias("presence")))
    return rows.select("sample_id", preds.alias("preds"), targets.alias("targets"))


@query("h25_match_palettes")  # an assignment has no SQL; tests compare it with all permutations
def _(s, d):
    return c.match_palettes(_sets(s, d), "sample_id")


@query("h26_palette_metrics", f"""WITH {PAIRED}, k AS (SELECT sample_id, count(*) AS n_true, count(*) - CAST(sample_id % 4 = 0 AS INT) + CAST(sample_id % 5 = 0 AS INT) AS n_pred FROM sh GROUP BY sample_id), p AS (SELECT sample_id, count(*) AS m, sum(least(de, 10)) AS s, max(de) AS x FROM dd GROUP BY 1), q AS (SELECT * FROM k LEFT JOIN p USING (sample_id)),
 o AS (SELECT round(avg(CAST(n_pred = n_true AS INT)), 6) AS count_accuracy, round(avg(abs(n_pred - n_true)), 6) AS count_mae, round(avg(CAST(n_pred = n_true AND x <= 1 AS INT)), 6) AS success, round(avg(greatest(n_pred - n_true, 0) / 12), 6) AS false_positives, round(sum(greatest(n_true - n_pred, 0)) / sum(n_true), 6) AS false_negatives, round(avg((s + 10 * abs(n_pred - n_true)) / greatest(n_pred, n_true, 1)), 6) AS set_error FROM q),
 t AS (SELECT round(avg((abs(r - r2) + abs(g - g2) + abs(b - b2)) / 765.0::DOUBLE), 6) AS mae, round(avg(de), 6) AS de_mean, {', '.join(f'round(avg(CAST(de <= {m} AS INT)), 6) AS de_within_{m}' for m in (1, 2, 5))}, {', '.join(f'round(quantile_cont(de, {x}), 6) AS de_{n}' for x, n in ((0.5, 'p50'), (0.9, 'p90'), (0.95, 'p95')))} FROM dd) SELECT * FROM o, t""")
def _(s, d):
    rows = shifted(s, d)
    n = F.count(F.lit(1))
    counts = rows.groupBy("sample_id").agg(n.alias("n_true")).withColumn("n_pred", F.col("n_true") - (F.col("sample_id") % 4 == 0).cast("int") + (F.col("sample_id") % 5 == 0).cast("int"))
    mae = (F.abs(F.col("r") - F.col("r2")) + F.abs(F.col("g") - F.col("g2")) + F.abs(F.col("b") - F.col("b2"))) / 765.0
    de = c.delta_e(c.lab(F.col("r"), F.col("g"), F.col("b")), c.lab(F.col("r2"), F.col("g2"), F.col("b2")))
    return c.palette_metrics(counts, rows.select("sample_id", mae.alias("mae"), de.alias("de")), "sample_id", 12)


@query("f21_patch_stats", f"""WITH {v.CELLS}, k AS (SELECT image_id, y // 4 AS py, x // 4 AS px, NOT locked AND target > 0 AS ok, (target * 60 + x) / 255.0::DOUBLE AS r, (pred * 60 + y) / 255.0::DOUBLE AS g, (target * 20) / 255.0::DOUBLE AS b FROM cells)
 SELECT image_id, py::BIGINT AS py, px::BIGINT AS px, count(*) FILTER (ok) AS n, {', '.join(f"round(coalesce(avg({n}) FILTER (ok), 0), 6) AS {n}_mean, round(greatest(coalesce(stddev_pop({n}) FILTER (ok), 0), 1e-8), 6) AS {n}_std, round(coalesce(min({n}) FILTER (ok), 1), 6) AS {n}_low, round(coalesce(max({n}) FILTER (ok), 0), 6) AS {n}_high" for n in 'rgb')} FROM k GROUP BY 1, 2, 3""")
def _(s, d):
    t, x, y, p = (F.col(n) for n in ("target", "x", "y", "pred"))
    cells = v.cells(s, d).select("image_id", "y", "x", (~F.col("locked") & (t > 0)).alias("valid"), (t * 60 + x).alias("r"), (p * 60 + y).alias("g"), (t * 20).alias("b"))
    return c.patch_stats(cells, 4).drop("ok_l", "ok_a", "ok_b")
