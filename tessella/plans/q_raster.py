"""Queries of label rasters: layers, neighbourhoods, components, region scores and windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import raster as r

from . import views as v
from .registry import query


def cells(s, d, code="target"):
    return v.cells(s, d).withColumn("code", F.col(code))


#: Whether two cells of an image touch, and every cell's component (its first cell's number) for a class column.
def comp_sql(code: str, name: str, touch: str = "abs(c.y - q.y) + abs(c.x - q.x) = 1", where: str = "true") -> str:
    return f"""{name}_reach AS (SELECT image_id, {code} AS code, y, x, y * 8 + x AS o FROM cells WHERE {where} UNION SELECT q.image_id, q.code, c.y, c.x, q.o FROM {name}_reach q JOIN cells c ON c.image_id = q.image_id AND c.{code} = q.code AND {touch} WHERE {where.replace('locked', 'c.locked')}),
 {name} AS (SELECT image_id, code, y, x, min(o) AS root FROM {name}_reach GROUP BY ALL)"""


COMP = f"RECURSIVE {v.CELLS}, " + comp_sql("target", "comp")


@query("f1_recode", f"WITH {v.CELLS} SELECT image_id, y, x, CASE target WHEN 0 THEN 255 WHEN 1 THEN 200 WHEN 2 THEN 150 ELSE -100 END AS code FROM cells")
def _(s, d):
    return r.recode(cells(s, d), {0: 255, 1: 200, 2: 150}, -100).select(*r.PLACE, "code")


@query("f1_levels", f"WITH {v.CELLS} SELECT image_id, y, x, CASE WHEN target BETWEEN 1 AND 3 THEN target - 1 ELSE -100 END AS level, CAST(target BETWEEN 2 AND 3 AS INT) AS at_least_1, CAST(target = 3 AS INT) AS at_least_2 FROM cells")
def _(s, d):
    return r.levels(cells(s, d)).select(*r.PLACE, "level", "at_least_1", "at_least_2")


@query("f2_derive_layers", f"""WITH {v.CELLS} SELECT image_id, y, x, CASE WHEN locked THEN 0 ELSE 255 END AS source, NOT locked AS valid, NOT locked AND target > 0 AS shade, CASE WHEN NOT locked AND target > 0 THEN target - 1 ELSE 255 END AS level,
 CASE WHEN locked THEN 0 WHEN target = 0 THEN 255 WHEN target = 1 THEN 200 WHEN target = 2 THEN 150 ELSE 100 END AS oracle FROM cells""")
def _(s, d):
    return r.derive_layers(cells(s, d), "target", "locked")


@query("b20_roundtrip_mismatch", f"WITH {v.CELLS} SELECT image_id, count(*) AS n, count(*) FILTER (NOT locked AND pred <> target) AS mismatches FROM cells GROUP BY 1")
def _(s, d):
    c = cells(s, d)
    return r.rebuild_mismatch(r.derive_layers(c, "pred", "locked"), c, "target")


@query("f4_wrapped_boundary", f"""WITH {v.CELLS}, n AS (SELECT c.image_id, c.y, c.x, c.target AS code, l.target AS le, r.target AS ri, u.target AS up, w.target AS dn FROM cells c JOIN cells l ON l.image_id = c.image_id AND l.y = c.y AND l.x = (c.x + 7) % 8 JOIN cells r ON r.image_id = c.image_id AND r.y = c.y AND r.x = (c.x + 1) % 8
 JOIN cells u ON u.image_id = c.image_id AND u.x = c.x AND u.y = (c.y + 7) % 8 JOIN cells w ON w.image_id = c.image_id AND w.x = c.x AND w.y = (c.y + 1) % 8), o AS (SELECT *, CASE WHEN up <> code THEN up WHEN le <> code THEN le END AS other FROM n)
 SELECT image_id, y, x, code, le <> code OR ri <> code OR up <> code OR dn <> code AS edge, CASE WHEN other IS NULL THEN -1 ELSE least(other, code) END AS class_a, CASE WHEN other IS NULL THEN -1 ELSE greatest(other, code) END AS class_b FROM o""")
def _(s, d):
    return r.wrapped_boundary(cells(s, d))


@query("f5_dilate", f"""WITH {v.CELLS} SELECT c.image_id, c.y, c.x, c.target = 3 AS mask, bool_or(m.target = 3 AND abs(m.y - c.y) <= 1 AND abs(m.x - c.x) <= 1) AS sq, bool_or(m.target = 3 AND abs(m.y - c.y) + abs(m.x - c.x) <= 2) AS di FROM cells c JOIN cells m ON m.image_id = c.image_id GROUP BY ALL""")
def _(s, d):
    c = cells(s, d).withColumn("mask", F.col("target") == 3)
    a, b = r.dilate(c, "mask", 1).withColumnRenamed("grown", "sq"), r.dilate(c, "mask", 2, "diamond").select(*r.PLACE, F.col("grown").alias("di"))
    return a.join(b, r.PLACE)


@query("f6_components", f"WITH {COMP} SELECT image_id, y, x, code, CAST(root // 8 AS INT) AS root_y, CAST(root % 8 AS INT) AS root_x FROM comp")
def _(s, d):
    return r.label_components(cells(s, d))


@query("f6_components_diagonal", f"WITH RECURSIVE {v.CELLS}, {comp_sql('target', 'comp', 'greatest(abs(c.y - q.y), abs(c.x - q.x)) = 1')} SELECT image_id, y, x, code, CAST(root // 8 AS INT) AS root_y, CAST(root % 8 AS INT) AS root_x FROM comp")
def _(s, d):
    return r.label_components(cells(s, d), diagonal=True)


STATS = f"""{COMP}, sides AS (SELECT a.image_id, a.root, a.y, a.x, 4 - count(b.y) AS open FROM comp a LEFT JOIN comp b ON b.image_id = a.image_id AND b.root = a.root AND b.code = a.code AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY ALL),
 st AS (SELECT c.image_id, c.code, CAST(c.root // 8 AS INT) AS root_y, CAST(c.root % 8 AS INT) AS root_x, count(*) AS area, min(c.y) AS y0, min(c.x) AS x0, max(c.y) AS y1, max(c.x) AS x1, round(avg(c.y), 6) AS cy, round(avg(c.x), 6) AS cx, CAST(sum(open) AS BIGINT) AS perimeter FROM comp c JOIN sides s ON s.image_id = c.image_id AND s.y = c.y AND s.x = c.x GROUP BY 1, 2, 3, 4)"""


@query("f7_component_stats", f"""WITH {STATS} SELECT *, round(area / ((y1 - y0 + 1) * (x1 - x0 + 1)), 6) AS fill, area <= 3 AS tiny, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, cy, cx, root_y, root_x) AS place FROM st""")
def _(s, d):
    return r.component_stats(r.label_components(cells(s, d)), 3)


@query("f7_largest_components", f"""WITH {STATS} SELECT image_id, code, area, place FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, cy, cx, root_y, root_x) AS place FROM st) WHERE area >= 5 AND place <= 3""")
def _(s, d):
    return r.largest_components(r.component_stats(r.label_components(cells(s, d))), 5, 3).select("image_id", "code", "area", "place")


@query("f8_region_reliability", f"""WITH {COMP}, g AS (SELECT image_id, code, root, count(*) AS area, bool_or(y IN (0, 7) OR x IN (0, 7)) AS t FROM comp GROUP BY ALL)
 SELECT image_id, code, CAST(root // 8 AS INT) AS root_y, CAST(root % 8 AS INT) AS root_x, area, area >= 2 AND NOT t AS reliable, CASE WHEN area < 2 THEN 'too_small(' || area || '<2)' WHEN t THEN 'open_outline_or_border_spill' ELSE '' END AS reason FROM g""")
def _(s, d):
    return r.region_reliability(r.label_components(cells(s, d)), 2)


INDEXED = f"{v.CELLS}, ix AS (SELECT image_id, y, x, CASE WHEN locked THEN 1 ELSE least(target, 2) END AS a, CASE WHEN locked THEN CASE WHEN image_id % 9 = 0 THEN 0 ELSE 1 END WHEN target >= 2 THEN 1 + pred ELSE target END AS b, pred % 3 AS p FROM cells)"


def indexed(s, d):
    c = cells(s, d)
    a = F.when(F.col("locked"), 1).otherwise(F.least("target", F.lit(2)))
    b = F.when(F.col("locked"), F.when(F.col("image_id") % 9 == 0, 0).otherwise(1)).when(F.col("target") >= 2, 1 + F.col("pred")).otherwise(F.col("target"))
    return c.select(*r.PLACE, a.alias("a"), b.alias("b"), (F.col("pred") % 3).alias("p"))


@query("f9_index_contract", f"""WITH {INDEXED}, g AS (SELECT image_id, count(*) FILTER (a NOT BETWEEN 0 AND 2) AS bad_input, count(*) FILTER (b NOT BETWEEN 0 AND 4) AS bad_output, count(*) FILTER (a <> 2 AND a <> b) AS outside, count(*) FILTER (a = 2 AND b IN (0, 1)) AS inside FROM ix GROUP BY 1)
 SELECT *, bad_input + bad_output + outside + inside = 0 AS ok FROM g""")
def _(s, d):
    return r.index_contract(indexed(s, d), "a", "b")


@query("f9_compose_output", f"WITH {INDEXED} SELECT image_id, y, x, CASE WHEN b IN (3, 4) THEN 2 ELSE b END AS input, CASE WHEN a = 2 THEN p + 2 ELSE a END AS output FROM ix")
def _(s, d):
    return r.compose_output(r.input_from_target(indexed(s, d), "b"), "a", "p").select(*r.PLACE, "input", "output")


@query("f11_soft_boundary", f"""WITH {v.CELLS}, p AS (SELECT image_id, y, x, list_transform(range(4), lambda k: CASE WHEN k = pred THEN 0.7::DOUBLE ELSE 0.1::DOUBLE END) AS p FROM cells)
 SELECT a.image_id, a.y, a.x, round(max(1 - list_dot_product(a.p, b.p)), 6) AS boundary FROM p a JOIN p b ON a.image_id = b.image_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY ALL""")
def _(s, d):
    c = cells(s, d).withColumn("p", F.array(*[F.when(F.col("pred") == k, 0.7).otherwise(0.1) for k in range(4)]))
    return r.soft_boundary(c, "p")


@query("f12_thin_structure", f"""WITH {v.CELLS}, k AS (SELECT image_id, target, count(*) AS n FROM cells GROUP BY ALL), t AS (SELECT a.image_id, a.y, a.x, any_value(k.n) < 4 OR bool_or(b.target <> a.target AND (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 4) AS thin FROM cells a JOIN cells b ON a.image_id = b.image_id JOIN k ON k.image_id = a.image_id AND k.target = a.target GROUP BY ALL),
 c AS (SELECT a.image_id, a.y, a.x, a.thin, count(*) FILTER (b.thin) AS n FROM t a JOIN t b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL) SELECT image_id, y, x, thin, thin AND n <= 2 AS endpoint, thin AND n >= 4 AS junction FROM c""")
def _(s, d):
    return r.thin_structure(cells(s, d))


@query("f13_distance", f"WITH {v.CELLS} SELECT a.image_id, a.y, a.x, round(sqrt(min((a.y - b.y) ** 2 + (a.x - b.x) ** 2) FILTER (b.target = 3)), 6) AS distance FROM cells a JOIN cells b ON a.image_id = b.image_id GROUP BY ALL")
def _(s, d):
    return r.distance_to(cells(s, d).withColumn("m", F.col("target") == 3), "m")


@query("f15_eligible", f"WITH {v.CELLS} SELECT image_id, y, x, least(pred, 2) = 2 AND target <> 3 AND NOT locked AS by_index, x % 2 = 0 AND target <> 3 AS by_mask, target <> 3 AS fallback, false AS explicit FROM cells")
def _(s, d):
    c = cells(s, d).withColumn("ix", F.least("pred", F.lit(2))).withColumn("em", F.col("x") % 2 == 0)
    line = F.col("target") == 3
    out = r.eligible_cells(c, line, index="ix", locked="locked").withColumnRenamed("eligible", "by_index")
    out = r.eligible_cells(out, line, editable="em").withColumnRenamed("eligible", "by_mask")
    out = r.eligible_cells(out, line).withColumnRenamed("eligible", "fallback")
    return r.eligible_cells(out, line, explicit=True).select(*r.PLACE, "by_index", "by_mask", "fallback", F.col("eligible").alias("explicit"))


@query("f16_constraints", f"WITH {v.CELLS} SELECT image_id, y, x, CASE WHEN NOT locked AND pred IN (0, 1, 2) THEN pred ELSE target END AS final, CASE WHEN NOT locked AND pred IN (0, 1, 2) THEN pred ELSE target END <> target AS changed FROM cells")
def _(s, d):
    return r.apply_constraints(cells(s, d).withColumn("free", ~F.col("locked")), "target", "pred", "free", [0, 1, 2]).select(*r.PLACE, "final", "changed")


@query("f17_majority_cleanup", f"""WITH {v.CELLS}, n AS (SELECT a.image_id, a.y, a.x, b.pred AS c, count(*) AS k FROM cells a JOIN cells b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL), m AS (SELECT image_id, y, x, arg_max(c, k * 10 - c) AS c FROM n GROUP BY ALL)
 SELECT a.image_id, a.y, a.x, a.pred AS code, CASE WHEN abs(a.v) < 0.05 AND NOT a.locked THEN m.c ELSE a.pred END AS cleaned FROM cells a JOIN m ON m.image_id = a.image_id AND m.y = a.y AND m.x = a.x""")
def _(s, d):
    return r.majority_cleanup(cells(s, d, "pred").withColumn("sure", F.abs("v")), "code", "sure", 0.05, 1, "locked")


@query("f20_edit_report", f"WITH {v.CELLS} SELECT image_id, count(*) AS n, count(*) FILTER (target <> pred) AS changed, round(count(*) FILTER (target <> pred) / count(*), 6) AS share FROM cells GROUP BY 1")
def _(s, d):
    return r.edit_report(cells(s, d), "target", "pred")


WINDOWS = "w AS (SELECT a.o AS y0, b.o AS x0 FROM (VALUES (0), (3), (4)) a(o), (VALUES (0), (3), (4)) b(o))"


@query("e12_window_sums", f"WITH {v.CELLS}, {WINDOWS} SELECT image_id, y0, x0, count(*) FILTER (target = 3 AND y >= y0 AND y < y0 + 4 AND x >= x0 AND x < x0 + 4) AS n FROM cells, w GROUP BY ALL")
def _(s, d):
    return r.window_sums(cells(s, d).withColumn("m", F.col("target") == 3), "m", 4, 3)


@query("e13_score_windows", f"""WITH {v.CELLS}, {WINDOWS}, g AS (SELECT image_id, y0, x0, count(*) FILTER (target = 3) AS dark, count(*) FILTER (target > 0) AS shade FROM cells, w WHERE y >= y0 AND y < y0 + 4 AND x >= x0 AND x < x0 + 4 GROUP BY ALL),
 u AS (SELECT image_id, 'dark' AS category, y0, x0, round(dark / 16, 6) AS score FROM g UNION ALL SELECT image_id, 'shade', y0, x0, round(shade / 16, 6) FROM g) SELECT *, row_number() OVER (PARTITION BY image_id, category ORDER BY score DESC, x0, y0) AS place FROM u""")
def _(s, d):
    c = cells(s, d).withColumn("m", F.col("target") == 3).withColumn("q", F.col("target") > 0)
    return r.score_windows(c, {"dark": "m", "shade": "q"}, 4, 3)


@query("e25_cell_weights", f"""WITH {v.CELLS} SELECT image_id, y, x, round(CASE WHEN locked THEN 0.0 WHEN x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5 THEN 1.0 ELSE 0.5 END * CASE WHEN target <> pred THEN 1.5 ELSE 1 END * CASE WHEN target = 3 THEN 2.0 ELSE 1 END * CASE WHEN target >= 1 THEN 1.25 ELSE 1 END, 6)::DOUBLE AS weight FROM cells""")
def _(s, d):
    core = F.col("x").between(2, 5) & F.col("y").between(2, 5)
    return r.cell_weights(cells(s, d), core, ~F.col("locked"), 0.5, F.col("target") != F.col("pred"), F.col("target") - 1).select(*r.PLACE, "weight")


AREAS = f"""{v.CELLS}, z AS (SELECT CASE WHEN locked THEN 255 ELSE target END AS t, pred AS p FROM cells), k AS (SELECT unnest(range(5))::INT AS class), a AS (SELECT class, count(*) FILTER (t = class AND p = class) AS intersect, count(*) FILTER (t = class OR p = class) AS union, count(*) FILTER (p = class) AS predicted, count(*) FILTER (t = class) AS labelled FROM z, k WHERE t <> 255 GROUP BY 1)"""


@query("h13_seg_areas", f"WITH {AREAS.replace('intersect', 'i_').replace('union', 'u_')} SELECT class, i_ AS \"intersect\", u_ AS \"union\", predicted, labelled FROM a")
def _(s, d):
    c = cells(s, d).withColumn("t", F.when(F.col("locked"), 255).otherwise(F.col("target")))
    return r.seg_areas(c, "t", "pred", 5)


@query("h13_seg_metrics", f"""WITH {AREAS.replace('intersect', 'i_').replace('union', 'u_')}, m AS (SELECT i_ / nullif(u_, 0) AS iou, i_ / nullif(labelled, 0) AS rec, i_ / nullif(predicted, 0) AS prec, 2 * i_ / nullif(predicted + labelled, 0) AS dice, i_, labelled FROM a)
 SELECT round(avg(iou), 6) AS miou, round(avg(rec), 6) AS acc, round(sum(i_) / sum(labelled), 6) AS a_acc, round(avg(dice), 6) AS dice, round(avg(2 * prec * rec / nullif(prec + rec, 0)), 6) AS fscore, round(avg(prec), 6) AS precision, round(avg(rec), 6) AS recall FROM m""")
def _(s, d):
    c = cells(s, d).withColumn("t", F.when(F.col("locked"), 255).otherwise(F.col("target")))
    return r.seg_metrics(r.seg_areas(c, "t", "pred", 5))


BF1 = """e AS (SELECT a.image_id, a.y, a.x, NOT a.locked AND coalesce(bool_or(b.target <> a.target), false) AS gt, NOT a.locked AND coalesce(bool_or(b.pred <> a.pred), false) AS pr FROM cells a LEFT JOIN cells b ON a.image_id = b.image_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY a.image_id, a.y, a.x, a.locked),
 nr AS (SELECT a.image_id, a.gt, a.pr, bool_or(b.gt) AS gn, bool_or(b.pr) AS pn FROM e a JOIN e b ON a.image_id = b.image_id AND abs(a.y - b.y) + abs(a.x - b.x) <= 2 GROUP BY a.image_id, a.y, a.x, a.gt, a.pr), ct AS (SELECT image_id, count(*) FILTER (gt) AS g, count(*) FILTER (pr) AS p, count(*) FILTER (pr AND gn) AS hp, count(*) FILTER (gt AND pn) AS hg FROM nr GROUP BY 1),
 bf AS (SELECT image_id, round(CASE WHEN g = 0 AND p = 0 THEN 1 WHEN g = 0 OR p = 0 OR hp + hg = 0 THEN 0 ELSE 2 * (hp / p) * (hg / g) / (hp / p + hg / g) END, 6) AS bf1 FROM ct)"""


@query("h15_boundary_f1", f"WITH {v.CELLS}, {BF1} SELECT image_id, bf1 FROM bf")
def _(s, d):
    return r.boundary_f1(cells(s, d), "target", "pred", ~F.col("locked"))


def region_sql(source: str, regions: dict[str, str], keys: str = "image_id") -> str:
    rows = ", ".join(f"('{n}', {c})" for n, c in regions.items())
    return f"""rg AS (SELECT {keys}, target, pred, u.region, u.on_ FROM {source}, LATERAL (VALUES {rows}) u(region, on_)), pc AS (SELECT {keys}, region, k, count(*) FILTER (on_ AND target = k AND pred = k) AS i, count(*) FILTER (on_ AND target = k) AS t, count(*) FILTER (on_ AND pred = k) AS p FROM rg, (SELECT unnest(range(4)) AS k) GROUP BY ALL),
 sc AS (SELECT {keys}, region, CAST(sum(t) AS BIGINT) AS n, round(sum(i) / greatest(sum(t), 1), 6) AS acc, round(avg(i / greatest(t + p - i, 1)), 6) AS miou, round(coalesce(avg(i / greatest(t + p - i, 1)) FILTER (t > 0), 0), 6) AS miou_present, round(coalesce(avg(i / greatest(t + p - i, 1)) FILTER (t + p > 0), 0), 6) AS miou_fp FROM pc GROUP BY ALL)"""


NEAR = f"""{v.CELLS}, eb AS (SELECT a.image_id, a.y, a.x, bool_or(b.target <> a.target) AS e FROM cells a JOIN cells b ON a.image_id = b.image_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY ALL),
 bn AS (SELECT a.*, NOT a.locked AND (bool_or(abs(b.v) < 0.003 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1) OR bool_or(eb.e AND b.y = a.y AND b.x = a.x AND a.y < 2) OR bool_or(eb.e AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1)) AS nb FROM cells a JOIN cells b ON a.image_id = b.image_id JOIN eb ON eb.image_id = b.image_id AND eb.y = b.y AND eb.x = b.x GROUP BY a.image_id, a.y, a.x, a.v, a.target, a.pred, a.locked)"""
EVAL = f"""{NEAR}, {BF1}, {region_sql('bn', {'global': 'NOT locked', 'boundary': 'nb', 'interior': 'NOT locked AND NOT nb'})},
 ev AS (SELECT image_id, {', '.join(f"max({c}) FILTER (region = '{g}') AS {g}_{c}" for g in ('global', 'boundary', 'interior') for c in ('miou', 'acc'))}, max(n) FILTER (region = 'boundary') AS boundary_n, max(n) FILTER (region = 'interior') AS interior_n, any_value(bf1) AS bf1 FROM sc JOIN bf USING (image_id) GROUP BY 1)"""


def evaluated(s, d):
    c = cells(s, d).withColumn("tr", F.abs("v") < 0.003)
    return r.boundary_eval(c, "target", "pred", "tr", ~F.col("locked"), 4, radius=1)


@query("h16_boundary_eval", f"WITH {EVAL} SELECT * FROM ev")
def _(s, d):
    return evaluated(s, d)


@query("h16_average_eval", f"WITH {EVAL} SELECT {', '.join(f'round(avg({c}), 6) AS {c}' for c in ('global_miou', 'global_acc', 'boundary_miou', 'boundary_acc', 'interior_miou', 'interior_acc', 'bf1'))}, CAST(sum(boundary_n) AS BIGINT) AS boundary_n, CAST(sum(interior_n) AS BIGINT) AS interior_n FROM ev")
def _(s, d):
    return r.average_eval(evaluated(s, d))


SMALL = f"""RECURSIVE {v.CELLS}, {comp_sql('target', 'g', where='NOT locked')}, {comp_sql('pred', 'p', where='NOT locked')}, ga AS (SELECT image_id, code, root, count(*) AS area FROM g WHERE code > 0 GROUP BY ALL HAVING count(*) <= 5), ps AS (SELECT image_id, code, root, count(*) AS size FROM p GROUP BY ALL),
 ov AS (SELECT g.image_id, g.code, g.root, p.root AS pr, count(*) AS n FROM g JOIN p ON p.image_id = g.image_id AND p.y = g.y AND p.x = g.x AND p.code = g.code GROUP BY ALL), bo AS (SELECT image_id, code, root, max(n) AS n, arg_max(pr, n * 100 - pr) AS pr FROM ov GROUP BY ALL),
 sm AS (SELECT ga.image_id, coalesce(bo.n, 0) / ga.area AS r, coalesce(bo.n / ps.size, 0) AS q FROM ga LEFT JOIN bo ON bo.image_id = ga.image_id AND bo.code = ga.code AND bo.root = ga.root LEFT JOIN ps ON ps.image_id = bo.image_id AND ps.code = bo.code AND ps.root = bo.pr)"""


@query("h17_small_components", f"WITH {SMALL} SELECT image_id, count(*) AS parts, round(avg(r) + 1e-9, 6) AS recall, round(avg(2 * q * r / greatest(q + r, 1e-8)) + 1e-9, 6) AS f1 FROM sm GROUP BY 1")
def _(s, d):
    out = r.small_component_scores(cells(s, d), "target", "pred", ~F.col("locked"), [1, 2, 3], 5)
    return out.select("image_id", "parts", F.round(F.col("recall") + 1e-9, 6).alias("recall"), F.round(F.col("f1") + 1e-9, 6).alias("f1"))  # off exact halves


@query("h17_tiny_agreement", f"""WITH RECURSIVE {v.CELLS}, rc AS (SELECT image_id, y, x, y * 8 + x AS o FROM cells WHERE target = 3 UNION SELECT q.image_id, c.y, c.x, q.o FROM rc q JOIN cells c ON c.image_id = q.image_id AND c.target = 3 AND greatest(abs(c.y - q.y), abs(c.x - q.x)) = 1), co AS (SELECT image_id, y, x, min(o) AS root FROM rc GROUP BY ALL),
 e AS (SELECT co.image_id, root, count(*) AS n, avg(CAST(target = pred AS INT)) AS a FROM co JOIN cells c ON c.image_id = co.image_id AND c.y = co.y AND c.x = co.x GROUP BY ALL HAVING count(*) <= 4) SELECT image_id, count(*) AS parts, round(avg(a), 6) AS agreement FROM e GROUP BY 1""")
def _(s, d):
    return r.tiny_agreement(cells(s, d), "target", "pred", F.col("target") == 3, 4)


OUTER = "(y < {b} OR y >= 8 - {b}) {j} (x < {b} OR x >= 8 - {b})"
REGIONS = {"global": "NOT locked", "core": "NOT locked", "seam": "NOT locked AND (y IN (3, 4) OR x IN (3, 4))", "border": f"NOT locked AND ({OUTER.format(b=1, j='OR')})", "corner": f"NOT locked AND {OUTER.format(b=2, j='AND')}"}


@query("h18_region_metrics", f"WITH {v.CELLS}, {region_sql('cells', REGIONS)} SELECT * FROM sc")
def _(s, d):
    return r.region_metrics(cells(s, d), "target", "pred", ~F.col("locked"), 4, 4, 1, 1, 2)


TURNED = f"{v.CELLS}, tc AS (SELECT *, image_id % 8 AS k_ FROM cells), {region_sql('tc', REGIONS, 'image_id, k_')}"


def turned(s, d):
    return r.region_metrics(cells(s, d).withColumn("k", F.col("image_id") % 8), "target", "pred", ~F.col("locked"), 4, 4, 1, 1, 2, ("image_id", "k"))


@query("h19_aggregate_regions", f"""WITH {TURNED}, o AS (SELECT region, k_, avg(miou_present) AS m, avg(miou_fp) AS f FROM sc GROUP BY ALL), w AS (SELECT region, round(min(m), 6) AS worst_miou, round(min(f), 6) AS worst_miou_fp FROM o GROUP BY 1)
 SELECT region, round(avg(miou_present) FILTER (n > 0), 6) AS miou, round(avg(miou_fp) FILTER (n > 0), 6) AS miou_fp, round(avg(acc) FILTER (n > 0), 6) AS acc, any_value(worst_miou) AS worst_miou, any_value(worst_miou_fp) AS worst_miou_fp FROM sc JOIN w USING (region) GROUP BY 1""")
def _(s, d):
    return r.aggregate_regions(turned(s, d))


@query("h20_composite_score", f"WITH {EVAL} SELECT image_id, round(0.35::DOUBLE * global_miou + 0.35::DOUBLE * boundary_miou + 0.2::DOUBLE * bf1 + 0.1::DOUBLE * boundary_acc + 1e-9, 6) AS score FROM ev")
def _(s, d):
    return r.composite_score(evaluated(s, d).withColumnRenamed("global_miou", "miou"), "boundary").select("image_id", F.round(F.col("score") + 1e-9, 6).alias("score"))
