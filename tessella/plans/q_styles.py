"""Queries of regions: templates that fit, proposals that are taken, contacts, provisional roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import raster as r
from tessella.operators import styles

from . import views as v
from .q_raster import COMP
from .registry import query, table

#: Fixed palette of the classes of the cells view.
COLORS = {0: (255, 255, 255), 1: (40, 60, 200), 2: (150, 150, 150), 3: (90, 20, 20)}


def labelled(s, d, code="target"):
    """Cells with the number of their class component, and the wanted column as ``code``."""
    cells = v.cells(s, d).withColumn("code", F.col("target"))
    found = r.label_components(cells).select(*r.PLACE, styles.region_number(F.col("root_y"), F.col("root_x"), 8).alias("region"))
    return v.cells(s, d).withColumn("code", F.col(code)).join(found, r.PLACE)


def templates(s, d):
    """Two rows of codes from each nation's name."""
    half = F.floor(F.length("n_name") / 2).cast("int")
    at = table(s, d, "nation").select(F.col("n_nationkey").alias("template"), "n_name", half.alias("w"), F.explode(F.array(F.lit(0), F.lit(1))).alias("y"))
    at = at.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    return at.select("template", "y", "x", (F.ascii(F.substring("n_name", F.col("y") * F.col("w") + F.col("x") + 1, F.lit(1))) % 4).alias("code"))


RANK = f"""{COMP}, rg AS MATERIALIZED (SELECT c.image_id, m.root AS region, c.y, c.x, c.pred AS code FROM cells c JOIN comp m ON m.image_id = c.image_id AND m.y = c.y AND m.x = c.x),
 bx AS MATERIALIZED (SELECT image_id, region, min(y) AS y0, min(x) AS x0, max(y) - min(y) + 1 AS rh, max(x) - min(x) + 1 AS rw, count(*) AS area, count(*) FILTER (code > 0) AS shaded FROM rg GROUP BY 1, 2 HAVING max(y) > min(y) AND max(x) > min(x)),
 tp AS (SELECT n_nationkey AS template, 2 AS h, len(n_name) // 2 AS w, yy.y AS y, xx.x AS x, ascii(substr(n_name, yy.y * (len(n_name) // 2) + xx.x + 1, 1)) % 4 AS code FROM nation, (SELECT unnest(range(2)) AS y) yy, (SELECT unnest(range(20)) AS x) xx WHERE xx.x < len(n_name) // 2),
 t1 AS (SELECT template, k, CASE WHEN k // 2 % 2 = 1 THEN w ELSE h END AS h, CASE WHEN k // 2 % 2 = 1 THEN h ELSE w END AS w, CASE k // 2 WHEN 0 THEN y WHEN 1 THEN w - 1 - x WHEN 2 THEN h - 1 - y ELSE x END AS ty, CASE k // 2 WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN w - 1 - x ELSE h - 1 - y END AS tx, code FROM tp, (SELECT unnest(range(8)) AS k)),
 vr AS MATERIALIZED (SELECT template, k, h, w, ty, CASE WHEN k % 2 = 1 THEN w - 1 - tx ELSE tx END AS tx, code FROM t1),
 ag AS (SELECT g.image_id, g.region, template, k, count(*) AS agree FROM rg g JOIN bx USING (image_id, region) JOIN vr ON ty = (g.y - y0) % h AND tx = (g.x - x0) % w AND vr.code = g.code GROUP BY ALL),
 fl AS (SELECT rh, rw, template, k, count(*) FILTER (code > 0) AS above FROM (SELECT DISTINCT rh, rw FROM bx) s, (SELECT unnest(range(8)) AS py) p, (SELECT unnest(range(8)) AS px) q, vr WHERE py < rh AND px < rw AND ty = py % h AND tx = px % w GROUP BY 1, 2, 3, 4),
 sc AS (SELECT image_id, region, template, k, y0, x0, round(coalesce(agree, 0) / area - 0.25 * abs(above / (rh * rw) - shaded / area), 9) AS score FROM bx JOIN fl USING (rh, rw) LEFT JOIN ag USING (image_id, region, template, k)),
 best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY image_id, region ORDER BY score DESC, template, k) = 1)"""


@query("f19_rank_templates", f"WITH {RANK} SELECT image_id, region, template, k, score FROM best WHERE score >= 0.05")
def _(s, d):
    return styles.rank_templates(labelled(s, d, "pred"), templates(s, d))


@query("f19_propose", f"WITH {RANK} SELECT g.image_id, g.y, g.x, vr.code AS proposal FROM rg g JOIN best b USING (image_id, region) JOIN vr ON vr.template = b.template AND vr.k = b.k AND ty = (g.y - y0) % h AND tx = (g.x - x0) % w WHERE score >= 0.05")
def _(s, d):
    cells, t = labelled(s, d, "pred").checkpoint(), templates(s, d)
    return styles.propose(cells, styles.rank_templates(cells, t), t)


EDITS = f"""{COMP}, rg AS (SELECT c.*, m.root AS region, (c.y * 3 + c.x + c.image_id) % 6 - 1 AS proposal FROM cells c JOIN comp m ON m.image_id = c.image_id AND m.y = c.y AND m.x = c.x),
 rl AS (SELECT image_id, region, CASE WHEN count(*) < 2 THEN concat('too_small(', count(*), '<2)') WHEN bool_or(y = 0 OR x = 0 OR y = 7 OR x = 7) THEN 'open_outline_or_border_spill' ELSE '' END AS reason FROM rg GROUP BY 1, 2),
 rw AS (SELECT rg.*, c, 1 + CASE WHEN c = pred THEN floor(20 * abs(v)) ELSE 0 END + CASE WHEN c = (pred + 1) % 4 THEN (image_id + x) % 3 ELSE 0 END AS w FROM rg, (SELECT unnest(range(4)) AS c)),
 pr AS (SELECT *, CASE WHEN image_id % 5 = 0 THEN exp(w - max(w) OVER z) ELSE w END AS e FROM rw WINDOW z AS (PARTITION BY image_id, y, x)),
 ps AS (SELECT *, round(e / sum(e) OVER (PARTITION BY image_id, y, x), 9) AS p FROM pr),
 ce AS (SELECT image_id, y, x, region, pred, proposal, max(p) AS conf, max(p) FILTER (c = proposal) AS own, max(p) FILTER (c = pred) AS model FROM ps GROUP BY ALL),
 ed AS (SELECT ce.*, reason, CASE WHEN reason = '' AND proposal <> pred AND proposal BETWEEN 0 AND 3 THEN CASE WHEN conf < 0.55 + 0.05::DOUBLE AND own >= 0.45::DOUBLE * 0.75 THEN 'supported' WHEN own >= round(model + 0.05, 9) THEN 'assertive' END END AS by_ FROM ce JOIN rl USING (image_id, region))"""


def edits(s, d):
    cells = labelled(s, d)
    regions = r.region_reliability(r.label_components(cells), 2).select("image_id", styles.region_number(F.col("root_y"), F.col("root_x"), 8).alias("region"), "reliable", "reason").checkpoint()
    weight = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: 1.0 + F.when(c == F.col("pred"), F.floor(20 * F.abs("v"))).otherwise(0) + F.when(c == (F.col("pred") + 1) % 4, (F.col("image_id") + F.col("x")) % 3).otherwise(0))
    share = F.transform("w", lambda x: F.when(F.col("image_id") % 5 == 0, x).otherwise(x / F.col("sum")))
    own = cells.withColumn("proposal", (F.col("y") * 3 + F.col("x") + F.col("image_id")) % 6 - 1).withColumn("w", weight).withColumn("sum", F.aggregate("w", F.lit(0.0), lambda a, x: a + x)).withColumn("scores", share)
    own = styles.class_probabilities(own.join(regions, ["image_id", "region"]), "scores", "pred", 4)
    return styles.proposal_edits(own, "pred", "proposal", 4, influence=0.6, chosen=True), regions


@query("f18_proposal_edits", f"WITH {EDITS} SELECT image_id, y, x, region, CASE WHEN by_ IS NULL THEN pred ELSE proposal END AS edited, by_ IS NOT NULL AS changed, by_ AS by FROM ed")
def _(s, d):
    return edits(s, d)[0]


@query("f18_region_edits", f"WITH {EDITS} SELECT image_id, region, count(by_) AS changed, count(*) FILTER (by_ = 'supported') AS supported, count(*) FILTER (by_ = 'assertive') AS assertive, CASE WHEN any_value(reason) <> '' THEN any_value(reason) WHEN count(by_) > 0 THEN 'edited' ELSE 'no_confident_edits' END AS outcome FROM ed GROUP BY 1, 2")
def _(s, d):
    return styles.region_edits(*edits(s, d))


CONTACTS = f"""{COMP}, rg AS (SELECT c.image_id, c.y, c.x, c.target AS code, m.root AS region FROM cells c JOIN comp m ON m.image_id = c.image_id AND m.y = c.y AND m.x = c.x),
 ri AS (SELECT a.image_id, a.region, a.code, a.y, a.x, count(*) = 8 AS inner_ FROM rg a LEFT JOIN rg b ON a.image_id = b.image_id AND a.region = b.region AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x) GROUP BY ALL),
 ct AS MATERIALIZED (SELECT image_id, region, code, count(*) AS area, round(count(*) FILTER (NOT inner_) / count(*), 6) AS contact, sum((y = 0)::INT + (x = 0)::INT + (y = 7)::INT + (x = 7)::INT)::BIGINT AS sides FROM ri GROUP BY 1, 2, 3)"""


@query("f14_region_contacts", f"WITH {CONTACTS} SELECT * FROM ct")
def _(s, d):
    return styles.region_contacts(labelled(s, d))


@query("f14_region_adjacency", f"""WITH {CONTACTS}, p AS (SELECT a.image_id, a.region, b.region AS neighbour, count(*) AS length FROM rg a JOIN rg b ON a.image_id = b.image_id AND a.region <> b.region AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY ALL) SELECT *, round(length / sum(length) OVER (PARTITION BY image_id, region), 6) AS share FROM p""")
def _(s, d):
    return styles.region_adjacency(labelled(s, d))


LIGHT = "lt AS (SELECT * FROM (VALUES (0, 100.0), (1, 32.0), (2, 61.0), (3, 18.0)) t(code, l))"


ROLES = f"""{CONTACTS}, {LIGHT}, cd AS (SELECT image_id, code, sum(area)::BIGINT AS area, sum(sides) AS sides FROM ct GROUP BY 1, 2),
 rk AS (SELECT cd.*, sum(area) OVER (PARTITION BY image_id) AS total, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, cd.code) AS a, row_number() OVER (PARTITION BY image_id ORDER BY l, cd.code) AS b, count(*) OVER (PARTITION BY image_id) AS n FROM cd JOIN lt ON lt.code = cd.code),
 ot AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY code, region) AS place FROM ct WHERE area <= 6 OR contact > 0.9)"""


def roles(s, d):
    contacts = styles.region_contacts(labelled(s, d)).checkpoint()
    return styles.provisional_roles(contacts, styles.palette_rows(contacts, COLORS), 6, 0.9)


@query("f14_provisional_roles", f"""WITH {ROLES} SELECT image_id, 'background' AS role, a AS place, code, round(least(0.95, 0.5 + area / total), 6)::DOUBLE AS confidence, area, round(sides / area, 6)::DOUBLE AS border FROM rk WHERE a = 1
 UNION ALL SELECT image_id, 'shade', b, code, 0.35, area, round(sides / area, 6) FROM rk WHERE n >= 3 AND b <= 3""")
def _(s, d):
    return roles(s, d).where("role <> 'outline'").drop("region", "contact")


@query("f14_outline_roles", f"WITH {ROLES} SELECT image_id, 'outline' AS role, place, code, region, 0.4::DOUBLE AS confidence, area, contact, round(sides / area, 6)::DOUBLE AS border FROM ot WHERE place <= 5")
def _(s, d):
    return roles(s, d).where("role = 'outline'")
