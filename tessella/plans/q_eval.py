"""Queries of dataset statistics, evaluation over orientations, splits and suites, and stored artefacts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import evaluation as e
from tessella.operators import raster as r
from tessella.operators import stats
from tessella.operators.geometry import orient_place

from . import views as v
from .q_raster import COMP, NEAR, SMALL, cells, region_sql
from .registry import query, table

QUARTERS = "qt AS (SELECT image_id, y, x, target, concat('q', y // 4, x // 4) AS strategy FROM cells)"
CLASSES = range(4)


@query("h28_dataset_stats", f"""WITH {COMP}, {QUARTERS},
 im AS MATERIALIZED (SELECT image_id, CASE WHEN image_id % 13 = 0 THEN 'invalid' WHEN image_id % 7 = 0 THEN 'warning' ELSE 'valid' END AS status, CASE WHEN image_id % 10 < 8 THEN 'train' WHEN image_id % 10 = 8 THEN 'val' ELSE 'test' END AS split, 256 + 32 * (image_id % 50) AS width, 256 + 16 * (image_id % 64) AS height, count(*) FILTER (NOT locked) AS candidates, {', '.join(f'count(*) FILTER (target = {c}) AS code_{c}' for c in CLASSES)} FROM cells GROUP BY 1),
 ar AS (SELECT image_id, root, count(*) AS area FROM comp GROUP BY 1, 2),
 cr AS MATERIALIZED (SELECT qt.image_id, strategy, any_value(split) AS split, count(*) FILTER (target = 3) <= 2 AS tiny, {', '.join(f'count(*) FILTER (target = {c}) AS code_{c}' for c in CLASSES)} FROM qt JOIN im ON im.image_id = qt.image_id GROUP BY 1, 2)
 SELECT 'images by status' AS section, status AS name, count(*)::DOUBLE AS value FROM im GROUP BY status UNION ALL SELECT 'images by split', split, count(*) FROM im GROUP BY split UNION ALL SELECT 'images', 'count', count(*) FROM im UNION ALL SELECT 'images', 'candidates', sum(candidates) FROM im
 {' '.join(f"UNION ALL SELECT 'images', '{c}_{n}', round({f}({c}), 6) FROM im" for c in ('width', 'height') for n, f in (('min', 'min'), ('max', 'max'), ('mean', 'avg')))} {' '.join(f"UNION ALL SELECT 'classes', 'code_{c}', sum(code_{c}) FROM im" for c in CLASSES)}
 {' '.join(f"UNION ALL SELECT 'components', '{n}', round({f}, 6) FROM ar" for n, f in (('count', 'count(*)'), ('min', 'min(area)'), ('max', 'max(area)'), ('mean', 'avg(area)'), ('median', 'quantile_cont(area, 0.5)'), ('p90', 'quantile_cont(area, 0.9)'), ('tiny', 'count(*) FILTER (area <= 3)')))}
 UNION ALL SELECT 'crops by split', split, count(*) FROM cr GROUP BY split UNION ALL SELECT 'crops by strategy', strategy, count(*) FROM cr GROUP BY strategy UNION ALL SELECT 'crops', 'count', count(*) FROM cr UNION ALL SELECT 'crops', 'tiny', count(*) FILTER (tiny) FROM cr {' '.join(f"UNION ALL SELECT 'crops', 'code_{c}', sum(code_{c}) FROM cr" for c in CLASSES)}""")
def _(s, d):
    c = cells(s, d)
    i = F.col("image_id")
    by_class = [F.count_if(F.col("target") == k).alias(f"code_{k}") for k in CLASSES]
    status = F.when(i % 13 == 0, "invalid").when(i % 7 == 0, "warning").otherwise("valid")
    split = F.when(i % 10 < 8, "train").when(i % 10 == 8, "val").otherwise("test")
    images = c.groupBy("image_id").agg(F.count_if(~F.col("locked")).alias("candidates"), *by_class)
    images = images.select("*", status.alias("status"), split.alias("split"), (256 + 32 * (i % 50)).alias("width"), (256 + 16 * (i % 64)).alias("height"))
    sizes = r.label_components(c).groupBy(*r.COMPONENT).agg(F.count(F.lit(1)).alias("area"))
    quarter = F.concat(F.lit("q"), F.expr("y div 4"), F.expr("x div 4"))
    crops = c.groupBy("image_id", quarter.alias("strategy")).agg((F.count_if(F.col("target") == 3) <= 2).alias("tiny"), *by_class).withColumn("split", split)
    return stats.dataset_stats(images, sizes, crops, list(CLASSES), 3)


WIDE = """wd AS (SELECT vec_id AS image_id, CAST(pos // 16 AS INT) AS y, CAST(pos % 16 AS INT) AS x, CAST(e AS DOUBLE) AS v FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)),
 tn AS (SELECT *, k % 4 AS t, CASE k % 4 WHEN 0 THEN y WHEN 1 THEN 15 - x WHEN 2 THEN 3 - y ELSE x END AS oy, CASE k % 4 WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN 15 - x ELSE 3 - y END AS o1 FROM wd, (SELECT unnest(range(8)) AS k)),
 tp AS (SELECT *, CASE WHEN k >= 4 THEN CASE WHEN t % 2 = 1 THEN 3 - o1 ELSE 15 - o1 END ELSE o1 END AS ox FROM tn),
 pq AS (SELECT *, v + ((oy * 7 + ox * 3 + k) % 5 - 2) * 0.02::DOUBLE AS u, (image_id + k) % 11 = 0 AND oy = 0 AS gone FROM tp),
 bn AS (SELECT image_id, k, CASE WHEN v < -0.1 THEN 3 WHEN v < 0 THEN 2 WHEN v < 0.1 THEN 1 ELSE 0 END AS target, CASE WHEN gone THEN -1 WHEN u < -0.1 THEN 3 WHEN u < 0 THEN 2 WHEN u < 0.1::DOUBLE THEN 1 ELSE 0 END AS pred FROM pq)"""


@query("h31_inverse_consistency", f"""WITH {WIDE}, ct AS (SELECT image_id, k, c, count(*) FILTER (target = c AND pred = c) AS i, count(*) FILTER (target = c) AS n, count(*) FILTER (target = c AND pred >= 0) AS nt, count(*) FILTER (pred = c) AS p FROM bn, (SELECT unnest(range(4)) AS c) GROUP BY 1, 2, 3),
 sc AS (SELECT image_id, k, round(coalesce(avg(i / greatest(nt + p - i, 1)) FILTER (n > 0), 0), 6) AS m FROM ct GROUP BY 1, 2) SELECT image_id, k, m AS transformed_miou, m AS inverse_miou, 0.0::DOUBLE AS delta FROM sc""")
def _(s, d):
    at = table(s, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("pos", "e"))
    at = at.select("image_id", F.expr("cast(pos div 16 as int)").alias("y"), (F.col("pos") % 16).alias("x"), F.col("e").cast("double").alias("v"))
    code = lambda c: F.when(c < -0.1, 3).when(c < 0, 2).when(c < 0.1, 1).otherwise(0)
    turned = at.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    oy, ox = orient_place(F.col("y"), F.col("x"), F.lit(4), F.lit(16), F.col("k"))
    turned = turned.withColumn("oy", oy).withColumn("ox", ox).where("not ((image_id + k) % 11 = 0 and oy = 0)")
    shift = (((F.col("oy") * 7 + F.col("ox") * 3 + F.col("k")) % 5) - 2) * F.lit(0.02)
    return e.inverse_consistency(at.select("image_id", "y", "x", code(F.col("v")).alias("target")), turned.select("image_id", "k", "oy", "ox", code(F.col("v") + shift).alias("pred")), 4)


#: Each image's mean IoU of all cells, near boundaries and along seams, and its recall of small components.
PARTS = f"""{SMALL}, {NEAR.replace(v.CELLS + ', ', '')}, {region_sql('bn', {'global': 'NOT locked', 'boundary': 'nb', 'seam': 'NOT locked AND (y IN (3, 4) OR x IN (3, 4))'})}, sr AS (SELECT image_id, round(avg(r), 6) AS small FROM sm GROUP BY 1),
 pt AS MATERIALIZED (SELECT image_id, image_id % 8 AS k, max(miou_present) FILTER (region = 'global') AS miou, max(miou_present) FILTER (region = 'boundary') AS boundary, any_value(small) AS small, max(miou_present) FILTER (region = 'seam') AS seam FROM sc LEFT JOIN sr USING (image_id) GROUP BY 1, 2)"""
SCORE = "0.25::DOUBLE * miou + 0.25::DOUBLE * worst + 0.2::DOUBLE * boundary + 0.15::DOUBLE * coalesce(small, miou) + 0.15::DOUBLE * seam"


def parts(s, d):
    c = cells(s, d).withColumn("tr", F.abs("v") < 0.003)
    near = r.boundary_regions(c, "target", "tr", ~F.col("locked"), 1)
    seam = F.col("y").isin(3, 4) | F.col("x").isin(3, 4)
    scores = r.region_scores(near, {"global": F.col("supervised"), "boundary": F.col("near_boundary"), "seam": F.col("supervised") & seam}, "target", "pred", 4)
    wide = scores.groupBy("image_id").agg(*[F.max(F.when(F.col("region") == g, F.col("miou_present"))).alias(n) for g, n in (("global", "miou"), ("boundary", "boundary"), ("seam", "seam"))])
    small = r.small_component_scores(c, "target", "pred", ~F.col("locked"), [1, 2, 3], 5).select("image_id", F.round("recall", 6).alias("small"))
    return wide.join(small, "image_id", "left").withColumn("k", (F.col("image_id") % 8).cast("int"))


@query("h32_scene_evaluation", f"""WITH {PARTS}, sn AS (SELECT *, image_id // 16 AS scene FROM pt WHERE NOT (image_id // 16 % 7 = 3 AND k = 5)), ks AS (SELECT scene, k, avg(miou) AS m FROM sn GROUP BY 1, 2),
 ms AS (SELECT s.scene, string_agg(CAST(q.k AS VARCHAR), ',' ORDER BY q.k) AS missing FROM (SELECT DISTINCT scene FROM sn) s, (SELECT unnest(range(8)) AS k) q WHERE NOT EXISTS (SELECT 1 FROM ks WHERE ks.scene = s.scene AND ks.k = q.k) GROUP BY 1),
 wk AS (SELECT scene, k AS worst_k, m AS worst FROM ks QUALIFY row_number() OVER (PARTITION BY scene ORDER BY m, k) = 1), mn AS (SELECT scene, count(*) AS n, count(DISTINCT k) AS found, avg(miou) AS miou, avg(boundary) AS boundary, avg(small) AS small, avg(seam) AS seam FROM sn GROUP BY 1)
 SELECT scene, n, found, coalesce(missing, '') AS missing, round(miou + 1e-9, 6) AS miou, worst_k, round(worst + 1e-9, 6) AS worst, round(boundary + 1e-9, 6) AS boundary, round(small + 1e-9, 6) AS small, round(seam + 1e-9, 6) AS seam, CASE WHEN missing IS NULL THEN round({SCORE} + 1e-9, 6) END AS score FROM mn JOIN wk USING (scene) LEFT JOIN ms USING (scene)""")
def _(s, d):
    rows = parts(s, d).withColumn("scene", F.expr("image_id div 16")).where("not (scene % 7 = 3 and k = 5)")
    out = e.orientation_scores(rows, ["scene"], list(range(8)))
    return out.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("miou", "worst", "boundary", "small", "seam", "score")})  # off exact halves


@query("h34_suite_summary", f"""WITH {PARTS}, st AS (SELECT *, CASE image_id % 3 WHEN 0 THEN 'cap' WHEN 1 THEN 'spat' ELSE 'scene' END AS p FROM pt), wk AS (SELECT p, min(m) AS worst FROM (SELECT p, k, avg(miou) AS m FROM st GROUP BY 1, 2) GROUP BY 1),
 mn AS (SELECT p, count(*)::DOUBLE AS n, avg(miou) AS miou, avg(boundary) AS boundary, avg(small) AS small, avg(seam) AS seam, any_value(worst) AS worst FROM st JOIN wk USING (p) GROUP BY 1),
 lg AS ({' UNION ALL '.join(f"SELECT p, '{n}' AS m, round({x} + 1e-9, 6) AS value FROM mn" for n, x in (('n', 'n'), ('miou', 'miou'), ('worst', 'worst'), ('boundary', 'boundary'), ('small', 'small'), ('seam', 'seam'), ('score', SCORE)))})
 SELECT concat(p, '_', m) AS name, value::DOUBLE AS value FROM lg UNION ALL SELECT m, value FROM lg WHERE p = 'scene' UNION ALL SELECT 'evaluated', 1""")
def _(s, d):
    suite = F.when(F.col("image_id") % 3 == 0, "capacity").when(F.col("image_id") % 3 == 1, "spatial").otherwise("scene")
    return e.suite_summary(parts(s, d).withColumn("suite", suite), "generalization").withColumn("value", F.round(F.col("value") + 1e-9, 6))


#: Boundaries of the cells away from 0.
EDGES = "ed AS MATERIALIZED (SELECT a.image_id, a.y, a.x, abs(a.v) > 0.05 AND coalesce(bool_or(b.target <> a.target), false) AS gt, abs(a.v) > 0.05 AND coalesce(bool_or(b.pred <> a.pred), false) AS pr FROM cells a LEFT JOIN cells b ON a.image_id = b.image_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY a.image_id, a.y, a.x, a.v)"


def _bf1(n: int) -> str:
    """Their F1 at a tolerance."""
    return f"""nr{n} AS (SELECT a.image_id, a.gt, a.pr, bool_or(b.gt) AS gn, bool_or(b.pr) AS pn FROM ed a JOIN ed b ON a.image_id = b.image_id AND abs(a.y - b.y) + abs(a.x - b.x) <= {n} GROUP BY a.image_id, a.y, a.x, a.gt, a.pr),
 ct{n} AS (SELECT image_id, count(*) FILTER (gt) AS g, count(*) FILTER (pr) AS p, count(*) FILTER (pr AND gn) AS hp, count(*) FILTER (gt AND pn) AS hg FROM nr{n} GROUP BY 1),
 bf{n} AS (SELECT image_id, round(CASE WHEN g = 0 AND p = 0 THEN 1 WHEN g = 0 OR p = 0 OR hp + hg = 0 THEN 0 ELSE 2 * (hp / p) * (hg / g) / (hp / p + hg / g) END, 6) AS bf1 FROM ct{n})"""


IMAGES = f"""RECURSIVE {v.CELLS}, {EDGES}, {_bf1(1)}, {_bf1(2)}, {_bf1(3)}, sv AS (SELECT * FROM cells WHERE abs(v) > 0.05), rc AS (SELECT image_id, y, x, y * 8 + x AS o FROM sv UNION SELECT q.image_id, c.y, c.x, q.o FROM rc q JOIN sv c ON c.image_id = q.image_id AND greatest(abs(c.y - q.y), abs(c.x - q.x)) = 1),
 co AS (SELECT image_id, y, x, min(o) AS root FROM rc GROUP BY ALL), ta AS (SELECT image_id, round(avg(a), 6) AS small FROM (SELECT co.image_id, root, avg(CAST(target = pred AS INT)) AS a FROM co JOIN cells c ON c.image_id = co.image_id AND c.y = co.y AND c.x = co.x GROUP BY 1, 2 HAVING count(*) <= 3) GROUP BY 1),
 im AS MATERIALIZED (SELECT image_id, round(avg(CAST(target = pred AS INT)), 6) AS acc, any_value(f1.bf1) AS bf1_1, any_value(f2.bf1) AS bf1_2, any_value(f3.bf1) AS bf1_3, coalesce(any_value(small), 1.0::DOUBLE) AS small FROM sv JOIN bf1 f1 USING (image_id) JOIN bf2 f2 USING (image_id) JOIN bf3 f3 USING (image_id) LEFT JOIN ta USING (image_id) GROUP BY 1)"""


def split_images(s, d):
    c = cells(s, d)
    return c, e.split_images(c, "target", "pred", F.abs("v") > 0.05, tiny=3)


@query("h33_split_images", f"WITH {IMAGES} SELECT * FROM im")
def _(s, d):
    return split_images(s, d)[1]


@query("h33_split_report", f"""WITH {IMAGES}, k AS (SELECT c, count(*) FILTER (target = c AND pred = c) AS i, count(*) FILTER (target = c) AS t, count(*) FILTER (pred = c) AS p FROM sv, (SELECT unnest(range(4)) AS c) GROUP BY 1),
 ks AS (SELECT i / greatest(t + p - i, 1) AS iou, i / greatest(p, 1) AS pr, i / greatest(t, 1) AS re FROM k), o AS (SELECT round(avg(iou), 6) AS miou, round(avg(2 * pr * re / greatest(pr + re, 1e-8)), 6) AS f1 FROM ks), a AS (SELECT round(avg(CAST(target = pred AS INT)), 6) AS accuracy, count(*) AS n, 0 AS dropped FROM sv),
 m AS (SELECT count(*) AS images, round(avg(bf1_1), 6) AS bf1_1, round(avg(bf1_2), 6) AS bf1_2, round(avg(bf1_3), 6) AS bf1_3, round(avg(small), 6) AS small FROM im) SELECT *, round(0.55::DOUBLE * miou + 0.3::DOUBLE * bf1_2 + 0.15::DOUBLE * small, 6) AS score FROM o, a, m""")
def _(s, d):
    c, images = split_images(s, d)
    return e.split_report(c, images.checkpoint(), "target", "pred", F.abs("v") > 0.05, 4)


@query("h18_tile_metrics", f"""WITH {v.CELLS}, {region_sql('cells', {'global': 'NOT locked', 'core': 'NOT locked AND y BETWEEN 2 AND 4 AND x BETWEEN 2 AND 4', 'halo': 'NOT locked AND (y < 2 OR y >= 6 OR x < 2 OR x >= 6)'})} SELECT * FROM sc""")
def _(s, d):
    return e.tile_metrics(cells(s, d), "target", "pred", ~F.col("locked"), 4, 2, 3)


@query("a13_reuse", "SELECT lang, count(*) AS n, true AS reused, 1 AS stale FROM documents GROUP BY 1")
def _(s, d):
    from tessella.sources.artefacts import Artefacts
    from tessella.sources.shared import fresh_path

    store, docs = Artefacts(s, fresh_path(s)), table(s, d, "documents")
    build = lambda df: df.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    keys = ["doc_id", "lang"]
    store.reuse("by lang", 1, docs.withColumn("lang", F.upper("lang")), keys, build)
    store.reuse("by lang", 1, docs, keys, build)
    found, there = store.reuse("by lang", 1, docs, keys, build)
    stale = store.stale("by lang", 1, store.identity(docs, keys))
    return found.withColumn("reused", F.lit(there)).withColumn("stale", F.lit(len(stale)))
