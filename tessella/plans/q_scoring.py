"""Queries of classification metrics on kNN votes, multi-label rows and corruption levels, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import scoring as m

from .q_core import NN, _nearest
from .registry import query, table
from tessella.operators import vectors

CLASSES = 10
#: One row per test vector: votes of the 20 nearest as an array over all classes, the class, and a second one for even ids.
PREDS = f"""{NN}, one AS (SELECT DISTINCT test_id, target FROM nn), preds AS (SELECT test_id, target, CASE WHEN test_id % 2 = 0 THEN [target, (target + 1) % {CLASSES}] ELSE [target, -1] END AS targets,
 (SELECT list(coalesce(v.vote, 0) ORDER BY c.c) FROM (SELECT unnest(range({CLASSES}))::INT AS c) c LEFT JOIN votes v ON v.test_id = one.test_id AND v.k = 20 AND v.label = c.c) AS scores FROM one)"""
LONG = f"""{PREDS}, long AS (SELECT test_id, target, targets, c::INT AS c, scores[c + 1] AS s, scores[target + 1] AS own, CAST(list_contains(targets, c::INT) AS INT) AS truth FROM preds, (SELECT unnest(range({CLASSES})) AS c))"""
RANKED = f"""{LONG}, ranked AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY s DESC, c) AS r FROM long)"""
CURVE = f"""{LONG}, cv AS (SELECT c AS label, s AS score, sum(truth) AS pos, sum(1 - truth) AS neg FROM long GROUP BY 1, 2), curve AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER (PARTITION BY label) AS p, sum(neg) OVER (PARTITION BY label) AS n FROM cv WINDOW d AS (PARTITION BY label ORDER BY score DESC))"""


def preds(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("test_id"), F.col("label").cast("int").alias("target"))
    votes = vectors.knn_vote(_nearest(s, d), [20], 0.07).groupBy("test_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("label").cast("int"), "vote"))).alias("m"))
    scores = F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda c: F.coalesce(F.col("m")[c], F.lit(0.0)))
    second = F.when(F.col("test_id") % 2 == 0, (F.col("target") + 1) % CLASSES).otherwise(-1)
    rows = votes.join(e, "test_id").select("test_id", "target", scores.alias("scores"), F.array("target", second).alias("targets"))
    return rows.withColumn("hot", F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda c: F.array_contains("targets", c).cast("int")))


@query("h1_topk_accuracy", f"""WITH {RANKED}, h AS (SELECT target AS class, k, r <= k AS hit FROM ranked, (VALUES (1), (5)) ks(k) WHERE c = target)
 SELECT k, coalesce(class, -1) AS class, count(*) AS n, round(avg(CAST(hit AS INT)), 6) AS accuracy FROM h GROUP BY GROUPING SETS ((k, class), (k))""")
def _(s, d):
    return m.topk_accuracy(preds(s, d)).fillna(-1, ["class"])


@query("h2_topk_recall", f"""WITH {RANKED}, h AS (SELECT target, k, CAST(r <= k AS INT) AS hit FROM ranked, (VALUES (1), (5)) ks(k) WHERE c = target),
 wr AS (SELECT DISTINCT 1 AS k, c FROM ranked WHERE r = 1), g AS (SELECT k, target AS c, avg(hit) AS a FROM h GROUP BY ALL), f AS (SELECT k, c, a FROM g UNION ALL SELECT k, c, 0 FROM wr WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.k = wr.k AND g.c = wr.c))
 SELECT k, (SELECT round(avg(hit), 6) FROM h WHERE h.k = f.k) AS micro, round(avg(a), 6) AS macro FROM f GROUP BY k""")
def _(s, d):
    return m.topk_macro(preds(s, d))


ANY = f"""{RANKED}, b AS (SELECT test_id, min(r) AS r FROM ranked WHERE truth = 1 GROUP BY 1), h AS (SELECT test_id % 3 AS g, k, CAST(r <= k AS INT) AS hit FROM b, (VALUES (1), (5)) ks(k))"""


@query("h3_any_match", f"WITH {ANY} SELECT k, count(*) AS n, round(avg(hit), 6) AS accuracy FROM h GROUP BY k")
def _(s, d):
    return m.any_match(preds(s, d))


@query("h4_any_match_by", f"WITH {ANY} SELECT k, coalesce(g, -1) AS by, count(*) AS n, round(avg(hit), 6) AS accuracy FROM h GROUP BY GROUPING SETS ((k, g), (k))")
def _(s, d):
    return m.any_match(preds(s, d).withColumn("g", F.col("test_id") % 3), by="g").fillna(-1, ["by"])


@query("h5_macro_mrr", f"""WITH {LONG}, q AS (SELECT test_id, target, 1.0::DOUBLE / count(*) FILTER (s >= own) AS r FROM long GROUP BY ALL), g AS (SELECT target, sum(r) / (count(*) + 1e-6::DOUBLE) AS a FROM q GROUP BY 1) SELECT round(sum(a) / {CLASSES}, 6) AS mrr FROM g""")
def _(s, d):
    return m.macro_mrr(preds(s, d), CLASSES)


@query("h6_multiclass_f1", f"""WITH {RANKED}, b AS (SELECT target AS t, c AS p FROM ranked WHERE r = 1), k AS (SELECT unnest(range({CLASSES})) AS k), g AS (SELECT k, count(*) FILTER (t = k AND p = k) AS tp, count(*) FILTER (t <> k AND p = k) AS fp, count(*) FILTER (t = k AND p <> k) AS fn FROM b, k GROUP BY 1)
 SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro, round(avg(2 * tp / (2 * tp + fp + fn)), 6) AS macro FROM g WHERE tp + fp + fn > 0""")
def _(s, d):
    return m.multiclass_f1(preds(s, d))


@query("h7_multilabel_f1", """WITH l AS (SELECT q.quality, q.toxic, CASE WHEN d.n_chars > 500 THEN 0.9 ELSE 0.2 END AS a, CASE WHEN d.n_chars % 7 = 0 THEN 0.8 ELSE 0.1 END AS b FROM labels q JOIN documents d ON d.doc_id = q.doc_id),
 r AS (SELECT 0 AS label, quality AS t, a > 0.5 AS p FROM l UNION ALL SELECT 1, toxic, b > 0.5 FROM l), g AS (SELECT label, count(*) FILTER (p AND t = 1) AS tp, count(*) FILTER (p AND t = 0) AS fp, count(*) FILTER (NOT p AND t = 1) AS fn FROM r GROUP BY 1)
 SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro, round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END), 6) AS macro FROM g""")
def _(s, d):
    rows = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    a, b = F.when(F.col("n_chars") > 500, 0.9).otherwise(0.2), F.when(F.col("n_chars") % 7 == 0, 0.8).otherwise(0.1)
    return m.multilabel_f1(rows.select(F.array("quality", "toxic").alias("hot"), F.array(a, b).alias("scores")))


@query("h8_auroc", f"WITH {CURVE} SELECT label, round(sum(pos * ((n - fp) + neg / 2)) / max(p * n), 6) AS auroc FROM curve WHERE p > 0 AND n > 0 GROUP BY label")
def _(s, d):
    return m.auroc(preds(s, d))


@query("h9_average_precision", f"WITH {CURVE} SELECT label, round(sum(pos / p * tp / (tp + fp)), 6) AS ap FROM curve WHERE p > 0 GROUP BY label")
def _(s, d):
    return m.average_precision(preds(s, d))


@query("h10_map_voc07", f"""WITH {CURVE}, pr AS (SELECT label, tp / p AS recall, tp / (tp + fp) AS precision FROM curve WHERE p > 0 UNION ALL SELECT DISTINCT label, 0, 1 FROM curve WHERE p > 0),
 b AS (SELECT label, i, max(precision) AS best FROM pr, (SELECT unnest(range(11)) AS i) WHERE recall >= i / 10 - 1e-12 GROUP BY ALL) SELECT round(avg(best), 6) AS map FROM b""")
def _(s, d):
    return m.map_voc07(preds(s, d))


@query("h11_corruption_error", """WITH s AS (SELECT event_type AS type, 1 + event_id % 5 AS level, avg(CAST(value < 60 AS INT)) AS accuracy FROM events GROUP BY ALL), r AS (SELECT p_type AS type, 1 + p_size % 5 AS level, avg(p_retailprice) / 3000 AS error FROM part GROUP BY ALL),
 t AS (SELECT DISTINCT type, dense_rank() OVER (ORDER BY type) AS n FROM s), u AS (SELECT DISTINCT type, dense_rank() OVER (ORDER BY type) AS n FROM r), ref AS (SELECT t.type, r.level, r.error FROM t JOIN u ON t.n = u.n JOIN r ON r.type = u.type WHERE t.n <> 2),
 e AS (SELECT s.type, avg(1 - accuracy) / avg(error) AS e FROM s JOIN ref ON ref.type = s.type AND ref.level = s.level GROUP BY 1)
 SELECT type, round(e, 6) AS error FROM e UNION ALL SELECT NULL, round(avg(e), 6) FROM e""")
def _(s, d):
    e, p = table(s, d, "events"), table(s, d, "part")
    scores = e.groupBy(F.col("event_type").alias("type"), (1 + F.col("event_id") % 5).alias("level")).agg(F.avg((F.col("value") < 60).cast("int")).alias("accuracy"))
    # Reference values of each kind of part stand for those of an event type, in order of names; the second type has none.
    from tessella.operators.identity import dense_codes

    names = dense_codes(e.select(F.col("event_type").alias("type")), "type").where("dense <> 1")
    kinds = dense_codes(p.select("p_type"), "p_type")
    ref = p.groupBy("p_type", (1 + F.col("p_size") % 5).alias("level")).agg((F.avg("p_retailprice") / 3000).alias("error"))
    return m.corruption_error(scores, ref.join(kinds, "p_type").join(names, "dense").select("type", "level", "error"))
