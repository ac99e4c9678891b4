"""Queries of splits and reading plans, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import plans as p
from tessella.operators import sampling

from . import views as v
from .registry import query, table

#: Scenes of which some share a group, a family, a design or their content.
LINKED = f"""{v.SCENES}, linked AS (SELECT scene_id, CASE WHEN scene_id % 60 < 2 THEN 'g' || (scene_id // 60 * 60) ELSE group_id END AS group_id, family_id, CASE WHEN scene_id % 90 IN (5, 6) THEN 'd' || (scene_id // 90) ELSE design_id END AS design_id, source_sha256 FROM scenes)"""
UNITS = f"""RECURSIVE {LINKED}, links AS (SELECT min(scene_id) OVER (PARTITION BY source_sha256) AS a, scene_id AS b FROM linked UNION SELECT min(scene_id) OVER (PARTITION BY family_id), scene_id FROM linked UNION SELECT min(scene_id) OVER (PARTITION BY design_id), scene_id FROM linked UNION SELECT min(scene_id) OVER (PARTITION BY group_id), scene_id FROM linked),
 both_ways AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b), reach AS (SELECT scene_id, scene_id AS other FROM linked UNION SELECT r.scene_id, e.b FROM reach r JOIN both_ways e ON r.other = e.a), units AS (SELECT scene_id, min(other) AS unit_id FROM reach GROUP BY scene_id)"""


def linked(s, d):
    i = F.col("scene_id")
    group = F.when(i % 60 < 2, F.concat(F.lit("g"), F.expr("scene_id div 60 * 60").cast("string"))).otherwise(F.col("group_id"))
    design = F.when((i % 90).isin(5, 6), F.concat(F.lit("d"), F.expr("scene_id div 90").cast("string"))).otherwise(F.col("design_id"))
    return v.scenes(s, d).select("scene_id", group.alias("group_id"), "family_id", design.alias("design_id"), "source_sha256")


@query("c4_unit_links", f"""WITH {LINKED} SELECT key, value, count(DISTINCT group_id) AS groups FROM (SELECT group_id, 'source_sha256' AS key, source_sha256 AS value FROM linked UNION ALL SELECT group_id, 'family_id', family_id FROM linked UNION ALL SELECT group_id, 'design_id', design_id FROM linked) GROUP BY 1, 2 HAVING count(DISTINCT group_id) > 1""")
def _(s, d):
    return p.unit_links(linked(s, d))


@query("c4_unit_records", f"WITH {UNITS} SELECT unit_id, count(*) AS scenes, count(DISTINCT group_id) AS n_group_id, count(DISTINCT family_id) AS n_family_id, count(DISTINCT design_id) AS n_design_id FROM units JOIN linked USING (scene_id) GROUP BY 1")
def _(s, d):
    scenes = linked(s, d)
    return p.split_unit_records(scenes, p.split_units(scenes, p.UNIT_KEYS))


@query("d3_scene_splits", f"""WITH {UNITS}, o AS (SELECT unit_id, row_number() OVER (ORDER BY sha256('21:' || unit_id), unit_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT unit_id FROM units))
 SELECT scene_id, unit_id, CASE WHEN r <= greatest(1, round_even(n * 0.2, 0)) THEN 'val' ELSE 'train' END AS split, 'group_holdout_fraction' AS policy FROM units JOIN o USING (unit_id)""")
def _(s, d):
    return p.assign_scene_splits(linked(s, d), 21)


D1 = """sp AS (SELECT source, CASE WHEN r <= tr THEN 'train' WHEN r <= tr + va THEN 'val' ELSE 'test' END AS split FROM (SELECT source, row_number() OVER (ORDER BY sha256('11:' || source), source) AS r, round_even(count(*) OVER () * 0.725, 0) AS tr, round_even(count(*) OVER () * 0.125, 0) AS va FROM (SELECT DISTINCT source FROM documents)))"""


def _splits(s, d):
    return sampling.assign_splits(table(s, d, "documents"), "source", (0.725, 0.125, 0.15), 11)


@query("d2_split_records", f"WITH {D1} SELECT doc_id, source, split, row_number() OVER (PARTITION BY split ORDER BY source, doc_id) AS place FROM documents JOIN sp USING (source)")
def _(s, d):
    return p.split_records(table(s, d, "documents").select("doc_id", "source"), _splits(s, d), "source", "doc_id")


@query("d2_splits_summary", f"WITH {D1} SELECT split, count(*) AS rows, count(DISTINCT source) AS keys, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents JOIN sp USING (source) GROUP BY 1")
def _(s, d):
    records = p.split_records(table(s, d, "documents").select("doc_id", "source"), _splits(s, d), "source", "doc_id")
    return p.splits_summary(records, "source", "doc_id")


D4 = "m AS (SELECT p_partkey, row_number() OVER (ORDER BY sha256('13:' || p_partkey), p_partkey) - 1 AS place, count(*) OVER () AS n FROM part), sm AS (SELECT p_partkey, CASE WHEN place < round_even(n * 0.8, 0) THEN 'train' WHEN place < round_even(n * 0.8, 0) + round_even(n * 0.1, 0) THEN 'val' ELSE 'test' END AS split, place FROM m)"


@query("d4_split_manifest", f"WITH {D4} SELECT * FROM sm")
def _(s, d):
    return p.split_manifest(table(s, d, "part"), "p_partkey", 13, (0.8, 0.1, 0.1))


@query("d4_select_split", f"WITH {D4} SELECT p.p_partkey, p.p_brand FROM part p JOIN sm ON sm.p_partkey = p.p_partkey WHERE split = 'val'")
def _(s, d):
    rows = table(s, d, "part").select("p_partkey", "p_brand")
    return p.select_split(rows, p.split_manifest(rows, "p_partkey", 13, (0.8, 0.1, 0.1)), "p_partkey", "val")


MULTI = "ml AS (SELECT DISTINCT l_orderkey, CAST(l_suppkey % 10 AS INT) AS label FROM lineitem)"


def share_sql(rows: str, share: str, name: str) -> str:
    return f"{name} AS (SELECT DISTINCT l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('17:' || l_orderkey), l_orderkey) AS r, count(*) OVER (PARTITION BY label) AS n FROM {rows}) WHERE r <= greatest(1, floor(n * {share})))"


@query("d7_multilabel_few_shot", f"""WITH {MULTI}, {share_sql('ml', '0.2::DOUBLE', 'one')}, f AS (SELECT 0.2::DOUBLE / (count(*)::DOUBLE / (SELECT floor(count(*) * 0.2) FROM ml)) AS share FROM ml WHERE l_orderkey IN (SELECT l_orderkey FROM one)), {share_sql('ml', '(SELECT share FROM f)', 'two')} SELECT l_orderkey FROM two""")
def _(s, d):
    rows = table(s, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 10).cast("int").alias("label")).distinct()
    return p.multilabel_few_shot(rows, "l_orderkey", "label", 0.2, 17)


@query("d6_class_share", "SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY sha256('3:' || vec_id), vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings) WHERE r <= greatest(1, floor(n * 0.1))")
def _(s, d):
    return p.class_share(table(s, d, "embeddings"), "label", "vec_id", 0.1, 3)


@query("d9_preview_sample", "SELECT lang, doc_id, turn FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('9:' || doc_id), doc_id) AS turn FROM documents) ORDER BY turn, lang LIMIT 42")
def _(s, d):
    return p.preview_sample(table(s, d, "documents"), "lang", "doc_id", 42, 9)


@query("d10_eval_list", "SELECT o_orderkey, CASE WHEN r <= 100 THEN 'val' ELSE 'train' END AS split, r <= 100 AS full_eval FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders)")
def _(s, d):
    return p.eval_list(table(s, d, "orders"), "o_orderkey", 100)


@query("d11_tiled_plan", "SELECT position, vec_id, copy, position % 4 AS rank FROM (SELECT vec_id, copy, row_number() OVER (ORDER BY sha256('1:2:' || vec_id || '#' || copy), vec_id || '#' || copy) - 1 AS position FROM embeddings, (SELECT unnest(range(3))::INT AS copy) WHERE copy < ceil((SELECT 1200 / count(*) FROM embeddings))) WHERE position < 1200")
def _(s, d):
    return p.tiled_plan(table(s, d, "embeddings"), "vec_id", 1200, 1, 2, 4)


@query("d12_sharded_plan", """WITH n AS (SELECT count(*) AS n FROM supplier), k AS (SELECT unnest(range(40))::INT AS round), o AS (SELECT round, s_suppkey, row_number() OVER (PARTITION BY round ORDER BY sha256('5:' || round || ':' || s_suppkey), s_suppkey) - 1 AS p FROM supplier, k),
 w AS (SELECT CAST(p % 3 AS INT) AS rank, round * ((n - p % 3 + 2) // 3) + p // 3 AS step, round, s_suppkey FROM o, n) SELECT * FROM w WHERE step >= 30 AND step < 90""")
def _(s, d):
    return p.sharded_plan(table(s, d, "supplier"), "s_suppkey", 5, 3, 30, 60)


@query("d13_pad_shards", """WITH o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place, count(*) OVER () AS n FROM embeddings), a AS (SELECT place, place AS index, vec_id FROM o UNION ALL SELECT place + n, -1, vec_id FROM o WHERE place < (7 - n % 7) % 7) SELECT *, place % 7 AS rank FROM a""")
def _(s, d):
    return p.pad_shards(table(s, d, "embeddings"), "vec_id", 7)


MIX = """dr AS (SELECT b AS batch, CAST('0x' || substr(sha256('31:' || b), 1, 15) AS BIGINT) % 1000000 / 1000000.0::DOUBLE AS u FROM (SELECT unnest(range(120)) AS b)), pl AS (SELECT batch, CASE WHEN u < 0.1::DOUBLE THEN 'de' WHEN u < 0.1::DOUBLE + 0.5::DOUBLE THEN 'en' WHEN u < 0.1::DOUBLE + 0.5::DOUBLE + 0.2::DOUBLE THEN 'es' ELSE 'fr' END AS source FROM dr),
 nt AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY batch) - 1 AS nth FROM pl), rw AS (SELECT lang AS source, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('31:' || doc_id), doc_id) - 1 AS q FROM documents), hs AS (SELECT source, count(*) // 4 AS has FROM rw GROUP BY 1),
 en AS (SELECT coalesce(min(batch), 120) AS e FROM nt LEFT JOIN hs USING (source) WHERE nth >= coalesce(has, 0)), mx AS (SELECT batch, source, doc_id, q % 4 AS slot FROM nt JOIN rw USING (source), en WHERE q // 4 = nth AND batch < e)"""


def _mixed(s, d):
    return p.mix_sources(table(s, d, "documents"), "lang", "doc_id", {"en": 0.5, "de": 0.1, "fr": 0.2, "es": 0.2}, 4, 120, 31)


@query("d15_mix_sources", f"WITH {MIX} SELECT * FROM mx")
def _(s, d):
    return _mixed(s, d)


@query("i10_ratio_monitor", f"WITH {MIX}, b AS (SELECT DISTINCT batch, source FROM mx), g AS (SELECT m.batch, n.source FROM (SELECT batch FROM b WHERE (batch + 1) % 10 = 0) m, (SELECT DISTINCT source FROM b) n) SELECT g.batch, g.source, round(count(b.batch) / (g.batch + 1), 6) AS share FROM g LEFT JOIN b ON b.source = g.source AND b.batch <= g.batch GROUP BY g.batch, g.source")
def _(s, d):
    return p.ratio_monitor(_mixed(s, d), 10)


@query("d18_scale_budgets", f"""WITH {v.IMAGES}, r AS (SELECT image_id, CAST(ceil(width / 384) * ceil(height / 384) AS BIGINT) AS raw FROM images), t AS (SELECT sum(raw) AS s, 3 * count(*) AS goal, greatest(40, 3 * count(*)) AS cap FROM r),
 b AS MATERIALIZED (SELECT image_id, CAST(least(greatest(2, round_even(raw::DOUBLE * goal::DOUBLE / s::DOUBLE, 0)), cap) AS BIGINT) AS b FROM r, t), c AS (SELECT b, count(*) AS k FROM b GROUP BY 1), w AS (SELECT sum(b * k) AS w FROM c),
 lv AS MATERIALIZED (SELECT l, sum(least(b, l) * k) AS lo, sum(greatest(b, l) * k) AS hi FROM c, (SELECT unnest(range(2, cap + 1)) AS l FROM t) GROUP BY 1),
 dn AS (SELECT l, CASE WHEN l = 2 THEN 0 ELSE lo - goal END AS x FROM lv, t WHERE lo >= goal ORDER BY l LIMIT 1), up AS (SELECT l, CASE WHEN l = cap THEN 0 ELSE goal - hi END AS x FROM lv, t WHERE hi <= goal ORDER BY l DESC LIMIT 1),
 m AS (SELECT image_id, b, CASE WHEN w > goal THEN (SELECT l FROM dn) WHEN w < goal THEN (SELECT l FROM up) END AS l, CASE WHEN w > goal THEN (SELECT x FROM dn) WHEN w < goal THEN (SELECT x FROM up) END AS x, CASE WHEN w > goal THEN b >= (SELECT l FROM dn) WHEN w < goal THEN b <= (SELECT l FROM up) ELSE false END AS hit, CASE WHEN w > goal THEN -1 ELSE 1 END AS step FROM b, t, w)
 SELECT image_id, CAST(CASE WHEN NOT hit THEN b WHEN row_number() OVER (PARTITION BY hit ORDER BY image_id) <= x THEN l + step ELSE l END AS BIGINT) AS budget FROM m""")
def _(s, d):
    i = v.images(s, d)
    return p.scale_budgets(i, "image_id", F.ceil(F.col("width") / 384) * F.ceil(F.col("height") / 384), 3 * i.count(), 2, 40)


@query("d19_rare_class_order", "WITH k AS (SELECT * FROM (VALUES (0, 'A'), (1, 'N'), (2, 'R'), (3, 'X')) t(k, class)) SELECT k.class, count(l.l_orderkey) AS n, row_number() OVER (ORDER BY count(l.l_orderkey), k.k) AS place FROM k LEFT JOIN lineitem l ON l.l_returnflag = k.class AND l.l_orderkey % 5 <> 0 GROUP BY k.class, k.k")
def _(s, d):
    rows = table(s, d, "lineitem").select(F.when(F.col("l_orderkey") % 5 == 0, "val").otherwise("train").alias("split"), "l_returnflag")
    return p.rare_class_order(rows, "split", "l_returnflag", ["A", "N", "R", "X"])


RECIPES = [("clean", "none", True), ("mild_shift", "easy", True), ("strong_shift", "hard", True), ("swap", "hard", False)]


@query("d20_expand_variants", f"""SELECT p_partkey, variant, difficulty, supervised, ('0x' || substr(sha256('7:' || p_partkey || ':' || variant), 1, 15))::BIGINT % 2147483648 AS seed FROM part, (VALUES {', '.join(f"('{n}', '{x}', {str(q).lower()})" for n, x, q in RECIPES)}) t(variant, difficulty, supervised)""")
def _(s, d):
    return p.expand_variants(table(s, d, "part"), "p_partkey", RECIPES, 7)


@query("d21_mask_plan", """WITH o AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('19:' || vec_id), vec_id) - 1 AS p, count(*) OVER () AS n FROM embeddings), m AS (SELECT vec_id, CASE WHEN p < floor(n * 0.5) THEN CAST(floor(64 * (0.1::DOUBLE + (0.5::DOUBLE - 0.1::DOUBLE) * (p + 1) / floor(n * 0.5)) + 1e-9) AS INT) ELSE 0 END AS masked FROM o),
 c AS (SELECT vec_id, masked, c, row_number() OVER (PARTITION BY vec_id ORDER BY sha256('19:' || vec_id || ':' || c), c) AS r FROM m, (SELECT unnest(range(64)) AS c)) SELECT vec_id, any_value(masked) AS masked, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (r <= masked), '') AS cells, round(1 / greatest(any_value(masked), 1), 6) AS weight FROM c GROUP BY 1""")
def _(s, d):
    out = p.mask_plan(table(s, d, "embeddings"), "vec_id", 64, 0.1, 0.5, 0.5, 19)
    return out.withColumn("cells", F.concat_ws(",", F.transform("cells", lambda c: c.cast("string"))))


@query("d22_affinity_pairs", f"""WITH {v.CELLS}, o AS (SELECT * FROM (VALUES (0, 1), (1, 0), (0, 2), (2, 0)) t(dy, dx)), p AS (SELECT a.image_id, a.y, a.x, o.dy, o.dx, a.target = b.target AS same FROM cells a, o JOIN cells b ON b.image_id = a.image_id AND b.y = a.y + o.dy AND b.x = a.x + o.dx WHERE a.target > 0 AND b.target > 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY image_id, same ORDER BY sha256('23:' || image_id || ':' || y || ':' || x || ':' || dy || ':' || dx)) AS r FROM p) SELECT image_id, y, x, dy, dx, same FROM r WHERE r <= 6""")
def _(s, d):
    c = v.cells(s, d).select("image_id", "y", "x", (F.col("target") - 1).alias("code"))
    return p.affinity_pairs(c, (1, 2), 12, 23)


@query("d23_pad_lists", """WITH l AS (SELECT l_orderkey % 50 AS batch, l_orderkey, list(l_suppkey ORDER BY l_suppkey) AS s FROM lineitem GROUP BY ALL), m AS (SELECT batch, max(len(s)) AS m FROM l GROUP BY 1)
 SELECT batch, l_orderkey, array_to_string(list_concat(s, list_transform(range(m - len(s)), lambda i: -1)), ',') AS padded, len(s) AS n, m - len(s) AS short FROM l JOIN m USING (batch)""")
def _(s, d):
    rows = table(s, d, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("batch"), "l_orderkey").agg(F.sort_array(F.collect_list("l_suppkey")).alias("s"))
    out = p.pad_lists(rows, "batch", "l_orderkey", "s", -1)
    n = F.aggregate("mask", F.lit(0), lambda a, x: a + x).cast("long")
    return out.select("batch", "l_orderkey", F.concat_ws(",", F.transform("padded", lambda x: x.cast("string"))).alias("padded"), n.alias("n"), (F.size("mask") - n).alias("short"))
