"""Queries of identity, audits, sampling, geometry, rasters, vectors, metrics and run logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.hashing import derive_seed, hash_order
from tessella.functions.texts import simple_upper, trim_spaces
from tessella.operators import audits, geometry, identity, metrics, sampling, vectors

from . import views as v
from .registry import query, table

ALNUM = "[^A-Za-z0-9._-]+"


@query("c1_duplicate_groups", "SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return identity.duplicate_groups(table(s, d, "documents"), F.col("text"), "doc_id")


@query("c2_near_duplicate_groups", r"""WITH t AS (SELECT text, source FROM documents UNION ALL SELECT upper(text) || ' ', source || '_b' FROM documents WHERE doc_id % 9 = 0 AND lang = 'en')
 SELECT sha256(regexp_replace(lower(text), '\s+', ' ', 'g')) AS sha, count(*) AS n, min(source) AS first_name, 0.8::DOUBLE AS confidence FROM (SELECT trim(text) AS text, source, text AS raw FROM t) GROUP BY 1 HAVING count(*) > 1 AND count(*) = count(DISTINCT source) AND count(DISTINCT text) > 1""")
def _(s, d):
    docs = table(s, d, "documents")
    more = docs.where("doc_id % 9 = 0 and lang = 'en'").select(F.concat(simple_upper(F.col("text")), F.lit(" ")).alias("text"), F.concat("source", F.lit("_b")).alias("source"))
    return identity.near_duplicate_groups(docs.select("text", "source").union(more).withColumn("text", trim_spaces(F.col("text"))), "text", "source")


@query("c3_design_group", "SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY sha) > 1 THEN 'grp_' ELSE 'grp_single_' END || substr(sha, 1, 8) AS design_group FROM (SELECT doc_id, sha256(text) AS sha FROM documents)")
def _(s, d):
    docs = table(s, d, "documents")
    return identity.assign_design_group(docs, identity.duplicate_groups(docs, F.col("text"), "doc_id"), F.col("text"), "doc_id")


@query("c4_split_units", f"""WITH RECURSIVE {v.SCENES}, linked AS (SELECT scene_id, CASE WHEN scene_id % 60 < 2 THEN 'g' || (scene_id // 60 * 60) ELSE group_id END AS group_id, family_id, design_id, source_sha256 FROM scenes), links AS (
 SELECT min(scene_id) OVER (PARTITION BY source_sha256) AS a, scene_id AS b FROM linked UNION SELECT min(scene_id) OVER (PARTITION BY family_id), scene_id FROM linked UNION SELECT min(scene_id) OVER (PARTITION BY group_id), scene_id FROM linked UNION SELECT min(scene_id) OVER (PARTITION BY design_id), scene_id FROM linked),
 both_ways AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
 reach AS (SELECT scene_id, scene_id AS other FROM linked UNION SELECT r.scene_id, e.b FROM reach r JOIN both_ways e ON r.other = e.a)
 SELECT scene_id, min(other) AS unit_id FROM reach GROUP BY scene_id""")
def _(s, d):
    group = F.when(F.col("scene_id") % 60 < 2, F.concat(F.lit("g"), F.expr("scene_id div 60 * 60").cast("string"))).otherwise(F.col("group_id"))
    return identity.split_units(v.scenes(s, d).withColumn("group_id", group), ["group_id", "source_sha256", "family_id", "design_id"])


@query("c5_group_id", r"SELECT p_partkey, coalesce(nullif(regexp_extract(p_name, '^([a-z]+)', 1), ''), p_name) AS group_id FROM part")
def _(s, d):
    return identity.extract_group_id(table(s, d, "part"), "p_name", "^([a-z]+)").select("p_partkey", "group_id")


@query("c6_normalize_name", r"SELECT doc_id, trim(regexp_replace(regexp_replace(source || '  copy (' || doc_id || ')', '\s*\(\d+\)\s*$', ''), '\s+', ' ', 'g')) AS name FROM documents")
def _(s, d):
    raw = table(s, d, "documents").select("doc_id", F.concat("source", F.lit("  copy ("), F.col("doc_id").cast("string"), F.lit(")")).alias("raw"))
    return raw.select("doc_id", identity.normalize_name("raw").alias("name"))


@query("c7_safe_ids", f"""SELECT p_partkey, CASE WHEN r = 1 THEN base ELSE base || '_' || substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 8) END AS safe_id FROM
 (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS r FROM (SELECT p_partkey, substr(regexp_replace(p_name, '{ALNUM}', '_', 'g'), 1, 120) AS base FROM part))""")
def _(s, d):
    return identity.safe_ids(table(s, d, "part").select("p_partkey", "p_name"), "p_name", "p_partkey").select("p_partkey", "safe_id")


@query("c8_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("c9_dense_codes", "SELECT l_suppkey, row_number() OVER (ORDER BY l_suppkey) - 1 AS dense FROM (SELECT DISTINCT l_suppkey FROM lineitem)")
def _(s, d):
    return identity.dense_codes(table(s, d, "lineitem"), "l_suppkey")


@query("c10_unique_value_codes", "SELECT p_partkey, first_code, dense_rank() OVER (ORDER BY first_code) - 1 AS unique_id FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS first_code FROM part)")
def _(s, d):
    return identity.unique_value_codes(table(s, d, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey", ["p_brand", "p_size"])


@query("c11_palette_usage", f"WITH {v.CELLS} SELECT p.code, count(c.target) AS n, round(100.0::DOUBLE * count(c.target) / (SELECT count(*) FROM cells), 6) AS percent, count(c.target) > 0 AS used FROM (SELECT unnest(range(6))::INT AS code) p LEFT JOIN cells c ON c.target = p.code GROUP BY 1")
def _(s, d):
    return identity.palette_usage(v.cells(s, d).withColumnRenamed("target", "code"), s.range(6).select(F.col("id").cast("int").alias("code")))


@query("c12_class_map", "SELECT label, count(*) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id, (SELECT max(label) + 1 FROM embeddings) AS classes FROM embeddings GROUP BY 1")
def _(s, d):
    e = table(s, d, "embeddings")
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id")).crossJoin(F.broadcast(e.agg((F.max("label") + 1).alias("classes"))))


@query("c13_multi_hot", "SELECT o.l_orderkey, c.code, CAST(count(l.s) > 0 AS INT) AS hit FROM (SELECT DISTINCT l_orderkey FROM lineitem) o CROSS JOIN (SELECT unnest(range(10))::INT AS code) c LEFT JOIN (SELECT DISTINCT l_orderkey, CAST(l_suppkey % 10 AS INT) AS s FROM lineitem) l ON l.l_orderkey = o.l_orderkey AND l.s = c.code GROUP BY ALL")
def _(s, d):
    return sampling.multi_hot(table(s, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 10).cast("int").alias("s")), "l_orderkey", "s", 10)


@query("c14_derive_seed", "SELECT doc_id, ('0x' || substr(sha256('7:' || doc_id), 1, 15))::BIGINT % 2147483648 AS seed FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", derive_seed(7, "doc_id").alias("seed"))


@query("b1_pair_by_stem", """SELECT source AS stem, CASE WHEN na > 1 OR nb > 1 THEN 'duplicate' WHEN na = 0 THEN 'missing_left' WHEN nb = 0 THEN 'missing_right' ELSE 'pair' END AS status FROM
 (SELECT coalesce(a.k, b.k) AS source, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb FROM (SELECT CAST(doc_id AS VARCHAR) AS k, count(*) AS n FROM documents GROUP BY 1) a FULL JOIN (SELECT CAST(doc_id * 2 AS VARCHAR) AS k, count(*) AS n FROM labels GROUP BY 1) b ON a.k = b.k)""")
def _(s, d):
    a = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("stem"))
    return audits.pair_by_stem(a, table(s, d, "labels").select((F.col("doc_id") * 2).cast("string").alias("stem")), "stem")


@query("b2_pair_first_wins", """SELECT coalesce(a.stem, b.stem) AS stem, left_path, right_path, greatest(coalesce(a.n, 0) - 1, 0) + greatest(coalesce(b.n, 0) - 1, 0) AS extra FROM
 (SELECT lower(p_brand) AS stem, min(p_name) AS left_path, count(*) AS n FROM part WHERE p_size < 40 GROUP BY 1) a FULL JOIN (SELECT lower(p_brand) AS stem, min(p_name) AS right_path, count(*) AS n FROM part WHERE p_size > 20 GROUP BY 1) b ON a.stem = b.stem""")
def _(s, d):
    p = table(s, d, "part")
    return audits.pair_first_wins(p.where("p_size < 40"), p.where("p_size > 20"), "p_brand", "p_name")


@query("b6_allowed_values", f"WITH {v.CELLS} SELECT image_id, count(*) AS n, count(*) FILTER (target NOT IN (0, 1, 2)) AS unexpected, round(count(*) FILTER (target NOT IN (0, 1, 2)) / count(*), 6) AS share, count(*) FILTER (target NOT IN (0, 1, 2)) = 0 AS ok FROM cells GROUP BY 1")
def _(s, d):
    return audits.check_allowed_values(v.cells(s, d), "image_id", "target", [0, 1, 2])


@query("b7_pair_mismatch", f"WITH {v.CELLS} SELECT image_id, count(*) FILTER (target <> pred) AS mismatches, count(*) FILTER (target <> pred AND locked) AS locked_mismatches, CASE WHEN count(*) FILTER (target <> pred AND locked) > 0 THEN 'fail' ELSE 'ok' END AS status FROM cells GROUP BY 1")
def _(s, d):
    bad = F.col("target") != F.col("pred")
    return v.cells(s, d).groupBy("image_id").agg(F.count_if(bad).alias("mismatches"), F.count_if(bad & F.col("locked")).alias("locked_mismatches")).withColumn("status", F.when(F.col("locked_mismatches") > 0, "fail").otherwise("ok"))


@query("b8_encode_labels", f"WITH {v.CELLS} SELECT image_id, y, x, CASE WHEN locked THEN -100 ELSE target END AS code FROM cells")
def _(s, d):
    return v.cells(s, d).select("image_id", "y", "x", F.when(F.col("locked"), -100).otherwise(F.col("target")).alias("code"))


@query("b9_readiness", "SELECT CASE WHEN q.doc_id IS NULL THEN 'unlabelled' WHEN q.quality = 0 THEN 'rejected' WHEN q.toxic = 1 THEN 'toxic' ELSE 'ready' END AS status, count(*) AS n FROM documents d LEFT JOIN labels q ON q.doc_id = d.doc_id GROUP BY 1")
def _(s, d):
    q = table(s, d, "labels").withColumn("has", F.lit(True))
    st = F.when(F.col("has").isNull(), "unlabelled").when(F.col("quality") == 0, "rejected").when(F.col("toxic") == 1, "toxic").otherwise("ready")
    return audits.readiness(table(s, d, "documents").select("doc_id").join(q, "doc_id", "left").select(st.alias("status")))


@query("b10_audit_manifest", """SELECT 'unknown_key' AS kind, 'error' AS severity, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 <> 0)
 UNION ALL SELECT 'duplicate_id', 'error', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'missing_part', 'warning', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) < 7)""")
def _(s, d):
    scenes = table(s, d, "orders").where("o_orderkey % 50 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return audits.audit_manifest(table(s, d, "lineitem"), scenes, "l_orderkey", ["l_orderkey", "l_linenumber"], 7)


@query("b12_record_audit", "SELECT doc_id, n_chars, length(text) AS actual, CASE WHEN n_chars <> length(text) THEN 'warning' ELSE 'ok' END AS status FROM documents")
def _(s, d):
    n = F.length("text").cast("long")
    return table(s, d, "documents").select("doc_id", "n_chars", n.alias("actual"), F.when(F.col("n_chars") != n, "warning").otherwise("ok").alias("status"))


SPLIT = "CASE WHEN ('0x' || substr(sha256('3:' || scene_id), 1, 15))::BIGINT % 10 < 2 THEN 'val' ELSE 'train' END AS split"


@query("b14_split_leakage", f"""WITH {v.SCENES}, s AS (SELECT *, {SPLIT} FROM scenes) SELECT key, value, count(DISTINCT split) AS splits FROM
 (SELECT split, 'family_id' AS key, family_id AS value FROM s UNION ALL SELECT split, 'design_id', design_id FROM s UNION ALL SELECT split, 'source_sha256', source_sha256 FROM s) GROUP BY 1, 2 HAVING count(DISTINCT split) > 1""")
def _(s, d):
    split = F.when(derive_seed(3, "scene_id", modulus=10) < 2, "val").otherwise("train")
    return audits.split_leakage(v.scenes(s, d).withColumn("split", split), ["family_id", "design_id", "source_sha256"])


@query("b16_dominance", "SELECT l_orderkey, q[1] AS first, q[2] AS second, q[1] > 10 * q[2] AS dominant FROM (SELECT l_orderkey, list(l_quantity ORDER BY l_quantity DESC) AS q FROM lineitem GROUP BY 1) WHERE len(q) > 1")
def _(s, d):
    return audits.dominance(table(s, d, "lineitem"), "l_orderkey", "l_quantity")


@query("b17_family_flag", "SELECT p_partkey, regexp_matches(p_name, '[aeiou]{2}') AS flagged FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.col("p_name").rlike("[aeiou]{2}").alias("flagged"))


@query("b21_finite_guard", "SELECT 'value' AS col, count(*) AS n, count(*) FILTER (value IS NULL) AS nulls, count(*) FILTER (isnan(value)) AS nans, count(*) FILTER (isinf(value)) AS infs FROM events UNION ALL SELECT 'user_id', count(*), count(*) FILTER (user_id IS NULL), 0, 0 FROM events")
def _(s, d):
    return audits.finite_guard(table(s, d, "events"), ["value", "user_id"])


@query("b22_preflight", "SELECT count(*) AS keys, max(n) AS most, count(*) FILTER (n > 2) AS over_2, count(*) FILTER (n > 4) AS over_4, count(*) FILTER (n > 6) AS over_6 FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def _(s, d):
    return audits.preflight_cardinality(table(s, d, "lineitem"), "l_orderkey", (2, 4, 6))


@query("d1_assign_splits", """SELECT source, CASE WHEN r <= tr THEN 'train' WHEN r <= tr + va THEN 'val' ELSE 'test' END AS split FROM (SELECT source, row_number() OVER (ORDER BY sha256('11:' || source), source) AS r, round_even(count(*) OVER () * 0.725, 0) AS tr, round_even(count(*) OVER () * 0.125, 0) AS va FROM (SELECT DISTINCT source FROM documents))""")
def _(s, d):
    return sampling.assign_splits(table(s, d, "documents"), "source", (0.725, 0.125, 0.15), 11)


@query("d5_stratified_holdout", "SELECT vec_id, label, CASE WHEN r <= CASE WHEN n > 1 THEN greatest(1, floor(n * 0.2)) ELSE 0 END THEN 'val' ELSE 'train' END AS split FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('5:' || vec_id), vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings)")
def _(s, d):
    return sampling.stratified_holdout(table(s, d, "embeddings"), "label", "vec_id", 0.2, 5)


@query("d6_few_shot", "SELECT try, label, vec_id FROM (SELECT try, label, vec_id, row_number() OVER (PARTITION BY try, label ORDER BY sha256(try || ':' || vec_id), vec_id) AS r FROM embeddings CROSS JOIN (SELECT unnest(range(3))::INT AS try)) WHERE r <= 5")
def _(s, d):
    return sampling.few_shot(table(s, d, "embeddings"), "label", "vec_id", 5, 3)


@query("d8_round_robin", "SELECT doc_id, source, turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('9:' || doc_id), doc_id) AS turn FROM documents) ORDER BY turn, sha256('9:' || source), source LIMIT 130")
def _(s, d):
    return sampling.round_robin_sample(table(s, d, "documents"), "source", "doc_id", 130, 9)


@query("d11_epoch_plan", "SELECT vec_id, p AS position, p % 4 AS rank FROM (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:2:' || vec_id), vec_id) - 1 AS p FROM embeddings)")
def _(s, d):
    return sampling.epoch_plan(table(s, d, "embeddings"), "vec_id", 1, 2, 4)


@query("d14_grouped_batches", """SELECT doc_id, source, CAST(floor((row_number() OVER (ORDER BY wave, sha256('4:' || doc_id), doc_id) - 1) / 32) AS BIGINT) AS batch FROM (SELECT doc_id, source, floor((row_number() OVER (PARTITION BY source ORDER BY sha256('4:' || doc_id), doc_id) - 1) / 4) AS wave FROM documents)""")
def _(s, d):
    return sampling.grouped_batches(table(s, d, "documents"), "source", "doc_id", 32, 4, 4)


@query("d14_batches_over", """WITH w AS (SELECT doc_id, source, floor((row_number() OVER (PARTITION BY source ORDER BY sha256('4:' || doc_id), doc_id) - 1) / 4) AS wave FROM documents), b AS (SELECT source, CAST(floor((row_number() OVER (ORDER BY wave, sha256('4:' || doc_id), doc_id) - 1) / 32) AS BIGINT) AS batch FROM w) SELECT batch, source, count(*) AS n FROM b GROUP BY 1, 2 HAVING count(*) > 2""")
def _(s, d):
    return sampling.batches_over(sampling.grouped_batches(table(s, d, "documents"), "source", "doc_id", 32, 4, 4), "source", 2)


@query("d16_pick_one", "SELECT conv_id, arg_min(turn, sha256('6:' || conv_id || ':' || turn)) AS picked FROM conversations GROUP BY 1")
def _(s, d):
    return sampling.pick_one(table(s, d, "conversations"), "conv_id", "turn", 6)


@query("d17_allocate_quota", """SELECT o_orderkey, name, CAST(low + CASE WHEN r <= total - s THEN 1 ELSE 0 END AS BIGINT) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY rest DESC, name) AS r, sum(low) OVER (PARTITION BY o_orderkey) AS s FROM
 (SELECT o_orderkey, name, total, floor(round(total * w, 9)) AS low, round(round(total * w, 9) - floor(round(total * w, 9)), 9) AS rest FROM (SELECT o_orderkey, CAST(o_custkey % 97 AS DOUBLE) AS total FROM orders) CROSS JOIN (VALUES ('edge', 0.3::DOUBLE), ('grid', 0.5::DOUBLE), ('rare', 0.2::DOUBLE)) t(name, w)))""")
def _(s, d):
    return sampling.allocate_quota(table(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 97).cast("double").alias("total")), "o_orderkey", "total", {"grid": 0.5, "edge": 0.3, "rare": 0.2})


@query("d24_pick_orientation", "SELECT vec_id, list_extract([0, 2, 5, 7], CAST(('0x' || substr(sha256('8:3:' || vec_id), 1, 15))::BIGINT % 4 AS INT) + 1) AS k FROM embeddings")
def _(s, d):
    return table(s, d, "embeddings").select("vec_id", F.element_at(F.array(*[F.lit(k) for k in (0, 2, 5, 7)]), derive_seed("8:3", "vec_id", modulus=4).cast("int") + 1).alias("k"))


@query("e1_core_tiles", f"""WITH {v.IMAGES} SELECT image_id, x AS core_x, y AS core_y, least(384, width - x) AS core_w, least(384, height - y) AS core_h, x - 64 AS in_x, y - 64 AS in_y, round(x / width, 6) AS nx, round(y / height, 6) AS ny FROM
 (SELECT *, unnest(range(0, height, 384))::INT AS y FROM (SELECT *, unnest(range(0, width, 384))::INT AS x FROM images))""")
def _(s, d):
    return geometry.core_tiles(v.images(s, d), 384, 64)


@query("e2_overlap_tiles", f"""WITH {v.IMAGES}, xs AS (SELECT image_id, unnest(list_distinct(list_append(list_filter(range(0, width + 1, 192), lambda s: s + 256 <= width), greatest(width - 256, 0))))::INT AS x FROM images),
 ys AS (SELECT image_id, unnest(list_distinct(list_append(list_filter(range(0, height + 1, 192), lambda s: s + 256 <= height), greatest(height - 256, 0))))::INT AS y FROM images) SELECT image_id, x, y FROM xs JOIN ys USING (image_id)""")
def _(s, d):
    return geometry.overlap_tiles(v.images(s, d), 256, 192)


@query("e3_orient_cells", f"""WITH {v.CELLS}, t AS (SELECT image_id, target, k, CASE k % 4 WHEN 0 THEN y WHEN 1 THEN 7 - x WHEN 2 THEN 7 - y ELSE x END AS oy, CASE k % 4 WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN 7 - x ELSE 7 - y END AS nx FROM cells CROSS JOIN (SELECT unnest(range(8))::INT AS k))
 SELECT image_id, k, oy, CASE WHEN k >= 4 THEN 7 - nx ELSE nx END AS ox, target FROM t""")
def _(s, d):
    return geometry.orient_cells(v.cells(s, d), 8).select("image_id", "k", "oy", "ox", "target")


@query("e17_box_iou", f"""WITH {v.BOXES}, p AS (SELECT a.image_id, a.n AS n1, b.n AS n2, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i, a.w * a.h + b.w * b.h AS s FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.n < b.n)
 SELECT image_id, n1, n2, round(i / (s - i), 6) AS iou, round(i / (s - i), 6) >= 0.9 AS same FROM p WHERE round(i / (s - i), 6) > 0""")
def _(s, d):
    return geometry.box_iou(v.boxes(s, d))


@query("e18_box_convert", f"WITH {v.BOXES} SELECT image_id, n, x + w / 2 AS cx, y + h / 2 AS cy, greatest(0, least(x + w, 512)) AS x2, greatest(0, least(y + h, 512)) AS y2, round(greatest(0, least(x + w, 512)) / 512, 6) AS nx2, round(greatest(0, least(y + h, 512)) / 512, 6) AS ny2 FROM boxes")
def _(s, d):
    return geometry.box_convert(v.boxes(s, d), 512)


@query("e24_region_flags", f"WITH {v.CELLS} SELECT image_id, y, x, (y < 2 OR y >= 6) OR (x < 2 OR x >= 6) AS border, (y < 2 OR y >= 6) AND (x < 2 OR x >= 6) AS corner, NOT ((y < 2 OR y >= 6) OR (x < 2 OR x >= 6)) AS core FROM cells")
def _(s, d):
    return geometry.region_flags(v.cells(s, d), 8, 2).select("image_id", "y", "x", "border", "corner", "core")


@query("f3_class_boundary", f"""WITH {v.CELLS} SELECT a.image_id, a.y, a.x, a.target, count(b.target) > 0 AS edge FROM cells a LEFT JOIN cells b ON a.image_id = b.image_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1 AND a.target <> b.target GROUP BY ALL""")
def _(s, d):
    return metrics.boundary(v.cells(s, d), "image_id", "target")


@query("f10_affinity_targets", f"""WITH {v.CELLS} SELECT a.image_id, a.y, a.x, o.k, coalesce(CAST(a.target = r.target AS INT), -1) AS right_same, coalesce(CAST(a.target = b.target AS INT), -1) AS down_same FROM cells a CROSS JOIN (VALUES (1), (2), (4), (8)) o(k)
 LEFT JOIN cells r ON r.image_id = a.image_id AND r.y = a.y AND r.x = a.x + o.k LEFT JOIN cells b ON b.image_id = a.image_id AND b.x = a.x AND b.y = a.y + o.k""")
def _(s, d):
    row, col = W.partitionBy("image_id", "y").orderBy("x"), W.partitionBy("image_id", "x").orderBy("y")
    same = lambda k, w: F.coalesce((F.lead("target", k).over(w) == F.col("target")).cast("int"), F.lit(-1))
    each = v.cells(s, d).select("image_id", "y", "x", F.array(*[F.struct(F.lit(k).alias("k"), same(k, row).alias("right_same"), same(k, col).alias("down_same")) for k in (1, 2, 4, 8)]).alias("a"))
    return each.select("image_id", "y", "x", F.inline("a"))


@query("g1_l2_normalize", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE) * e)) / list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE) * e)), 6) AS norm, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE) * e))), 6) AS first FROM embeddings")
def _(s, d):
    n = vectors.l2_normalize(table(s, d, "embeddings"), "embedding")
    return n.select("vec_id", F.round(F.sqrt(vectors.dot("embedding", "embedding")), 6).alias("norm"), F.round(F.col("embedding")[0], 6).alias("first"))


NN = """t AS (SELECT vec_id AS test_id, label AS target, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v FROM embeddings WHERE vec_id % 5 = 0), u AS (SELECT vec_id AS train_id, label, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v FROM embeddings WHERE vec_id % 5 <> 0),
 p AS (SELECT test_id, target, train_id, label, round(list_dot_product(t.v, u.v), 6) AS score FROM t CROSS JOIN u), nn AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY score DESC, train_id) AS rank FROM p QUALIFY rank <= 20),
 w AS (SELECT *, exp((score - max(score) OVER (PARTITION BY test_id)) / 0.07) AS e FROM nn), z AS (SELECT *, e / sum(e) OVER (PARTITION BY test_id) AS q FROM w), votes AS (SELECT test_id, target, k, label, round(sum(q), 6) AS vote FROM z CROSS JOIN (VALUES (5), (10), (20)) ks(k) WHERE rank <= k GROUP BY ALL)"""


def _nearest(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return vectors.knn(e.where("id % 5 = 0"), e.where("id % 5 <> 0"), 20)


@query("g4_knn", f"WITH {NN} SELECT test_id, train_id, label, score, rank FROM nn")
def _(s, d):
    return _nearest(s, d)


@query("g5_knn_vote", f"WITH {NN} SELECT test_id, k, label, vote FROM votes")
def _(s, d):
    return vectors.knn_vote(_nearest(s, d), [5, 10, 20], 0.07)


@query("knn_topk_accuracy", f"""WITH {NN}, r AS (SELECT *, row_number() OVER (PARTITION BY test_id, k ORDER BY vote DESC, label) AS r FROM votes), h AS (SELECT test_id, k, target, max(CAST(label = target AND r <= 1 AS INT)) AS top1, max(CAST(label = target AND r <= 5 AS INT)) AS top5 FROM r GROUP BY ALL)
 SELECT k, count(*) AS n, round(avg(top1), 6) AS top1, round(avg(top5), 6) AS top5 FROM h GROUP BY k""")
def _(s, d):
    target = table(s, d, "embeddings").select(F.col("vec_id").alias("test_id"), F.col("label").alias("target"))
    votes = vectors.knn_vote(_nearest(s, d), [5, 10, 20], 0.07).join(target, "test_id")
    hits = metrics.topk_hits(votes, ["test_id", "k"], "target", "vote", "label", (1, 5))
    return hits.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("top1"), 6).alias("top1"), F.round(F.avg("top5"), 6).alias("top5"))


SIDES = NN[: NN.index(" p AS")].rstrip(", \n")


@query("g6_knn_tries", f"""WITH {SIDES}, tr AS (SELECT train_id, label, v, y.t AS try FROM u, (SELECT unnest(range(3))::INT AS t) y QUALIFY row_number() OVER (PARTITION BY y.t, label ORDER BY sha256(concat(y.t, ':', train_id)), train_id) <= 4),
 ks AS (SELECT DISTINCT try, least(k, n) AS k FROM (VALUES (5), (20), (100)) a(k), (SELECT try, count(*) AS n FROM tr GROUP BY 1)), p AS (SELECT try, test_id, target, label, round(list_dot_product(t.v, tr.v), 6) AS score, train_id FROM t CROSS JOIN tr),
 nn AS (SELECT *, row_number() OVER (PARTITION BY try, test_id ORDER BY score DESC, train_id) AS rank, exp((score - max(score) OVER (PARTITION BY try, test_id)) / 0.07) AS e FROM p), z AS (SELECT nn.try, k, test_id, target, label, sum(e) AS w FROM nn JOIN ks ON ks.try = nn.try AND rank <= k GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY try, k, test_id ORDER BY round(w, 6) DESC, label) AS place FROM z), h AS (SELECT try, k, test_id, max(CAST(label = target AND place <= 1 AS INT)) AS a, max(CAST(label = target AND place <= 5 AS INT)) AS b FROM r GROUP BY 1, 2, 3), m AS (SELECT try, k, 100 * avg(a) AS a, 100 * avg(b) AS b FROM h GROUP BY 1, 2)
 SELECT k::INT AS k, count(*) AS tries, round(avg(a), 6) AS top1_mean, round(stddev_samp(a), 6) AS top1_std, round(avg(b), 6) AS top5_mean, round(stddev_samp(b), 6) AS top5_std FROM m GROUP BY k""")
def _(s, d):
    from pyspark.sql import Window as W

    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    train = e.where("id % 5 <> 0").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(2))))
    order = F.sha2(F.concat_ws(":", "t", "id"), 256)
    few = train.withColumn("n", F.row_number().over(W.partitionBy("t", "label").orderBy(order, "id"))).where("n <= 4")
    return vectors.knn_evaluation(e.where("id % 5 = 0"), few, [5, 20, 100], "t")


@query("g7_similarity_map", "SELECT a.vec_id AS anchor_id, e.vec_id AS id, round(list_dot_product(list_transform(e.embedding, lambda z: CAST(z AS DOUBLE)), list_transform(a.embedding, lambda z: CAST(z AS DOUBLE))), 6) AS cosine FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id < 4) a")
def _(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return vectors.similarity_map(e, e.where("id < 4"))


CLASSED = f"{v.CELLS}, zc AS (SELECT target, CASE WHEN image_id % 10 = 0 AND pred = 3 THEN 9 ELSE pred END AS pred FROM cells), c AS (SELECT k AS class, count(*) FILTER (target = k AND pred = k) AS tp, count(*) FILTER (target = k AND pred < 5) AS t, count(*) FILTER (pred = k) AS p FROM zc CROSS JOIN (SELECT unnest(range(5))::INT AS k) GROUP BY 1), cs AS (SELECT class, tp / greatest(t + p - tp, 1) AS iou, tp / greatest(p, 1) AS precision, tp / greatest(t, 1) AS recall FROM c)"


def _classed(s, d):
    return v.cells(s, d).withColumn("pred", F.when((F.col("image_id") % 10 == 0) & (F.col("pred") == 3), 9).otherwise(F.col("pred")))


@query("h12_class_summary", f"WITH {CLASSED} SELECT class, round(iou, 6) AS iou, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / greatest(precision + recall, 1e-8), 6) AS f1 FROM cs")
def _(s, d):
    return metrics.class_summary(_classed(s, d), "target", "pred", 5)


@query("h12_confusion_summary", f"WITH {CLASSED} SELECT round(avg(iou), 6) AS miou, round(avg(2 * precision * recall / greatest(precision + recall, 1e-8)), 6) AS f1, (SELECT round(avg(CAST(target = pred AS INT)), 6) FROM zc WHERE pred < 5) AS accuracy, (SELECT count(*) FROM zc WHERE pred < 5) AS n, (SELECT count(*) FROM zc WHERE pred >= 5) AS dropped FROM cs")
def _(s, d):
    return metrics.confusion_summary(_classed(s, d), "target", "pred", 5)


@query("h12_confusion", f"WITH {v.CELLS} SELECT target, pred, count(*) AS n FROM cells GROUP BY 1, 2")
def _(s, d):
    return metrics.confusion(v.cells(s, d), "target", "pred")


@query("h27_histogram", "SELECT n AS value, count(*) AS n FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY 1")
def _(s, d):
    return metrics.histogram(table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")), "n")


@query("h14_image_miou", f"""WITH {v.CELLS}, c AS (SELECT image_id, k, count(*) FILTER (target = k AND pred = k) AS i, count(*) FILTER (target = k OR pred = k) AS u, count(*) FILTER (target = k) AS t FROM cells CROSS JOIN (SELECT unnest(range(4))::INT AS k) GROUP BY 1, 2)
 SELECT image_id, round(avg(i / u) FILTER (t > 0), 6) AS miou_present, round(avg(i / u) FILTER (u > 0), 6) AS miou_fp FROM c GROUP BY 1""")
def _(s, d):
    return metrics.image_miou(v.cells(s, d), "image_id", "target", "pred", 4)


@query("h21_depth_metrics", """WITH x AS (SELECT l_extendedprice / l_quantity AS p, p_retailprice AS t FROM lineitem JOIN part ON l_partkey = p_partkey), y AS (SELECT p, t, greatest(p / t, t / p) AS r, ln(p) - ln(t) AS g FROM x WHERE p > 0 AND t > 0)
 SELECT round(avg(CAST(r < 1.25 AS INT)), 6) AS a1, round(avg(CAST(r < 1.5625 AS INT)), 6) AS a2, round(avg(CAST(r < 1.953125 AS INT)), 6) AS a3, round(avg(abs(p - t) / t), 6) AS abs_rel, round(avg((p - t) * (p - t) / t), 6) AS sq_rel, round(sqrt(avg((p - t) * (p - t))), 6) AS rmse, round(sqrt(avg(g * g)), 6) AS rmse_log, round(avg(abs(log10(p) - log10(t))), 6) AS log10, round(avg(abs(p - t)), 6) AS mae, round(100 * sqrt(greatest(avg(g * g) - avg(g) * avg(g), 0)), 6) AS silog FROM y""")
def _(s, d):
    x = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return metrics.depth_metrics(x, F.col("l_extendedprice") / F.col("l_quantity"), F.col("p_retailprice"))


@query("h22_align_scale_shift", "SELECT l_suppkey, round(coalesce(regr_slope(l_extendedprice, l_quantity), 1), 4) AS scale, round(coalesce(regr_intercept(l_extendedprice, l_quantity), 0), 2) AS shift FROM lineitem GROUP BY 1")
def _(s, d):
    return metrics.align_scale_shift(table(s, d, "lineitem"), "l_suppkey", "l_quantity", "l_extendedprice")


@query("h27_summarize_counts", "SELECT count(n) AS n, min(n) AS low, max(n) AS high, round(avg(n), 6) AS mean, round(quantile_cont(n, 0), 6) AS p0, round(quantile_cont(n, 0.25), 6) AS p25, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.75), 6) AS p75, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 1), 6) AS p100 FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def _(s, d):
    return metrics.summarize_counts(table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")), "n")


@query("h30_average_over_tries", "SELECT event_type, user_id % 7 AS try_group, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*) AS tries FROM events GROUP BY 1, 2")
def _(s, d):
    return metrics.average_over_tries(table(s, d, "events").withColumn("try_group", F.col("user_id") % 7), ["event_type", "try_group"], "value")


@query("i1_smooth", f"""WITH {v.STEPS} SELECT run_id, step, name, round(quantile_disc(value, 0.5) OVER w, 6) AS median, round(avg(value) OVER w, 6) AS mean, round(max(value) OVER w, 6) AS high FROM steps WINDOW w AS (PARTITION BY run_id, name ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def _(s, d):
    w = W.partitionBy("run_id", "name").orderBy("step").rowsBetween(-19, 0)
    last = F.sort_array(F.collect_list("value").over(w))
    median = F.element_at(last, F.ceil(F.size(last) / 2).cast("int"))
    return v.steps(s, d).select("run_id", "step", "name", F.round(median, 6).alias("median"), F.round(F.avg("value").over(w), 6).alias("mean"), F.round(F.max("value").over(w), 6).alias("high"))


@query("i2_merge_meters", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(sum(value) / count(*), 6) AS mean FROM events GROUP BY 1")
def _(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.sum("value") / F.count(F.lit(1)), 6).alias("mean"))


@query("i5_latest_eval", f"WITH {v.STEPS} SELECT run_id, name, max(step) AS step, round(arg_max(value, step), 6) AS value FROM steps GROUP BY 1, 2")
def _(s, d):
    return v.steps(s, d).groupBy("run_id", "name").agg(F.max("step").alias("step"), F.round(F.max_by("value", "step"), 6).alias("value"))


@query("i7_best_history", f"WITH {v.STEPS} SELECT run_id, name, step, round(value, 6) AS value FROM (SELECT *, max(value) OVER (PARTITION BY run_id, name ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM steps) WHERE best IS NULL OR value > best")
def _(s, d):
    w = W.partitionBy("run_id", "name").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    return v.steps(s, d).withColumn("best", F.max("value").over(w)).where("best is null or value > best").select("run_id", "name", "step", F.round("value", 6).alias("value"))


@query("i9_retention", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 3 OR o_orderpriority = '1-URGENT' AS keep FROM orders")
def _(s, d):
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderkey")))
    return table(s, d, "orders").select("o_custkey", "o_orderkey", ((rank <= 3) | (F.col("o_orderpriority") == "1-URGENT")).alias("keep"))


@query("a1_asset_inventory", "SELECT page_id, sha256(html) AS sha256, CAST(octet_length(encode(html)) AS BIGINT) AS length, regexp_extract(url, '([^/?#]+)/?([?#].*)?$', 1) AS stem FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("length"), F.regexp_extract("url", "([^/?#]+)/?([?#].*)?$", 1).alias("stem"))


@query("a5_build_entries", "SELECT dense_rank() OVER (ORDER BY regexp_extract(url, '://[^/]+/([a-z]+)/', 1)) - 1 AS class_index, regexp_extract(url, '://[^/]+/([a-z]+)/', 1) AS class_id, page_id AS actual_index FROM pages")
def _(s, d):
    p = table(s, d, "pages").select(F.regexp_extract("url", "://[^/]+/([a-z]+)/", 1).alias("class_id"), F.col("page_id").alias("actual_index"))
    ids = identity.dense_codes(p, "class_id").withColumnRenamed("dense", "class_index")
    return p.join(ids, "class_id").select("class_index", "class_id", "actual_index")


@query("a8_csv_fields", "SELECT d.doc_id, coalesce(CAST(q.quality AS VARCHAR), '') AS quality, coalesce(CAST(q.toxic AS VARCHAR), '') AS toxic, '' AS reviewer FROM documents d LEFT JOIN labels q ON q.doc_id = d.doc_id")
def _(s, d):
    from tessella.sources.manifests import csv_fields

    return csv_fields(table(s, d, "documents").select("doc_id").join(table(s, d, "labels"), "doc_id", "left"), ["quality", "toxic", "reviewer"], ["doc_id"])


@query("a13_fingerprint", "WITH r AS (SELECT sha256(concat_ws(chr(31), doc_id, lang, source)) AS h FROM documents), a AS (SELECT substr(h, 1, 6) AS k, sha256(string_agg(h, '' ORDER BY h)) AS h FROM r GROUP BY 1), b AS (SELECT substr(a.k, 1, 3) AS p, sha256(string_agg(h, '' ORDER BY a.k)) AS h FROM a GROUP BY 1) SELECT sha256(string_agg(h, '' ORDER BY p)) AS fingerprint FROM b")
def _(s, d):
    from tessella.sources.manifests import fingerprint

    return fingerprint(table(s, d, "documents"), ["doc_id", "lang", "source"])


@query("a15_stale_entries", "SELECT w.p_partkey, w.variant FROM (SELECT p_partkey, unnest(range(8))::INT AS variant, p_brand FROM part) w WHERE NOT EXISTS (SELECT 1 FROM part h WHERE h.p_partkey = w.p_partkey AND h.p_size % 8 = w.variant AND h.p_brand = w.p_brand)")
def _(s, d):
    from tessella.sources.manifests import stale_entries

    p = table(s, d, "part")
    want = p.select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("variant"), "p_brand")
    return stale_entries(want, p.select("p_partkey", (F.col("p_size") % 8).alias("variant"), "p_brand"), ["p_partkey", "variant", "p_brand"]).select("p_partkey", "variant")
