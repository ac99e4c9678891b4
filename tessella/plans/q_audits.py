"""Queries of sources, validation reports and audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import audits
from tessella.sources import tables as t

from . import views as v
from .registry import query, table


@query("a2_caption_groups", "SELECT c.conv_id, coalesce(string_agg(q.text, '|' ORDER BY q.turn), '') AS captions, count(q.turn) AS n FROM (SELECT DISTINCT conv_id FROM conversations UNION SELECT DISTINCT conv_id + 1000000 FROM conversations WHERE conv_id % 5 = 0) c LEFT JOIN conversations q ON q.conv_id = c.conv_id AND q.role = 'user' GROUP BY 1")
def _(s, d):
    c = table(s, d, "conversations")
    images = c.select("conv_id").union(c.where("conv_id % 5 = 0").select(F.col("conv_id") + 1000000))
    out = t.caption_groups(images, c.where("role = 'user'"), "conv_id", "text", "turn")
    return out.select("conv_id", F.concat_ws("|", "captions").alias("captions"), F.size("captions").cast("long").alias("n"))


@query("a3_pair_list", r"SELECT row_number() OVER (ORDER BY l) - 1 AS row, image_path, target_path FROM (SELECT '/img/' || page_id || '.jpg /depth/' || page_id || '.png 518.8' AS l, 'img/' || page_id || '.jpg' AS image_path, 'depth/' || page_id || '.png' AS target_path FROM pages)")
def _(s, d):
    i = F.col("page_id").cast("string")
    path = t.write_lines(table(s, d, "pages"), F.concat(F.lit("/img/"), i, F.lit(".jpg /depth/"), i, F.lit(".png 518.8")))
    return t.load_pair_list(s, path)


@query("a4_offset_entries", """WITH o AS (SELECT source AS class_id, doc_id, coalesce(sum(1 + n_chars // 512) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(1 + n_chars // 512) OVER (PARTITION BY source ORDER BY doc_id) AS e FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1))
 SELECT class_id, CAST(512 * b AS BIGINT) AS start, CAST(512 * e AS BIGINT) AS "end", 'd' || doc_id || '.txt' AS filename FROM o WHERE doc_id <> 7""")
def _(s, d):
    from pyspark.sql import Window as W

    docs = table(s, d, "documents")
    docs = docs.join(docs.groupBy("doc_id").count().where("count > 1"), "doc_id", "left_anti")
    w = W.partitionBy("source").orderBy("doc_id")
    size = F.expr("1 + n_chars div 512")
    end = F.sum(size).over(w)
    log = docs.select("source", (end - size).alias("b"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"))
    last = docs.groupBy("source").agg(F.sum(size).alias("b")).select("source", "b", F.lit(t.TERMINATOR).alias("name"))
    lines = log.union(last).select("source", F.concat(F.lit("block "), F.col("b").cast("string"), F.lit(": "), "name").alias("line"))
    return t.offset_entries(lines, "source", "line", ("d7.txt",))


@query("a5_classes", "SELECT dense_rank() OVER (ORDER BY c) - 1 AS class_index, c AS class_id, n FROM (SELECT regexp_extract(url, '://[^/]+/([a-z]+)/', 1) AS c, count(*) AS n FROM pages GROUP BY 1) WHERE c <> ''")
def _(s, d):
    return t.build_entries(table(s, d, "pages"), "url", "://[^/]+/([a-z]+)/([^/?#]*)")[1].select("class_index", "class_id", "n")


@query("a6_read_dataset", "SELECT p_partkey, p_brand FROM part")
def _(s, d):
    return t.read_dataset(s, f"Parquet:root={d}/part.parquet").select("p_partkey", "p_brand")


@query("a7_manifest_round_trip", "SELECT doc_id, lang, n_chars FROM documents")
def _(s, d):
    from tessella.sources.manifests import read_manifest, write_manifest
    from tessella.sources.shared import fresh_path

    path = fresh_path(s)
    write_manifest(table(s, d, "documents").select("doc_id", "lang", "n_chars"), path)
    return read_manifest(s, path, "doc_id long, lang string, n_chars long")


@query("a9_results_round_trip", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, CAST(max(value) > 90 AS VARCHAR) AS high, -1::BIGINT AS rank FROM events GROUP BY 1 UNION ALL SELECT event_type, -1, -1, 'none', 7 FROM events GROUP BY 1")
def _(s, d):
    from tessella.sources.shared import fresh_path

    path = f"{fresh_path(s)}.jsonl"
    rows = table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), (F.max("value") > 90).alias("high"))
    t.results_write(rows, path)
    both = t.results_vstack([t.results_read(s, path), rows.select("event_type", F.lit(7).alias("rank"))])
    return both.fillna(-1, ["n", "mean", "rank"]).fillna("none", ["high"])


@query("a10_collection", "SELECT 'by_lang' AS sheet, lang AS k, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'by_source', source, count(*) FROM documents GROUP BY 2")
def _(s, d):
    from tessella.sources.shared import fresh_path

    docs, path = table(s, d, "documents"), fresh_path(s)
    t.collection_write({f"by_{c}": docs.groupBy(F.col(c).alias("k")).agg(F.count(F.lit(1)).alias("n")) for c in ("lang", "source")}, path)
    a, b = (x.select(F.lit(n).alias("sheet"), "k", "n") for n, x in t.collection_read(s, path, ["by_lang", "by_source"]).items())
    return a.union(b)


@query("a11_publish", "SELECT p_partkey, p_size FROM part")
def _(s, d):
    from tessella.sources.shared import fresh_path

    path = fresh_path(s)
    t.publish(table(s, d, "part").select("p_partkey", "p_size"), path)
    t.publish(table(s, d, "part").select("p_partkey"), path, "resume")
    return s.read.parquet(path)


@query("a12_features", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE))), 6) AS total FROM embeddings")
def _(s, d):
    from tessella.sources.shared import fresh_path

    path = fresh_path(s)
    t.save_features(table(s, d, "embeddings"), path, "vec_id", ["embedding", "label"])
    return t.load_features(s, path, ["embedding"]).select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


TILES = f"{v.IMAGES}, tl AS (SELECT image_id, x AS core_x, y AS core_y, image_id || '_' || x || '_' || y AS sample_id, CASE WHEN image_id % 11 = 0 THEN 'subscene' ELSE 'tile' END AS record_type, CASE WHEN image_id % 4 = 0 THEN 'val' ELSE 'train' END AS split FROM (SELECT *, unnest(range(0, height, 384))::INT AS y FROM (SELECT *, unnest(range(0, width, 384))::INT AS x FROM images)))"


def tiles(s, d):
    from tessella.operators import geometry

    g = geometry.core_tiles(v.images(s, d), 384, 64)
    i = F.col("image_id")
    return g.select("image_id", "core_x", "core_y", F.concat_ws("_", i.cast("string"), F.col("core_x").cast("string"), F.col("core_y").cast("string")).alias("sample_id"), F.when(i % 11 == 0, "subscene").otherwise("tile").alias("record_type"), F.lit("grid").alias("sampling_region"), F.when(i % 4 == 0, "val").otherwise("train").alias("split"))


@query("a14_materialize", f"WITH {TILES} SELECT sample_id, CASE WHEN image_id % 3 = 0 THEN 'skipped' ELSE 'written' END AS status FROM tl")
def _(s, d):
    rows = tiles(s, d)
    return t.materialize(rows, rows.where("image_id % 3 = 0"), "sample_id", lambda new: new)[1]


@query("a14_built", f"WITH {TILES} SELECT sample_id, core_x + core_y AS at FROM tl WHERE image_id % 3 <> 0")
def _(s, d):
    rows = tiles(s, d)
    return t.materialize(rows, rows.where("image_id % 3 = 0"), "sample_id", lambda new: new.select("sample_id", (F.col("core_x") + F.col("core_y")).alias("at")))[0]


@query("a16_load_tiles", f"WITH {TILES} SELECT sample_id, width, height FROM tl JOIN images USING (image_id) WHERE record_type = 'tile' AND split = 'val'")
def _(s, d):
    return t.require_rows(t.load_tiles(tiles(s, d), v.images(s, d), "image_id", "val"), "val tiles").select("sample_id", "width", "height")


@query("c15_discover_scenes", "SELECT o_custkey, coalesce(min(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END), min(o_orderkey)) AS o_orderkey, CASE WHEN count(*) FILTER (o_orderpriority = '1-URGENT') > 0 THEN 0 ELSE 1 END AS source_rank FROM orders GROUP BY 1")
def _(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return t.discover_scenes([o.where("o_orderpriority = '1-URGENT'").drop("o_orderpriority"), o.drop("o_orderpriority")], "o_custkey")


@query("b3_match_substring", "SELECT p.p_brand AS id, min(g.g) AS guide FROM (SELECT DISTINCT p_brand FROM part) p LEFT JOIN (SELECT DISTINCT 'x' || p_brand || 'y' AS g FROM part WHERE p_size < 25 UNION SELECT DISTINCT substr(p_brand, 1, 7) FROM part) g ON contains(g.g, p.p_brand) OR contains(p.p_brand, g.g) GROUP BY 1")
def _(s, d):
    p = table(s, d, "part")
    guides = p.where("p_size < 25").select(F.concat(F.lit("x"), "p_brand", F.lit("y")).alias("g")).union(p.select(F.substring("p_brand", 1, 7)))
    return audits.match_substring(p.select(F.col("p_brand").alias("id")).distinct(), guides, "id", "g")


NOTES = f"""{v.PALETTES}, nt AS (SELECT sample_id, list(struct_pack(r := r, g := g, b := b) ORDER BY r, g, b) AS c FROM palette_rows GROUP BY 1), an AS (SELECT CASE WHEN sample_id % 17 = 0 THEN 'x' || sample_id ELSE '' || sample_id END AS stem, sample_id, CASE WHEN sample_id % 13 = 0 THEN sample_id + 1 ELSE sample_id END AS own, len(c) + CAST(sample_id % 19 = 0 AS INT) AS num_colors, len(c) AS n, c, sample_id % 7 = 0 AS bad, sample_id % 23 = 0 AS off FROM nt)"""


def notes(s, d):
    i = F.col("sample_id")
    own = v.palette_rows(s, d).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("r", "g", "b"))).alias("c"))
    two = lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")
    rgb = F.transform("c", lambda x, k: F.array(F.when((k == 0) & (i % 7 == 0), 300).otherwise(x["r"]).cast("int"), x["g"].cast("int"), x["b"].cast("int")))
    hexes = F.transform("c", lambda x, k: F.when((k == 0) & (i % 23 == 0), "#zz").otherwise(F.concat(F.lit("#"), two(x["r"]), two(x["g"]), two(x["b"]))))
    return own.select(F.concat(F.when(i % 17 == 0, "x").otherwise(""), i.cast("string")).alias("stem"), F.when(i % 13 == 0, i + 1).otherwise(i).alias("sample_id"), (F.size("c") + (i % 19 == 0).cast("int")).alias("num_colors"), rgb.alias("rgb"), hexes.alias("hex"))


CHECKED = f"{NOTES}, ck AS (SELECT stem, num_colors, CASE WHEN sample_id % 17 = 0 OR sample_id % 13 = 0 THEN 1 ELSE CAST(num_colors <> n AS INT) + CAST(bad AS INT) + CAST(off AND NOT bad AS INT) END AS n_errors FROM an)"


@query("b4_validate_annotations", f"WITH {CHECKED} SELECT stem, CAST(n_errors AS BIGINT) AS n_errors, 0::BIGINT AS n_warnings, n_errors = 0 AS ok FROM ck")
def _(s, d):
    return audits.validate_annotations(notes(s, d)).select("stem", F.size("errors").cast("long").alias("n_errors"), F.size("warnings").cast("long").alias("n_warnings"), "ok")


@query("b5_palette_report", f"""WITH {CHECKED}, im AS (SELECT DISTINCT '' || o_orderkey AS stem FROM orders WHERE o_orderkey % 10 <> 3), j AS (SELECT im.stem AS a, ck.stem AS b, n_errors, num_colors FROM im FULL JOIN ck ON im.stem = ck.stem)
 SELECT count(a) AS images, count(b) AS palettes, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS pairs, count(*) FILTER (a IS NULL) AS missing_images, count(*) FILTER (b IS NULL) AS missing_palettes, count(*) FILTER (a IS NOT NULL AND n_errors > 0) AS invalid, 0::BIGINT AS repeated, count(*) FILTER (a IS NOT NULL AND n_errors = 0 AND num_colors > 5) AS over_cap, count(*) FILTER (a IS NOT NULL AND n_errors = 0 AND num_colors <= 5) AS trainable FROM j""")
def _(s, d):
    images = table(s, d, "orders").where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").cast("string").alias("stem"))
    return audits.palette_report(images, audits.validate_annotations(notes(s, d)), "stem", 5)


SUB = "sb AS (SELECT o_orderkey % 5000 AS sample, o_custkey AS scene, CASE WHEN o_orderkey % 50 = 0 THEN 'tile' ELSE 'subscene' END AS kind, CASE WHEN o_orderkey % 70 = 0 THEN 5 END AS core_x FROM orders)"
FOUND = f"{SUB}, fd AS (SELECT 'wrong_kind' AS finding, count(*) AS n FROM sb WHERE kind <> 'subscene' UNION ALL SELECT 'tile_fields', count(*) FROM sb WHERE core_x IS NOT NULL UNION ALL SELECT 'unknown_scene', count(*) FROM sb WHERE scene NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0) UNION ALL SELECT 'duplicate_sample', count(*) - count(DISTINCT sample) FROM sb)"


def subs(s, d):
    o = F.col("o_orderkey")
    rows = table(s, d, "orders").select((o % 5000).alias("sample"), F.col("o_custkey").alias("scene"), F.when(o % 50 == 0, "tile").otherwise("subscene").alias("kind"), F.when(o % 70 == 0, 5).alias("core_x"))
    return audits.audit_subscenes(rows, table(s, d, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("scene")), "kind", "scene", "sample", ["core_x"])


@query("b11_audit_subscenes", f"WITH {FOUND} SELECT * FROM fd")
def _(s, d):
    return subs(s, d)


@query("b13_audit_dataset", f"""WITH {FOUND}, al AS (SELECT 'subscenes' AS part, finding, n FROM fd UNION ALL SELECT 'documents', 'n_chars', count(*) FROM documents WHERE n_chars <> length(text)), c AS (SELECT *, finding IN ('unknown_scene', 'duplicate_sample') AS critical FROM al)
 SELECT part, finding, n, critical, CASE WHEN sum(CASE WHEN critical THEN n ELSE 0 END) OVER () > 0 THEN 'fail' ELSE 'ok' END AS status FROM c""")
def _(s, d):
    docs = table(s, d, "documents").agg(F.count_if(F.col("n_chars") != F.length("text")).alias("n")).select(F.lit("n_chars").alias("finding"), "n")
    return audits.audit_dataset({"subscenes": subs(s, d), "documents": docs}, {"unknown_scene", "duplicate_sample"})


HASHED = "hs AS (SELECT doc_id, source, sha256(text) AS sha, CASE WHEN ('0x' || substr(sha256('3:' || doc_id), 1, 15))::BIGINT % 10 < 2 THEN 'val' ELSE 'train' END AS split FROM documents)"


def hashed(s, d):
    from tessella.functions.hashing import derive_seed

    return table(s, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha"), F.when(derive_seed(3, "doc_id", modulus=10) < 2, "val").otherwise("train").alias("split"))


@query("b15_cross_split_hashes", f"WITH {HASHED}, e AS (SELECT sha, split, count(*) AS n, min(doc_id) AS first_id FROM hs GROUP BY 1, 2) SELECT sha, split, n, first_id, 'train,val' AS splits FROM e WHERE sha IN (SELECT sha FROM e GROUP BY 1 HAVING count(*) > 1)")
def _(s, d):
    return audits.cross_split_hashes(hashed(s, d), "sha", "split", "doc_id")


@query("b18_identifiability", f"""WITH {HASHED}, g AS (SELECT sha, count(*) AS n, count(DISTINCT split) AS s FROM hs GROUP BY 1), q AS (SELECT list(l_quantity ORDER BY l_quantity DESC) AS q FROM lineitem GROUP BY l_orderkey)
 SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (n > 1) AS repeated, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS repeated_rows, count(*) FILTER (s > 1) AS cross_split, (SELECT count(*) FROM hs WHERE regexp_matches(source, '[02468]$')) AS flagged, (SELECT count(*) FROM q WHERE len(q) > 1 AND q[1] > 10 * q[2]) AS dominated FROM g""")
def _(s, d):
    sizes = table(s, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_quantity").alias("size"))
    return audits.identifiability(hashed(s, d), "sha", "split", "doc_id", "source", "[02468]$", sizes)


@query("b19_invariants", "SELECT name, CASE WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END AS status, bad || ' of ' || n AS detail FROM (SELECT 'has_text' AS name, count(*) FILTER (NOT coalesce(length(text) > 0, false)) AS bad, count(*) AS n FROM documents UNION ALL SELECT 'short', count(*) FILTER (NOT coalesce(n_chars < 3000, false)), count(*) FROM documents)")
def _(s, d):
    return audits.invariants(table(s, d, "documents"), {"has_text": "length(text) > 0", "short": "n_chars < 3000"})
