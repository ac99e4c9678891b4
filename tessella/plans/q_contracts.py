"""Queries of pairs, contracts, manifests, records and retention, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import contracts as c

from . import views as v
from .registry import query, table


def files(s, d):
    p = table(s, d, "part")
    one = lambda where, kind: p.where(where).select(F.concat_ws(" ", "p_brand", F.col("p_size").cast("string"), F.expr("cast(p_partkey % 37 as string)")).alias("stem"), F.concat(F.lit(kind), "p_partkey").alias("path"))
    return one("p_partkey % 3 > 0", "in/"), one("p_partkey % 4 > 0", "out/")


FILES = """fi AS (SELECT concat_ws(' ', p_brand, p_size, p_partkey % 37) AS stem, concat('in/', p_partkey) AS path FROM part WHERE p_partkey % 3 > 0), fo AS (SELECT concat_ws(' ', p_brand, p_size, p_partkey % 37) AS stem, concat('out/', p_partkey) AS path FROM part WHERE p_partkey % 4 > 0),
 ci AS (SELECT stem, count(*) AS n, min(path) AS path FROM fi GROUP BY 1), co AS (SELECT stem, count(*) AS n, min(path) AS path FROM fo GROUP BY 1),
 pf AS (SELECT coalesce(a.stem, b.stem) AS stem, CASE WHEN a.n IS NULL OR b.n IS NULL THEN 'missing' ELSE 'pair' END AS finding, CASE WHEN a.n IS NULL THEN 'input' WHEN b.n IS NULL THEN 'target' ELSE '' END AS side, coalesce(a.path, '') AS input_path, coalesce(b.path, '') AS target_path, CAST(1 AS BIGINT) AS n FROM ci a FULL JOIN co b ON a.stem = b.stem WHERE coalesce(a.n, 1) = 1 AND coalesce(b.n, 1) = 1
  UNION ALL SELECT stem, 'duplicate', 'input', fi.path, '', n FROM fi JOIN ci USING (stem) WHERE n > 1 UNION ALL SELECT stem, 'duplicate', 'target', '', fo.path, n FROM fo JOIN co USING (stem) WHERE n > 1)"""


@query("b1_pair_files", f"WITH {FILES} SELECT * FROM pf")
def _(s, d):
    return c.pair_files(*files(s, d), "stem", "path")


@query("b2_repeated_stems", "SELECT DISTINCT p_brand AS stem FROM (SELECT CASE WHEN p_size % 2 = 0 THEN upper(p_brand) ELSE lower(p_brand) END AS p_brand, p_name, min(p_name) OVER (PARTITION BY lower(p_brand)) AS f FROM part) WHERE p_name > f")
def _(s, d):
    p = table(s, d, "part").select(F.when(F.col("p_size") % 2 == 0, F.upper("p_brand")).otherwise(F.lower("p_brand")).alias("p_brand"), "p_name")
    return c.repeated_stems(p, "p_brand", "p_name")


def sides(s, d):
    cells, i = v.cells(s, d), F.col("image_id")
    flat = i % 29 == 0
    kind = F.when(F.col("locked"), 0).when((F.col("target") > 0) & ~flat, 2).otherwise(1)
    inputs = cells.select("image_id", "y", "x", F.when((i % 17 == 0) & (F.col("x") == 0), 9 + F.col("y")).otherwise(kind).alias("code"), F.when((i % 23 == 0) & (F.col("y") == 1), 254).otherwise(255).alias("alpha"))
    own = F.when(i % 5 == 0, F.col("pred")).otherwise(F.col("target"))
    code = F.when(F.col("locked"), F.when(i % 31 == 0, 1).otherwise(0)).when((own > 0) & ~flat, 9 + own).otherwise(1)
    targets = cells.where("not (image_id % 19 = 0 and y = 7)").select("image_id", "y", "x", code.alias("code"), F.lit(255).alias("alpha"))
    return inputs, targets


CONTRACT = f"""{v.CELLS}, ip AS (SELECT image_id, y, x, CASE WHEN image_id % 17 = 0 AND x = 0 THEN 9 + y WHEN locked THEN 0 WHEN target > 0 AND image_id % 29 <> 0 THEN 2 ELSE 1 END AS a, image_id % 23 = 0 AND y = 1 AS al FROM cells),
 tg AS (SELECT image_id, y, x, CASE WHEN locked THEN CASE WHEN image_id % 31 = 0 THEN 1 ELSE 0 END WHEN own > 0 AND image_id % 29 <> 0 THEN 9 + own ELSE 1 END AS b FROM (SELECT *, CASE WHEN image_id % 5 = 0 THEN pred ELSE target END AS own FROM cells) WHERE NOT (image_id % 19 = 0 AND y = 7)),
 sz AS (SELECT i.image_id, w1, h1, al, w2, h2, w1 = w2 AND h1 = h2 AS same FROM (SELECT image_id, max(x) + 1 AS w1, max(y) + 1 AS h1, bool_or(al) AS al FROM ip GROUP BY 1) i JOIN (SELECT image_id, max(x) + 1 AS w2, max(y) + 1 AS h2 FROM tg GROUP BY 1) t USING (image_id)),
 cc AS (SELECT image_id, count(*) FILTER (a = 2) AS candidates, count(*) FILTER (b = 10) AS class_10, count(*) FILTER (b = 11) AS class_11, count(*) FILTER (b = 12) AS class_12, count(*) FILTER ((a = 2) <> (b IN (10, 11, 12))) AS mismatches, count(*) FILTER (a = 0 AND b <> 0 OR a = 1 AND b <> 1) AS inconsistent FROM ip JOIN tg USING (image_id, y, x) GROUP BY 1),
 od AS (SELECT image_id, string_agg(concat('(', a, ')=', n), ', ' ORDER BY n DESC, a) AS odd FROM (SELECT image_id, a, count(*) AS n FROM ip WHERE a NOT IN (0, 1, 2) GROUP BY 1, 2) GROUP BY 1),
 zz AS (SELECT image_id, w1, h1, al, w2, h2, same, odd, {', '.join(f'CASE WHEN same THEN {n} ELSE 0 END AS {n}' for n in ('candidates', 'class_10', 'class_11', 'class_12', 'mismatches', 'inconsistent'))} FROM sz LEFT JOIN cc USING (image_id) LEFT JOIN od USING (image_id)),
 fd AS (SELECT *, concat_ws('; ', CASE WHEN al THEN 'alpha is not opaque' END, CASE WHEN NOT same THEN concat('sizes differ: ', w1, 'x', h1, ' and ', w2, 'x', h2) END, CASE WHEN odd IS NOT NULL THEN concat('input codes: ', odd) END, CASE WHEN mismatches > 0 THEN concat('region and classes differ on ', mismatches, ' cells') END, CASE WHEN inconsistent > 0 THEN concat('outline or blank differs on ', inconsistent, ' cells') END) AS f FROM zz),
 pc AS (SELECT image_id, w1 AS width, h1 AS height, candidates, class_10, class_11, class_12, mismatches, inconsistent, CASE WHEN f <> '' THEN 'invalid' WHEN same AND candidates = 0 THEN 'warning' ELSE 'valid' END AS status, CASE WHEN same AND candidates = 0 THEN concat_ws('; ', nullif(f, ''), 'no cell of the region') WHEN f <> '' THEN f ELSE 'OK' END AS reason FROM fd)"""


def contract(s, d):
    return c.pair_contract(*sides(s, d), 2, 0, 1, [10, 11, 12], "alpha")


@query("b7_pair_contract", f"WITH {CONTRACT} SELECT * FROM pc")
def _(s, d):
    return contract(s, d)


@query("b9_readiness_report", f"WITH {CONTRACT}, {FILES} SELECT 'status' AS section, status AS name, count(*) AS n FROM pc GROUP BY 2 UNION ALL SELECT 'files', finding, count(*) FROM pf GROUP BY 2 UNION ALL SELECT 'reason', reason, count(*) FROM pc WHERE status <> 'valid' GROUP BY 2 UNION ALL SELECT 'ready', 'ready', CAST(count(*) FILTER (status = 'valid') > 0 AND count(*) FILTER (status = 'invalid') = 0 AS BIGINT) FROM pc")
def _(s, d):
    return c.readiness_report(contract(s, d).checkpoint(), c.pair_files(*files(s, d), "stem", "path"))


TILES = """tl AS (SELECT CASE WHEN l_partkey % 91 = 0 THEN NULL ELSE concat(l_orderkey, '-', l_linenumber % 6) END AS sample_id, l_orderkey AS scene_id, l_linenumber - 1 AS transform_id, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE concat(l_orderkey, '/', l_linenumber) END AS tile_uid, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS region, CASE WHEN l_quantity = 50 THEN 'subscene' WHEN l_quantity > 40 THEN NULL ELSE 'tile' END AS kind FROM lineitem)"""


@query("b10_audit_tiles", f"""WITH {TILES}, sn AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 1000), kn AS (SELECT DISTINCT scene_id, transform_id AS k FROM tl)
 SELECT 'unknown_scene' AS finding, '' AS name, 'error' AS severity, count(*) AS n FROM tl WHERE scene_id NOT IN (SELECT o_orderkey FROM sn) UNION ALL SELECT 'no_sample_id', '', 'error', count(*) FROM tl WHERE sample_id IS NULL UNION ALL SELECT 'duplicate_sample', '', 'error', count(sample_id) - count(DISTINCT sample_id) FROM tl
 UNION ALL SELECT 'missing_field', '', 'error', count(*) FROM tl WHERE sample_id IS NULL OR tile_uid IS NULL UNION ALL SELECT 'wrong_record', '', 'error', count(*) FROM tl WHERE kind = 'subscene' UNION ALL SELECT 'duplicate_tile', '', 'error', count(tile_uid) - count(DISTINCT tile_uid) FROM tl UNION ALL SELECT 'rows_without_tile', '', 'error', abs(count(*) - count(DISTINCT tile_uid)) FROM tl
 UNION ALL SELECT 'missing_orientation', CAST(k AS VARCHAR), 'error', count(*) FROM (SELECT DISTINCT scene_id FROM tl) s, (SELECT unnest(range(8)) AS k) q WHERE NOT EXISTS (SELECT 1 FROM kn WHERE kn.scene_id = s.scene_id AND kn.k = q.k) GROUP BY 2
 UNION ALL SELECT 'orientation', CAST(transform_id AS VARCHAR), 'info', count(*) FROM tl GROUP BY 2 UNION ALL SELECT 'region', coalesce(region, 'unknown'), 'info', count(*) FROM tl GROUP BY 2""")
def _(s, d):
    k = F.col("l_orderkey").alias("scene_id")
    tiles = table(s, d, "lineitem").select(
        F.when(F.col("l_partkey") % 91 != 0, F.concat("l_orderkey", F.lit("-"), F.col("l_linenumber") % 6)).alias("sample_id"), k, (F.col("l_linenumber") - 1).alias("transform_id"), F.when(F.col("l_suppkey") % 7 != 0, F.concat("l_orderkey", F.lit("/"), "l_linenumber")).alias("tile_uid"),
        F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("region"), F.when(F.col("l_quantity") == 50, "subscene").when(F.col("l_quantity") <= 40, "tile").alias("kind"),
    )
    scenes = table(s, d, "orders").where("o_totalprice > 1000").select(F.col("o_orderkey").alias("scene_id"))
    return c.audit_tiles(tiles, scenes, "scene_id", "sample_id", "tile_uid", "transform_id", "region", ["sample_id", "scene_id", "transform_id", "tile_uid"], "kind")


RECORDS = """rc AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN sha256('x') ELSE sha256(text) END AS sha256, n_chars + CAST(doc_id % 8 = 0 AS INT) AS width, 4 AS height, sha256(text) AS actual, n_chars AS w FROM documents)"""


@query("b12_audit_records", f"""WITH {RECORDS} SELECT doc_id, 'missing_source' AS finding, 'error' AS severity, '' AS detail FROM rc WHERE doc_id % 21 = 0 UNION ALL SELECT doc_id, 'missing_target', 'error', '' FROM rc WHERE doc_id % 22 = 0 UNION ALL SELECT doc_id, 'hash', 'warning', concat(substr(sha256, 1, 12), ' and ', substr(actual, 1, 12)) FROM rc WHERE doc_id % 9 = 0 AND doc_id % 21 <> 0
 UNION ALL SELECT doc_id, 'shape', 'error', concat(w, 'x4 and ', w, 'x5') FROM rc WHERE doc_id % 6 = 0 AND doc_id % 21 <> 0 AND doc_id % 22 <> 0 UNION ALL SELECT doc_id, 'size', 'warning', concat(width, 'x4 and ', w, 'x4') FROM rc WHERE doc_id % 8 = 0 AND doc_id % 21 <> 0 UNION ALL SELECT doc_id, 'codes', 'error', '7,9' FROM rc WHERE doc_id % 10 = 0 AND doc_id % 22 <> 0""")
def _(s, d):
    docs, i = table(s, d, "documents"), F.col("doc_id")
    records = docs.select("doc_id", F.when(i % 9 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("text", 256)).alias("sha256"), (F.col("n_chars") + (i % 8 == 0).cast("int")).alias("width"), F.lit(4).alias("height"))
    codes = lambda *x: F.array(*[F.lit(k) for k in x])
    source = docs.where("doc_id % 21 <> 0").select("doc_id", F.lit("source").alias("side"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("width"), F.lit(4).alias("height"), codes(0, 1).alias("codes"))
    target = docs.where("doc_id % 22 <> 0").select("doc_id", F.lit("target").alias("side"), F.sha2("lang", 256).alias("sha256"), F.col("n_chars").alias("width"), F.when(i % 6 == 0, 5).otherwise(4).alias("height"), F.when(i % 10 == 0, codes(9, 0, 7)).otherwise(codes(0, 2)).alias("codes"))
    return c.audit_records(records, source.union(target), "doc_id", [0, 1, 2])


@query("b22_cardinality_report", """WITH n AS (SELECT user_id AS key, count(*) AS n FROM events GROUP BY 1), o AS (SELECT key, n FROM n WHERE n > 12 ORDER BY key LIMIT 20)
 SELECT 'counts' AS section, u.name AS name, u.v AS n FROM (SELECT count(*) FILTER (n > 16) AS a, count(*) FILTER (n > 32) AS b, count(*) FILTER (n > 64) AS c, count(*) FILTER (n > 128) AS e, count(*) FILTER (n > 12) AS f, count(*) AS g FROM n), LATERAL (VALUES ('gt_16', a), ('gt_32', b), ('gt_64', c), ('gt_128', e), ('over_cap', f), ('keys', g)) u(name, v) UNION ALL SELECT 'example', CAST(key AS VARCHAR), n FROM o""")
def _(s, d):
    return c.cardinality_report(table(s, d, "events"), "user_id")


@query("i9_retention_policy", "WITH e AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'best' WHEN o_orderpriority = '2-HIGH' THEN 'final' WHEN o_orderpriority = '5-LOW' THEN 'draft' ELSE CAST(o_orderkey AS VARCHAR) END AS name FROM orders) SELECT o_custkey, o_orderkey, name, CASE WHEN name IN ('best', 'final') THEN true WHEN name = 'draft' THEN false ELSE row_number() OVER (PARTITION BY o_custkey, name IN ('best', 'final', 'draft') ORDER BY o_orderkey DESC) <= 2 END AS keep FROM e")
def _(s, d):
    p = F.col("o_orderpriority")
    name = F.when(p == "1-URGENT", "best").when(p == "2-HIGH", "final").when(p == "5-LOW", "draft").otherwise(F.col("o_orderkey").cast("string"))
    return c.retention(table(s, d, "orders").select("o_custkey", "o_orderkey", name.alias("name")), "o_custkey", "name", "last_and_best", 2)


@query("a1_inventory_files", "SELECT CAST(page_id AS VARCHAR) AS page_id, 'txt' AS ext, CAST(octet_length(encode(html)) + 1 AS BIGINT) AS length, sha256(concat(html, chr(10))) AS sha256, false AS lossy FROM pages")
def _(s, d):
    """A file a page, written and listed again."""
    from tessella.sources.shared import fresh_path
    from tessella.sources.tables import asset_inventory

    path = fresh_path(s)
    table(s, d, "pages").select("page_id", F.col("html").alias("value")).repartition("page_id").write.partitionBy("page_id").text(path)
    found = asset_inventory(s, [path], ["txt"])
    return found.select(F.regexp_extract("path", r"page_id=(\d+)", 1).alias("page_id"), "ext", "length", "sha256", "lossy")


@query("a6_class_folder", "SELECT CAST(item_id AS VARCHAR) AS item, CAST(octet_length(encode(replace(text, chr(10), ' '))) + 1 AS BIGINT) AS length FROM benchmark WHERE item_id % 3 = 1")
def _(s, d):
    """A file an item, written in folders of split and class, and read back by a dataset's name."""
    from tessella.sources.shared import fresh_path
    from tessella.sources.tables import read_dataset

    path = fresh_path(s)
    rows = table(s, d, "benchmark").select((F.col("item_id") % 3).alias("part"), F.col("item_id").alias("item"), F.translate("text", "\n", " ").alias("value"))
    rows.repartition("item").write.partitionBy("part", "item").text(path)
    found = read_dataset(s, f"ClassFolder:root={path}:split=part=1:extra=txt")
    return found.select(F.regexp_extract("class_id", "item=(.*)", 1).alias("item"), "length")
