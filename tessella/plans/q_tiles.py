"""Queries of boxes, tiles, crops, blending and vectors, with their SQL."""

from __future__ import annotations

from math import exp, log

from pyspark.sql import functions as F

from tessella.operators import geometry as g
from tessella.operators import vectors as e

from . import views as v
from .registry import query, table

UNIT = f"{v.BOXES}, ub AS (SELECT image_id, n, x / 1024.0::DOUBLE AS x, y / 1024.0::DOUBLE AS y, w / 1024.0::DOUBLE AS w, h / 2048.0::DOUBLE AS h FROM boxes)"


def unit(s, d):
    return v.boxes(s, d).select("image_id", "n", *[(F.col(c) / z).alias(c) for c, z in (("x", 1024.0), ("y", 1024.0), ("w", 1024.0), ("h", 2048.0))])


WAYS = ["x, y, w, h", "1-x-w, y, w, h", "x, 1-y-h, w, h", "1-x-w, 1-y-h, w, h", "y, 1-x-w, h, w", "1-x-w, 1-y-h, w, h", "1-y-h, x, h, w", "1-y-h, 1-x-w, h, w"]


@query("e4_orient_boxes", f"WITH {UNIT}, k AS ({' UNION ALL '.join(f'SELECT image_id, n, {i} AS k, ' + ', '.join(f'{c} AS c{j}' for j, c in enumerate(w.split(', '))) + ' FROM ub' for i, w in enumerate(WAYS))}) SELECT image_id, n, k, round(c0, 6) AS ox, round(c1, 6) AS oy, round(c2, 6) AS ow, round(c3, 6) AS oh FROM k")
def _(s, d):
    return g.orient_boxes(unit(s, d))


MOVED = f"{v.BOXES}, mv AS (SELECT image_id, n, x::DOUBLE AS px, y::DOUBLE AS py, w::DOUBLE AS pw, h::DOUBLE AS ph, x + n * 3.0::DOUBLE AS gx, y + n * 2.0::DOUBLE AS gy, w * 1.5::DOUBLE AS gw, h * 0.5::DOUBLE AS gh FROM boxes), en AS (SELECT *, round((gx - px) / (pw + 0.1), 6) AS dx, round((gy - py) / (ph + 0.1), 6) AS dy, round(ln(gw / (pw + 0.1)), 6) AS dw, round(ln(gh / (ph + 0.1)), 6) AS dh FROM mv)"


def moved(s, d):
    b = v.boxes(s, d)
    c = lambda n: F.col(n).cast("double")
    return g.box_encode(b.select("image_id", "n", *[c(k).alias(f"p{k}") for k in "xywh"], (c("x") + c("n") * 3).alias("gx"), (c("y") + c("n") * 2).alias("gy"), (c("w") * 1.5).alias("gw"), (c("h") * 0.5).alias("gh")))


@query("e19_box_encode", f"WITH {MOVED} SELECT image_id, n, px, py, dx, dy, dw, dh FROM en")
def _(s, d):
    return moved(s, d).select("image_id", "n", "px", "py", "dx", "dy", "dw", "dh")


@query("e19_box_decode", f"""WITH {MOVED}, c AS (SELECT image_id, n, px + pw * dx AS cx, py + ph * dy AS cy, pw * exp(greatest(least(dw * 9, {abs(log(16 / 1000))}), -{abs(log(16 / 1000))})) AS w, ph * exp(dh) AS h FROM en)
 SELECT image_id, n, round(greatest(least(cx - w / 2, 400.0), 0.0), 4)::DOUBLE AS x1, round(greatest(least(cy - h / 2, 300.0), 0.0), 4)::DOUBLE AS y1, round(greatest(least(cx + w / 2, 400.0), 0.0), 4)::DOUBLE AS x2, round(greatest(least(cy + h / 2, 300.0), 0.0), 4)::DOUBLE AS y2 FROM c""")
def _(s, d):
    return g.box_decode(moved(s, d).withColumn("dw", F.col("dw") * 9), 400, 300).select("image_id", "n", "x1", "y1", "x2", "y2")


@query("e20_decode_detections", """WITH q AS (SELECT vec_id, i AS query, list_transform(range(4), lambda c: CAST(embedding[i * 8 + c + 1] AS DOUBLE)) AS z, abs(CAST(embedding[i * 8 + 5] AS DOUBLE)) AS cx, abs(CAST(embedding[i * 8 + 6] AS DOUBLE)) AS cy, abs(CAST(embedding[i * 8 + 7] AS DOUBLE)) AS w, abs(CAST(embedding[i * 8 + 8] AS DOUBLE)) AS h FROM embeddings, (SELECT unnest(range(8)) AS i)),
 p AS (SELECT vec_id, query, c AS label, round(1 / (1 + exp(-z[c + 1])), 6) AS score, cx, cy, w, h FROM q, (SELECT unnest(range(4)) AS c)), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, query, label) AS place FROM p)
 SELECT vec_id, place, label, score, round((cx - w / 2) * 640, 4) AS x1, round((cy - h / 2) * 480, 4) AS y1, round((cx + w / 2) * 640, 4) AS x2, round((cy + h / 2) * 480, 4) AS y2 FROM r WHERE place <= 5""")
def _(s, d):
    part = lambda i, k: F.abs(F.get("embedding", i * 8 + k).cast("double"))
    q = table(s, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("query"))
    i = F.col("query")
    rows = q.select("vec_id", "query", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.get("embedding", i * 8 + c).cast("double")).alias("logits"), part(i, 4).alias("cx"), part(i, 5).alias("cy"), part(i, 6).alias("w"), part(i, 7).alias("h"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    return g.decode_detections(rows, "vec_id", 5)


BOXED = f"{v.IMAGES}, lb AS (SELECT *, least(512::DOUBLE / height, 512::DOUBLE / width) AS scale FROM images), lc AS (SELECT *, least(greatest(1, round_even(width * scale, 0)), 512)::INT AS content_w, least(greatest(1, round_even(height * scale, 0)), 512)::INT AS content_h FROM lb), ld AS (SELECT *, (512 - content_w) // 2 AS offset_x, (512 - content_h) // 2 AS offset_y FROM lc)"


@query("e21_letterbox", f"WITH {BOXED} SELECT image_id, round(scale, 6) AS scale, content_w, content_h, CAST(offset_x AS BIGINT) AS offset_x, CAST(offset_y AS BIGINT) AS offset_y FROM ld")
def _(s, d):
    return g.letterbox(v.images(s, d), 512).select("image_id", F.round("scale", 6).alias("scale"), "content_w", "content_h", "offset_x", "offset_y")


@query("e21_crop_to_letterbox", f"WITH {BOXED} SELECT image_id, round((offset_x + (0.25::DOUBLE + 0.5::DOUBLE * 0.1::DOUBLE) * width * scale) / 512, 6) AS lx, round((offset_y + (0.125::DOUBLE + 0.75::DOUBLE * 0.2::DOUBLE) * height * scale) / 512, 6) AS ly FROM ld")
def _(s, d):
    p = g.letterbox(v.images(s, d), 512).select("*", *[F.lit(z).alias(c) for c, z in (("x", 0.25), ("y", 0.125), ("w", 0.1), ("h", 0.2), ("u", 0.5), ("v", 0.75))])
    return g.crop_to_letterbox(p, 512).select("image_id", "lx", "ly")


@query("e21_cells_and_points", f"WITH {v.IMAGES}, p AS (SELECT *, (image_id % 97) / 96.0::DOUBLE AS u, (image_id % 89) / 88.0::DOUBLE AS w FROM images), c AS (SELECT *, CAST(greatest(least(floor(w * 12), 11), 0) AS BIGINT) AS row, CAST(greatest(least(floor(u * 16), 15), 0) AS BIGINT) AS col FROM p) SELECT image_id, row, col, round((col + 0.5) / 16 * width, 6) AS px, round((row + 0.5) / 12 * height, 6) AS py FROM c")
def _(s, d):
    i = v.images(s, d)
    row, col = g.uv_to_cell((F.col("image_id") % 97) / 96.0, (F.col("image_id") % 89) / 88.0, 12, 16)
    at = i.select("image_id", "width", "height", row.alias("row"), col.alias("col"))
    x, y = g.cell_to_xy(F.col("row"), F.col("col"), 12, 16, F.col("width"), F.col("height"))
    return at.select("image_id", "row", "col", F.round(x, 6).alias("px"), F.round(y, 6).alias("py"))


@query("e10_coverage", f"""WITH {v.IMAGES}, small AS (SELECT * FROM images), t AS (SELECT image_id, x, y FROM (SELECT *, unnest(range(0, height, 384)) AS y FROM (SELECT *, unnest(range(0, width, 384)) AS x FROM small)) WHERE NOT (image_id % 7 = 0 AND x = 384 AND y = 0) UNION ALL SELECT image_id, 192, 192 FROM small WHERE image_id % 3 = 0),
 c AS (SELECT image_id, unnest(range(0, width, 16)) AS cx, height FROM small), d AS (SELECT image_id, cx, unnest(range(0, height, 16)) AS cy FROM c), n AS (SELECT d.image_id, cx, cy, count(t.x) AS n FROM d LEFT JOIN t ON t.image_id = d.image_id AND cx >= t.x AND cx < t.x + 384 AND cy >= t.y AND cy < t.y + 384 GROUP BY ALL)
 SELECT image_id, CAST(256 * count(*) FILTER (n = 0) AS BIGINT) AS holes, CAST(256 * count(*) FILTER (n > 1) AS BIGINT) AS over FROM n GROUP BY 1""")
def _(s, d):
    i = v.images(s, d)
    t = g.core_tiles(i, 384, 64).where("not (image_id % 7 = 0 and core_x = 384 and core_y = 0)").select("image_id", F.col("core_x").alias("x"), F.col("core_y").alias("y"), F.lit(384).alias("w"), F.lit(384).alias("h"))
    return g.coverage(i, t.union(i.where("image_id % 3 = 0").select("image_id", F.lit(192), F.lit(192), F.lit(384), F.lit(384))))


def drawn(part: str, most: str) -> str:
    """The hash of a try, modulo ``most``."""
    return f"CAST(concat('0x', substr(sha256(concat('5:', region, ':', image_id, ':', t, ':{part}')), 1, 12)) AS BIGINT) % ({most})"


@query("e5_offgrid_origins", f"""WITH {v.IMAGES}, e AS (SELECT image_id, region, n, greatest(width - 512, 0)::BIGINT AS mx, greatest(height - 512, 0)::BIGINT AS my, unnest(range(tries)) AS t FROM images, (VALUES ('interior', 3, 240), ('edge', 2, 200), ('corner', 1, 200)) r(region, n, tries)),
 o AS (SELECT image_id, region, n, t, CASE WHEN region = 'interior' THEN {drawn('x', 'mx + 1')} WHEN {drawn('x', '2')} = 0 THEN 0 ELSE mx END AS ox, CASE WHEN region <> 'corner' THEN {drawn('y', 'my + 1')} WHEN {drawn('y', '2')} = 0 THEN 0 ELSE my END AS oy FROM e),
 g AS (SELECT image_id, region, n, ox, oy, min(t) AS t FROM o WHERE NOT ((ox + 64) % 384 = 0 AND (oy + 64) % 384 = 0) AND NOT (ox % 384 = 0 AND oy % 384 = 0) GROUP BY ALL)
 SELECT image_id, ox, oy, CAST(row_number() OVER w AS INT) AS place FROM g WINDOW w AS (PARTITION BY image_id, region ORDER BY t) QUALIFY row_number() OVER w <= n""")
def _(s, d):
    i = v.images(s, d)
    return g.offgrid_origins(i, 512, 384, 64, 3, "interior", 5).unionByName(g.offgrid_origins(i, 512, 384, 64, 2, "edge", 5)).unionByName(g.offgrid_origins(i, 512, 384, 64, 1, "corner", 5))


@query("e6_capacity_manifest", f"""WITH {v.IMAGES}, k AS (SELECT image_id, k, CASE WHEN k % 2 = 1 THEN height ELSE width END AS width, CASE WHEN k % 2 = 1 THEN width ELSE height END AS height FROM images, (SELECT unnest(range(8))::INT AS k)), t AS (SELECT image_id, k, x AS core_x, y AS core_y FROM (SELECT *, unnest(range(0, height, 384)) AS y FROM (SELECT *, unnest(range(0, width, 384)) AS x FROM k)))
 SELECT image_id, k, core_x, core_y, 'grid' AS region, image_id || '__t' || k || '__' || core_x || '_' || core_y AS tile_uid FROM t""")
def _(s, d):
    return g.capacity_manifest(v.images(s, d), 384, 64, 512, 0, 5)


SUBS = f"{v.IMAGES}, sz AS (SELECT *, unnest([512, 768, 1024]) AS size FROM images), sl AS (SELECT * FROM sz WHERE greatest(width, height) > CASE size WHEN 512 THEN 0 WHEN 768 THEN 512 ELSE 768 END), sc AS (SELECT image_id, size, (width - least(size, width)) // 2 AS x, (height - least(size, height)) // 2 AS y, least(size, width) AS w, least(size, height) AS h FROM sl)"


@query("e7_subscenes", f"WITH {SUBS} SELECT image_id, size, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, w, h FROM sc")
def _(s, d):
    return g.subscenes(v.images(s, d))


@query("e8_manifest_summary", f"WITH {SUBS}, r AS (SELECT *, sha256(concat_ws(chr(31), size, image_id, x, y)) AS hs FROM sc), a AS (SELECT substr(hs, 1, 6) AS k, sha256(string_agg(hs, '' ORDER BY hs)) AS q FROM r GROUP BY 1), b AS (SELECT substr(a.k, 1, 3) AS p, sha256(string_agg(q, '' ORDER BY a.k)) AS q FROM a GROUP BY 1), f AS (SELECT sha256(string_agg(q, '' ORDER BY p)) AS fingerprint FROM b) SELECT size, count(*) AS n, count(DISTINCT image_id) AS images, any_value(fingerprint) AS fingerprint FROM sc, f GROUP BY 1")
def _(s, d):
    return g.manifest_summary(g.subscenes(v.images(s, d)), "size", ["image_id", "x", "y"])


@query("e9_training_manifest", f"""WITH {v.BOXES}, c AS (SELECT *, (x + y) / 1024.0::DOUBLE AS score, CASE WHEN x % 5 = 0 THEN 'rich' ELSE 'plain' END AS category FROM boxes WHERE w = 64 AND h = 64), h AS (SELECT image_id FROM (SELECT DISTINCT image_id FROM c) ORDER BY 1 LIMIT 20)
 SELECT image_id, n, k, mode, CASE WHEN image_id IN (SELECT image_id FROM h) THEN 'val' ELSE 'train' END AS split, image_id || '__' || x || '_' || y AS group_id FROM c, (SELECT unnest(range(8))::INT AS k), (VALUES ('bw'), ('guide')) m(mode) WHERE score >= 0.5 OR category = 'rich'""")
def _(s, d):
    c = v.boxes(s, d).withColumn("score", (F.col("x") + F.col("y")) / 1024.0).withColumn("category", F.when(F.col("x") % 5 == 0, "rich").otherwise("plain"))
    return g.training_manifest(c, 64, 0.5, "score", "category", "rich", 20)


TILED = f"{v.CELLS}, tl AS (SELECT i.image_id, a.k AS tile, a.x0, a.y0 FROM (SELECT DISTINCT image_id FROM cells) i, (VALUES (0, 0, 0), (1, 4, 0), (2, 2, 3)) a(k, x0, y0))"


def tiles(s, d):
    rows = F.array(*[F.struct(F.lit(k).alias("tile"), F.lit(x).alias("x0"), F.lit(y).alias("y0"), F.lit(4).alias("w"), F.lit(4).alias("h")) for k, x, y in ((0, 0, 0), (1, 4, 0), (2, 2, 3))])
    return v.cells(s, d).select("image_id").distinct().select("image_id", F.inline(rows))


@query("e11_extract_tiles", f"WITH {TILED}, p AS (SELECT *, ty, tx FROM tl, (SELECT unnest(range(-1, 5))::INT AS ty), (SELECT unnest(range(-1, 5))::INT AS tx)) SELECT p.image_id, tile, ty, tx, coalesce(c.target, -1) AS code, c.target IS NOT NULL AS inside FROM p LEFT JOIN cells c ON c.image_id = p.image_id AND c.y = y0 + ty AND c.x = x0 + tx")
def _(s, d):
    t = tiles(s, d).withColumnsRenamed({"x0": "x", "y0": "y"})
    return g.extract_tiles(v.cells(s, d).withColumn("code", F.col("target")), t, 1, -1)


@query("e16_crop_stats", f"""WITH {TILED}, i AS (SELECT tl.*, c.* EXCLUDE (image_id), x >= x0 + 1 AND x < x0 + 3 AND y >= y0 + 1 AND y < y0 + 3 AS mid FROM tl JOIN cells c ON c.image_id = tl.image_id AND x >= x0 AND x < x0 + 4 AND y >= y0 AND y < y0 + 4)
 SELECT image_id, tile, count(*) FILTER (NOT locked) AS region, count(*) FILTER (NOT locked AND mid) AS center, count(*) FILTER (NOT locked AND target <> pred) AS edges, {', '.join(f'count(*) FILTER (NOT locked AND target = {c}) AS code_{c}' for c in range(4))} FROM i GROUP BY 1, 2""")
def _(s, d):
    c = v.cells(s, d).withColumn("code", F.col("target")).withColumn("edge", F.col("target") != F.col("pred")).withColumn("free", ~F.col("locked"))
    return g.crop_stats(c, tiles(s, d), 1, [0, 1, 2, 3], "edge", "free")


@query("e22_blend_tiles", f"""WITH {TILED}, p AS (SELECT c.image_id, c.y, c.x, c.y - y0 AS ty, c.x - x0 AS tx, c.v + tile AS value FROM tl JOIN cells c ON c.image_id = tl.image_id AND x >= x0 AND x < x0 + 4 AND y >= y0 AND y < y0 + 4), w AS (SELECT *, greatest((0.5 - 0.5 * cos(2 * pi() * ty / 3)) * (0.5 - 0.5 * cos(2 * pi() * tx / 3)), 1e-3) AS w FROM p)
 SELECT image_id, y, x, round(sum(value * w) / greatest(sum(w), 1e-6), 6) AS value FROM w GROUP BY 1, 2, 3""")
def _(s, d):
    inside = v.cells(s, d).join(tiles(s, d), "image_id").where("x >= x0 and x < x0 + w and y >= y0 and y < y0 + h")
    rows = inside.select("image_id", "y", "x", (F.col("y") - F.col("y0")).alias("ty"), (F.col("x") - F.col("x0")).alias("tx"), F.lit(4).alias("size"), (F.col("v") + F.col("tile")).alias("value"))
    return g.blend_tiles(rows)


@query("e23_tta_average", f"""WITH {v.CELLS}, p AS (SELECT image_id, y, x, c, avg(CASE WHEN c = (pred + k) % 4 THEN 0.55 - 0.1 * k ELSE 0.15 END) AS m FROM cells, (SELECT unnest(range(3)) AS k), (SELECT unnest(range(4)) AS c) GROUP BY ALL) SELECT image_id, y, x, CAST(arg_max(c, round(m, 6) * 100 - c * 0.000001) AS INT) AS pred, round(max(m), 6)::DOUBLE AS confidence FROM p GROUP BY 1, 2, 3""")
def _(s, d):
    k = F.col("k")
    rows = v.cells(s, d).select("image_id", "y", "x", "pred", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    probs = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.when(c == (F.col("pred") + k) % 4, 0.55 - 0.1 * k).otherwise(0.15))
    return g.tta_average(rows.select("image_id", "y", "x", probs.alias("probs")), 4)


@query("f27_valid_cells", f"WITH {v.CELLS} SELECT image_id, y, x, y >= 0 AND y < 7 AND x >= 0 AND x < 7 AND v > -0.1 AND v < 0.15 AS valid FROM cells")
def _(s, d):
    return g.valid_cells(v.cells(s, d), "v", -0.1, 0.15, (45, 471, 41, 601), (480, 640)).select("image_id", "y", "x", "valid")


HALF = "hv AS (SELECT vec_id, list_transform(embedding, lambda z: CAST(z AS DOUBLE)) AS q FROM embeddings)"


@query("g3_probe_input", f"WITH {HALF} SELECT vec_id, 20 AS n, round(q[1], 6) AS first, round(q[17], 6) AS nth, round((q[33] + q[37] + q[41] + q[45]) / 4, 6) AS mean FROM hv")
def _(s, d):
    rows = table(s, d, "embeddings").select("vec_id", F.slice("embedding", 1, 8).alias("b1"), F.slice("embedding", 17, 8).alias("b2"), F.array(*[F.slice("embedding", 33 + 4 * k, 4) for k in range(4)]).alias("p"))
    out = e.probe_input(rows, ["b1", "b2"], "p")
    return out.select("vec_id", F.size("probe").alias("n"), F.round(F.get("probe", F.lit(0)), 6).alias("first"), F.round(F.get("probe", F.lit(8)), 6).alias("nth"), F.round(F.get("probe", F.lit(16)), 6).alias("mean"))


FARTHER = "greatest(abs(c.y - {p}.y), abs(c.x - {p}.x)) > 1"


@query("g8_topn_nms", f"""WITH {v.CELLS}, c AS (SELECT image_id, y, x, round(v, 6) AS s FROM cells WHERE greatest(abs(y - 3), abs(x - 3)) > 1), p1 AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY s DESC, y, x) = 1),
 p2 AS (SELECT c.* FROM c JOIN p1 USING (image_id) WHERE {FARTHER.format(p='p1')} QUALIFY row_number() OVER (PARTITION BY c.image_id ORDER BY c.s DESC, c.y, c.x) = 1), p3 AS (SELECT c.* FROM c JOIN p1 USING (image_id) JOIN p2 USING (image_id) WHERE {FARTHER.format(p='p1')} AND {FARTHER.format(p='p2')} QUALIFY row_number() OVER (PARTITION BY c.image_id ORDER BY c.s DESC, c.y, c.x) = 1)
 SELECT image_id, 1 AS place, y AS row, x AS col, s AS score FROM p1 UNION ALL SELECT image_id, 2, y, x, s FROM p2 UNION ALL SELECT image_id, 3, y, x, s FROM p3""")
def _(s, d):
    c = v.cells(s, d).select("image_id", "y", "x", F.round("v", 6).alias("score"), F.lit(3).alias("ay"), F.lit(3).alias("ax"))
    return e.topn_nms(c, "image_id", 3, 1, exclude=("ay", "ax"))


@query("g11_koleo", f"WITH {HALF}, p AS (SELECT a.vec_id, round(list_dot_product(a.q, b.q), 6) AS s FROM hv a JOIN hv b ON a.vec_id <> b.vec_id), m AS (SELECT vec_id, max(s) AS s FROM p GROUP BY 1) SELECT round(-avg(ln(sqrt(greatest(2 - 2 * s, 0)) + 1e-8)), 6) AS spread FROM m")
def _(s, d):
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return e.koleo(e.knn(rows, rows, 2))


@query("g12_gram_mse", f"""WITH {HALF}, p AS (SELECT vec_id, i, list_transform(range(8), lambda k: q[i * 8 + k + 1]) AS a, list_transform(range(8), lambda k: q[i * 8 + k + 1] * (1 + 0.1::DOUBLE * (k % 3))) AS b FROM hv, (SELECT unnest(range(8)) AS i)),
 m AS (SELECT x.vec_id, list_dot_product(x.a, y.a) AS g, greatest(list_dot_product(x.b, y.b), 0) AS h FROM p x JOIN p y USING (vec_id)) SELECT vec_id, round(avg((CASE WHEN g < 0 AND h <= 0 THEN 0 ELSE g END - h) ** 2), 6) AS mse FROM m GROUP BY 1""")
def _(s, d):
    at = table(s, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    a = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.get("embedding", F.col("i") * 8 + k).cast("double"))
    b = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.get("embedding", F.col("i") * 8 + k).cast("double") * (1 + 0.1 * (k % 3)))
    return e.gram_mse(at.select("vec_id", "i", a.alias("a"), b.alias("b")), "vec_id", "i", "a", "b", "drop_second")


def _round_sql(n: int) -> str:
    q = "q0"
    out = "z AS (SELECT vec_id, k, exp(q[k + 1] / 0.5) AS w FROM hv, (SELECT unnest(range(6)) AS k)), q0 AS (SELECT vec_id, k, w FROM z)"
    for i in range(1, n + 1):
        out += f", r{i} AS (SELECT vec_id, k, w / sum(w) OVER (PARTITION BY k) / 6 AS w FROM {q}), q{i} AS (SELECT vec_id, k, w / sum(w) OVER (PARTITION BY vec_id) AS w FROM r{i})"
        q = f"q{i}"
    return out


@query("g13_sinkhorn", f"WITH {HALF}, {_round_sql(3)} SELECT vec_id, CAST(k AS INT) AS k, round(w, 6) AS share FROM q3")
def _(s, d):
    rows = table(s, d, "embeddings").select("vec_id", F.slice("embedding", 1, 6).alias("v"))
    return e.sinkhorn(rows, "vec_id", "v", 0.5).select("vec_id", F.posexplode("shares").alias("k", "share")).withColumn("share", F.round("share", 6))


@query("g14_clip_loss", f"""WITH {HALF}, p AS (SELECT vec_id % 20 AS batch, vec_id, q, list_transform(range(64), lambda k: q[(k + 1) % 64 + 1]) AS t FROM hv), z AS (SELECT a.batch, a.vec_id AS i, b.vec_id AS j, 10 * list_dot_product(a.q, b.t) AS z FROM p a JOIN p b USING (batch)),
 l AS (SELECT batch, ln(sum(exp(z - 10))) + 10 AS l FROM z GROUP BY batch, i UNION ALL SELECT batch, ln(sum(exp(z - 10))) + 10 FROM z GROUP BY batch, j), o AS (SELECT batch, sum(z) AS own, count(*) AS n FROM z WHERE i = j GROUP BY 1) SELECT batch, round((sum(l) - 2 * any_value(own)) / any_value(n) / 2, 6) AS loss FROM l JOIN o USING (batch) GROUP BY 1""")
def _(s, d):
    t = F.concat(F.slice("embedding", 2, 63), F.slice("embedding", 1, 1))
    return e.clip_loss(table(s, d, "embeddings").select((F.col("vec_id") % 20).alias("batch"), "vec_id", "embedding", t.alias("t")), "batch", "vec_id", "embedding", "t", 10.0)


@query("g17_align_results", "SELECT event_id % 700 AS index, round(arg_max(value, event_id), 6) AS pred, arg_max(user_id, event_id) AS target FROM events GROUP BY 1")
def _(s, d):
    rows = table(s, d, "events").select((F.col("event_id") % 700).alias("index"), "event_id", F.round("value", 6).alias("pred"), F.col("user_id").alias("target"))
    return e.align_results(rows, "index", "event_id", ["pred", "target"])


CENTRES = [(1 - i / 63) * exp(log(0.5) + (log(10.0) - log(0.5)) * i / 63) + i / 63 * (0.5 + 9.5 * i / 63) for i in range(64)]


@query("h23_soft_bins", f"WITH {HALF}, y AS (SELECT vec_id, list_transform(q, lambda z: greatest(z, 0) + 1e-8) AS y FROM hv) SELECT vec_id, round(8 * list_dot_product(y, [{', '.join(f'{c!r}::DOUBLE' for c in CENTRES)}]) / list_sum(y), 6) AS value FROM y")
def _(s, d):
    return e.soft_bins(table(s, d, "embeddings"), "vec_id", "embedding", 0.5, 80.0, 64)
