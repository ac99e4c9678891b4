"""Queries of crops: sampled by quotas, and the best window of each category."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import crops

from . import views as v
from .registry import query


def sampled(s, d):
    cells = v.cells(s, d).select("image_id", "y", "x", F.col("target").alias("code"), (~F.col("locked") & (F.col("v") > -0.05)).alias("region")).checkpoint()
    images = cells.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return crops.sample_crops(images, cells, 7, 3, [3, 1], stride=2, band=2, least=6, most=24, tiny=2), images, cells


@query("e15_sample_crops")
def _(s, d):
    found, images, cells = sampled(s, d)
    return crops.crop_records(found.checkpoint(), images, cells, [0, 1, 2, 3], 3, 1, (0, 5))


@query("e15_crop_counters")
def _(s, d):
    return sampled(s, d)[0].select("image_id", "generated", "accepted", "no_candidate", "duplicate", "high_iou")


SELECT = f"""WITH RECURSIVE {v.CELLS}, k AS (SELECT image_id, y, x, target <> pred AS tr, target > 0 AS sh, target = 3 AS dk, locked AS ln FROM cells),
 w AS (SELECT s.size, a.o AS y0, b.o AS x0 FROM (VALUES (3), (4)) s(size), (SELECT unnest(range(6))::INT AS o) a, (SELECT unnest(range(6))::INT AS o) b WHERE a.o <= 8 - s.size AND b.o <= 8 - s.size),
 st AS MATERIALIZED (SELECT image_id, size, x0 AS x, y0 AS y, count(*) FILTER (tr) AS t, count(*) FILTER (sh) AS s, count(*) FILTER (dk) AS d, count(*) FILTER (ln) AS n, string_agg(concat(CAST(tr AS INT), CAST(sh AS INT)), '' ORDER BY k.y, k.x) AS content
  FROM k JOIN w ON k.y >= y0 AND k.y < y0 + size AND k.x >= x0 AND k.x < x0 + size GROUP BY 1, 2, 3, 4),
 sc AS (SELECT *, 0 AS c, round(t / (size * size), 6) AS score, '' AS h FROM st UNION ALL SELECT *, 1, round(s / (size * size), 6), '' FROM st UNION ALL SELECT *, 2, round(d / (size * size), 6), '' FROM st
  UNION ALL SELECT *, 3, round(n / (size * size), 6), '' FROM st WHERE s <= 0.001 * size * size AND n > 0.01 * size * size UNION ALL SELECT *, 4, 0, sha256(concat('7:', image_id, ':', size, ':', x, ':', y)) FROM st),
 rk AS (SELECT *, row_number() OVER (PARTITION BY image_id, size, c ORDER BY score DESC, h, x, y) AS rank FROM sc),
 cand AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY size, c, rank) AS i FROM rk WHERE rank <= 12),
 g AS (SELECT DISTINCT image_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(size INT, c INT, x INT, y INT, score DOUBLE, content VARCHAR)[]) AS picks FROM cells UNION ALL
  SELECT g.image_id, n.i, CASE WHEN len(list_filter(g.picks, lambda p: p.size = n.size AND (p.c = n.c OR p.content = n.content OR greatest(0, n.size - abs(p.x - n.x)) * greatest(0, n.size - abs(p.y - n.y)) >= 0.5 * (2 * n.size * n.size - greatest(0, n.size - abs(p.x - n.x)) * greatest(0, n.size - abs(p.y - n.y)))))) > 0 THEN g.picks
   ELSE list_append(g.picks, {{'size': n.size, 'c': n.c, 'x': n.x, 'y': n.y, 'score': n.score, 'content': n.content}}) END FROM g JOIN cand n ON n.image_id = g.image_id AND n.i = g.i + 1),
 done AS (SELECT image_id, picks FROM g QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY i DESC) = 1),
 u AS (SELECT image_id, unnest(picks) AS p, generate_subscripts(picks, 1) - 1 AS place FROM done)
 SELECT image_id, place, p.size AS size, ['transition_rich', 'shade_rich', 'dark_rare', 'negative', 'mixed_random'][p.c + 1] AS category, p.x AS x, p.y AS y, p.score AS score FROM u"""


@query("e14_select_crops", SELECT)
def _(s, d):
    c = v.cells(s, d).select("image_id", "y", "x", (F.col("target") != F.col("pred")).alias("transition"), (F.col("target") > 0).alias("shade"), (F.col("target") == 3).alias("dark"), F.col("locked").alias("line"))
    return crops.select_crops(c, 7, [4, 3], iou=0.5, most=12, least_stride=1)
