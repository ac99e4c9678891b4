"""Views of the driver tables that stand for label rasters, images, boxes, scenes, palettes and metric series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8 x 8 label raster per vector: value, target and predicted class, locked flag."""
    at = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("pos", "e"))
    v = F.col("e").cast("double")
    code = lambda x: F.when(x < -0.1, 3).when(x < 0, 2).when(x < 0.1, 1).otherwise(0)
    d = (((F.col("pos") * 7 + F.col("image_id")) % 5) - 2) * F.lit(0.02)
    return at.select("image_id", F.expr("cast(pos div 8 as int)").alias("y"), (F.col("pos") % 8).alias("x"), v.alias("v"), code(v).alias("target"), code(v + d).alias("pred"), (F.col("pos") % 11 == 0).alias("locked"))


CELLS = """cells AS (SELECT image_id, y, x, v, CASE WHEN v < -0.1 THEN 3 WHEN v < 0 THEN 2 WHEN v < 0.1 THEN 1 ELSE 0 END AS target,
 CASE WHEN v + d < -0.1::DOUBLE THEN 3 WHEN v + d < 0 THEN 2 WHEN v + d < 0.1::DOUBLE THEN 1 ELSE 0 END AS pred, locked
 FROM (SELECT vec_id AS image_id, CAST(pos // 8 AS INT) AS y, CAST(pos % 8 AS INT) AS x, CAST(e AS DOUBLE) AS v, ((pos * 7 + vec_id) % 5 - 2) * 0.02::DOUBLE AS d, pos % 11 = 0 AS locked
 FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)))"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), (256 + 32 * F.col("p_size")).cast("int").alias("width"), (256 + 16 * (F.col("p_partkey") % 64)).cast("int").alias("height"))


IMAGES = "images AS (SELECT p_partkey AS image_id, CAST(256 + 32 * p_size AS INT) AS width, CAST(256 + 16 * (p_partkey % 64) AS INT) AS height FROM part)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), n.alias("n"), (F.col("l_partkey") % 512).cast("int").alias("x"), ((F.col("l_suppkey") * 5) % 512).cast("int").alias("y"), (32 + 16 * n).alias("w"), (32 + 16 * n).alias("h")).distinct()


BOXES = "boxes AS (SELECT DISTINCT l_orderkey AS image_id, l_linenumber AS n, CAST(l_partkey % 512 AS INT) AS x, CAST((l_suppkey * 5) % 512 AS INT) AS y, 32 + 16 * l_linenumber AS w, 32 + 16 * l_linenumber AS h FROM lineitem)"


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("scene_id"), F.concat(F.lit("g"), i).alias("group_id"), F.when(F.col("doc_id") % 40 == 0, F.concat(F.lit("f_"), "lang")).otherwise(F.concat(F.lit("f"), i)).alias("family_id"), F.concat(F.lit("d"), i).alias("design_id"), F.sha2("text", 256).alias("source_sha256")
    )


SCENES = """scenes AS (SELECT doc_id AS scene_id, concat('g', CAST(doc_id AS VARCHAR)) AS group_id, CASE WHEN doc_id % 40 = 0 THEN concat('f_', lang) ELSE concat('f', CAST(doc_id AS VARCHAR)) END AS family_id,
 concat('d', CAST(doc_id AS VARCHAR)) AS design_id, sha256(text) AS source_sha256 FROM documents)"""


def palette_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), (F.col("l_partkey") % 256).cast("int").alias("r"), ((F.col("l_suppkey") * 7) % 256).cast("int").alias("g"), ((F.col("l_linenumber") * 31) % 256).alias("b")).distinct()


PALETTES = "palette_rows AS (SELECT DISTINCT l_orderkey AS sample_id, CAST(l_partkey % 256 AS INT) AS r, CAST((l_suppkey * 7) % 256 AS INT) AS g, (l_linenumber * 31) % 256 AS b FROM lineitem)"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("step"), "ts", F.col("event_type").alias("name"), "value")


STEPS = "steps AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, ts, event_type AS name, value FROM events)"
