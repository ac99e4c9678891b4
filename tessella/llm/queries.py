"""The operators' queries over the driver tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontaminate, exact_dedup, hard_negatives, license_scan, line_dedup, ngram_join, packing, quality, secret_scan, surrogates, token_counts, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
WINDOW g AS (PARTITION BY text_sha256)
"""


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # here, so that the other queries don't need it

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), url_filter.RULES)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the key of this example; a deployment passes its own secret."""
    return surrogates.with_surrogates(_table(spark, sf_dir, "documents"), b"example key, not a secret")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_groups(_table(spark, sf_dir, "documents"), least_words=1)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(_table(spark, sf_dir, "embeddings"))


def _cluster_sql(rounds: int) -> str:
    """The clustering as one table a round."""
    steps = [
        """v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "e AS MATERIALIZED (SELECT vec_id, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM v)",
        "s0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, q FROM (SELECT sha256(concat('3:', vec_id)) AS h, q FROM v ORDER BY h LIMIT 8))",
        "c0 AS MATERIALIZED (SELECT k, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM s0)",
    ]
    for n in range(rounds + 1):
        steps.append(f"d{n} AS (SELECT e.vec_id, c.k, CAST(sum((e.x - c.x) * (e.x - c.x)) AS BIGINT) AS d FROM e JOIN c{n} AS c ON e.i = c.i GROUP BY ALL)")
        steps.append(f"a{n} AS MATERIALIZED (SELECT vec_id, k, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)")
        if n < rounds:
            steps.append(f"m{n} AS (SELECT a.k, e.i, floor(sum(e.x) / CAST(count(*) AS DOUBLE)) AS x FROM a{n} AS a JOIN e ON a.vec_id = e.vec_id GROUP BY ALL)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c.k, CAST(coalesce(m.x, c.x) AS BIGINT) AS x, c.i FROM c{n} AS c LEFT JOIN m{n} AS m ON c.k = m.k AND c.i = m.i)")
    last = f"""SELECT vec_id, CAST(k AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY k) USING (k)"""
    return "WITH " + ",\n".join(steps) + "\n" + last


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row has the next label, so that near rows of another label exist; every hundredth is an anchor."""
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0, label=label)


OP13_SQL = """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
 FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS MATERIALIZED (SELECT vec_id, label, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM v),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(sum(a.x * r.x) AS BIGINT) AS score
 FROM e AS a JOIN e AS r ON a.i = r.i AND a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id GROUP BY ALL),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5
"""


_FOUND = [op1_url_filter, op2_exact_dedup, op3_secret_scan, op4_decontamination, op5_pii_surrogates, op6_packing, op7_line_dedup, op8_quality_classifier, op9_ngram_join, op10_license_scan, op11_token_counts, op12_centroid_clusters, op13_hard_negatives]
QUERIES = {f.__name__: f for f in _FOUND}
ORACLES = {"op2_exact_dedup": OP2_SQL, "op12_centroid_clusters": _cluster_sql(10), "op13_hard_negatives": OP13_SQL}
