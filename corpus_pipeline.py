"""A corpus pipeline: quality, exact copies, near copies, benchmark leaks, packing. ``run`` applies STAGES to ``documents``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontaminate, exact_dedup, ngram_join, packing, quality
from tessella.llm.common import scratch, shared_dir


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Null and empty texts are scored like any other; repeated rows share their verdict."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last document of each group of equal texts; null and empty texts are one group, and rows that repeat its id all stay."""
    return exact_dedup.drop_exact_duplicates(docs)


def distinct_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group that near copies link; texts without words link with nothing and stay."""
    return ngram_join.keep_one_per_component(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none. Items without words match nothing."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens; a null or empty text is its end token."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", good_documents),
    ("exact_dedup", distinct_documents),
    ("ngram_join", distinct_groups),
    ("decontamination", clean_documents),
    ("packing", packed_sequences),
]

#: SQL has neither the classifier nor the tokenizer; tests/llm/test_pipeline.py runs it against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over ``documents``; each stage's result is written and read again as the next one's input.

    Tables that a stage needs on its way are removed when its result is written. An empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
