"""Helpers that the operators share: written tables, skew-safe lookups, text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's own limit of bytes in an Arrow batch, and ours.
SPARK_BATCH, BATCH = "67108864b", "4m"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share; a temporary one only in local mode."""
    found = spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH at most for this session's Python operators, unless it has a size of its own: long texts else fill memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == SPARK_BATCH:
        spark.conf.set(name, BATCH)


_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that ``stash`` writes inside once the block ends; what is built on them has to be written by then."""
    held = _SCRATCH.set([])
    try:
        yield
    finally:
        for path in _SCRATCH.get():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _SCRATCH.reset(held)


def stash(df: DataFrame, dictionary: bool = True, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: computed once, lineage cut, safe when executors go.

    ``dictionary=False`` saves the work of looking for repeated values in tables of hashes and texts; "zstd" takes less disk for texts.
    """
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    if _SCRATCH.get() is not None:
        _SCRATCH.get().append(path)
    df.write.option("parquet.enable.dictionary", str(dictionary).lower()).option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is. Texts of ASCII alone take the faster built-in."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hot_keys(rows: DataFrame, key: str, most: int = 2000, least: int = 10_000) -> list:
    """Keys with more than ``max(least, rows / most)`` rows: fewer than ``most`` of them, whatever the input."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = rows.count()
    return [r[0] for r in counts.where(F.col("__n") > max(least, total // most)).select(key).collect()] if total > least else []


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: Column, how: str = "inner", salts: int = 64, counted: DataFrame | None = None, small: int = 400_000) -> DataFrame:
    """Join many ``rows`` to ``table``, a written table of a few numbers or one digest a row, with one row a key.

    A table of at most ``small`` rows is broadcast. Else rows of a hot key are dealt over ``salts`` partitions by ``by``;
    hot keys are counted in ``counted`` (or ``rows``), a written table, with a partial aggregation. ``small=0`` never
    broadcasts, for wide rows.
    """
    if small and table.count() <= small:
        return rows.join(F.broadcast(table), key, how)
    hot = hot_keys(rows if counted is None else counted, key)
    if not hot:
        return rows.join(table, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    left = rows.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).otherwise(0))
    right = table.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "__salt"], how).drop("__salt")


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df``, a written table, with a broadcast hint if it has at most ``rows`` rows (of a few numbers each), else as it is."""
    return F.broadcast(df) if df.count() <= rows else df
