"""Manifests and result tables: reading, writing, fingerprints, refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_manifest(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped and a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_manifest(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with columns in name order."""
    df.select(*sorted(df.columns)).write.mode(mode).json(path)


def csv_fields(df: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    """Fixed text fields: missing ones and nulls are empty, others are dropped."""
    return df.select(*keys, *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in df.columns else F.lit("").alias(f) for f in fields])


def canonical(df: DataFrame) -> DataFrame:
    """Columns as string, long or double; booleans become text."""
    kind = {"tinyint": "long", "smallint": "long", "int": "long", "bigint": "long", "float": "double", "double": "double"}
    return df.select(*[F.col(c).cast(kind.get(t, "double" if t.startswith("decimal") else "string")).alias(c) for c, t in df.dtypes])


def fingerprint(df: DataFrame, keys: list[str]) -> DataFrame:
    """One hash of all rows in any order: row hashes meet in 16 million buckets, their hashes in 4096, and those make the last one.

    A bucket of a million million rows holds some 60,000 hashes, and nothing holds more.
    """
    row = F.sha2(F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys]), 256)
    first = df.select(row.alias("h")).groupBy(F.substring("h", 1, 6).alias("k")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    joined = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), ""), 256)
    second = first.groupBy(F.substring("k", 1, 3).alias("__k")).agg(joined.alias("h")).withColumnRenamed("__k", "k")
    return second.agg(joined.alias("fingerprint"))


def stale_entries(want: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted entries whose key, version included, isn't there."""
    return want.join(have, keys, "left_anti")
