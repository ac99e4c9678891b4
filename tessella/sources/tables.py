"""Sources that aren't plain tables, results by file name, and outputs that never replace others by accident."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .manifests import canonical
from .shared import fresh_path

LOSSY = ("jpg", "jpeg", "webp")


def asset_inventory(spark: SparkSession, folders: list[str], suffixes: list[str], recursive: bool = True) -> DataFrame:
    """``asset_id, side, path, stem, ext, length, sha256, lossy`` of the files of the folders (``side`` is the folder's place) with these suffixes in any case."""
    glob = "*.{" + ",".join(sorted({form for s in suffixes for form in (s.lower(), s.upper())})) + "}"
    out = None
    for side, folder in enumerate(folders):
        files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
        name = F.regexp_extract("path", r"([^/]+)$", 1)
        ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
        one = files.select(F.sha2("path", 256).alias("asset_id"), F.lit(side).alias("side"), "path", F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), ext.alias("ext"), "length", F.sha2("content", 256).alias("sha256"), ext.isin(*LOSSY).alias("lossy"))
        out = one if out is None else out.union(one)
    return out


def caption_groups(images: DataFrame, annotations: DataFrame, key: str, caption: str, order: str) -> DataFrame:
    """``key, captions``: each image's captions in order; an empty list without one."""
    own = annotations.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, caption))), lambda x: x[caption]).alias("captions"))
    return images.select(key).distinct().join(own, key, "left").select(key, F.coalesce("captions", F.array().cast("array<string>")).alias("captions"))


def load_caption_groups(spark: SparkSession, path: str) -> DataFrame:
    """``image_id, path, captions`` of JSON documents with arrays ``images(id, file_name)`` and ``annotations(id, image_id, caption)``."""
    doc = spark.read.schema("images array<struct<id: long, file_name: string>>, annotations array<struct<id: long, image_id: long, caption: string>>").option("multiLine", "true").json(path)
    images = doc.select(F.inline("images")).select(F.col("id").alias("image_id"), F.col("file_name").alias("path")).distinct()
    notes = doc.select(F.inline("annotations"))
    return images.join(caption_groups(images, notes, "image_id", "caption", "id"), "image_id")


def load_pair_list(spark: SparkSession, path: str, kind: str = "triples") -> DataFrame:
    """``row, image_path, target_path`` of sorted lines: ``image target focal`` with outer slashes off, or names, whose targets are PNG files of the same stem."""
    from tessella.functions.ordering import number_sorted

    lines = spark.read.text(path).where("trim(value) <> ''")
    bare = lambda c: F.regexp_replace(c, "^/+|/+$", "")
    if kind == "triples":
        part = F.split(F.trim("value"), r"\s+")
        rows = lines.select("value", bare(part[0]).alias("image_path"), bare(part[1]).alias("target_path"))
    elif kind == "names":
        stem = F.regexp_replace("value", r"\.[^./]+$", "")
        rows = lines.select("value", F.concat(F.lit("images/"), "value").alias("image_path"), F.concat(F.lit("annotations/"), stem, F.lit(".png")).alias("target_path"))
    else:
        raise ValueError(f"unknown kind: {kind}")
    return number_sorted(rows, ["value"], "row").select("row", "image_path", "target_path")


TERMINATOR = "** Block of NULs **"


def offset_entries(lines: DataFrame, file: str, line: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """``class_id, start, end, filename``: byte ranges between consecutive ``block N: name`` lines of a file, 512 bytes a block.

    A file whose last line isn't the terminator fails the query; names in ``skip`` are left out.
    """
    at = lines.select(F.col(file).alias("class_id"), F.regexp_extract(line, r"^block (\d+):", 1).cast("long").alias("block"), F.regexp_extract(line, r"^block \d+: (.*?)\s*$", 1).alias("filename"))
    order = W.partitionBy("class_id").orderBy("block", (F.col("filename") == TERMINATOR))
    nxt = at.withColumn("end", F.lead("block").over(order))
    bad = F.raise_error(F.concat(F.lit("no terminator in "), F.col("class_id"))).cast("long")
    end = F.when(F.col("end").isNull() & (F.col("filename") != TERMINATOR), bad).otherwise(F.col("end"))
    return nxt.select("class_id", (512 * F.col("block")).alias("start"), (512 * end).alias("end"), "filename").where((F.col("filename") != TERMINATOR) & ~F.coalesce(F.col("filename").isin(*skip) if skip else F.lit(False), F.lit(False)))


def load_offset_entries(spark: SparkSession, glob: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """``offset_entries`` of log files, with ``class_index`` by file name."""
    from tessella.operators.identity import dense_codes

    lines = spark.read.text(glob).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1).alias("file"), "value")
    found = offset_entries(lines, "file", "value", skip)
    return found.join(dense_codes(found.select("class_id"), "class_id").withColumnRenamed("dense", "class_index"), "class_id")


def build_entries(paths: DataFrame, path: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """Entries ``class_index, class_id, actual_index, path`` and classes ``class_index, class_id, n``, by the two groups of ``pattern``; classes are numbered by id."""
    from tessella.operators.identity import dense_codes

    own = paths.select(F.col(path).alias("path"), F.regexp_extract(path, pattern, 1).alias("class_id"), F.regexp_extract(path, pattern, 2).alias("actual_index")).where("class_id <> ''")
    codes = dense_codes(own.select("class_id"), "class_id").withColumnRenamed("dense", "class_index")
    classes = own.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).join(codes, "class_id")
    return own.join(codes, "class_id"), classes


_SOURCES: dict[str, Callable[..., DataFrame]] = {}


def source(name: str):
    """Register the decorated ``(spark, **keys) -> DataFrame`` as a dataset name."""

    def keep(f):
        _SOURCES[name] = f
        return f

    return keep


@source("Parquet")
def _parquet(spark: SparkSession, root: str, split: str | None = None, extra: str | None = None) -> DataFrame:
    """A Parquet table; ``split`` picks rows of that split, ``extra`` is a table whose columns join on those that both have."""
    df = spark.read.parquet(root)
    df = df.where(F.col("split") == split.lower()) if split else df
    if not extra:
        return df
    more = spark.read.parquet(extra)
    return df.join(more, [c for c in df.columns if c in more.columns], "left")


def read_dataset(spark: SparkSession, spec: str) -> DataFrame:
    """The dataset of ``Name:key=value:...`` with keys root, extra and split; unknown names and keys are errors.

    Names are Parquet, ClassFolder and OffsetLog, and what else ``source`` has registered.
    """
    from . import folders  # noqa: F401  it registers its kinds

    name, *rest = re.split(r":(?=(?:root|extra|split|[A-Za-z_]+)=)", spec)
    if name not in _SOURCES:
        raise ValueError(f"unknown dataset: {name}")
    keys = dict(part.split("=", 1) for part in rest)
    wrong = set(keys) - {"root", "extra", "split"}
    if wrong:
        raise ValueError(f"unknown keys: {sorted(wrong)}")
    return _SOURCES[name](spark, **keys)


def results_read(spark: SparkSession, path: str) -> DataFrame:
    """A results table by its suffix, ``.csv`` or ``.jsonl``, with columns of string, long or double."""
    if path.endswith(".csv"):
        return canonical(spark.read.option("header", "true").option("inferSchema", "true").csv(path))
    if path.endswith(".jsonl"):
        return canonical(spark.read.json(path))
    raise ValueError(f"unknown suffix: {path}")


def results_write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a results table by its suffix."""
    if path.endswith(".csv"):
        canonical(df).write.mode(mode).option("header", "true").csv(path)
    elif path.endswith(".jsonl"):
        canonical(df).write.mode(mode).json(path)
    else:
        raise ValueError(f"unknown suffix: {path}")


def results_vstack(tables: list[DataFrame]) -> DataFrame:
    """Tables below each other by column name; what one lacks is null."""
    out = canonical(tables[0])
    for t in tables[1:]:
        out = out.unionByName(canonical(t), allowMissingColumns=True)
    return out


def collection_write(tables: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Named tables as one folder each."""
    for i, (name, t) in enumerate(sorted(tables.items())):
        if not re.fullmatch(r"[A-Za-z0-9 _.-]+", name):
            raise ValueError(f"bad name of a table: {name}")
        canonical(t).write.mode(mode if i == 0 or mode != "errorifexists" else "errorifexists").parquet(f"{path}/sheet={name}")


def collection_read(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/sheet={n}") for n in names}


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def publish(df: DataFrame, path: str, mode: str = "refuse") -> None:
    """Write beside ``path`` and move it there: ``refuse`` fails if something is there, ``overwrite`` takes its place, ``resume`` leaves it.

    Readers never see half of a table.
    """
    if mode not in ("refuse", "overwrite", "resume"):
        raise ValueError(f"unknown mode: {mode}")
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    there = fs.exists(target) and len(fs.listStatus(target)) > 0
    if there and mode == "refuse":
        raise FileExistsError(path)
    if there and mode == "resume":
        return
    part = f"{path}.part"
    df.write.mode("overwrite").parquet(part)
    if fs.exists(target):
        fs.delete(target, True)
    if not fs.rename(_fs(spark, part)[1], target):
        raise OSError(f"can't move {part} to {path}")


def save_features(df: DataFrame, path: str, index: str, columns: list[str]) -> None:
    """Matrices aligned by row: an index and arrays, ordered by index within files of ranges of it."""
    df.select(index, *columns).repartitionByRange(index).sortWithinPartitions(index).write.parquet(path)


def load_features(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(df.columns[0], *columns) if columns else df


def load_tiles(rows: DataFrame, scenes: DataFrame, scene: str, split: str | None = None) -> DataFrame:
    """Tile rows of a mixed manifest with their scenes' columns: no subscenes, none without a core's origin, one split if named.

    A tile of an unknown scene fails the query; so does a manifest without tiles, which ``require_rows`` tells.
    """
    own = rows.where("coalesce(record_type, 'tile') <> 'subscene' and coalesce(sampling_region, '') <> 'subscene' and core_x is not null and core_y is not null")
    own = own.where(F.col("split") == split) if split else own
    known = scenes.withColumn("__known", F.lit(True))
    out = own.join(known, scene, "left")
    checked = F.when(F.col("__known").isNull(), F.raise_error(F.concat(F.lit("unknown scene "), F.col(scene).cast("string")))).otherwise(F.col(scene))
    return out.withColumn(scene, checked).drop("__known")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """``df``, or an error if it is empty."""
    if df.isEmpty():
        raise ValueError(f"no rows: {what}")
    return df


def materialize(want: DataFrame, have: DataFrame, key: str, build: Callable[[DataFrame], DataFrame], overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows built for wanted keys that aren't there yet (all of them to overwrite), and the index ``key, status`` of written and skipped ones."""
    there = have.select(key).distinct()
    new = want if overwrite else want.join(there, key, "left_anti")
    status = F.lit("written") if overwrite else F.when(F.col("__there"), "skipped").otherwise("written")
    index = want.select(key).distinct().join(there.withColumn("__there", F.lit(True)), key, "left").select(key, status.alias("status"))
    return build(new), index


def discover_scenes(sources: list[DataFrame], key: str) -> DataFrame:
    """Scenes of several sources in order of preference: each key's first row, with the place of its source."""
    ranked = None
    for i, s in enumerate(sources):
        one = s.withColumn("source_rank", F.lit(i))
        ranked = one if ranked is None else ranked.unionByName(one, allowMissingColumns=True)
    cols = [c for c in ranked.columns if c != key]
    best = ranked.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct("source_rank", *cols)).alias("__r"))
    return best.select(key, *[F.col(f"__r.{c}").alias(c) for c in cols])


def write_lines(df: DataFrame, value: Column) -> str:
    """The path of a text of one line a row in the shared folder."""
    path = fresh_path(df.sparkSession)
    df.select(value.cast("string")).write.text(path)
    return path
