"""Class folders as a Spark data source: ``spark.read.format("class_folder").load(root)``.

``root/split/class/file`` gives a row a file. A folder of a class is a partition; a filter on ``split`` or ``class_id`` picks
folders before any is listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .tables import load_offset_entries, source

SCHEMA = "split string, class_id string, name string, path string, length long"
#: Rows of a batch that a reader hands on.
BATCH = 10_000


def _system(root: str):
    """The file system of a path or address, and the path in it."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    return FileSystem.from_uri(root) if "://" in root else (LocalFileSystem(), root)


def _folders(fs, path: str) -> list[str]:
    from pyarrow.fs import FileSelector, FileType

    return sorted(i.base_name for i in fs.get_file_info(FileSelector(path)) if i.type == FileType.Directory and not i.base_name.startswith((".", "_")))


class _ClassFolder(InputPartition):
    def __init__(self, split: str | None, class_id: str | None):
        self.split, self.class_id = split, class_id


class ClassFolderReader(DataSourceReader):
    def __init__(self, root: str, suffixes: list[str]):
        self.root, self.suffixes = root.rstrip("/"), suffixes
        self.only: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes equality and lists of splits and classes; Spark applies the others."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else ""
            if name in ("split", "class_id"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[name] = self.only.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = _system(self.root)
        wanted = lambda name, found: [x for x in found if name not in self.only or x in self.only[name]]
        out = [_ClassFolder(s, c) for s in wanted("split", _folders(fs, root)) for c in wanted("class_id", _folders(fs, f"{root}/{s}"))]
        return out or [_ClassFolder(None, None)]

    def read(self, partition: _ClassFolder) -> Iterator[pa.RecordBatch]:
        if partition.split is None:
            return
        from pyarrow.fs import FileSelector, FileType

        fs, root = _system(self.root)
        found = fs.get_file_info(FileSelector(f"{root}/{partition.split}/{partition.class_id}"))
        files = sorted((i for i in found if i.type == FileType.File and not i.base_name.startswith((".", "_")) and (not self.suffixes or i.extension.lower() in self.suffixes)), key=lambda i: i.base_name)
        for at in range(0, len(files), BATCH):
            own = files[at : at + BATCH]
            names = pa.schema([("split", pa.string()), ("class_id", pa.string()), ("name", pa.string()), ("path", pa.string()), ("length", pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array([partition.split] * len(own)), pa.array([partition.class_id] * len(own)), pa.array([i.base_name for i in own]), pa.array([i.path for i in own]), pa.array([i.size for i in own], pa.int64())], schema=names)


class ClassFolderSource(DataSource):
    """Options: ``path``, and ``suffixes`` separated by commas (all without)."""

    @classmethod
    def name(cls) -> str:
        return "class_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ClassFolderReader:
        suffixes = [s.strip().lower().lstrip(".") for s in self.options.get("suffixes", "").split(",") if s.strip()]
        return ClassFolderReader(self.options["path"], suffixes)


def read_class_folder(spark: SparkSession, root: str, suffixes: str = "") -> DataFrame:
    """The files of a class folder; filters on split and class are pushed into the listing."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ClassFolderSource)
    return spark.read.format("class_folder").option("suffixes", suffixes).load(root)


@source("ClassFolder")
def _class_folder(spark: SparkSession, root: str, split: str | None = None, extra: str | None = None) -> DataFrame:
    """Files by split and class; ``extra`` names suffixes."""
    df = read_class_folder(spark, root, extra or "")
    return df.where(df["split"] == split) if split else df


@source("OffsetLog")
def _offset_log(spark: SparkSession, root: str, split: str | None = None, extra: str | None = None) -> DataFrame:
    """Entries of the logs that ``root`` names; ``split`` picks one class, ``extra`` is a name to skip."""
    found = load_offset_entries(spark, root, (extra,) if extra else ())
    return found.where(found["class_id"] == split) if split else found
