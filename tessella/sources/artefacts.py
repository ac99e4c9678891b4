"""Tables that are built once for an identity: a store addressed by what the table depends on."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .manifests import fingerprint
from .tables import _fs


class Artefacts:
    """Tables in a shared folder, each in a folder of its name, version and identity.

    An identity is the fingerprint of the rows and columns that a table depends on, and its parameters: other rows, values,
    parameters or another version have another one. A table is written beside its place and moved there, so that no reader
    sees half of one; of two writers the first wins and the other reads what is there.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def identity(self, source: DataFrame, keys: list[str], parameters: dict | None = None) -> str:
        """A hexadecimal name of ``keys`` of the source's rows, in any order, and of the parameters."""
        own = fingerprint(source, keys).first()[0]
        return hashlib.sha256(json.dumps([own, keys, parameters or {}], sort_keys=True).encode()).hexdigest()[:32]

    def path(self, name: str, version: int, identity: str) -> str:
        return f"{self.root}/{name}/v{version}/{identity}"

    def get(self, name: str, version: int, identity: str) -> DataFrame | None:
        """The table, if it is whole."""
        path = self.path(name, version, identity)
        fs, done = _fs(self.spark, f"{path}/_SUCCESS")
        return self.spark.read.parquet(path) if fs.exists(done) else None

    def put(self, name: str, version: int, identity: str, df: DataFrame) -> DataFrame:
        """Writes the table, unless somebody else has by then."""
        path = self.path(name, version, identity)
        part = f"{self.root}/{name}/.part-{uuid.uuid4().hex}"
        df.write.parquet(part)
        fs, target = _fs(self.spark, path)
        if not fs.exists(target):
            fs.mkdirs(target.getParent())
            fs.rename(_fs(self.spark, part)[1], target)
        # A rename into a folder that came meanwhile would put this one inside it, or fail.
        for left in (part, f"{path}/{part.rsplit('/', 1)[1]}"):
            fs.delete(_fs(self.spark, left)[1], True)
        found = self.get(name, version, identity)
        if found is None:
            raise OSError(f"{path} isn't whole")
        return found

    def reuse(self, name: str, version: int, source: DataFrame, keys: list[str], build: Callable[[DataFrame], DataFrame], parameters: dict | None = None) -> tuple[DataFrame, bool]:
        """The table of ``build(source)`` and whether it was there already."""
        identity = self.identity(source, keys, parameters)
        found = self.get(name, version, identity)
        if found is not None:
            return found, True
        return self.put(name, version, identity, build(source)), False

    def stale(self, name: str, version: int, identity: str) -> list[str]:
        """Folders of the name that aren't of this version and identity: a listing, as many as there were builds."""
        fs, top = _fs(self.spark, f"{self.root}/{name}")
        if not fs.exists(top):
            return []
        own = self.path(name, version, identity)
        each = [s.getPath() for s in fs.listStatus(top) if not s.getPath().getName().startswith(".")]
        found = [s.getPath().toUri().getPath() for v in each for s in fs.listStatus(v)]
        return sorted(p for p in found if not own.endswith(p) and not p.endswith(own))
