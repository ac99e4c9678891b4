"""Seeds and orders from hashes, so that random choice doesn't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_order(seed: object, *ids: str | Column) -> Column:
    """A hexadecimal string to order rows by: sha256 of ``seed:id[:id]``."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") if isinstance(i, str) else i.cast("string") for i in ids]), 256)


def derive_seed(seed: object, *ids: str | Column, modulus: int = 2**31) -> Column:
    """An integer below ``modulus`` from the first 60 bits of the hash."""
    return F.conv(F.substring(hash_order(seed, *ids), 1, 15), 16, 10).cast("long") % modulus
