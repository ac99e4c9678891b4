"""Exact duplicates by two-pass Bloom filtering, with DataFrame functions only.

Pass one sets two bits a row in a counting Bloom filter and keeps the bits that two rows or more set. Pass two probes each
row against those bits. A row with a bit that no other row set has no copy and passes straight through; only the others
(the copies, and about one single row in 72) shuffle and are grouped by the whole digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, spread_join, stash

BITS_PER_ROW = 16
#: Words of 64 bits, with their numbers 16 bytes each, up to which the filter is broadcast.
FILTER_WORDS = 1_000_000


def _slots(size: int) -> list[Column]:
    """The two bits of a digest in a filter of ``size`` bits: its first and second 60 bits."""
    return [F.pmod(F.conv(F.substring("__sha", at, 15), 16, 10).cast("long"), F.lit(size)) for at in (1, 16)]


def repeated_bits(digests: DataFrame, rows: int, bits_per_row: int = BITS_PER_ROW) -> tuple[DataFrame, int]:
    """Pass one: ``(word, bits)``, the bits that are set more than once, in words of 64; and the filter's size.

    Counts add up before they shuffle, so a text that a third of all rows hold adds one number a task.
    """
    size = max(64, rows * bits_per_row)
    bits = digests.select(F.explode(F.array(*_slots(size))).alias("bit")).groupBy("bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    mask = F.expr("shiftleft(1L, cast(bit % 64 as int))")
    return bits.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(mask).alias("bits")), size


def flag_repeated(digests: DataFrame, bits_per_row: int = BITS_PER_ROW) -> DataFrame:
    """Pass two: ``digests`` (a written table with ``__sha``) and ``__again``, false only where no other row has that digest.

    The filter is broadcast if it has at most a million words (16 MB); beyond, rows meet its words by a shuffle of their
    digests alone, and those of a word that many rows look at (a text with many copies) are dealt over partitions by id.
    """
    words, size = repeated_bits(digests, digests.count(), bits_per_row)
    words = stash(words)
    out = digests.withColumn("__again", F.lit(True))
    for i, slot in enumerate(_slots(size)):
        one = words.select(F.col("word").alias(f"__w{i}"), F.col("bits").alias(f"__b{i}"))
        out = out.withColumn("__slot", slot).withColumn(f"__w{i}", F.expr("__slot div 64"))
        out = spread_join(out, one, f"__w{i}", F.col("__id"), "left", small=FILTER_WORDS)
        out = out.withColumn("__again", F.col("__again") & F.coalesce(F.expr(f"(__b{i} & shiftleft(1L, cast(__slot % 64 as int))) <> 0"), F.lit(False)))
        out = out.drop("__slot", f"__w{i}", f"__b{i}")
    return out


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so all null and empty texts are one
    group. ``keep_id`` is the group's largest id (null only if all its ids are null); a row is kept if it has that id, or
    if it is alone. A row that occurs twice counts twice in ``group_size`` and both rows are kept, as their ids tie.
    Other columns aren't read, whatever their names.
    """
    digests = stash(docs.select(F.col(id_col).alias("__id"), F.sha2(ascii_lower(F.col(text_col)).cast("binary"), 256).alias("__sha")))
    flagged = stash(flag_repeated(digests))
    single = flagged.where("not __again").select("__id", F.col("__id").alias("__keep"), F.lit(1).cast("long").alias("__size"), "__sha")
    again = flagged.where("__again").select("__id", "__sha")
    groups = again.groupBy("__sha").agg(F.max("__id").alias("__keep"), F.count(F.lit(1)).alias("__size"))
    repeated = spread_join(again, stash(groups), "__sha", F.col("__id")).select("__id", "__keep", "__size", "__sha")
    return single.union(repeated).select(
        F.col("__id").alias("doc_id"),
        F.col("__keep").alias("keep_id"),
        F.col("__size").alias("group_size"),
        ((F.col("__size") == 1) | F.coalesce(F.col("__id") == F.col("__keep"), F.lit(False))).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, without those that ``exact_duplicates`` doesn't keep.

    Null and empty texts are one group. Of equal texts that repeat the largest id all rows of that id stay. Rows without an id
    stay if no row of their group has one. Columns may have any names. An empty table stays empty. The texts don't shuffle:
    only the ids to drop meet them.
    """
    drop = broadcast_if_small(stash(exact_duplicates(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("__drop")).distinct()))
    return docs.join(drop, docs[id_col] == drop["__drop"], "left_anti")
