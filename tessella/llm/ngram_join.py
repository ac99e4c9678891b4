"""N-gram Jaccard self-join with PartEnum signatures.

A text's set is its distinct 5-word shingles, as 64-bit hashes. Texts with the same set are one class. Sets fall into bands
whose upper size grows by the square root of two; a set also signs in the band of its largest possible partner, so a pair
always meets in one band. Sets of at most u shingles that link differ in at most k = 2u / 9. A band cuts the domain of
hashes into groups of PARTS parts, k / 2 + 1 groups and two spare ones; for each group and each choice of PARTS - 1 of its
parts, a set's signature is the hash of what it holds there. As k differences spoil at most k / 2 groups (two parts each),
two sets that link share a signature. (Signatures of nothing are left out; the spare groups make up for that.)

Bands of more than WHOLE shingles look at a fixed share of the domain that leaves about WHOLE of them, in GROUPS groups, so
that the number of signatures doesn't grow with the text: at similarity 0.8 exactly, a pair then shares none with a
probability of about 1e-8 or less, which falls steeply with more similarity. Signatures only propose; links are verified on
the whole sets.

A passage that many texts share gives them signatures in common. Where signatures bring different components together, the
sets there are put in one order of shingles, by how many fall on a shingle's slot: of two sets that link, the first fifth of
each and one more have a shingle in common. Only pairs that meet there too go on. The counts of SLOTS slots are all that
passes the driver, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, small_batches, spread_join, stash
from .graph import bucket_components
from .textbytes import U, mix, text_shingles

GROUPS, PARTS, WHOLE = 26, 3, 216
#: The bands' upper sizes, and each one's groups and share of the domain (as the largest hash that it looks at).
UPPER = np.array([int(8 * 2 ** (b / 2)) for b in range(60)], np.int64)
_GROUPS = np.where(UPPER <= 8, GROUPS, np.minimum(GROUPS, UPPER * 2 // 9 // 2 + 3))
_SHARE = np.minimum(1.0, WHOLE / UPPER)
_LAST = np.array([2**64 - 1 if s == 1 else int(s * 2**64) for s in _SHARE.tolist()], np.uint64)
#: Bits of a parity sketch, the share of the domain that it covers by band, and bands of one share in one class.
SKETCH, FOLD = 2048, 512
#: Slots in which shingles are counted to tell frequent passages from the rest; any counts give a valid order.
SLOTS = 1 << 16
_COVER = np.minimum(1.0, 1024 / UPPER)
_COVER_LAST = np.array([2**64 - 1 if s == 1 else int(s * 2**64) for s in _COVER.tolist()], np.uint64)
_CLASS = np.where(_COVER == 1, 0, np.arange(60))
_TAGS = mix(np.arange(1, 1 << 14).astype(U))
_SIGNED = pa.int64()


def band(n: np.ndarray) -> np.ndarray:
    """The first band whose upper size is n or more."""
    return np.searchsorted(UPPER, n).astype(np.int64)


def _inside(flat: np.ndarray, owner: np.ndarray, bands: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles in the share of the domain that their owner's band looks at."""
    keep = flat <= last[bands[owner]]
    return flat[keep], owner[keep]


def signatures(flat: np.ndarray, owner: np.ndarray, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, signature)`` of sets in these bands; ``flat`` are the shingles of all sets, ``owner`` their set."""
    flat, owner = _inside(flat, owner, bands, _LAST)
    n, width = len(bands), GROUPS * PARTS
    spread = mix(flat ^ _TAGS[0])
    slot = owner * width + (spread % (_GROUPS[bands] * PARTS).astype(U)[owner]).astype(np.int64)
    held = np.zeros(n * width, U)
    np.add.at(held, slot, mix(spread + _TAGS[1]))
    held = held.reshape(n, GROUPS, PARTS)
    full = np.bincount(slot, minlength=n * width).reshape(n, GROUPS, PARTS) > 0
    base = (_TAGS[2 + bands][:, None] ^ _TAGS[100 : 100 + GROUPS][None, :]).astype(U)
    ids, found = [], []
    for left_out in range(PARTS):
        own = [p for p in range(PARTS) if p != left_out]
        value = base ^ _TAGS[200 + left_out]
        for p in own:
            value = mix(value * U(0x9E3779B97F4A7C15) + held[:, :, p])
        some = full[:, :, own].any(2)
        ids.append(np.nonzero(some)[0])
        found.append(value[some])
    return np.concatenate(ids), np.concatenate(found)


def sketches(flat: np.ndarray, owner: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """A parity sketch of each set: bit i tells whether an odd number of its shingles fall on i. One row of words a set."""
    flat, owner = _inside(flat, owner, bands, _COVER_LAST)
    bit = (mix(flat ^ _TAGS[3]) % U(SKETCH)).astype(np.int64)
    odd = (np.bincount(owner * SKETCH + bit, minlength=len(bands) * SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(bands), SKETCH), axis=1).view(np.int64)


def _keys(flat: np.ndarray, owner: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each whole set."""
    key = np.zeros(len(n), U)
    np.add.at(key, owner, mix(flat + _TAGS[4]))
    return mix(key ^ mix(n.astype(U)))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, sets in text_shingles(batch.column(1)):
            n = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets) if len(sets) else np.zeros(0, U)
            owner = np.repeat(np.arange(len(sets)), n)
            key = _keys(flat, owner, n)
            low, high = band(n), band(n * 5 // 4)
            two = np.flatnonzero(low != high)
            of, sig = signatures(flat, owner, low)
            of2, sig2 = _of(flat, owner, two, high, signatures)
            of, sig = np.concatenate((of, two[of2])), np.concatenate((sig, sig2))
            order = np.argsort(of, kind="stable")
            cut = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(sets)))))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)), pa.array(n, _SIGNED), pa.array(key.view(np.int64), _SIGNED), _lists(sig[order].view(np.int64), cut)], ["__id", "n", "key", "sigs"])


def _of(flat: np.ndarray, owner: np.ndarray, some: np.ndarray, bands: np.ndarray, f):
    """``f`` for some of the sets, in these bands."""
    own = np.isin(owner, some)
    return f(flat[own], np.searchsorted(some, owner[own]), bands[some])


def _lists(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values, _SIGNED))


def _words(rows: np.ndarray) -> pa.Array:
    return _lists(np.ascontiguousarray(rows).reshape(-1), np.arange(len(rows) + 1) * rows.shape[1])


def _most_bits(n: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """Differing bits of folded sketches that ``_close`` allows, where sketches cover a share of the domain."""
    bits = FOLD / 2 * (1 - np.exp(n / 4 * _COVER[bands] * (-2.0 / FOLD)))
    return np.ceil(bits + 6 * np.sqrt(bits)).astype(np.int64)


def _traits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and sketch of each set, in its band's class and, if another, in that of its largest possible partner."""
    for batch in batches:
        for row, sets in text_shingles(batch.column(1)):
            n = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets) if len(sets) else np.zeros(0, U)
            owner = np.repeat(np.arange(len(sets)), n)
            own = batch.column(0).slice(row, len(sets))
            right = _keys(flat, owner, n).view(np.int64) == own.to_numpy()
            low, high = band(n), band(n * 5 // 4)
            for bands, some in ((low, np.flatnonzero(right)), (high, np.flatnonzero(right & (_CLASS[low] != _CLASS[high])))):
                if len(some):
                    words = _of(flat, owner, some, bands, sketches)
                    fold = np.bitwise_xor.reduce(words.reshape(len(some), SKETCH // FOLD, FOLD // 64), axis=1)
                    parts = [pa.array(n[some], _SIGNED), pa.array(_CLASS[bands[some]].astype(np.int32)), pa.array(_most_bits(n[some], bands[some]), _SIGNED), _words(words), _words(fold)]
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(some)), pa.StructArray.from_arrays(parts, ["n", "class", "most", "sketch", "fold"])], ["id", "trait"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole sets of texts whose set has this key (an id may stand for several texts)."""
    for batch in batches:
        for row, sets in text_shingles(batch.column(1)):
            n = np.array([len(s) for s in sets], np.int64)
            cut = np.concatenate(([0], np.cumsum(n)))
            flat = np.concatenate(sets) if sets else np.zeros(0, U)
            own = batch.column(0).slice(row, len(sets))
            right = pa.array(_keys(flat, np.repeat(np.arange(len(sets)), n), n).view(np.int64) == own.to_numpy())
            yield pa.RecordBatch.from_arrays([own.filter(right), _lists(flat.view(np.int64), cut).filter(right)], ["key", "shingles"])


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of a task's sets fall on each slot."""
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for _, sets in text_shingles(batch.column(1)):
            if sets:
                counts += np.bincount(_slot(np.concatenate(sets)), minlength=SLOTS)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["slot", "m"])


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles % U(SLOTS)).astype(np.int64)


def _rarest(counts: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first fifth of each set and one more, in the order of their slots' counts, then of the shingles."""
    for batch in batches:
        for row, sets in text_shingles(batch.column(1)):
            n = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets) if sets else np.zeros(0, U)
            owner = np.repeat(np.arange(len(sets)), n)
            own = batch.column(0).slice(row, len(sets)).to_numpy()
            right = _keys(flat, owner, n).view(np.int64) == own
            flat = flat[np.lexsort((flat, counts[_slot(flat)], owner))]
            rank = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            early = (rank <= n[owner] // 5) & right[owner]
            yield pa.RecordBatch.from_arrays([pa.array(own[owner[early]]), pa.array(flat[early].view(np.int64))], ["id", "bucket"])


def _near(x: str, y: str) -> Column:
    """Sizes allow the similarity, and the sketches don't rule it out.

    Sets that may link differ in at most (|A| + |B|) / 9 shingles, and sketches of whole sets in no more bits than that.
    Where sketches cover a share of the domain, the expected number of differing bits has six standard deviations added.
    """
    a, b = (lambda f: F.col(f"{x}.{f}")), (lambda f: F.col(f"{y}.{f}"))
    sizes = (a("class") == b("class")) & (a("n") * 100 >= b("n") * 80) & (b("n") * 100 >= a("n") * 80)
    apart = sum((F.bit_count(F.get(a("sketch"), F.lit(i)).bitwiseXOR(F.get(b("sketch"), F.lit(i)))) for i in range(SKETCH // 64)), F.lit(0))
    most = (a("n") + b("n")) / 9.0
    share = 1024.0 / F.floor(8 * F.pow(F.lit(2.0), a("class") / 2))
    bits = SKETCH / 2 * (1 - F.exp(most * share * (-2.0 / SKETCH)))
    return sizes & (apart <= F.when(a("class") == 0, most).otherwise(bits + 6 * F.sqrt(bits)))


def _close(x: str, y: str) -> Column:
    """A cheap condition that pairs meet which ``_near`` lets through: sizes, and sketches folded to FOLD bits.

    A partner of a set of n has at most 5n / 4 shingles, so the two differ in at most n / 4.
    """
    a, b = (lambda f: F.col(f"{x}.{f}")), (lambda f: F.col(f"{y}.{f}"))
    sizes = (a("class") == b("class")) & (a("n") * 100 >= b("n") * 80) & (b("n") * 100 >= a("n") * 80)
    apart = sum((F.bit_count(F.get(a("fold"), F.lit(i)).bitwiseXOR(F.get(b("fold"), F.lit(i)))) for i in range(FOLD // 64)), F.lit(0))
    return sizes & (apart * 9 <= F.when(a("class") == 0, a("n") + b("n")).otherwise(9 * F.greatest(a("most"), b("most"))))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, n_class``: one row per row of ``docs``.

    A-Z is lower-cased; words stand between spaces, tabs and line ends. Two texts link when 100 * intersection >=
    80 * union of their sets. ``component_id`` is the smallest id that links reach, the row's own included. Null, empty and
    blank texts have an empty set and link with nothing, equal ones included; a text of one to four words is one shingle.
    Rows without an id keep their ``n_shingles``, have no component and join no others. ``n_class`` counts the rows with
    this very set. Repeated rows are repeated in the result. Other columns aren't read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    signed = stash(rows.mapInArrow(_sign, f"__id {dict(rows.dtypes)['__id']}, n long, key long, sigs array<long>"))
    plain = signed.select("__id", "n", "key")
    live = signed.where("n > 0 and __id is not null")
    classes = live.groupBy("key").agg(F.min("__id").alias("first"), F.count(F.lit(1)).alias("n_class"))
    classes = stash(classes)
    # The signatures of one row of each class; rows meet their class by its first id.
    firsts = classes.select("key", F.col("first").alias("__id"))
    one = stash(spread_join(live, firsts.withColumnRenamed("__id", "first"), "key", F.col("__id")).where(F.col("__id") == F.col("first")).drop("first", "__id").dropDuplicates(["key"]))
    members = one.select(F.col("key").alias("id"), F.explode("sigs").alias("bucket"))
    repeated = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket")
    members = stash(spread_join(members, stash(repeated), "bucket", F.col("id"), small=1_000_000))

    def texts(keys: DataFrame) -> DataFrame:
        """The texts of these classes' first rows."""
        return rows.join(broadcast_if_small(stash(keys.distinct().join(firsts, "key"))), "__id").select("key", "__text")

    shared = members.select(F.col("id").alias("key"))
    traits = stash(texts(shared).mapInArrow(_traits, "id long, trait struct<n: long, class: int, most: long, sketch: array<long>, fold: array<long>>").select("id", "trait", "trait.class").dropDuplicates(["id", "class"]).drop("class"))

    def verify(pairs: DataFrame) -> DataFrame:
        sets = stash(texts(pairs.select(F.explode(F.array("a", "b")).alias("key"))).mapInArrow(_sets, "key long, shingles array<long>").dropDuplicates(["key"]))
        a = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
        b = sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
        both = spread_join(pairs.join(b, "b"), a, "a", F.col("b"), counted=pairs, small=0)
        common = F.size(F.array_intersect("x", "y"))
        return both.where(100 * common >= 80 * (F.size("x") + F.size("y") - common)).select("a", "b")

    def rare_first(ids: DataFrame) -> DataFrame:
        """Of each of these sets, those of its ``n / 5 + 1`` rarest shingles that another of them has among its own."""
        own = stash(texts(ids.select(F.col("id").alias("key"))))
        slots = own.mapInArrow(_slot_counts, "slot int, m long").groupBy("slot").agg(F.sum("m").alias("m")).toArrow()
        counts = np.zeros(SLOTS, np.int64)
        counts[slots["slot"].to_numpy()] = slots["m"].to_numpy()
        early = stash(own.mapInArrow(partial(_rarest, counts), "id long, bucket long").distinct())
        often = stash(early.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket"))
        return spread_join(early, often, "bucket", F.col("id"), small=1_000_000)

    size = F.floor(F.log(F.col("trait.n")) / F.log(F.lit(1.25)))
    comps = bucket_components(members, traits, _near, verify, size, finer=rare_first, coarse=(F.struct("trait.n", "trait.class", "trait.most", "trait.fold"), _close))
    comps = stash(spread_join(comps, firsts.select(F.col("key").alias("id"), F.col("__id").alias("first")), "id", F.col("comp")))
    least = stash(comps.groupBy("comp").agg(F.min("first").alias("least")))
    linked = spread_join(comps, least, "comp", F.col("id")).select(F.col("id").alias("key"), "least")
    final = stash(classes.join(linked, "key", "left").select("key", F.coalesce("least", "first").alias("component_id"), "n_class"))
    out = spread_join(plain.where("n > 0 and __id is not null"), final, "key", F.col("__id"))
    out = out.select(F.col("__id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "n_class")
    alone = plain.where("n = 0 or __id is null").select(F.col("__id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("__id").alias("component_id"), F.lit(1).cast("long").alias("n_class"))
    return out.union(alone)


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, of the smallest id of each component.

    Null, empty and wordless texts link with nothing and stay, as do rows without an id; rows that repeat the smallest id all
    stay. Columns may have any names. An empty table stays empty.
    """
    found = jaccard_components(docs, id_col, text_col)
    drop = broadcast_if_small(stash(found.where("component_id <> doc_id").select(F.col("doc_id").alias("__drop")).distinct()))
    return docs.join(drop, docs[id_col] == drop["__drop"], "left_anti")
