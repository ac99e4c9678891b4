"""Vectorised word and shingle hashing of Arrow text columns, on their UTF-8 bytes.

All memory is bounded by the chunk of documents at hand (``CHUNK`` bytes, or one document if it is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
SLICE = 1 << 20
U = np.uint64
_M1, _M2, _G = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
_STEP = U(0xD1342543DE82EF95)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are what stands between spaces, tabs and line ends.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
#: Words are runs of letters and digits; every byte outside ASCII counts as a letter.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= _M1
    x ^= x >> U(27)
    x *= _M2
    x ^= x >> U(31)
    return x


#: What is left of a lane of eight bytes of which only the first 0 to 8 belong to a run.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
_PLACE = mix(np.arange(1, 257).astype(U) * _G)


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = mix(np.arange(1, 1 + (1 << (n - 1).bit_length())).astype(U) * _G)
    return _PLACE


def _lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs cut into lanes of eight bytes, zeros behind the end: each lane's value and place in its run, and each run's first lane."""
    lens = ends - starts
    count = (lens + 7) >> 3
    first = np.cumsum(count) - count
    place = np.arange(int(count.sum())) - np.repeat(first, count)
    padded = np.concatenate((data[starts[0] : ends[-1]], np.zeros(8, np.uint8)))
    every = np.ndarray(len(padded) - 7, np.dtype("<u8"), padded, 0, (1,))
    value = every[np.repeat(starts - starts[0], count) + 8 * place]
    value &= _MASK[np.minimum(np.repeat(lens, count) - 8 * place, 8)]
    return value, place, first


def _slices(lens: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of runs of about SLICE bytes in all, one run at least."""
    total = np.concatenate(([0], np.cumsum(lens)))
    i = 0
    while i < len(lens):
        j = max(i + 1, int(np.searchsorted(total, total[i] + SLICE, "right")) - 1)
        yield i, j
        i = j


def columns(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def chunks(at: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes, one document at least."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (bytes that ``table`` marks; none crosses a document) and each document's first word."""
    inside = table[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < len(data))]
    start[edge] = inside[edge]
    end[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, at)


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run; runs are in order and don't overlap.

    Each lane is mixed with its place before lanes add up, so no pattern of bytes cancels out as in a polynomial.
    """
    out = np.empty(len(starts), U)
    lens = ends - starts
    for i, j in _slices(lens):
        value, place, first = _lanes(data, starts[i:j], ends[i:j])
        value ^= _places(int(place.max()) + 1)[place]
        out[i:j] = np.add.reduceat(mix(value), first)
    return mix(out + lens.astype(U) * _G)


def same_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each run has the very bytes of the run whose number ``other`` gives."""
    lens = ends - starts
    same = lens == lens[other]
    if not len(starts):
        return same
    value, place, first = _lanes(data, starts, ends)
    count = np.where(same, (lens + 7) >> 3, 0)
    run = np.repeat(np.arange(len(starts)), count)
    at = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    differ = value[first[run] + at] != value[first[other[run]] + at]
    same[run[differ]] = False
    return same


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """Each document's distinct shingles of ``width`` words, sorted; the whole sequence is one where words are fewer."""
    n = len(hashes)
    rolled = np.zeros(max(0, n - width + 1), U)
    for k in range(width if len(rolled) else 0):
        rolled *= _STEP
        rolled += hashes[k : n - width + 1 + k]
    rolled = mix(rolled + U(width))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            one = U(0)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    one = one * _STEP + h
                yield mix(np.array([one + U(b - a)]))
        else:
            yield np.zeros(0, U)


def text_shingles(col: pa.Array | pa.ChunkedArray, table: np.ndarray = NOT_SPACE, width: int = 5) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each chunk of documents: the first one's row, and each one's sorted distinct shingle hashes (A-Z lower-cased)."""
    data, at = columns(col)
    for i, j in chunks(at):
        own = LOWER[data[at[i] : at[j]]]
        starts, ends, first = words(own, at[i : j + 1] - at[i], table)
        yield i, list(shingles(hash_runs(own, starts, ends), first, width))
