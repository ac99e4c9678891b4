"""Quality classifier: regularised quadratic discriminant over transformed statistics of whole texts.

Statistics are counts on the texts' bytes and words, turned into logarithms and log-odds. Each class has a mean and a
covariance, shrunk towards its diagonal and the pooled covariance; a score is the logistic of the difference of the two
Mahalanobis log-densities plus the log prior odds, by each class's cached Cholesky factor. Spark sums the moments of all
labelled rows; only d + d * d numbers a class and task reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stash
from .textbytes import LOWER, NOT_SPACE, chunks, columns, hash_runs, words

#: Byte classes: lower, upper, digit, space, line end, sentence mark, inner mark, other ASCII mark, non-ASCII lead, rest.
_CLASS = np.full(256, 9, np.uint8)
_CLASS[33:127], _CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 7, 0, 1, 2
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10], _CLASS[192:] = 3, 4, 8
_CLASS[[ord(c) for c in ".?"]] = 5
_CLASS[[ord(c) for c in ",;:'-()\""]] = 6
PRIOR = 25.0
NAMES = ("log_words", "upper", "digit", "line", "sentence", "inner", "mark", "other", "word_length", "word_spread", "distinct", "again", "short")


def _odds(part: np.ndarray, whole: np.ndarray, usual: float) -> np.ndarray:
    """Log-odds of a share, with PRIOR imagined cases of the usual share: a short text says little and stays near it."""
    return np.log((part + PRIOR * usual) / (np.maximum(whole - part, 0) + PRIOR * (1 - usual)))


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of statistics a document, in the order of NAMES; finite for empty texts too."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    c = np.bincount(owner * 10 + _CLASS[data], minlength=n * 10).reshape(n, 10).astype(float)
    letters = c[:, 0] + c[:, 1] + c[:, 8]
    starts, ends, first = words(data, at, NOT_SPACE)
    count = np.diff(first).astype(float)
    own = np.repeat(np.arange(n), np.diff(first))
    length = (ends - starts).astype(float)
    mean = np.bincount(own, length, n) / np.maximum(count, 1)
    spread = np.sqrt(np.maximum(np.bincount(own, length**2, n) / np.maximum(count, 1) - mean**2, 0))
    hashes = hash_runs(LOWER[data], starts, ends)
    distinct = np.fromiter((len(np.unique(hashes[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)), float, n)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])
    again = np.bincount(own, same, n)
    short = np.bincount(own, length <= 2, n)
    marks = c[:, 5] + c[:, 6] + c[:, 7]
    return np.column_stack(
        [
            np.log(count + PRIOR),
            _odds(c[:, 1], letters, 0.03),
            _odds(c[:, 2], letters + c[:, 2], 0.01),
            _odds(c[:, 4], count, 0.02),
            _odds(c[:, 5], count, 0.1),
            _odds(c[:, 6], count, 0.06),
            _odds(c[:, 7], letters + marks, 0.005),
            _odds(c[:, 8], letters, 0.03),
            np.log((mean * count + PRIOR * 5.5) / (count + PRIOR)),
            np.log((spread * count + PRIOR * 3.0) / (count + PRIOR)),
            _odds(distinct, count, 0.8),
            _odds(again, count, 0.01),
            _odds(short, count, 0.2),
        ]
    )


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``__id, __x``: an array of statistics for each row of ``docs``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = columns(batch.column(1))
            for i, j in chunks(at):
                x = statistics(data[at[i] : at[j]], at[i : j + 1] - at[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))], ["__id", "__x"])

    return rows.mapInArrow(measure, f"__id {dict(rows.dtypes)['__id']}, __x array<double>")


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors, log-determinants and log-priors of classes 0 and 1."""

    means: np.ndarray
    whiten: np.ndarray
    constant: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row."""
        z = [self.constant[k] - 0.5 * np.square((x - self.means[k]) @ self.whiten[k].T).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(z[1] - z[0], -50, 50)))


def fit(rows: DataFrame, shrink: float = 0.1, pool: float = 0.1) -> Discriminant:
    """A discriminant from ``rows(__x, y)``, all of them. A class without rows takes the pooled moments."""
    d = len(NAMES)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                y = batch.column(1).to_numpy(zero_copy_only=False)
                for k in (0, 1):
                    own = x[y == k]
                    n[k] += len(own)
                    s[k] += own.sum(0)
                    q[k] += own.T @ own
        for k in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n[k]]), pa.array([np.concatenate((s[k], q[k].reshape(-1))).tolist()])], ["y", "n", "m"])

    parts = rows.select("__x", "y").mapInArrow(moments, "y int, n double, m array<double>").where("n > 0")
    added = parts.select("y", "n", F.posexplode("m").alias("i", "v")).groupBy("y", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).orderBy("y", "i").collect()
    n, m = np.zeros(2), np.zeros((2, d + d * d))
    for r in added:
        n[r.y], m[r.y, r.i] = r.n, r.v
    if not n.sum():
        n, m[:, d:] = np.ones(2), np.eye(d).reshape(-1)
    means, covs = [], []
    whole = m.sum(0) / n.sum()
    all_cov = whole[d:].reshape(d, d) - np.outer(whole[:d], whole[:d])
    for k in (0, 1):
        own = m[k] / n[k] if n[k] else whole
        means.append(own[:d])
        covs.append(own[d:].reshape(d, d) - np.outer(own[:d], own[:d]) if n[k] > 1 else all_cov)
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / n.sum()
    whiten, constant = [], []
    for k in (0, 1):
        cov = (1 - pool) * covs[k] + pool * pooled
        cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + 1e-3 * np.eye(d)
        low = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(low))
        constant.append(np.log(max(n[k], 0.5) / n.sum()) - np.log(np.diag(low)).sum())
    return Discriminant(np.array(means), np.array(whiten), np.array(constant))


def held_out(id_col: Column) -> Column:
    """The fifth of ids whose crc32 is divisible by five; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", least: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Learns from the labelled rows that aren't held out, all of them; labels other than 0 and 1 are left out, an id with
    several labels takes its least. Null and empty texts have finite statistics and a score. Repeated rows are scored each;
    for learning an id counts once a row. Labels, ids and other columns are no inputs of the score.
    """
    x = stash(with_statistics(docs, id_col, text_col))
    y = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.min(label).cast("int").alias("y"))
    model = fit(x.where(~held_out(F.col("__id"))).join(y, "__id"))
    return x.mapInArrow(_scores(model), f"__id {dict(x.dtypes)['__id']}, score double").select(F.col("__id").alias("doc_id"), held_out(F.col("__id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def _scores(model: Discriminant):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["__id", "score"])

    return score


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", least: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns as they are, with a score of ``least`` or more; texts don't shuffle.

    Null and empty texts are scored like any other, repeated rows share their verdict, null ids are carried; ids take no part
    but in the choice of rows to learn from. An empty table stays empty; without labels the priors decide.
    """
    x = with_statistics(docs, id_col, text_col)
    y = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.min(label).cast("int").alias("y"))
    # Learning needs the statistics of labelled rows alone; scoring measures each text where it lies.
    model = fit(stash(x.where(~held_out(F.col("__id"))).join(y, "__id").select("__x", "y")))
    text_at = docs.columns.index(text_col)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = columns(batch.column(text_at))
            keep = np.ones(batch.num_rows, bool)
            for i, j in chunks(at):
                keep[i:j] = model.score(statistics(data[at[i] : at[j]], at[i : j + 1] - at[i])) >= least
            yield batch.filter(pa.array(keep))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(good, docs.schema)
