"""Live metric series: smoothed values, best values so far, and first-seen ingestion, as Structured Streaming.

Each key's rows are taken in order of time and id within a micro-batch, and micro-batches in order of arrival. A stream run
over the same rows gives what the batch operators give.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tessella.sources.shared import fresh_path

WINDOW = 20
SMOOTHED = "run_id long, name string, step long, median double, mean double, high double, last double, global_mean double"
BEST = "run_id long, name string, step long, value double"


def read_tables(spark: SparkSession, folder: str, glob: str, schema: StructType, files: int | None = None) -> DataFrame:
    """A stream of the Parquet files of ``folder`` whose names fit ``glob``, ``files`` at most in one micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def _ordered(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(["ts", "event_id"])


def _smooth(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, count, total = ([], 0, 0.0) if not state.exists else (list(state.get[0]), state.get[1], state.get[2])
    out = []
    for value in _ordered(parts)["value"].tolist():
        last = [*last, value][-WINDOW:]
        count, total = count + 1, total + value
        ordered = sorted(last)
        out.append((*key, count, ordered[(len(ordered) - 1) // 2], sum(last) / len(last), ordered[-1], value, total / count))
    state.update((last, count, total))
    yield pd.DataFrame(out, columns=["run_id", "name", "step", "median", "mean", "high", "last", "global_mean"])


def smooth_stream(events: DataFrame) -> DataFrame:
    """Of each run and name: lower median, mean and maximum of the last 20 values, the last one, and the mean of all so far.

    ``events(run_id, name, ts, event_id, value)``; state is 20 values, a count and a sum a key.
    """
    return events.groupBy("run_id", "name").applyInPandasWithState(_smooth, SMOOTHED, "last array<double>, count long, total double", "append", GroupStateTimeout.NoTimeout)


def _best(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    best, count = (None, 0) if not state.exists else (state.get[0], state.get[1])
    out = []
    for value in _ordered(parts)["value"].tolist():
        count += 1
        if best is None or value > best:
            best = value
            out.append((*key, count, value))
    state.update((best, count))
    yield pd.DataFrame(out, columns=["run_id", "name", "step", "value"])


def best_stream(events: DataFrame) -> DataFrame:
    """Rows of each run and name that are better than all before; ties keep the earlier."""
    return events.groupBy("run_id", "name").applyInPandasWithState(_best, BEST, "best double, count long", "append", GroupStateTimeout.NoTimeout)


def ingest_stream(rows: DataFrame, key: list[str], time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each key's first row. With ``time`` keys are forgotten ``delay`` after it, so that state doesn't grow without end."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(key) if time else rows.dropDuplicates(key)


def run_available(stream: DataFrame) -> DataFrame:
    """All that the stream has now, written in the shared folder and read again; the stream's progress is kept there too."""
    spark = stream.sparkSession
    out, progress = fresh_path(spark), fresh_path(spark)
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", progress).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
