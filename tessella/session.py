"""Session defaults; on a cluster the submit-time configuration wins."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "tessella", cpus: int | str | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches, with adaptive execution, UTC and Arrow on."""
    n = cpus or os.environ.get("BENCH_CPUS") or "8"
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
