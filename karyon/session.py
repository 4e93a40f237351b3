"""Session settings."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str | None = None, partitions: int = 8, folder: str | None = None) -> SparkSession:
    """A local session for tests and benchmarks; ``folder`` is where intermediate tables go, should the environment set none."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder
    if folder:
        builder = builder.config("spark.checkpoint.dir", folder)
    return (
        builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
