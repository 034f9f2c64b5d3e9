"""Session defaults: a local session for tests and benches, and the shared scratch folder."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, memory: str = "8g", name: str = "tidewell") -> SparkSession:
    """A single-JVM session. A cluster brings its own; nothing in the package depends on these settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.warehouse.dir", os.path.join("/tmp", "tidewell-warehouse"))
        .getOrCreate()
    )
