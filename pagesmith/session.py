"""Session helpers for tests, bench and jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def get_spark(cores: str = "8", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pagesmith")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A folder all executors see: the one of spark.checkpoint.dir, a new one on a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="pagesmith-"))
    return _local[0]
