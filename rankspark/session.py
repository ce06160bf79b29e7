"""The session the engine is tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Adaptive execution splits skewed joins and merges small partitions; Arrow batches bound what Python holds at a time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(app: str = "rankspark", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with SETTINGS; on a cluster, master and the number of partitions come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", os.environ.get("RANKSPARK_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
