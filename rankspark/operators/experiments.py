"""Grids of experiments, and keys under which their results are kept."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(models: DataFrame, domains: DataFrame) -> DataFrame:
    """models (task, model) with domains (domain): one row for each run. Both are lists of names, so of bounded size."""
    return models.crossJoin(domains).select("task", "model", "domain")


def grid_of(spark: SparkSession, models: dict[str, list[str]], domains: list[str]) -> DataFrame:
    rows = [(t, m) for t, names in models.items() for m in names]
    return grid(spark.createDataFrame(rows, "task string, model string"), spark.createDataFrame([(d,) for d in domains], "domain string"))


def config_key(**settings) -> str:
    """A digest of all settings, debug slices included, so no run is taken for another."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]


def debug_slice(df: DataFrame, position: str, rows: int) -> DataFrame:
    """The first rows by position: 30 documents and 10 queries make a smoke run."""
    return df.where(F.col(position) < rows)
