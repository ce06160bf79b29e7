"""All queries of the engine by name, and the same results as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.operators import metrics
from rankspark.plans import queries_scalars, queries_search, queries_sources
from rankspark.plans import tables as t


def dense_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source, scoring, exclusion, top k, judging and NDCG@10 of each query."""
    run = queries_search._dense(spark, sf_dir, queries_search.K, t.exclusions(spark, sf_dir))
    found = metrics.per_query(run, t.vector_qrels(spark, sf_dir).select("query_id", "doc_id", "rel"), (10,))
    return found.select("query_id", F.round("NDCG@10", 6).alias("ndcg10"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"dense_ndcg": dense_ndcg} | queries_sources.QUERIES | queries_search.QUERIES | queries_scalars.QUERIES
ORACLES: dict[str, str] = {"dense_ndcg": f"{queries_search._M} SELECT query_id, round(ndcg10, 6) AS ndcg10 FROM m"} | queries_sources.ORACLES | queries_search.ORACLES | queries_scalars.ORACLES
