"""Relevance judgements (query_id, doc_id, rel) for the four kinds of task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.functions import text as T


def from_lists(queries: DataFrame, column: str = "gold_ids") -> DataFrame:
    """A row for each listed id, in the corpus or not."""
    rows = queries.select("query_id", F.explode(F.col(column).cast("array<string>")).alias("doc_id"))
    return rows.distinct().withColumn("rel", F.lit(1))


def for_images(queries: DataFrame) -> DataFrame:
    """Positive images; of a query without any, its gold ids."""
    chosen = F.when(F.size("positive_images") > 0, F.col("positive_images")).otherwise(F.col("gold_ids"))
    return from_lists(queries.select("query_id", chosen.alias("_ids")), "_ids")


def for_pairs(gold: DataFrame, pair_docs: DataFrame) -> DataFrame:
    """gold (query_id, doc_id), pair_docs (doc_id): all pairs of a gold base id, and the id itself where it is a document."""
    pairs = pair_docs.select("doc_id", T.pair_base(F.col("doc_id")).alias("base_id"))
    wanted = gold.select("query_id", F.col("doc_id").alias("base_id"))
    derived = wanted.join(pairs, "base_id").select("query_id", "doc_id")
    direct = gold.select("query_id", "doc_id").join(pair_docs.select("doc_id").distinct(), "doc_id", "left_semi").select("query_id", "doc_id")
    return derived.unionByName(direct).distinct().withColumn("rel", F.lit(1))


def gold_coverage(gold: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, n_gold, n_found): how many gold ids are documents."""
    there = corpus.select("doc_id").distinct().withColumn("_there", F.lit(1))
    rows = gold.select("query_id", "doc_id").distinct().join(there, "doc_id", "left")
    return rows.groupBy("query_id").agg(F.count("*").alias("n_gold"), F.count("_there").alias("n_found"))
