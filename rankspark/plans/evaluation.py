"""The whole evaluation: encode or index, search, judge, measure, summarise - all domains in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.functions import vectors
from rankspark.operators import encoders, lexical, metrics
from rankspark.operators.search import KEPT, dense, search


def dense_run(queries: DataFrame, corpus: DataFrame, model: encoders.Model, exclusions: DataFrame | None = None, k: int = KEPT) -> DataFrame:
    """Text search of (query_id, query) in (doc_id, pos, content) by a registered model."""
    docs = encoders.encode(corpus.select("doc_id", "pos", model.prepare_document(F.col("content")).alias("content")), model.encoder)
    asked = encoders.encode(queries.select("query_id", model.prepare_query(F.col("query")).alias("content")), model.encoder)
    return dense(asked.select("query_id", F.col("embedding").alias("q")), docs.select("doc_id", "pos", F.col("embedding").alias("v")), k, normalise=model.normalise, exclusions=exclusions)


def fused_run(queries: DataFrame, corpus: DataFrame, exclusions: DataFrame | None = None, k: int = KEPT, policy: str | dict[str, str] = "text", mode: str = "before", blank: list[float] | None = None, normalise: bool = True) -> DataFrame:
    """Search of texts with images: queries (query_id, text_vec, image_vec), corpus (doc_id, pos, text_vec, image_vec);
    either side's missing parts follow its policy (of one name, or by `query` and `document`); blank: the vector of a
    blank image, for that policy; a corpus of images alone has no text_vec."""
    by_side = {"query": policy, "document": policy} if isinstance(policy, str) else {"query": "text", "document": "text"} | policy
    white = F.lit([float(x) for x in blank]) if blank is not None else None

    def fuse(side: str) -> Column:
        fused = vectors.fuse_missing(F.col("text_vec"), F.col("image_vec"), by_side[side], white)
        return F.when(F.col("text_vec").isNull(), vectors.as_double(F.col("image_vec"))).otherwise(fused)

    q = queries.select("query_id", fuse("query").alias("q"))
    v = corpus.select("doc_id", "pos", fuse("document").alias("v"))
    if mode == "before":
        return dense(q, v, k, normalise=normalise, exclusions=exclusions)
    run = dense(q, v, k, normalise=normalise).drop("rank")
    return search(run, exclusions, mode, k)


def bm25_run(queries: DataFrame, corpus: DataFrame, exclusions: DataFrame | None = None, k: int = KEPT, **options) -> DataFrame:
    return lexical.bm25(queries, corpus, exclusions, k, **options)


def report(run: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = metrics.CUTOFFS, keys: list[str] | None = None, **options) -> DataFrame:
    """All metrics of each query, the reranker's ceiling included."""
    keys = keys or ["query_id"]
    plain = metrics.per_query(run, qrels, cutoffs, keys=keys, **options)
    return plain.join(metrics.oracle_per_query(run, qrels, cutoffs, keys=keys), keys)


def summary(run: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = metrics.CUTOFFS) -> DataFrame:
    """(domain, metric, k, value) of a run and judgements with a domain: means over queries, then over domains."""
    by_query = report(run, qrels, cutoffs, keys=["domain", "query_id"])
    return metrics.over_domains(metrics.long_form(metrics.mean(by_query.drop("query_id"), ["domain"]), ["domain"]))
