"""Ranking metrics of a run against judgements.

Ranks follow the evaluator's order: score as a 32-bit float descending, then document id descending (`trec`), or score
descending, then position (`pos`). Precision divides by k; recall, average precision and the ideal gain use all judged
documents, in the corpus or not; the reciprocal rank has no cutoff. A query without relevant documents counts as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS = (1, 5, 10, 25, 50, 100)
ORACLE_DEPTH = 100


def _gain(rank: Column) -> Column:
    return F.log(F.lit(2.0)) / F.log(rank + F.lit(1.0))


def rank_order(tie: str) -> list[Column]:
    if tie == "trec":
        return [F.desc(F.col("score").cast("float")), F.desc("doc_id")]
    if tie == "pos":
        return [F.desc("score"), F.asc("pos")]
    raise ValueError(f"unknown tie {tie}")


def judged(run: DataFrame, qrels: DataFrame, tie: str = "trec", keys: list[str] | None = None) -> DataFrame:
    """run with rel (0 where a document isn't judged) and the evaluator's rank `r`."""
    keys = keys or ["query_id"]
    rows = run.join(qrels.select(*keys, "doc_id", "rel"), [*keys, "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*rank_order(tie))).cast("long"))


def relevant_counts(qrels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["query_id"]
    return qrels.where("rel > 0").groupBy(*keys).agg(F.count("*").alias("n_rel"))


def ideal_gain(n_rel: Column, k: int) -> Column:
    top = F.least(n_rel, F.lit(k).cast("long"))
    return F.when(top > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(top, F.lit(1).cast("long"))), F.lit(0.0), lambda a, i: a + _gain(i)))


def per_query(run: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS, tie: str = "trec", keys: list[str] | None = None, skip_unjudged: bool = False) -> DataFrame:
    """A row for each query of the run: NDCG@k, MAP@k, Recall@k, P@k and MRR.

    One window and one aggregation serve all cutoffs. skip_unjudged leaves out queries that have no judgement.
    """
    keys = keys or ["query_id"]
    rows = judged(run, qrels, tie, keys)
    so_far = Window.partitionBy(*keys).orderBy(*rank_order(tie)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_hits", F.sum("rel").over(so_far))
    rel = F.col("rel").cast("double")
    sums = []
    for k in cutoffs:
        inside = F.col("r") <= k
        sums += [
            F.sum(F.when(inside, rel * _gain(F.col("r"))).otherwise(0.0)).alias(f"_dcg{k}"),
            F.sum(F.when(inside, rel * F.col("_hits") / F.col("r")).otherwise(0.0)).alias(f"_ap{k}"),
            F.sum(F.when(inside, rel).otherwise(0.0)).alias(f"_n{k}"),
        ]
    sums.append(F.min(F.when(F.col("rel") > 0, F.col("r"))).alias("_first"))
    totals = rows.groupBy(*keys).agg(*sums).join(relevant_counts(qrels, keys), keys, "inner" if skip_unjudged else "left")
    n = F.coalesce("n_rel", F.lit(0).cast("long"))
    out = [F.col(c) for c in keys]
    share = lambda x: F.when(n > 0, x / n).otherwise(0.0)
    for k in cutoffs:
        out += [F.coalesce(F.col(f"_dcg{k}") / ideal_gain(n, k), F.lit(0.0)).alias(f"NDCG@{k}"), share(F.col(f"_ap{k}")).alias(f"MAP@{k}"), share(F.col(f"_n{k}")).alias(f"Recall@{k}"), (F.col(f"_n{k}") / k).alias(f"P@{k}")]
    return totals.select(*out, F.coalesce(1 / F.col("_first").cast("double"), F.lit(0.0)).alias("MRR"))


def oracle_run(run: DataFrame, qrels: DataFrame, depth: int = ORACLE_DEPTH, keys: list[str] | None = None) -> DataFrame:
    """What a perfect reranker of the first `depth` makes: rel there, 0 elsewhere. The depth follows positions; later
    ties are the evaluator's, so a relevant document outside the depth may still come before irrelevant ones."""
    keys = keys or ["query_id"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("pos")))
    rows = run.withColumn("_place", place).join(qrels.select(*keys, "doc_id", "rel"), [*keys, "doc_id"], "left")
    score = F.when(F.col("_place") <= depth, F.coalesce("rel", F.lit(0))).otherwise(0).cast("double")
    return rows.withColumn("score", score).drop("_place", "rel")


def oracle_per_query(run: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS, depth: int = ORACLE_DEPTH, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["query_id"]
    found = per_query(oracle_run(run, qrels, depth, keys), qrels, cutoffs, "trec", keys)
    return found.select(*keys, *[F.col(f"NDCG@{k}").alias(f"Oracle NDCG@{k}") for k in cutoffs])


def metric_names(cutoffs: tuple[int, ...] = CUTOFFS, oracle: bool = True) -> list[str]:
    """Names in the report's order."""
    names = [f"{m}@{k}" for m in ("NDCG", "MAP", "Recall", "P") for k in cutoffs] + ["MRR"]
    return names + ([f"Oracle NDCG@{k}" for k in cutoffs] if oracle else [])


def mean(per_query_metrics: DataFrame, by: list[str] | None = None, digits: int = 5, half_even: bool = True) -> DataFrame:
    """Means over queries, for each group if any; without queries they are null. half_even rounds like the report."""
    names = [c for c in per_query_metrics.columns if c == "MRR" or "@" in c]
    rounded = F.bround if half_even else F.round
    means = [rounded(F.avg(F.col(f"`{c}`")), digits).alias(c) for c in names]
    return per_query_metrics.groupBy(*by).agg(*means) if by else per_query_metrics.agg(*means)


def long_form(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, k, value) of a wide table; k is null for metrics without a cutoff."""
    names = [c for c in metrics.columns if c not in keys]
    rows = metrics.unpivot([F.col(f"`{k}`") for k in keys], [F.col(f"`{c}`") for c in names], "name", "value")
    cutoff = F.when(F.col("name").contains("@"), F.substring_index("name", "@", -1)).cast("int")
    return rows.select(*keys, F.substring_index("name", "@", 1).alias("metric"), cutoff.alias("k"), "value")


def over_domains(domain_metrics: DataFrame, digits: int = 5, half_even: bool = True) -> DataFrame:
    """(domain, metric, k, value): each domain's values, and under a null domain their unweighted means."""
    rounded = F.bround if half_even else F.round
    total = domain_metrics.groupBy("metric", "k").agg(rounded(F.avg("value"), digits).alias("value"))
    return domain_metrics.select("domain", "metric", "k", "value").unionByName(total.select(F.lit(None).cast("string").alias("domain"), "metric", "k", "value"))
