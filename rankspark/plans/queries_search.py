"""Queries on scoring, top k, BM25 and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankspark.operators import lexical, metrics, qrels, search
from rankspark.plans import evaluation
from rankspark.plans import queries_sources as src
from rankspark.plans import tables as t

K = 100


def _scores(s: SparkSession, d: str, similarity: str = "dot", scale: float = 100.0) -> DataFrame:
    return search.pair_scores(t.vector_queries(s, d).select("query_id", "q"), t.vector_corpus(s, d).select("doc_id", "pos", "v"), similarity, scale)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def dense_scores(s: SparkSession, d: str) -> DataFrame:
    return _rounded(_scores(s, d)).select("query_id", "doc_id", "score")


def cosine_scores(s: SparkSession, d: str) -> DataFrame:
    return _rounded(_scores(s, d, "cosine", 1.0)).select("query_id", "doc_id", "score")


def raw_dot(s: SparkSession, d: str) -> DataFrame:
    """Vectors of different lengths, not normalised first."""
    q = t.vector_queries(s, d).select("query_id", F.transform(F.col("q").cast("array<double>"), lambda x: x * 3.0).alias("q"))
    v = t.vector_corpus(s, d).select("doc_id", "pos", F.transform(F.col("v").cast("array<double>"), lambda x: x * (F.col("pos") % 5 + 1).cast("double")).alias("v"))
    return _rounded(search.pair_scores(q, v, "dot", 100.0)).select("query_id", "doc_id", "score")


def _dense(s: SparkSession, d: str, k: int = K, exclusions: DataFrame | None = None) -> DataFrame:
    return search.dense(t.vector_queries(s, d), t.vector_corpus(s, d).select("doc_id", "pos", "v"), k, 100.0, False, exclusions)


def dense_topk(s: SparkSession, d: str) -> DataFrame:
    """Exact top 100 of every query over the whole corpus, excluded pairs taken out first, by Arrow blocks."""
    return _rounded(_dense(s, d, K, t.exclusions(s, d))).select("query_id", "doc_id", "score", "rank")


def topk_after(s: SparkSession, d: str) -> DataFrame:
    run = search.search(_scores(s, d), t.exclusions(s, d), "after", K)
    return _rounded(run).select("query_id", "doc_id", "score", "rank")


def topk_mask(s: SparkSession, d: str) -> DataFrame:
    """So many rows that masked documents come in, too."""
    run = search.search(_scores(s, d), t.exclusions(s, d), "mask", 1_000_000)
    return _rounded(run).select("query_id", "doc_id", "score", "rank")


def topk_order(s: SparkSession, d: str) -> DataFrame:
    """Order by a derived index: documents by the row that a store has them in."""
    kept = t.vector_corpus(s, d).select("doc_id", ((F.col("pos") * 7919) % 104729).alias("row"))
    return kept.withColumn("n", F.row_number().over(Window.partitionBy((F.col("row") % 16)).orderBy("row", "doc_id")).cast("long"))


def maxp_dedup(s: SparkSession, d: str) -> DataFrame:
    """Vectors as chunks of documents, three each: the best chunk's score."""
    chunks = _scores(s, d).withColumn("doc_id", F.floor(F.col("pos") / 3).cast("string"))
    return _rounded(search.best_per_document(chunks))


def _terms(s: SparkSession, d: str) -> DataFrame:
    return lexical.analyzed(t.text_corpus(s, d).select("doc_id", "content"))


def tokenize_tf(s: SparkSession, d: str) -> DataFrame:
    return lexical.term_frequencies(_terms(s, d))


def bm25_idf(s: SparkSession, d: str) -> DataFrame:
    return lexical.inverse_frequencies(_terms(s, d)).withColumn("idf", F.round("idf", 6))


def bm25_doclen(s: SparkSession, d: str) -> DataFrame:
    terms = _terms(s, d)
    return lexical.document_lengths(terms).crossJoin(F.broadcast(lexical.corpus_statistics(terms))).select("doc_id", "dl", "n", F.round("avgdl", 6).alias("avgdl"))


def _bm25(s: SparkSession, d: str, k: int, **options) -> DataFrame:
    return lexical.bm25(t.text_queries(s, d), t.text_corpus(s, d).select("doc_id", "pos", "content"), None, k, **options)


def _run(df: DataFrame) -> DataFrame:
    return df.select("query_id", "doc_id", "score", "rank")


def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return _run(_bm25(s, d, 10, decimals=6))


def bm25_binary_topk(s: SparkSession, d: str) -> DataFrame:
    return _run(_bm25(s, d, 10, weighting="binary", decimals=6))


def _metric(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _dense(s, d, K, t.exclusions(s, d)), t.vector_qrels(s, d).select("query_id", "doc_id", "rel")


def _some(prefix: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        found = metrics.per_query(*_metric(s, d))
        return found.select("query_id", *[F.round(F.col(f"`{prefix}@{k}`"), 6).alias(f"m{k}") for k in metrics.CUTOFFS])

    return run


def metrics_mrr(s: SparkSession, d: str) -> DataFrame:
    return metrics.per_query(*_metric(s, d)).select("query_id", F.round("MRR", 6).alias("mrr"))


def metrics_oracle(s: SparkSession, d: str) -> DataFrame:
    """The ceiling of a reranker of the first 20: relevant documents behind them tie with irrelevant ones."""
    run, judged = _metric(s, d)
    found = metrics.oracle_per_query(run, judged, metrics.CUTOFFS, 20)
    return found.select("query_id", *[F.round(F.col(f"`Oracle NDCG@{k}`"), 6).alias(f"m{k}") for k in metrics.CUTOFFS])


def _by_domain(s: SparkSession, d: str) -> DataFrame:
    run, _ = _metric(s, d)
    domains = t.vector_queries(s, d).select("query_id", "domain")
    judged = t.vector_qrels(s, d)
    found = metrics.per_query(run.join(domains, "query_id"), judged, (10, 100), keys=["domain", "query_id"])
    return metrics.mean(found.drop("query_id"), ["domain"], 5, half_even=False)


def metrics_long(s: SparkSession, d: str) -> DataFrame:
    return metrics.long_form(_by_domain(s, d), ["domain"])


def summary_domains(s: SparkSession, d: str) -> DataFrame:
    """Domains' values, and their unweighted means; the mean of rounded values is rounded again."""
    return metrics.over_domains(metrics_long(s, d), 5, half_even=False)


def bm25_metrics(s: SparkSession, d: str) -> DataFrame:
    """Text to text: BM25 of every item over all documents, judged by containment."""
    run = _bm25(s, d, K, decimals=6)
    found = metrics.per_query(run, t.text_gold(s, d), (1, 10, 100))
    return found.select("query_id", *[F.round(F.col(f"`{m}@{k}`"), 6).alias(f"{m.lower()}{k}") for m in ("NDCG", "MAP", "Recall", "P") for k in (1, 10, 100)], F.round("MRR", 6).alias("mrr"))


def pair_metrics(s: SparkSession, d: str) -> DataFrame:
    """Texts with images: items search their own and others' passages, with and without images, by shared terms."""
    docs = src.pair_expand(s, d)
    items = t.text_queries(s, d)
    corpus = docs.select("doc_id", F.xxhash64("doc_id").alias("pos"), "content")
    run = lexical.bm25(items, corpus, None, K, weighting="binary", decimals=6, tie=[F.desc("doc_id")])
    judged = qrels.for_pairs(src._pair_gold(s, d), docs)
    found = metrics.per_query(run, judged, (1, 10))
    return found.select("query_id", *[F.round(F.col(f"`{m}@{k}`"), 6).alias(f"{m.lower()}{k}") for m in ("NDCG", "Recall") for k in (1, 10)], F.round("MRR", 6).alias("mrr"))


def fused_search(s: SparkSession, d: str) -> DataFrame:
    """Vectors as texts, reversed ones as images that a third of them lacks: mean fusion on both sides."""
    corpus = t.vector_corpus(s, d)
    image = F.when(F.col("pos") % 3 == 0, F.lit(None)).otherwise(F.reverse("v"))
    docs = corpus.select("doc_id", "pos", F.col("v").alias("text_vec"), image.alias("image_vec"))
    asked = docs.where("pos % 100 = 0").select(F.col("doc_id").alias("query_id"), "text_vec", "image_vec")
    run = evaluation.fused_run(asked, docs, None, 20)
    return _rounded(run).select("query_id", "doc_id", "score", "rank")


def hash_encode(s: SparkSession, d: str) -> DataFrame:
    """A registered model from end to end, the hashing encoder in place of a neural one."""
    from rankspark.operators.encoders import registered

    run = evaluation.dense_run(t.text_queries(s, d), t.text_corpus(s, d), registered("hashing"), None, 10)
    return _rounded(run).select("query_id", "doc_id", "score", "rank")


QUERIES = {f.__name__: f for f in (dense_scores, cosine_scores, raw_dot, dense_topk, topk_after, topk_mask, topk_order, maxp_dedup, tokenize_tf, bm25_idf, bm25_doclen, bm25_topk, bm25_binary_topk, metrics_mrr, metrics_oracle, metrics_long, summary_domains, bm25_metrics, pair_metrics, fused_search, hash_encode)}
QUERIES |= {"metrics_ndcg": _some("NDCG"), "metrics_map": _some("MAP"), "metrics_recall": _some("Recall"), "metrics_precision": _some("P")}

RUN = f"""{t.SCORES},
run AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM s WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.query_id = s.query_id AND x.doc_id = s.doc_id)) WHERE rank <= {K})"""


def measured(run: str, gold: str, cutoffs: tuple[int, ...], keys: str = "query_id") -> str:
    """CTEs that give `m`: all metrics of each query. run (keys, doc_id, score), gold (keys, doc_id, rel)."""
    dcg = ", ".join(f"sum(CASE WHEN r <= {k} THEN rel * ln(2) / ln(r + 1) ELSE 0e0 END) AS dcg{k}, sum(CASE WHEN r <= {k} THEN rel * hits / CAST(r AS DOUBLE) ELSE 0e0 END) AS ap{k}, sum(CASE WHEN r <= {k} THEN CAST(rel AS DOUBLE) ELSE 0e0 END) AS n{k}" for k in cutoffs)
    out = ", ".join(f"coalesce(dcg{k} / nullif(list_sum(list_transform(range(1, least(n, {k}) + 1), lambda i: ln(2) / ln(i + 1))), 0), 0) AS ndcg{k}, CASE WHEN n > 0 THEN ap{k} / n ELSE 0 END AS map{k}, CASE WHEN n > 0 THEN n{k} / n ELSE 0 END AS recall{k}, n{k} / {k} AS p{k}" for k in cutoffs)
    return f"""jd AS (SELECT r.*, coalesce(g.rel, 0) AS rel FROM {run} r LEFT JOIN {gold} g USING ({keys}, doc_id)),
jr AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY CAST(score AS FLOAT) DESC, doc_id DESC) AS r FROM jd),
jh AS (SELECT *, sum(rel) OVER (PARTITION BY {keys} ORDER BY r ROWS UNBOUNDED PRECEDING) AS hits FROM jr),
ja AS (SELECT {keys}, {dcg}, min(CASE WHEN rel > 0 THEN r END) AS first FROM jh GROUP BY {keys}),
nr AS (SELECT {keys}, count(*) AS n FROM {gold} GROUP BY {keys}),
m AS (SELECT {keys}, {out}, coalesce(1 / CAST(first AS DOUBLE), 0) AS mrr FROM (SELECT ja.*, coalesce(nr.n, 0) AS n FROM ja LEFT JOIN nr USING ({keys})))"""


_M = f"WITH {RUN}, {t.GOLD}, {measured('(SELECT query_id, doc_id, score FROM run)', 'gold', metrics.CUTOFFS)}"
_O = f"""WITH {RUN}, {t.GOLD}, orun AS (SELECT run.query_id AS query_id, run.doc_id AS doc_id, CASE WHEN rank <= 20 THEN coalesce(rel, 0) ELSE 0 END AS score FROM run LEFT JOIN gold ON gold.query_id = run.query_id AND gold.doc_id = run.doc_id), {measured('orun', 'gold', metrics.CUTOFFS)}"""
_D = f"""WITH {RUN}, {t.GOLD}, {measured('(SELECT domain, query_id, doc_id, score FROM run)', 'gold', (10, 100), 'domain, query_id')},
dm AS (SELECT domain, {', '.join(f'round(avg({c}{k}), 5) AS {c}{k}' for c in ('ndcg', 'map', 'recall', 'p') for k in (10, 100))}, round(avg(mrr), 5) AS mrr FROM m GROUP BY domain),
lm AS ({' UNION ALL '.join(f"SELECT domain, '{n}' AS metric, {k} AS k, {c}{k} AS value FROM dm" for n, c in (('NDCG', 'ndcg'), ('MAP', 'map'), ('Recall', 'recall'), ('P', 'p')) for k in (10, 100))} UNION ALL SELECT domain, 'MRR', NULL, mrr FROM dm)"""
TF = """tok AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id AS pos, regexp_extract_all(lower(text), '[a-z0-9]+') AS terms FROM documents),
tf AS (SELECT doc_id, pos, len(terms) AS dl, term, count(*) AS tf FROM (SELECT doc_id, pos, terms, unnest(terms) AS term FROM tok) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(CAST(len(terms) AS DOUBLE)) AS avgdl FROM tok),
idf AS (SELECT term, df, ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) AS idf, avgdl FROM (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(terms) AS term FROM tok)) GROUP BY term), st)"""


def bm25_sql(binary: bool, k: int) -> str:
    """CTEs that give `run`: BM25's top k over rounded scores."""
    weight = "1e0" if binary else "idf.idf * qt.tf / (qt.tf + 9e-1 * (6e-1 + 4e-1 * ql / idf.avgdl))"
    tf = TF.replace("(SELECT doc_id, pos, terms, unnest(terms) AS term FROM tok) GROUP BY ALL", "(SELECT doc_id, pos, terms, unnest(terms) AS term FROM tok) GROUP BY doc_id, pos, len(terms), term")
    return f"""{tf},
qx AS (SELECT CAST(item_id AS VARCHAR) AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
qt AS (SELECT query_id, term, count(*) AS tf FROM qx SEMI JOIN idf USING (term) GROUP BY query_id, term),
qq AS (SELECT *, sum(tf) OVER (PARTITION BY query_id) AS ql FROM qt),
sc AS (SELECT query_id, doc_id, pos, round(sum({weight.replace('qt.', 'qq.')} * idf.idf * tf.tf / (tf.tf + 9e-1 * (6e-1 + 4e-1 * dl / idf.avgdl))), 6) AS score FROM qq JOIN tf USING (term) JOIN idf USING (term) GROUP BY query_id, doc_id, pos),
run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM sc) WHERE rank <= {k})"""


_UNIT = "list_transform({0}, lambda x: x / greatest(sqrt(list_dot_product({0}, {0})), 1e-12))"
ORACLES = {
    "dense_scores": f"WITH {t.SCORES} SELECT query_id, doc_id, round(score, 6) AS score FROM s",
    "cosine_scores": f"WITH {t.VECTORS} SELECT query_id, doc_id, round(coalesce(list_dot_product(q, v) / nullif(sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v)), 0), 0), 6) AS score FROM q, v",
    "raw_dot": f"WITH {t.VECTORS} SELECT query_id, doc_id, round(100 * list_dot_product(list_transform(q, lambda x: x * 3e0), list_transform(v, lambda x: x * CAST(pos % 5 + 1 AS DOUBLE))), 6) AS score FROM q, v",
    "dense_topk": f"WITH {RUN} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM run",
    "topk_after": f"WITH {t.SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM s) SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {K} AND NOT EXISTS (SELECT 1 FROM x WHERE x.query_id = r.query_id AND x.doc_id = r.doc_id)",
    "topk_mask": f"WITH {t.SCORES}, xd AS (SELECT DISTINCT * FROM x), z AS (SELECT s.query_id AS query_id, s.doc_id AS doc_id, pos, CASE WHEN xd.doc_id IS NULL THEN score ELSE -1e9 END AS score FROM s LEFT JOIN xd ON xd.query_id = s.query_id AND xd.doc_id = s.doc_id) SELECT query_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS INTEGER) AS rank FROM z",
    "topk_order": f'WITH {t.VECTORS}, k AS (SELECT doc_id, (pos * 7919) % 104729 AS "row" FROM v) SELECT doc_id, "row", row_number() OVER (PARTITION BY "row" % 16 ORDER BY "row", doc_id) AS n FROM k',
    "maxp_dedup": f"WITH {t.SCORES} SELECT query_id, CAST(pos // 3 AS VARCHAR) AS doc_id, round(max(score), 6) AS score FROM s GROUP BY query_id, pos // 3",
    "tokenize_tf": f"WITH {TF} SELECT doc_id, term, tf FROM tf",
    "bm25_idf": f"WITH {TF} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_doclen": f"WITH {TF} SELECT doc_id, CAST(len(terms) AS BIGINT) AS dl, n, round(avgdl, 6) AS avgdl FROM tok, st",
    "bm25_topk": f"WITH {bm25_sql(False, 10)} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM run",
    "bm25_binary_topk": f"WITH {bm25_sql(True, 10)} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM run",
    "metrics_mrr": f"{_M} SELECT query_id, round(mrr, 6) AS mrr FROM m",
    "metrics_oracle": f"{_O} SELECT query_id, {', '.join(f'round(ndcg{k}, 6) AS m{k}' for k in metrics.CUTOFFS)} FROM m",
    "metrics_long": f"{_D} SELECT * FROM lm",
    "summary_domains": f"{_D} SELECT * FROM lm UNION ALL SELECT NULL, metric, k, round(avg(value), 5) FROM lm GROUP BY metric, k",
    "bm25_metrics": f"WITH {bm25_sql(False, K)}, gold AS (SELECT CAST(item_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, 1 AS rel FROM documents d, benchmark b WHERE contains(d.text, b.text)), {measured('(SELECT query_id, doc_id, score FROM run)', 'gold', (1, 10, 100))} SELECT query_id, {', '.join(f'round({c}{k}, 6) AS {c}{k}' for c in ('ndcg', 'map', 'recall', 'p') for k in (1, 10, 100))}, round(mrr, 6) AS mrr FROM m",
    "pair_metrics": f"""WITH {src.PAIRS}, {src.PAIR_GOLD}, gold AS (SELECT DISTINCT query_id, pairs.doc_id AS doc_id, 1 AS rel FROM g JOIN pairs ON pairs.base_id = g.doc_id),
tok AS (SELECT doc_id, regexp_extract_all(lower(content), '[a-z0-9]+') AS terms FROM pairs),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM tok) GROUP BY doc_id, dl, term),
st AS (SELECT count(*) AS n, avg(CAST(len(terms) AS DOUBLE)) AS avgdl FROM tok),
idf AS (SELECT term, ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) AS idf, avgdl FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), st),
qx AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
sc AS (SELECT query_id, doc_id, round(sum(idf.idf * tf.tf / (tf.tf + 9e-1 * (6e-1 + 4e-1 * dl / idf.avgdl))), 6) AS score FROM qx JOIN tf USING (term) JOIN idf USING (term) GROUP BY query_id, doc_id),
run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank FROM sc) WHERE rank <= {K}),
{measured('(SELECT query_id, doc_id, score FROM run)', 'gold', (1, 10))} SELECT query_id, {', '.join(f'round({c}{k}, 6) AS {c}{k}' for c in ('ndcg', 'recall') for k in (1, 10))}, round(mrr, 6) AS mrr FROM m""",
    "fused_search": f"""WITH {t.VECTORS}, f AS (SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN v ELSE list_transform(v, lambda x, i: (x + v[65 - i]) / 2e0) END AS f FROM v),
u AS (SELECT doc_id, pos, {_UNIT.format('f')} AS u FROM f), s AS (SELECT a.doc_id AS query_id, b.doc_id AS doc_id, b.pos AS pos, 100 * list_dot_product(a.u, b.u) AS score FROM u a, u b WHERE a.pos % 100 = 0)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM s) WHERE rank <= 20""",
}
for _name, _column in (("metrics_ndcg", "ndcg"), ("metrics_map", "map"), ("metrics_recall", "recall"), ("metrics_precision", "p")):
    ORACLES[_name] = f"{_M} SELECT query_id, {', '.join(f'round({_column}{k}, 6) AS m{k}' for k in metrics.CUTOFFS)} FROM m"
