"""BM25 over postings that are made on the fly.

w(t, d) = idf(t) * tf / (tf + k1 * (1 - b + b * dl / avgdl)), idf(t) = ln(1 + (N - df + 0.5) / (df + 0.5)). Query terms
are weighted by the same formula (`bm25`, so idf enters squared) or by 1 each (`binary`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.functions import text as T
from rankspark.operators import analysis
from rankspark.operators.search import search, top_k

K1, B = 0.9, 0.4
#: Terms of all queries together that are sent to every executor at most; more are joined by an exchange.
FEW_TERMS = 1_000_000


def analyze(text: Column, analyzer: str = "simple") -> Column:
    """simple: lower-case runs of a-z and 0-9. english: possessives, stop words and suffixes go too (Porter)."""
    if analyzer == "simple":
        return T.tokens(text)
    if analyzer == "english":
        return analysis.english(text)
    raise ValueError(f"unknown analyzer {analyzer}")


def analyzed(docs: DataFrame, doc_id: str = "doc_id", text: str = "content", analyzer: str = "simple") -> DataFrame:
    """(doc_id, terms): a null text has none."""
    terms = F.coalesce(analyze(F.col(text), analyzer), F.expr("cast(array() as array<string>)"))
    return docs.select(F.col(doc_id).alias("doc_id"), *([F.col("pos")] if "pos" in docs.columns else []), terms.alias("terms"))


def term_frequencies(terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, tf)."""
    return terms.select(key, F.explode("terms").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_lengths(terms: DataFrame) -> DataFrame:
    """(doc_id, dl), documents without terms included."""
    return terms.select("doc_id", F.size("terms").cast("long").alias("dl"))


def corpus_statistics(terms: DataFrame) -> DataFrame:
    """One row: n documents and their mean length."""
    return terms.agg(F.count("*").alias("n"), F.avg(F.size("terms").cast("double")).alias("avgdl"))


def document_frequencies(terms: DataFrame) -> DataFrame:
    """(term, df): terms are made distinct in each document first, so nothing but one row a term and task is moved."""
    return terms.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(df: Column, n: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def inverse_frequencies(terms: DataFrame) -> DataFrame:
    """(term, df, idf)."""
    n = terms.agg(F.count("*").alias("n"))
    return document_frequencies(terms).crossJoin(F.broadcast(n)).select("term", "df", idf(F.col("df"), F.col("n")).alias("idf"))


def saturated(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl / avgdl))


@dataclass(frozen=True)
class Index:
    """Postings (doc_id, pos, dl, term, tf) and one row of statistics (n, avgdl), of a corpus or read from tables."""

    postings: DataFrame
    statistics: DataFrame
    analyzer: str = "simple"
    #: Whether the postings are those of the queries' terms already.
    restricted: bool = False

    @classmethod
    def of(cls, corpus: DataFrame, analyzer: str = "simple", wanted: DataFrame | None = None) -> Index:
        """wanted (term): only these terms' postings are made; the corpus is exploded against them.

        Documents are dealt by their ids before they are exploded: neither a document's frequencies nor its scores for
        all queries need another exchange then.
        """
        docs = analyzed(corpus, "doc_id", "content", analyzer)
        rows = docs.repartition("doc_id").select("doc_id", "pos", F.size("terms").cast("long").alias("dl"), F.explode("terms").alias("term"))
        rows = rows.join(wanted, "term", "left_semi") if wanted is not None else rows
        return cls(rows.groupBy("doc_id", "pos", "dl", "term").agg(F.count("*").alias("tf")), corpus_statistics(docs), analyzer, wanted is not None)

    def write(self, path: str, parts: int = 64) -> None:
        """Tables that many searches share: postings lie by term, so a search reads only what its terms' files hold."""
        self.postings.repartitionByRange(parts, "term", "doc_id").sortWithinPartitions("term").write.parquet(f"{path}/postings")
        self.statistics.write.parquet(f"{path}/statistics")

    @classmethod
    def read(cls, spark: SparkSession, path: str, analyzer: str = "simple") -> Index:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/statistics"), analyzer)

    def scores(self, queries: DataFrame, weighting: str = "bm25", k1: float = K1, b: float = B) -> DataFrame:
        """(query_id, doc_id, pos, score) of queries (query_id, query) for documents that share a term.

        Terms outside the corpus vanish from queries, from their lengths too.
        """
        asked = analyzed(queries, "query_id", "query", self.analyzer).withColumnRenamed("doc_id", "query_id")
        sent = _sent(asked)
        postings = self.postings
        if not self.restricted:
            postings = postings.join(sent(asked.select(F.explode("terms").alias("term")).distinct()), "term", "left_semi")
        frequencies = postings.groupBy("term").agg(F.count("tf").alias("df"))
        weights = frequencies.crossJoin(F.broadcast(self.statistics)).select("term", idf(F.col("df"), F.col("n")).alias("idf"), "avgdl")  # one row
        q = term_frequencies(asked, "query_id").join(weights, "term")
        if weighting == "bm25":
            lengths = q.groupBy("query_id").agg(F.sum("tf").alias("ql"))
            q = q.join(lengths, "query_id").withColumn("qw", F.col("idf") * saturated(F.col("tf"), F.col("ql"), F.col("avgdl"), k1, b))
        elif weighting == "binary":
            q = q.withColumn("qw", F.lit(1.0))
        else:
            raise ValueError(f"unknown weighting {weighting}")
        scored = postings.join(sent(q.select("query_id", "term", "qw", "idf", "avgdl")), "term")
        weight = F.col("qw") * F.col("idf") * saturated(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
        return scored.groupBy("query_id", "doc_id", "pos").agg(F.sum(weight).alias("score"))


def _sent(asked: DataFrame):
    """broadcast, if the terms of the analysed queries are few enough for all executors; else nothing."""
    n = asked.agg(F.sum(F.size("terms").cast("long"))).first()[0] or 0
    return F.broadcast if n <= FEW_TERMS else lambda df: df


def bm25(
    queries: DataFrame, corpus: DataFrame, exclusions: DataFrame | None = None, k: int = 1000, weighting: str = "bm25", analyzer: str = "simple", k1: float = K1, b: float = B, pad_zero: bool = False,
    decimals: int | None = None, tie: list[Column] | None = None,
) -> DataFrame:
    """The run (query_id, doc_id, pos, score, rank) of an index that is made for these queries alone.

    queries (query_id, query), corpus (doc_id, pos, content). pad_zero: documents that match nothing follow with score 0
    in corpus order, as far as k goes. decimals: scores are rounded before they are ranked, as sums in another order
    differ in their last bits. tie: the order of equal scores, by position if none is given.
    """
    asked = analyzed(queries, "query_id", "query", analyzer)
    index = Index.of(corpus, analyzer, _sent(asked)(asked.select(F.explode("terms").alias("term")).distinct()))
    scores = index.scores(queries, weighting, k1, b)
    if decimals is not None:
        scores = scores.withColumn("score", F.round("score", decimals))
    if pad_zero:
        first = corpus.orderBy("pos").select("doc_id", "pos").limit(2 * k)  # enough to fill k places after any k matches
        none = queries.select("query_id").crossJoin(F.broadcast(first)).join(scores, ["query_id", "doc_id"], "left_anti")
        scores = scores.unionByName(none.withColumn("score", F.lit(0.0)))
    if tie is not None:
        if exclusions is not None:
            scores = scores.join(exclusions.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_anti")
        return top_k(scores, k, tie=tie)
    return search(scores, exclusions, "before", k)
