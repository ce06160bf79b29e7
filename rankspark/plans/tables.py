"""The driver's tables as corpora, queries and judgements; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark import schemas
from rankspark.operators.search import blocks_joined


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: the language is the domain, the id the position."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("domain"), F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").alias("pos"), F.col("text").alias("content"))


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items of benchmark."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))


def text_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is relevant for an item whose text it contains."""
    found = containing(text_queries(spark, sf_dir), text_corpus(spark, sf_dir).select("doc_id", "content"))
    return found.withColumn("rel", F.lit(1))


def containing(items: DataFrame, docs: DataFrame, words: int = 4) -> DataFrame:
    """(query_id, doc_id) of items (query_id, query) whose text a document (doc_id, content) contains.

    What stands between blanks inside an item stands between blanks in a document that contains it. So documents are
    looked up by an item's second to fifth word together, and only those are searched; items of fewer words meet all.
    """
    parts = F.split("query", " ")
    long = items.where(F.size(parts) >= words + 2).select("query_id", "query", F.xxhash64(F.slice(parts, 2, words)).alias("h"))
    ends = F.sequence(F.lit(1), F.greatest(F.size("p") - (words - 1), F.lit(1)))
    runs = docs.select("doc_id", F.split("content", " ").alias("p")).where(F.size("p") >= words)
    runs = runs.select("doc_id", F.explode(F.array_distinct(F.transform(ends, lambda i: F.xxhash64(F.slice("p", i, words))))).alias("h"))
    near = runs.join(long, "h").select("query_id", "query", "doc_id")
    found = docs.join(near, "doc_id").where(F.expr("contains(content, query)")).select("query_id", "doc_id")
    short = blocks_joined(items.where(F.size(parts) < words + 2), docs).where(F.expr("contains(content, query)"))
    return found.unionByName(short.select("query_id", "doc_id"))


def vector_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("label") % 3).cast("string").alias("domain"), F.col("vec_id").cast("string").alias("doc_id"), F.col("vec_id").alias("pos"), F.col("label"), F.col("embedding").alias("v"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100."""
    return vector_corpus(spark, sf_dir).where("pos % 100 = 0").select("domain", F.col("doc_id").alias("query_id"), F.col("pos").alias("qpos"), "label", F.col("v").alias("q"))


def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's own id, ids that are (query + id) divisible by 17, the mark for none, and an id that isn't there."""
    q = vector_queries(spark, sf_dir).select("query_id", "qpos")
    c = vector_corpus(spark, sf_dir).select("doc_id", "pos")
    some = blocks_joined(q, c).where("(pos + qpos) % 17 = 0 or pos = qpos").select("query_id", "doc_id")
    extra = q.select("query_id", F.explode(F.array(F.lit(schemas.NO_EXCLUSION), F.lit("nowhere"))).alias("doc_id"))
    return some.unionByName(extra)


def vector_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the query's label, itself left out."""
    q = vector_queries(spark, sf_dir).select("domain", "query_id", "label")
    c = vector_corpus(spark, sf_dir).select("doc_id", "label")
    return c.join(q, "label").where("doc_id <> query_id").select("domain", "query_id", "doc_id", F.lit(1).alias("rel"))


#: The same in SQL, as the beginning of a WITH.
VECTORS = """v AS (SELECT CAST(label % 3 AS VARCHAR) AS domain, CAST(vec_id AS VARCHAR) AS doc_id, vec_id AS pos, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q AS (SELECT domain, doc_id AS query_id, pos AS qpos, label, v AS q FROM v WHERE pos % 100 = 0),
x AS (SELECT query_id, doc_id FROM q JOIN v ON (pos + qpos) % 17 = 0 OR pos = qpos UNION SELECT query_id, 'nowhere' FROM q)"""
SCORES = VECTORS + """,
s AS (SELECT q.domain AS domain, query_id, doc_id, pos, 100 * list_dot_product(q, v) AS score FROM q, v)"""
GOLD = """gold AS (SELECT DISTINCT q.domain AS domain, query_id, doc_id, 1 AS rel FROM q JOIN v ON q.label = v.label AND doc_id <> query_id)"""
