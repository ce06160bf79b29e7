"""One query for each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.llm import bpe, html_text, jaccard, langid, packing, sharding, suffix_dedup, topk, toxicity, vectors_dedup
from rankspark.llm.common import bound_batches, crc_bucket

#: A text is toxic from this score on.
TOXIC_FROM = 0.7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    grammar = toxicity.train(docs, labels.where(crc_bucket("doc_id", 3) != 1))
    found = toxicity.score(docs.select("doc_id", "text"), grammar, out="score", hits="n_matches")
    return found.select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "n_matches")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(crc_bucket("doc_id", 4) != 2))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", F.size("lang_spans").alias("n_spans"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(_table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digests(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.join_classes(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_bpe": op1_bpe, "op2_repeats": op2_repeats, "op3_topk": op3_topk, "op4_vectors": op4_vectors, "op5_sharding": op5_sharding, "op6_packing": op6_packing, "op9_jaccard": op9_jaccard, "op10_html": op10_html, "op7_toxicity": op7_toxicity, "op8_langid": op8_langid}

#: Smallest reachable id of each node of pairs `p` (a, b, both ways round).
_REACH = "reach AS (SELECT id AS a, id AS m FROM nodes UNION SELECT reach.a, p.b FROM reach JOIN p ON p.a = reach.m), c AS (SELECT a AS id, min(m) AS component_id FROM reach GROUP BY a)"

ORACLES: dict[str, str] = {
    "op2_repeats": """
        WITH d AS MATERIALIZED (
            SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), s AS MATERIALIZED (
            SELECT r, i, md5(h[2 * i + 1:2 * i + 800]) AS g FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 399)) AS i FROM d WHERE len(h) >= 800)
        ), c AS (
            SELECT r, i FROM s WHERE g IN (SELECT g FROM s GROUP BY g HAVING count(*) > 1)
        ), k AS (
            SELECT r, i, sum(CASE WHEN i <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run
            FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM c)
        ), u AS (
            SELECT r, min(i) AS a, max(i) + 400 AS b FROM k GROUP BY r, run
        ), x AS (
            SELECT w.r, string_agg(h[2 * p + 1:2 * a], '' ORDER BY a) AS head, max(b) AS tail, sum(b - a) AS gone, count(*) AS spans
            FROM (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM u) w JOIN d ON d.r = w.r GROUP BY w.r
        )
        SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
            sha256(unhex(coalesce(head, '') || h[2 * coalesce(tail, 0) + 1:])) AS kept_sha256
        FROM d LEFT JOIN x ON x.r = d.r""",
    "op3_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5""",
    "op4_vectors": f"""
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), p AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_dot_product(a.e, b.e) >= 98e-2 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)) AND list_dot_product(a.e, a.e) > 0 AND list_dot_product(b.e, b.e) > 0
        ), nodes AS (SELECT vec_id AS id FROM embeddings), {_REACH}, n AS (SELECT a AS id, count(*) AS n FROM p GROUP BY a)
        SELECT c.id AS vec_id, coalesce(n.n, 0) AS n_links, component_id, c.id = component_id AS kept FROM c LEFT JOIN n ON n.id = c.id""",
    "op9_jaccard": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w WHERE len(w) > 0
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
        p AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 75 * (na.n + nb.n - o)),
        nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
        SELECT c.id AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM c LEFT JOIN n ON n.doc_id = c.id""",
}
