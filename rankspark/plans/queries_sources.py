"""Queries on sources, filters and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.functions import images as I
from rankspark.operators import cache, experiments, pairs, qrels
from rankspark.plans import tables as t
from rankspark.sources.readers import list_or_empty


def scan_corpus(s: SparkSession, d: str) -> DataFrame:
    return t.text_corpus(s, d).select("domain", "doc_id", "content")


def _queries_with_lists(s: SparkSession, d: str) -> DataFrame:
    """Items with lists that may be null: an item's paths, one, two or none."""
    b = t.table(s, d, "benchmark").select("item_id", F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    path = lambda n: F.format_string("en/en_%08x_0001\\image_%d.webp", F.col("item_id"), F.lit(n))
    lists = F.when(F.col("item_id") % 3 == 1, F.array(path(1))).when(F.col("item_id") % 3 == 2, F.array(path(2), path(1)))
    return b.withColumn("image_paths", lists)


LISTS = """b AS (SELECT item_id, CAST(item_id AS VARCHAR) AS query_id, text AS query,
 CASE WHEN item_id % 3 = 1 THEN [printf('en/en_%08x_0001\\image_1.webp', item_id)] WHEN item_id % 3 = 2 THEN [printf('en/en_%08x_0001\\image_2.webp', item_id), printf('en/en_%08x_0001\\image_1.webp', item_id)] END AS image_paths FROM benchmark)"""


def scan_queries(s: SparkSession, d: str) -> DataFrame:
    return _queries_with_lists(s, d).select("query_id", "query", F.size(list_or_empty("image_paths")).cast("long").alias("n_images"))


def image_path_norm(s: SparkSession, d: str) -> DataFrame:
    q = _queries_with_lists(s, d).select("query_id", F.posexplode(list_or_empty("image_paths")).alias("pos", "p"))
    return q.select("query_id", F.col("pos").cast("long").alias("pos"), I.normalise_path(F.col("p")).alias("path"))


def _images(s: SparkSession, d: str) -> DataFrame:
    """Image paths: of every item but those divisible by 5 a first image, of even ones a second."""
    b = t.table(s, d, "benchmark").select("item_id")
    b = b.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).where("item_id % 5 <> 0 and (n = 1 or item_id % 2 = 0)")
    path = F.format_string("en/en_%08x_0001/image_%d.webp", F.col("item_id"), F.col("n"))
    return b.select(path.alias("path"), F.encode(path, "utf-8").alias("bytes"))


IMAGES = """im AS (SELECT printf('en/en_%08x_0001/image_%d.webp', item_id, n) AS path FROM benchmark, (SELECT unnest([1, 2]) AS n) WHERE item_id % 5 <> 0 AND (n = 1 OR item_id % 2 = 0))"""


def query_images_join(s: SparkSession, d: str) -> DataFrame:
    found = pairs.query_images(_queries_with_lists(s, d).withColumn("image_paths", list_or_empty("image_paths")), _images(s, d))
    return found.select("query_id", F.col("pos").cast("long").alias("pos"), "path", F.octet_length("bytes").cast("long").alias("n_bytes"))


def first_image(s: SparkSession, d: str) -> DataFrame:
    return _queries_with_lists(s, d).select("query_id", I.normalise_path(pairs.first_image()).alias("path"))


def debug_slice(s: SparkSession, d: str) -> DataFrame:
    return experiments.debug_slice(t.text_corpus(s, d), "pos", 30).select("domain", "doc_id")


def ext_filter(s: SparkSession, d: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(x) for x in (".JPG", ".png", ".svg", ".tiff", ".txt", ".webp", "")]), (F.col("page_id") % 7 + 1).cast("int"))
    p = t.table(s, d, "pages").select("page_id", F.concat(F.lit("img/"), F.col("page_id").cast("string"), ext).alias("path"))
    return p.where(I.has_image_extension(F.col("path")) & ~I.is_svg(F.col("path")))


def _passages(s: SparkSession, d: str) -> DataFrame:
    """Items as passages whose ids hold a key."""
    b = t.table(s, d, "benchmark")
    return b.select(F.format_string("en/%08x_%d.txt", F.col("item_id"), F.col("item_id") % 7).alias("doc_id"), F.col("text").alias("content"), "item_id")


PASSAGES = "p AS (SELECT printf('en/%08x_%d.txt', item_id, item_id % 7) AS doc_id, text AS content, item_id FROM benchmark)"
PAIRS = f"""{PASSAGES}, {IMAGES},
pairs AS (SELECT doc_id || '|||__NO_IMAGE__' AS doc_id, doc_id AS base_id, CAST(NULL AS VARCHAR) AS image_path, content FROM p
 UNION ALL SELECT doc_id || '|||' || path, doc_id, path, content FROM p JOIN im ON regexp_extract(doc_id, '/([0-9a-f]+)_\\d+\\.txt$', 1) = regexp_extract(path, 'en_([0-9a-f]+)_\\d+', 1))"""


def pair_expand(s: SparkSession, d: str) -> DataFrame:
    return pairs.expand_pairs(_passages(s, d).select("doc_id", "content"), _images(s, d).select("path"), "en")


def _pair_gold(s: SparkSession, d: str) -> DataFrame:
    """Each item's own passage and the next one's."""
    p = _passages(s, d).select("item_id", "doc_id")
    own = p.select(F.col("item_id").cast("string").alias("query_id"), "doc_id")
    other = p.select((F.col("item_id") - 1).cast("string").alias("query_id"), "doc_id").where("item_id > 0")
    return own.unionByName(other)


PAIR_GOLD = "g AS (SELECT CAST(item_id AS VARCHAR) AS query_id, doc_id FROM p UNION ALL SELECT CAST(item_id - 1 AS VARCHAR), doc_id FROM p WHERE item_id > 0)"


def qrels_pair(s: SparkSession, d: str) -> DataFrame:
    return qrels.for_pairs(_pair_gold(s, d), pair_expand(s, d))


def gold_coverage(s: SparkSession, d: str) -> DataFrame:
    gold = t.vector_qrels(s, d).select("query_id", F.when(F.col("doc_id").cast("int") % 7 == 0, F.concat(F.lit("lost"), "doc_id")).otherwise(F.col("doc_id")).alias("doc_id"))
    return qrels.gold_coverage(gold, t.vector_corpus(s, d))


def exclude_anti(s: SparkSession, d: str) -> DataFrame:
    from rankspark.operators import search

    every = search.blocks_joined(t.vector_queries(s, d).select("query_id"), t.vector_corpus(s, d).select("doc_id"))
    return search.exclude(every, t.exclusions(s, d)).groupBy("query_id").agg(F.count("*").alias("n_left"), F.sum(F.col("doc_id").cast("long")).alias("id_sum"))


def _kept(s: SparkSession, d: str) -> DataFrame:
    """Vectors that a store has: those not divisible by 3; those divisible by 4 in a newer version too."""
    e = t.table(s, d, "embeddings").where("vec_id % 3 <> 0").select(F.col("vec_id").cast("string").alias("id"), F.lit(1).cast("long").alias("version"), "embedding")
    newer = e.where("cast(id as long) % 4 = 0").withColumn("version", F.lit(2).cast("long")).withColumn("embedding", F.reverse("embedding"))
    return e.unionByName(newer)


KEPT = """k AS (SELECT CAST(vec_id AS VARCHAR) AS id, 1 AS version, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings WHERE vec_id % 3 <> 0
 UNION ALL SELECT CAST(vec_id AS VARCHAR), 2, list_reverse(CAST(embedding AS DOUBLE[])) FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id % 4 = 0)"""


def emb_cache_scan(s: SparkSession, d: str) -> DataFrame:
    wanted = t.table(s, d, "embeddings").where("vec_id % 3 = 1").select(F.col("vec_id").cast("string").alias("id"))
    last = cache.upsert(_kept(s, d).where("version = 1"), _kept(s, d).where("version = 2"))
    return cache.gather(wanted, last).select("id", "version", F.round(F.col("embedding")[0].cast("double"), 6).alias("x0"), F.size("embedding").cast("long").alias("dim"))


def cache_uncached(s: SparkSession, d: str) -> DataFrame:
    wanted = t.table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"))
    return cache.missing(wanted, _kept(s, d), by_content=False)


def cache_upsert(s: SparkSession, d: str) -> DataFrame:
    k = _kept(s, d)
    out = cache.upsert(k.where("version = 1"), k.where("version = 2"))
    return out.select("id", "version", F.round(F.col("embedding")[0].cast("double"), 6).alias("x0"))


def jsonl_keep_last(s: SparkSession, d: str) -> DataFrame:
    """The last turn of each conversation: later rows of a key win."""
    c = t.table(s, d, "conversations")
    return c.groupBy("conv_id").agg(F.max_by(F.struct("role", "text"), "turn").alias("r"), F.max("turn").alias("turn")).select("conv_id", "turn", "r.role", "r.text")


def experiment_grid(s: SparkSession, d: str) -> DataFrame:
    models = t.table(s, d, "nation").select(F.col("n_regionkey").cast("string").alias("task"), F.col("n_name").alias("model"))
    return experiments.grid(models, t.table(s, d, "region").select(F.col("r_name").alias("domain")))


def domain_counts(s: SparkSession, d: str) -> DataFrame:
    return t.text_corpus(s, d).groupBy("domain").agg(F.count("*").alias("n_docs"))


def domain_stats(s: SparkSession, d: str) -> DataFrame:
    """Documents and characters by source and language, with totals of each level."""
    docs = t.table(s, d, "documents")
    out = docs.rollup("source", "lang").agg(F.count("*").alias("n_docs"), F.round(F.avg(F.length("text").cast("double")), 4).alias("avg_chars"), F.grouping_id().cast("long").alias("level"))
    return out.select("source", "lang", "n_docs", "avg_chars", "level")


QUERIES = {f.__name__: f for f in (scan_corpus, scan_queries, image_path_norm, query_images_join, first_image, debug_slice, ext_filter, pair_expand, qrels_pair, gold_coverage, exclude_anti, emb_cache_scan, cache_uncached, cache_upsert, jsonl_keep_last, experiment_grid, domain_counts, domain_stats)}

ORACLES = {
    "scan_corpus": "SELECT lang AS domain, CAST(doc_id AS VARCHAR) AS doc_id, text AS content FROM documents",
    "scan_queries": f"WITH {LISTS} SELECT query_id, query, CAST(coalesce(len(image_paths), 0) AS BIGINT) AS n_images FROM b",
    "image_path_norm": f"WITH {LISTS}, e AS (SELECT query_id, unnest(image_paths) AS p, CAST(generate_subscripts(image_paths, 1) - 1 AS BIGINT) AS pos FROM b) SELECT query_id, pos, replace(p, '\\', '/') AS path FROM e",
    "query_images_join": f"WITH {LISTS}, {IMAGES}, e AS (SELECT query_id, replace(unnest(image_paths), '\\', '/') AS path, CAST(generate_subscripts(image_paths, 1) - 1 AS BIGINT) AS pos FROM b) SELECT query_id, pos, path, CAST(strlen(path) AS BIGINT) AS n_bytes FROM e JOIN im USING (path)",
    "first_image": f"WITH {LISTS} SELECT query_id, replace(image_paths[1], '\\', '/') AS path FROM b",
    "debug_slice": "SELECT lang AS domain, CAST(doc_id AS VARCHAR) AS doc_id FROM documents WHERE doc_id < 30",
    "ext_filter": "SELECT page_id, path FROM (SELECT page_id, 'img/' || CAST(page_id AS VARCHAR) || (['.JPG', '.png', '.svg', '.tiff', '.txt', '.webp', ''])[page_id % 7 + 1] AS path FROM pages) WHERE lower(regexp_extract(path, '\\.[^./]+$')) IN ('.jpg', '.jpeg', '.png', '.webp', '.bmp', '.tif', '.tiff')",
    "pair_expand": f"WITH {PAIRS} SELECT * FROM pairs",
    "qrels_pair": f"WITH {PAIRS}, {PAIR_GOLD} SELECT DISTINCT query_id, pairs.doc_id AS doc_id, 1 AS rel FROM g JOIN pairs ON pairs.base_id = g.doc_id",
    "gold_coverage": f"WITH {t.VECTORS}, g AS (SELECT DISTINCT query_id, CASE WHEN pos % 7 = 0 THEN 'lost' || doc_id ELSE doc_id END AS doc_id FROM q JOIN v ON q.label = v.label AND doc_id <> query_id) SELECT query_id, count(*) AS n_gold, count(v.doc_id) AS n_found FROM g LEFT JOIN v USING (doc_id) GROUP BY query_id",
    "exclude_anti": f"WITH {t.VECTORS} SELECT query_id, count(*) AS n_left, CAST(sum(pos) AS BIGINT) AS id_sum FROM q, v WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.query_id = q.query_id AND x.doc_id = v.doc_id) GROUP BY query_id",
    "emb_cache_scan": f"WITH {KEPT} SELECT id, CAST(max(version) AS BIGINT) AS version, round(arg_max(embedding, version)[1], 6) AS x0, CAST(max(len(embedding)) AS BIGINT) AS dim FROM k WHERE CAST(id AS BIGINT) % 3 = 1 GROUP BY id",
    "cache_uncached": "SELECT CAST(vec_id AS VARCHAR) AS id FROM embeddings WHERE vec_id % 3 = 0",
    "cache_upsert": f"WITH {KEPT} SELECT id, CAST(max(version) AS BIGINT) AS version, round(arg_max(embedding, version)[1], 6) AS x0 FROM k GROUP BY id",
    "jsonl_keep_last": "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1",
    "experiment_grid": "SELECT CAST(n_regionkey AS VARCHAR) AS task, n_name AS model, r_name AS domain FROM nation, region",
    "domain_counts": "SELECT lang AS domain, count(*) AS n_docs FROM documents GROUP BY lang",
    "domain_stats": "SELECT source, lang, count(*) AS n_docs, round(avg(CAST(length(text) AS DOUBLE)), 4) AS avg_chars, CAST(grouping_id(source, lang) AS BIGINT) AS level FROM documents GROUP BY ROLLUP (source, lang)",
}
