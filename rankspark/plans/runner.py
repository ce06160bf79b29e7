"""A task from files to reports: scan, encode or index, search, judge, measure, keep."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.functions import images
from rankspark.operators import encoders, experiments, lexical, metrics, pairs, profiles, qrels, search
from rankspark.operators.cache import EmbeddingStore
from rankspark.plans import evaluation
from rankspark.sources import readers, sinks


@dataclass(frozen=True)
class Settings:
    """Everything that a run depends on. Paths hold a folder for each domain: `<path>/<domain>`."""

    task: str
    model: str
    domains: tuple[str, ...]
    documents: str
    examples: str
    output: str
    document_images: str | None = None
    query_images: str | None = None
    configs: str = "configs"
    cache: str | None = None
    k: int = search.KEPT
    debug: bool = False
    force: bool = False
    exclusion: str | None = None

    def key(self) -> str:
        """What tells this run from others with the same folders: debug runs and other k have their own."""
        return experiments.config_key(**{n: v for n, v in asdict(self).items() if n not in ("domains", "output", "force", "cache")})


def _encoded(settings: Settings, domain: str, df: DataFrame, encoder, modality: str) -> DataFrame:
    """(id, content) with vectors, from the store as far as it has them."""
    if settings.cache is None:
        return encoders.encode(df, encoder)
    store = EmbeddingStore(df.sparkSession, settings.cache, settings.model, domain, modality)
    version = store.rows().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0] + 1
    store.encode_missing(df, encoder, version)
    return store.gather(df)


def _image_vectors(images: DataFrame, encoder) -> DataFrame:
    return encoders.encode_images(images.select("path", "bytes"), encoder).select("path", F.col("embedding").cast("array<double>").alias("image_vec"))


def domain_run(spark: SparkSession, settings: Settings, domain: str, encoder=None) -> tuple[DataFrame, DataFrame] | None:
    """(run, judgements) of one domain, or None if it has no documents or no queries."""
    task = settings.task
    mode = settings.exclusion or profiles.EXCLUSION[task]
    multimodal = task != "text_text"
    read = readers.read_multimodal_queries if multimodal else readers.read_queries
    queries = read(spark, f"{settings.examples}/{domain}", domain)
    if task == "text_image":
        pictures = readers.read_images(spark, f"{settings.document_images}/{domain}", domain)
        corpus = pictures.select(F.col("path").alias("doc_id"), F.xxhash64("path").alias("pos"), F.lit(None).cast("string").alias("content"), F.col("path").alias("image_path"))
    else:
        corpus = readers.read_corpus(spark, f"{settings.documents}/{domain}", domain).select("doc_id", "pos", "content")
        if task == "text_pair":
            pictures = readers.read_images(spark, f"{settings.document_images}/{domain}", domain)
            expanded = pairs.expand_pairs(corpus.select("doc_id", "content"), pictures, domain)
            corpus = expanded.select("doc_id", F.xxhash64("doc_id").alias("pos"), "content", "image_path")
    if settings.debug:
        corpus, queries = corpus.orderBy("pos").limit(30), queries.orderBy("query_id").limit(10)  # a smoke run
    if corpus.isEmpty() or queries.isEmpty():
        return None
    excluded = search.explode_exclusions(queries)
    if task == "text_pair":  # exclusions name base documents
        base = corpus.select("doc_id", F.substring_index("doc_id", "|||", 1).alias("base"))
        excluded = excluded.withColumnRenamed("doc_id", "base").join(base, "base").select("query_id", "doc_id")
    gold = qrels.for_images(queries) if task == "text_image" else qrels.from_lists(queries)
    judged = qrels.for_pairs(gold, corpus.select("doc_id")) if task == "text_pair" else gold
    if settings.model in profiles.LEXICAL.get(task, ()):
        return lexical.bm25(queries, corpus, excluded, settings.k), judged
    profile = profiles.PROFILES[task][settings.model]
    encoder = encoder or encoders.registered(settings.model).encoder
    config = readers.read_model_config(settings.configs, settings.model)
    ready = lambda df, i, c, side, steps: df.select(F.col(i).alias("id"), profiles.prepare(F.coalesce(c, F.lit("")), steps, config[side], F.lit(domain)).alias("content"))
    if profile.joint and not hasattr(encoder, "encode_joint"):
        raise ValueError(f"{settings.model} takes texts with their images: its encoder needs encode_joint")
    asked = _encoded(settings, domain, ready(queries, "query_id", F.col("query"), "query", profile.query), encoder, "query").select(F.col("id").alias("query_id"), F.col("embedding").cast("array<double>").alias("text_vec"))
    if task != "text_image":
        texts = _encoded(settings, domain, ready(corpus, "doc_id", F.col("content"), "document", profile.document), encoder, "text")
        docs = corpus.join(texts.select(F.col("id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("text_vec")), "doc_id")
    else:
        docs = corpus.withColumn("text_vec", F.lit(None).cast("array<double>"))
    if not multimodal:
        run = search.dense(asked.select("query_id", F.col("text_vec").alias("q")), docs.select("doc_id", "pos", F.col("text_vec").alias("v")), settings.k, normalise=profile.normalise, exclusions=excluded)
        return run, judged
    none = F.lit(None).cast("array<double>")
    shown = readers.read_images(spark, f"{settings.query_images}/{domain}", domain) if settings.query_images else None
    first = pairs.query_images(queries, shown).groupBy("query_id").agg(F.min_by("path", "pos").alias("path")) if shown is not None else None
    if profile.joint:
        texts = ready(queries, "query_id", F.col("query"), "query", profile.query).withColumnRenamed("id", "query_id")
        texts = texts.join(first.join(shown.select("path", "bytes"), "path").select("query_id", "bytes"), "query_id", "left") if shown is not None else texts.withColumn("bytes", F.lit(None).cast("binary"))
        asked = _joint(texts, encoder)
        if task in ("text_image", "text_pair"):
            texts = ready(corpus, "doc_id", F.col("content"), "document", profile.document).withColumnRenamed("id", "doc_id") if task == "text_pair" else corpus.select("doc_id", "content")
            both = corpus.select("doc_id", "pos", "image_path").join(texts, "doc_id").join(pictures.select(F.col("path").alias("image_path"), "bytes"), "image_path", "left")
            docs = _joint(both, encoder)
        else:
            docs = docs.withColumn("image_vec", none)
        return evaluation.fused_run(asked, docs, excluded, settings.k, "text", mode, normalise=profile.normalise), judged
    if shown is not None:
        asked = asked.join(first.join(_image_vectors(shown, encoder), "path").select("query_id", "image_vec"), "query_id", "left")
    else:
        asked = asked.withColumn("image_vec", none)
    if task in ("text_image", "text_pair"):
        docs = docs.join(_image_vectors(pictures, encoder).withColumnRenamed("path", "image_path"), "image_path", "left")
    else:
        docs = docs.withColumn("image_vec", none)
    policy = dict(profile.missing_image)
    if task != "text_pair":
        policy["document"] = "text"  # documents are texts alone, or images alone
    blank = [float(x) for x in encoder.encode_image([images.blank_image()])[0]] if "blank" in policy.values() else None
    return evaluation.fused_run(asked, docs, excluded, settings.k, policy, mode, blank, profile.normalise), judged


def _joint(df: DataFrame, encoder) -> DataFrame:
    """df, with vectors of its texts and images together in the place of a text's; images are part of them."""
    found = encoders.encode_joint(df, encoder).drop("content", "bytes")
    return found.withColumn("text_vec", F.col("embedding").cast("array<double>")).drop("embedding").withColumn("image_vec", F.lit(None).cast("array<double>"))


def run(spark: SparkSession, settings: Settings, encoder=None) -> dict:
    """All domains; runs and metrics as tables, and the summary as JSON. Complete runs with the same settings are reused."""
    root = f"{sinks.run_folder(settings.output, settings.task, settings.model)}/{settings.key()}"
    rows = None
    for domain in settings.domains:
        found = domain_run(spark, settings, domain, encoder)
        if found is None:
            continue
        path = f"{root}/run_{domain}"
        kept = None if settings.force else readers.read_run_if_complete(spark, path)
        if kept is None:
            named = found[0].select(F.lit(settings.model).alias("model"), F.lit(domain).alias("domain"), "query_id", "doc_id", "pos", "score", "rank")
            named.write.mode("overwrite").parquet(path)
        made = spark.read.parquet(path)
        report = evaluation.report(made, found[1])
        mean = metrics.mean(report).withColumn("domain", F.lit(domain))
        rows = mean if rows is None else rows.unionByName(mean)
    if rows is None:
        return {"model": settings.model, "task_type": settings.task, "domains": {}, "aggregated": {}}
    long = metrics.long_form(rows, ["domain"])
    sinks.write_metrics(long, f"{root}/metrics")
    everything = metrics.over_domains(long)
    named = F.when(F.col("k").isNull(), F.col("metric")).otherwise(F.concat_ws("@", "metric", F.col("k").cast("string")))
    return sinks.write_summary(everything.select("domain", named.alias("metric"), "value"), settings.model, settings.task, f"{root}/summary.json")
