"""Sources: corpora, queries, images, configurations and earlier results as DataFrames.

Readers fail where the input is missing or of another shape; ids are strings from here on.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankspark import schemas
from rankspark.functions.images import has_image_extension, normalise_path

def empty_list() -> Column:
    return F.expr("cast(array() as array<string>)")


def list_or_empty(column: str) -> Column:
    """A null list is an empty one."""
    return F.coalesce(F.col(column), empty_list())


def read_corpus(spark: SparkSession, path: str, domain: str | None = None) -> DataFrame:
    """(domain, doc_id, pos, content) of Parquet partitioned by domain, or of one domain's files.

    pos orders documents for ties: the order of ids, as files of a table have none of their own.
    """
    df = spark.read.schema(schemas.DOCUMENTS if domain else schemas.DOCUMENTS + ", domain string").parquet(path)
    df = df.withColumn("domain", F.lit(domain)) if domain else df
    order = F.row_number().over(Window.partitionBy("domain").orderBy("id"))
    return df.select("domain", F.col("id").alias("doc_id"), (order - 1).cast("long").alias("pos"), "content")


def read_queries(spark: SparkSession, path: str, domain: str) -> DataFrame:
    """Text queries with gold, excluded and image ids; null lists are empty."""
    df = spark.read.schema(schemas.EXAMPLES).parquet(path)
    lists = [list_or_empty(c).alias(c) for c in ("gold_ids", "negative_ids", "image_paths")]
    return df.select(F.lit(domain).alias("domain"), F.col("id").alias("query_id"), "query", *lists)


def read_multimodal_queries(spark: SparkSession, path: str, domain: str, plain_images: bool = False) -> DataFrame:
    """Queries with positive and negative images. The files may hold further columns; the schema picks ours.

    plain_images: image lists hold strings instead of structs.
    """
    df = spark.read.schema(schemas.EXAMPLES_MULTIMODAL_PLAIN if plain_images else schemas.EXAMPLES_MULTIMODAL).parquet(path)
    lists = [list_or_empty(c).alias(c) for c in ("gold_ids", "negative_ids", "image_paths")]
    images = [image_paths(F.col(c), plain_images).alias(c) for c in ("positive_images", "negative_images")]
    return df.select(F.lit(domain).alias("domain"), F.col("id").alias("query_id"), "query", *lists, *images)


def image_paths(images: Column, plain: bool) -> Column:
    """Paths of annotations that are strings or structs, with forward slashes; null is empty, null members go."""
    paths = F.transform(images, lambda x: normalise_path(x if plain else x["image_path"]))
    return F.coalesce(F.filter(paths, lambda p: p.isNotNull()), empty_list())


def read_images(spark: SparkSession, path: str, domain: str, decodable=None) -> DataFrame:
    """(domain, path, bytes); of rows that repeat a path the last one stays, in the order of the files. decodable: a Column function that tests the bytes;
    by default, the bytes must begin like an image file."""
    df = spark.read.schema(schemas.IMAGES).parquet(path).withColumn("domain", F.lit(domain))
    test = decodable or looks_like_image
    placed = df.withColumn("_at", F.struct(F.input_file_name(), F.monotonically_increasing_id())).where(test(F.col("bytes")))
    last = placed.groupBy("domain", "path").agg(F.max_by("bytes", "_at").alias("bytes"))
    return last.select("domain", "path", "bytes")


def looks_like_image(data: Column) -> Column:
    """First bytes of JPEG, PNG, WebP (RIFF), BMP, and both orders of TIFF."""
    head = F.hex(F.substring(data, 1, 4))
    return head.startswith("FFD8FF") | head.isin("89504E47", "52494646", "49492A00", "4D4D002A") | head.startswith("424D")


def read_image_directory(spark: SparkSession, root: str) -> DataFrame:
    """(id, path, length, modificationTime, bytes) of image files below a folder; ids are relative, with slashes."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    relative = F.expr(f"substring(path, instr(path, {json.dumps(base)}) + {len(base)})")
    return df.where(has_image_extension(F.col("path"))).select(relative.alias("id"), "path", "length", "modificationTime", F.col("content").alias("bytes")).orderBy("path")


def read_query_images_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, image_paths) of JSON lines; of lines that repeat an id the last one of the file counts."""
    df = spark.read.schema("id string, image_paths array<string>").json(path).where("id is not null")
    df = df.withColumn("_at", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    last = df.groupBy("id").agg(F.max_by(F.struct("image_paths"), "_at").alias("x"))
    return last.select(F.col("id").alias("query_id"), F.coalesce("x.image_paths", empty_list()).alias("image_paths"))


def read_model_config(root: str, model: str) -> dict[str, str]:
    """A model's instructions for queries and documents; empty strings where there is no file."""
    path = Path(root) / model / "default.json"
    found = json.loads(path.read_text()).get("instructions", {}) if path.exists() else {}
    return {"query": found.get("query", ""), "document": found.get("document", "")}


def read_run_if_complete(spark: SparkSession, path: str) -> DataFrame | None:
    """A run that was written to its end, or None: what is left of a broken write has no success mark."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    files = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(schemas.RUN).parquet(path) if files.exists(mark) else None
