"""Joins between texts and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.functions import text as T
from rankspark.functions.images import normalise_path


def query_images(queries: DataFrame, images: DataFrame, column: str = "image_paths") -> DataFrame:
    """(query_id, pos, path, bytes): images of each query in the list's order; paths without an image are left out."""
    refs = queries.select("query_id", F.posexplode(column).alias("pos", "path"))
    refs = refs.withColumn("path", normalise_path(F.col("path")))
    return refs.join(images.select("path", "bytes"), "path").select("query_id", "pos", "path", "bytes")


def gathered_images(found: DataFrame) -> DataFrame:
    """(query_id, paths) in list order; a query's images are few."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "path")))
    return found.groupBy("query_id").agg(F.transform(ordered, lambda x: x["path"]).alias("paths"))


def first_image(column: str = "image_paths") -> Column:
    """The first path of a list, null if there is none."""
    return F.try_element_at(F.col(column), F.lit(1))


def expand_pairs(docs: DataFrame, images: DataFrame, domain: str | Column) -> DataFrame:
    """(doc_id, base_id, image_path, content): each document without an image, and with each image of its key.

    docs (doc_id, content), images (path). Paths without a key are left out.
    """
    domain = F.lit(domain) if isinstance(domain, str) else domain
    keyed = docs.withColumn("base_key", T.base_key_of_passage(F.col("doc_id")))
    pictures = images.select(T.base_key_of_image(F.col("path"), domain).alias("base_key"), F.col("path").alias("image_path")).where("base_key <> ''")
    alone = keyed.withColumn("image_path", F.lit(None).cast("string"))
    both = keyed.join(pictures, "base_key")
    rows = alone.unionByName(both)
    return rows.select(T.pair_id(F.col("doc_id"), F.col("image_path")).alias("doc_id"), F.col("doc_id").alias("base_id"), "image_path", "content")
