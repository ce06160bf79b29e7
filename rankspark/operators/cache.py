"""Embeddings that are kept between runs: a Parquet table by row key, in place of matrices and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: model, domain and modality are the table's folders; a row's text is known by its digest, so changed texts are encoded anew.
TABLE = "id string, content_md5 string, version long, embedding array<float>, model string, domain string, modality string"


def content_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def missing(wanted: DataFrame, kept: DataFrame, by_content: bool = True) -> DataFrame:
    """Rows of wanted (id, content) that kept has no vector for; by_content also those whose text has changed."""
    if not by_content:
        return wanted.join(kept.select("id"), "id", "left_anti")
    keyed = wanted.withColumn("content_md5", content_key(F.col("content")))
    return keyed.join(kept.select("id", "content_md5"), ["id", "content_md5"], "left_anti").drop("content_md5")


def upsert(kept: DataFrame, new: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The rows of both; of those that share a key the one with the highest version."""
    columns = [c for c in kept.columns if c != key]
    both = kept.unionByName(new.select(kept.columns))
    return both.groupBy(key).agg(F.max_by(F.struct(*columns), version).alias("_r")).select(key, "_r.*")


def gather(wanted: DataFrame, kept: DataFrame, key: str = "id") -> DataFrame:
    """wanted with its vectors; fails if one is missing."""
    found = wanted.join(kept, key, "left")
    lost = found.where("embedding is null").count()
    if lost:
        raise KeyError(f"{lost} ids have no embedding")
    return found


class EmbeddingStore:
    """A Parquet table of vectors. Writes append; reads take a row's last version; compact() rewrites to a new folder."""

    def __init__(self, spark: SparkSession, path: str, model: str, domain: str, modality: str = "text"):
        self.spark, self.path, self.place = spark, path, {"model": model, "domain": domain, "modality": modality}

    def _exists(self) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def rows(self) -> DataFrame:
        """All rows of this model, domain and modality, older versions too; an empty table if nothing was written."""
        if not self._exists():
            return self.spark.createDataFrame([], TABLE).drop(*self.place)
        df = self.spark.read.schema(TABLE).parquet(self.path)
        for column, value in self.place.items():
            df = df.where(F.col(column) == value)
        return df.drop(*self.place)

    def latest(self) -> DataFrame:
        return self.rows().groupBy("id").agg(F.max_by(F.struct("content_md5", "version", "embedding"), "version").alias("_r")).select("id", "_r.*")

    def missing(self, wanted: DataFrame) -> DataFrame:
        return missing(wanted, self.latest())

    def append(self, encoded: DataFrame, version: int) -> None:
        """encoded (id, content, embedding)."""
        rows = encoded.select("id", content_key(F.col("content")).alias("content_md5"), F.lit(version).cast("long").alias("version"), F.col("embedding").cast("array<float>").alias("embedding"))
        for column, value in self.place.items():
            rows = rows.withColumn(column, F.lit(value))
        rows.write.mode("append").partitionBy(*self.place).parquet(self.path)

    def encode_missing(self, wanted: DataFrame, encoder, version: int) -> int:
        """Encode what is missing, append it, and tell how many rows that were."""
        from rankspark.operators.encoders import encode

        todo = self.missing(wanted)
        n = todo.count()
        if n:
            self.append(encode(todo, encoder), version)
        return n

    def gather(self, wanted: DataFrame) -> DataFrame:
        return gather(wanted, self.latest().select("id", "embedding"))

    def compact(self, target: str) -> None:
        rows = self.latest()
        for column, value in self.place.items():
            rows = rows.withColumn(column, F.lit(value))
        rows.write.mode("errorifexists").partitionBy(*self.place).parquet(target)
