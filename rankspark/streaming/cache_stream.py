"""The embedding store fed by a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rankspark.operators.cache import EmbeddingStore
from rankspark.operators.encoders import Encoder


def stream_documents(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def encode_stream(documents: DataFrame, store: EmbeddingStore, encoder: Encoder, checkpoint: str, once: bool = True) -> StreamingQuery:
    """documents (id, content). Each micro-batch appends vectors of what the store doesn't have in that wording yet;
    a batch that is run again after a failure finds them there and adds nothing."""

    def add(batch: DataFrame, number: int) -> None:
        store.encode_missing(batch.dropDuplicates(["id", "content"]), encoder, number)

    writer = documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
