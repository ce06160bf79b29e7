"""Truncation by a model's own tokens."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame


class Tokenizer(Protocol):
    """Text to ids and back. It is pickled to executors; load files at the first call."""

    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


def cut_by_tokenizer(df: DataFrame, tokenizer: Tokenizer, limit: int, text: str = "content") -> DataFrame:
    """df with texts of more than `limit` tokens cut to the text of the first ones; others, and nulls, stay."""

    def cut(t: str | None) -> str | None:
        ids = tokenizer.encode(t) if t else []
        return tokenizer.decode(ids[:limit]) if len(ids) > limit else t

    names, schema = df.columns, df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[names.index(text)] = pa.array([cut(t) for t in batch.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, schema)
