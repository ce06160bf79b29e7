"""Encoders as a plug-in: a model turns batches of texts, or of texts and images, into vectors inside Arrow batches."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Encoder(Protocol):
    """What a model has to offer. It is pickled to executors; load heavy parts at the first call."""

    dim: int

    def encode_text(self, texts: list[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class HashingEncoder:
    """A deterministic stand-in for a neural model: hashed tokens with signs, normalised. Equal texts, equal vectors."""

    dim: int = 64
    seed: int = 0

    def encode_text(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in enumerate(texts):
            for token in text.lower().split():
                h = zlib.crc32(token.encode(), self.seed)
                out[row, h % self.dim] += 1.0 if h & 0x80000000 else -1.0
        norms = np.sqrt((out * out).sum(1, keepdims=True))
        return (out / np.where(norms == 0, 1.0, norms)).astype(np.float32)

    def encode_image(self, images: list[bytes]) -> np.ndarray:
        out = np.zeros((len(images), self.dim))
        for row, data in enumerate(images):
            counts = np.bincount(np.frombuffer(data, np.uint8) % self.dim, minlength=self.dim)
            out[row] = counts / max(1.0, float(np.sqrt((counts * counts).sum())))
        return out.astype(np.float32)


@dataclass(frozen=True)
class Retrying:
    """An encoder whose calls are tried again, each time later, and at last with ever shorter texts; then it raises."""

    inner: Encoder
    tries: int = 5
    wait_seconds: float = 1.0
    shorten: float = 0.8

    @property
    def dim(self) -> int:
        return self.inner.dim

    def encode_text(self, texts: list[str]) -> np.ndarray:
        for attempt in range(self.tries):
            try:
                return self.inner.encode_text(texts)
            except Exception:
                if attempt == self.tries - 1:
                    raise
                time.sleep(self.wait_seconds * 2**attempt)
                if attempt:
                    texts = [t[: max(1, int(len(t) * self.shorten))] for t in texts]
        raise AssertionError


def encode(df: DataFrame, encoder: Encoder, text: str = "content", out: str = "embedding", batch: int = 256) -> DataFrame:
    """df with an array<float> column; null texts are encoded as empty ones. A wrong shape fails the task."""
    base = df.drop(out) if out in df.columns else df
    schema, names = base.schema.simpleString()[7:-1] + f",{out}:array<float>", [*base.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                vectors = np.asarray(encoder.encode_text([t or "" for t in part.column(text).to_pylist()]), np.float32)
                if vectors.shape != (part.num_rows, encoder.dim):
                    raise ValueError(f"the encoder gave {vectors.shape} for {part.num_rows} texts of dimension {encoder.dim}")
                ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * encoder.dim)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, pa.array(vectors.ravel()))], names=names)

    return base.mapInArrow(run, schema)


def encode_images(df: DataFrame, encoder, image: str = "bytes", out: str = "embedding") -> DataFrame:
    """df with vectors of its images; a null image has a null vector, and never reaches the model."""
    schema = df.schema.simpleString()[7:-1] + f",{out}:array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            data = part.column(image).to_pylist()
            there = [k for k, b in enumerate(data) if b is not None]
            vectors = encoder.encode_image([data[k] for k in there]) if there else []
            found = dict(zip(there, (np.asarray(v, np.float32).tolist() for v in vectors)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([found.get(k) for k in range(part.num_rows)], pa.list_(pa.float32()))], names=[*part.schema.names, out])

    return df.mapInArrow(run, schema)


def encode_joint(df: DataFrame, encoder, text: str = "content", image: str = "bytes", out: str = "embedding") -> DataFrame:
    """df with vectors of texts and images that one model takes together; either may be null, not both."""
    if not hasattr(encoder, "encode_joint"):
        raise ValueError(f"{type(encoder).__name__} has no encode_joint: this model takes a text with its image")
    schema = df.schema.simpleString()[7:-1] + f",{out}:array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                vectors = np.asarray(encoder.encode_joint(part.column(text).to_pylist(), part.column(image).to_pylist()), np.float32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors.tolist(), pa.list_(pa.float32()))], names=[*part.schema.names, out])

    return df.mapInArrow(run, schema)


@dataclass(frozen=True)
class Model:
    """A retrieval model: how texts are prepared, what encodes them, how vectors are compared."""

    name: str
    encoder: Encoder
    prepare_query: Callable[[Column], Column] = lambda c: c
    prepare_document: Callable[[Column], Column] = lambda c: c
    normalise: bool = True
    exclusion: str = "before"


_registry: dict[str, Model] = {}


def register(model: Model) -> Model:
    if model.name in _registry:
        raise ValueError(f"{model.name} is registered already")
    _registry[model.name] = model
    return model


def registered(name: str) -> Model:
    if name not in _registry:
        raise KeyError(f"no model {name}; there are {sorted(_registry)}")
    return _registry[name]


register(Model("hashing", HashingEncoder()))
register(Model("hashing-search", HashingEncoder(), prepare_query=lambda c: F.concat(F.lit("search_query: "), c)))
