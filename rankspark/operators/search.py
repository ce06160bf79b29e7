"""Scoring of queries against a corpus, exclusions, and the top k of each query.

Every query meets every document, in blocks: the query side is cut into blocks of bounded size, each block of documents
keeps its local top k, and a window takes the best of what is left. The query side is broadcast only if its measured
size is under a bound; else blocks of both sides are joined by block number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark import schemas
from rankspark.functions import vectors

#: A run keeps so many documents for each query.
KEPT = 1000
MASKED = -1e9
#: Bytes of query vectors that are sent to every executor at most.
BROADCAST_BYTES = 64 << 20
QUERY_BLOCK, DOCUMENT_BLOCK = 4096, 65536


def top_k(scores: DataFrame, k: int = KEPT, query: list[str] | None = None, score: str = "score", tie: list[Column] | None = None) -> DataFrame:
    """scores with `rank` from 1, the k best rows of each query; ties by position. Spark limits groups before and after
    the exchange, so only k rows of each query and task are moved."""
    keys = query or ["query_id"]
    order = [F.desc(score), *(tie or [F.asc("pos")])]
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def real_exclusions(exclusions: DataFrame) -> DataFrame:
    """Distinct (query_id, doc_id) without the mark for none."""
    return exclusions.where(F.col("doc_id") != schemas.NO_EXCLUSION).select("query_id", "doc_id").distinct()


def explode_exclusions(queries: DataFrame, column: str = "negative_ids") -> DataFrame:
    return queries.select("query_id", F.explode(column).alias("doc_id"))


def exclude(scores: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Without excluded pairs; ids that aren't in the corpus, and the mark for none, are ignored."""
    return scores.join(real_exclusions(exclusions), ["query_id", "doc_id"], "left_anti")


def search(scores: DataFrame, exclusions: DataFrame | None = None, mode: str = "before", k: int = KEPT) -> DataFrame:
    """A run of scores (query_id, doc_id, pos, score).

    before: excluded pairs go first, so k others are left; after: they go from the k best, so fewer may be left; mask:
    they get the score MASKED first and may end up last. Documents that repeat an id keep their best score.
    """
    best = scores if exclusions is None else scores.join(real_exclusions(exclusions).withColumn("_x", F.lit(True)), ["query_id", "doc_id"], "left")
    if exclusions is None or mode == "none":
        return top_k(best.drop("_x") if exclusions is not None else best, k)
    if mode == "before":
        return top_k(best.where(F.col("_x").isNull()).drop("_x"), k)
    if mode == "after":
        return top_k(best, k).where(F.col("_x").isNull()).drop("_x")
    if mode == "mask":
        return top_k(best.withColumn("score", F.when(F.col("_x"), F.lit(MASKED)).otherwise(F.col("score"))).drop("_x"), k)
    raise ValueError(f"unknown mode {mode}")


def best_per_document(scores: DataFrame) -> DataFrame:
    """Of scores of chunks (query_id, doc_id, score), the best for each document."""
    return scores.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def pair_scores(queries: DataFrame, corpus: DataFrame, similarity: str = "dot", scale: float = 100.0) -> DataFrame:
    """All (query_id, doc_id, pos, score) by array expressions; for small query sides, and as the plain form of `dense`.

    queries (query_id, q), corpus (doc_id, pos, v). similarity: dot, cosine (zero vectors have 0) or unit (both sides
    normalised first).
    """
    q, v = F.col("q"), F.col("v")
    if similarity == "unit":
        q, v = vectors.l2_normalize(q), vectors.l2_normalize(v)
    value = vectors.cosine(q, v) if similarity == "cosine" else vectors.dot(q, v)
    return blocks_joined(queries, corpus).select("query_id", "doc_id", "pos", (value * F.lit(scale)).alias("score"))


def blocks_joined(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Every query with every document. A query side of measured bounded size is broadcast; else both sides are dealt
    into blocks and joined on the pair of block numbers, so each task holds one block of queries."""
    n, size = queries.agg(F.count("*"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()
    if size <= BROADCAST_BYTES:
        return corpus.crossJoin(F.broadcast(queries))
    nq, nd = -(-n // QUERY_BLOCK), max(1, -(-corpus.count() // DOCUMENT_BLOCK))
    left = queries.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(nq))).withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(nd - 1))))
    right = corpus.withColumn("_d", F.pmod(F.xxhash64("doc_id"), F.lit(nd))).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    return right.join(left, ["_q", "_d"]).drop("_q", "_d")


class _Best:
    """The best rows of each query that a task has met, documents block by block."""

    def __init__(self, q: np.ndarray, k: int, scale: float):
        self.q, self.k, self.scale = q, k, scale
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, docs: np.ndarray, pos: np.ndarray, v: np.ndarray) -> None:
        """A matrix product finds each query's candidates up to rounding; they are scored again one by one, in array
        order, so that results don't depend on blocks."""
        rough = self.q @ v.T
        slack = 1e-9 * (1 + np.abs(rough).max(initial=0))
        for row in range(len(self.q)):
            near = np.arange(len(docs))
            if len(docs) > self.k:
                bound = np.partition(rough[row], len(docs) - self.k)[len(docs) - self.k]
                near = np.flatnonzero(rough[row] >= bound - slack)
            exact = np.add.accumulate(self.q[row] * v[near], axis=1)[:, -1] * self.scale
            best = np.lexsort((pos[near], -exact))[: self.k]
            self.held.append((np.full(len(best), row), docs[near[best]], pos[near[best]], exact[best]))
            self.size += len(best)
        if self.size > max(1_000_000, 3 * len(self.q) * self.k):
            self.prune()

    def prune(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query's row, document, position, score), k for each query at most."""
        row, docs, pos, score = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((pos, -score, row))
        ordered = row[order]
        place = np.arange(len(order)) - np.searchsorted(ordered, ordered)
        keep = order[place < self.k]
        self.held = [(row[keep], docs[keep], pos[keep], score[keep])]
        self.size = len(keep)
        return self.held[0]


def dense(queries: DataFrame, corpus: DataFrame, k: int = KEPT, scale: float = 100.0, normalise: bool = False, exclusions: DataFrame | None = None) -> DataFrame:
    """The exact run (query_id, doc_id, pos, score, rank) of dot products, Arrow blocks at a time.

    queries (query_id string, q array), corpus (doc_id string, pos long, v array). normalise: unit vectors first.
    exclusions go before the top k: a block keeps k plus a query's number of exclusions.
    """
    spare = 0
    if exclusions is not None:
        spare = real_exclusions(exclusions).groupBy("query_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    most = k + int(spare)
    packed = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).where("q is not null")
    docs = corpus.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("v").cast("array<double>").alias("v")).where("v is not null")
    shape = packed.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    schema = "query_id string, doc_id string, pos long, score double"

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12) if normalise and len(x) else x

    names = ["query_id", "doc_id", "pos", "score"]
    nothing = pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.string(), pa.string(), pa.int64(), pa.float64())], names=names)

    def emit(ids: list[str], best: _Best) -> Iterator[pa.RecordBatch]:
        row, found, pos, score = best.prune()
        for at in range(0, len(row), 50_000):
            part = slice(at, at + 50_000)
            asked = pa.array(ids, pa.string()).take(pa.array(row[part]))
            yield pa.RecordBatch.from_arrays([asked, pa.array(found[part], pa.string()), pa.array(pos[part]), pa.array(score[part])], names=names)

    def dense_block(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))

    if shape[0] * shape[1] * 8 <= BROADCAST_BYTES:
        rows = packed.collect()  # measured: BROADCAST_BYTES at most
        handle = queries.sparkSession.sparkContext.broadcast(([r["query_id"] for r in rows], unit(np.array([r["q"] for r in rows], float).reshape(len(rows), shape[1]))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = handle.value
            best = _Best(q, most, scale)
            for batch in batches:
                if batch.num_rows and len(q):
                    best.add(np.array(batch.column("doc_id").to_pylist(), object), batch.column("pos").to_numpy(), unit(dense_block(batch.column("v"))))
            if best.held:
                yield from emit(ids, best)

        local = docs.mapInArrow(run, schema)
    else:
        nq, nd = -(-shape[0] // QUERY_BLOCK), max(1, -(-docs.count() // DOCUMENT_BLOCK))
        left = packed.select(F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int").alias("i"), F.col("query_id").alias("id"), F.lit(None).cast("long").alias("pos"), F.col("q").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(nd - 1))).alias("j"))
        right = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(nd)).cast("int").alias("j"), F.col("doc_id").alias("id"), "pos", F.col("v").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("i"))

        def meet(left_: pa.Table, right_: pa.Table) -> pa.Table:
            if not left_.num_rows or not right_.num_rows:
                return pa.Table.from_batches([nothing])
            q, v = (unit(dense_block(t["x"].combine_chunks())) for t in (left_, right_))
            best = _Best(q, most, scale)
            best.add(np.array(right_["id"].to_pylist(), object), right_["pos"].to_numpy(), v)
            return pa.Table.from_batches(list(emit(left_["id"].to_pylist(), best)))

        local = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, schema)
    return search(local, exclusions, "before", k)
