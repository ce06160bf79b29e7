"""Exact top-k inner products by a bit-sliced index.

Components are quantised to integers. The index of a block of rows has, for each attribute and bit, a bitmap over the
rows. A query's scores are the sum of attributes times its own components, made slice by slice with bitmap arithmetic
(negative components take the complement's slices, so everything is an addition); the top rows are then selected from
the most significant slice of the sum downward, and ties at the boundary go to the smallest ids, as rows lie in id order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankspark.llm.common import materialize, require, tidy

SCALE = 256
ROWS, QUERIES, TOGETHER = 8192, 8192, 64
#: Scores below this magnitude are summed as 64-bit integers, larger ones as Python's integers.
WIDE = 1 << 62


def quantised(df: DataFrame, vec_id: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, width, q array<long>) of usable vectors: no null, no non-finite component. A component whose quantised value
    is no long is an error, as scores are longs."""
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    large = F.raise_error(F.lit("a component is too large for scores that are longs")).cast("long")
    q = F.transform("v", lambda x: F.when(F.abs(x) * F.lit(float(scale)) < F.lit(2.0**62), F.floor(x * F.lit(float(scale)))).otherwise(large))
    return rows.select("id", F.size("v").alias("width"), q.alias("q"))


def _ints(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0), np.int64)
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


class SlicedBlock:
    """Bit slices of a block of rows in id order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, x = ids[order], x[order]
        self.rows, self.width = x.shape
        self.low = x.min(0)
        y = x.astype(np.uint64) - self.low.astype(np.uint64)  # both wrap alike
        self.bits = [int(m).bit_length() for m in y.max(0)]
        words = -(-self.rows // 64)
        self.slices = []
        for d in range(self.width):
            planes = np.zeros((self.bits[d], words * 64), np.uint8)
            for b in range(self.bits[d]):
                planes[b, : self.rows] = (y[:, d] >> np.uint64(b)) & np.uint64(1)
            self.slices.append(np.packbits(planes, axis=1, bitorder="little").view(np.uint64))
        full = np.zeros(words * 64, np.uint8)
        full[: self.rows] = 1
        self.all = np.packbits(full, bitorder="little").view(np.uint64)

    def sums(self, q: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Slices of sum(|q| * y), low bits first, each (queries, words), and what to add for the true scores."""
        size, positive = np.abs(q), q >= 0
        tops = [(1 << b) - 1 for b in self.bits]
        peaks, lows = size.max(0).tolist() if len(q) else [0] * self.width, np.abs(self.low).tolist()
        most = sum(a * b for a, b in zip(peaks, tops))
        if most + sum(a * b for a, b in zip(peaks, lows)) >= WIDE:
            size, low = size.astype(object), self.low.astype(object)
            tops = np.array(tops, object)
        else:
            low, tops = self.low, np.array(tops, np.int64)
        total = [np.zeros((len(q), len(self.all)), np.uint64) for _ in range(max(1, most.bit_length()))]
        flip = np.where(positive, np.uint64(0), ~np.uint64(0))
        ones = ~np.uint64(0)
        for d in range(self.width):
            planes = [s[None, :] ^ flip[:, d : d + 1] for s in self.slices[d]]
            column = np.abs(q[:, d])
            for shift in range(int(column.max()).bit_length()):
                mask = np.where((column >> shift) & 1, ones, np.uint64(0))[:, None]
                if planes and mask.any():
                    self._add(total, [p & mask for p in planes], shift)
        base = (q.astype(low.dtype) * low).sum(1) - np.where(positive, 0, size * tops).sum(1)
        return total, base

    @staticmethod
    def _add(total: list[np.ndarray], planes: list[np.ndarray], shift: int) -> None:
        """Ripple-carry addition of bit slices from a place on."""
        carry = None
        for k in range(shift, len(total)):
            have = total[k]
            if k - shift < len(planes):
                new = planes[k - shift]
                differ = have ^ new
                if carry is None:
                    carry = have & new
                    total[k] = differ
                else:
                    both = have & new
                    total[k] = differ ^ carry
                    differ &= carry
                    both |= differ
                    carry = both
            else:
                if carry is None or not carry.any():
                    return
                total[k] = have ^ carry
                carry = have & carry

    def top(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query, row's id, score): the k best rows of this block for each query, its own id left out."""
        total, base = self.sums(q)
        open_ = np.repeat(self.all[None, :], len(q), 0)
        first, last = np.searchsorted(self.ids, query_ids, "left"), np.searchsorted(self.ids, query_ids, "right")
        for j in np.flatnonzero(last > first):
            for r in range(first[j], last[j]):
                open_[j, r // 64] &= ~(np.uint64(1) << np.uint64(r % 64))
        chosen = np.zeros_like(open_)
        for plane in reversed(total):
            high = open_ & plane
            n = (np.bitwise_count(chosen).sum(1, dtype=np.int64) + np.bitwise_count(high).sum(1, dtype=np.int64))[:, None]
            chosen = np.where(n <= k, chosen | high, chosen)
            open_ = np.where(n > k, high, open_ & ~plane)
        out = []
        for j in range(len(q)):
            rows = _set_bits(chosen[j], self.rows)
            rows = np.concatenate([rows, _set_bits(open_[j], k - len(rows))]) if len(rows) < k else rows
            score = np.full(len(rows), base[j], base.dtype)
            for s, plane in enumerate(total):
                score += ((plane[j, rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64).astype(base.dtype) << s
            if any(abs(x) >= 1 << 63 for x in score.tolist()):
                raise OverflowError(f"a score of query {query_ids[j]} is no long")
            out += zip([int(query_ids[j])] * len(rows), self.ids[rows].tolist(), score.tolist())
        return out


def _set_bits(words: np.ndarray, most: int) -> np.ndarray:
    """Places of the first set bits."""
    found = []
    for w in np.flatnonzero(words):
        x = int(words[w])
        while x and len(found) < most:
            found.append(int(w) * 64 + (x & -x).bit_length() - 1)
            x &= x - 1
        if len(found) >= most:
            break
    return np.array(found, np.int64)


def top_k(df: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", rows: int = ROWS, query_rows: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows of df by quantised inner product, ties to smaller ids.

    queries has the same columns; a row with a query's own id is no candidate for it. Vectors that are null, empty, or
    hold null or non-finite components take no part; a query meets rows of its own width, and without candidates gives
    no row. A query's id that is in queries twice is asked once, with the vector that is first in order; rows of df
    that repeat an id are candidates each. A score that is no long is an error. An empty table gives no rows. Both sides
    are cut into blocks of one width; each pair of blocks is one piece of work.
    """
    require(df, vec_id, vector)
    base = materialize(quantised(df, vec_id, vector), "quantised")
    asked = materialize(quantised(queries, vec_id, vector).groupBy("id").agg(F.min(F.struct("width", "q")).alias("v")).select("id", "v.width", "v.q"), "queries")
    most = lambda df: df.groupBy("width").count().agg(F.max("count")).first()[0] or 0
    nr, nq = max(1, -(-most(base) // rows)), max(1, -(-most(asked) // query_rows))
    left = base.select(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(nr)).cast("int").alias("r"), "width", "id", "q")
    right = asked.select(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(nq)).cast("int").alias("c"), "width", "id", "q")

    def gather(name: str, schema: str):
        def run(table: pa.Table) -> pa.Table:
            ids, x = table["id"].combine_chunks().to_numpy(), _ints(table["q"])
            small = not x.size or max(-int(x.min()), int(x.max())) < 1 << 31
            columns = {name: (table[name][0].as_py(), pa.int32()), "width": (x.shape[1], pa.int32()), "ids": (ids.astype("<i8").tobytes(), pa.binary()), "bytes": (4 if small else 8, pa.int32()), "x": (x.astype("<i4" if small else "<i8").tobytes(), pa.binary())}
            return pa.table({k: pa.array([v], t) for k, (v, t) in columns.items()})

        return run, schema

    run, schema = gather("r", "r int, width int, ids binary, bytes int, x binary")
    row_blocks = left.groupBy("r", "width").applyInArrow(run, schema).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    run, schema = gather("c", "c int, width int, ids binary, bytes int, x binary")
    query_blocks = right.groupBy("c", "width").applyInArrow(run, schema).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(nr - 1)))).select("r", "c", "width", F.col("ids").alias("qids"), F.col("bytes").alias("qbytes"), F.col("x").alias("qx"))
    work = row_blocks.join(query_blocks, ["r", "c", "width"])
    vectors = lambda blob, size, width: np.frombuffer(blob, f"<i{size}").astype(np.int64).reshape(-1, width)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if last != (row["r"], row["width"]):  # the next query block of the same rows finds their index here
                    last, block = (row["r"], row["width"]), SlicedBlock(np.frombuffer(row["ids"], "<i8"), vectors(row["x"], row["bytes"], row["width"]))
                ids, q = np.frombuffer(row["qids"], "<i8"), vectors(row["qx"], row["qbytes"], row["width"])
                for at in range(0, len(ids), TOGETHER):
                    found = block.top(ids[at : at + TOGETHER], q[at : at + TOGETHER], k)
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["query_id", "vec_id", "score"])

    best = work.mapInArrow(tidy(__name__, search), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
