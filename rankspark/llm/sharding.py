"""Shards of near equal size by histogram sort, with DataFrame operations only.

Rows are ordered by a 63-bit key: 31 bits of the text's hash, so that equal texts lie side by side, then 32 bits of the
id's hash, so that even a group with a third of all rows can be cut. Rounds of probes count the exact bytes below
candidate boundaries in all partitions: a bin that holds a wanted splitter and is larger than the tolerance, or that
has too many rows for one task, is probed again at a finer step. When every splitter is within the tolerance, rows are
exchanged once, by bin; a row's slot is its bin's offset plus its rank in the bin.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankspark.llm.common import free_name, materialize, replace_columns, require

LAW = "bytes"
#: Bits of the key that lie below a probe, round by round; from 32 down, boundaries fall inside a group of equal texts.
STEPS = (51, 41, 32, 22, 11, 0)
#: A splitter may miss its place by this share of a shard's size.
TOLERANCE = 0.001
#: It may miss it by this share so that a group of equal texts stays whole.
FOR_GROUPS = 0.01
OVERHEAD = 8
#: Rows of a bin that one task sorts, at any size of the table.
MOST_ROWS = 2_000_000


def row_key(text: Column, doc_id: Column) -> Column:
    high = F.xxhash64(text).bitwiseAND(F.lit((1 << 31) - 1))
    return F.shiftleft(high, 32).bitwiseOR(F.xxhash64(doc_id).bitwiseAND(F.lit((1 << 32) - 1)))


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(OVERHEAD)


@dataclass(frozen=True)
class Bin:
    """Rows whose keys agree above the step's bits."""

    step: int
    prefix: int
    rows: int
    bytes: int

    @property
    def start(self) -> int:
        return self.prefix << self.step


def _small(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A DataFrame of a few driver values, made by the JVM alone."""
    text = json.dumps([dict(zip(names, r)) for r in rows])
    kind = "array<struct<" + ",".join(f"{n}:bigint" for n in names) + ">>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), kind)))


def _probe(keys: DataFrame, step: int, within: list[Bin] | None) -> list[Bin]:
    """Exact rows and bytes of each bin of a step; only inside the given coarser bins, if there are any."""
    if within is not None:
        coarse = _small(keys.sparkSession, [(b.prefix,) for b in within], ["p"])
        keys = keys.join(F.broadcast(coarse), F.shiftright("key", within[0].step) == F.col("p"), "left_semi")
    found = keys.groupBy(F.shiftright("key", step).alias("prefix")).agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    return [Bin(step, r["prefix"], r["n"], r["b"]) for r in found.collect()]


def histogram(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> tuple[list[Bin], list[int]]:
    """Bins in key order, and the splitters as numbers of bins before each shard but the first.

    The driver holds bins only: 4,096 of the first round, and the finer ones of bins that hold a splitter or more rows
    than one task is to sort: 1/1,024 of all (256 at least), MOST_ROWS at most, so a task's work has a bound; a bin takes
    some 100 bytes of the driver for each MOST_ROWS / 2,048 rows or more.
    """
    bins = _probe(keys, STEPS[0], None)
    rows, total = sum(b.rows for b in bins), sum(b.bytes for b in bins)
    most_rows, most_bytes = min(max(256, rows // 1024), MOST_ROWS), max(1, int(tolerance * total / shards))
    targets = [total * i // shards for i in range(1, shards)]
    for step in STEPS[1:]:
        bins.sort(key=lambda b: b.start)
        refine, below = [], 0
        for b in bins:
            k = bisect_left(targets, below + 1)
            holds = k < len(targets) and targets[k] < below + b.bytes
            below += b.bytes
            if b.rows > 1 and (b.rows > most_rows or (holds and b.bytes > most_bytes)):
                refine.append(b)
        for at in sorted({b.step for b in refine}, reverse=True):
            part = [b for b in refine if b.step == at and b.step > step]
            if part:
                gone = set(part)
                bins = [b for b in bins if b not in gone] + _probe(keys, step, part)
    bins.sort(key=lambda b: b.start)
    return bins, _splitters(bins, targets, total / shards)


def _splitters(bins: list[Bin], targets: list[int], ideal: float) -> list[int]:
    edges = [0]
    for b in bins:
        edges.append(edges[-1] + b.bytes)
    whole = [k for k in range(len(bins) + 1) if k == len(bins) or bins[k].start % (1 << 32) == 0]
    whole_bytes = [edges[k] for k in whole]
    out: list[int] = []
    for t in targets:
        k = bisect_left(edges, t)
        near = min((j for j in (k - 1, k) if 0 <= j < len(edges)), key=lambda j: abs(edges[j] - t))
        w = bisect_left(whole_bytes, t)
        group = min((j for j in (w - 1, w) if 0 <= j < len(whole)), key=lambda j: abs(whole_bytes[j] - t))
        pick = whole[group] if abs(whole_bytes[group] - t) <= FOR_GROUPS * ideal else near
        out.append(max(pick, out[-1] if out else 0))
    return out


def shard(df: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", key_table: DataFrame | None = None) -> DataFrame:
    """df with size long, law string, shard int and slot long (gapless from 0 in each shard); law: `bytes`.

    Null texts count as none and have the overhead's size. Equal texts go to one shard, unless they lie across a
    splitter that a group's edge near it can't replace. Rows with equal text and id are ties and stay in one bin.
    An empty table gives no rows; with fewer rows than shards, some shards are empty. Columns named like the results
    are replaced. key_table: (key, size) of the same rows, where the caller has them in a table already.
    """
    require(df, doc_id, text)
    spark = df.sparkSession
    base = replace_columns(df, "size", "law", "shard", "slot")
    key, bin_ = free_name(base, "_key"), free_name(base, "_bin")
    kept = F.coalesce(F.col(text), F.lit(""))
    rows = base.withColumn(key, row_key(kept, F.col(doc_id))).withColumn("size", row_size(F.col(text)))
    keys = key_table if key_table is not None else materialize(rows.select(F.col(key).alias("key"), "size"), "shard-keys")
    bins, splitters = histogram(keys, shards)
    return _exchange(spark, rows, bins, splitters, key, bin_, doc_id).drop(key, bin_)


def _exchange(spark: SparkSession, rows: DataFrame, bins: list[Bin], splitters: list[int], key: str, bin_: str, doc_id: str) -> DataFrame:
    by_step: dict[int, list[tuple[int, int, int, int]]] = {}
    number, before, at = 0, 0, 0
    for k, b in enumerate(bins):
        while at < len(splitters) and splitters[at] <= k:
            at, number, before = at + 1, number + 1, 0
        by_step.setdefault(b.step, []).append((b.prefix, k, number, before))
        before += b.rows
    matched = []
    for step, values in by_step.items():
        names = [f"_p{step}", f"_k{step}", f"_s{step}", f"_o{step}"]
        rows = rows.join(F.broadcast(_small(spark, values, names)), F.shiftright(key, step) == F.col(names[0]), "left")
        matched.append(names)
    lost = F.raise_error(F.lit("a row has no bin: its key isn't in the histogram")).cast("long")
    pick = lambda i: F.coalesce(*[F.col(n[i]) for n in matched], lost)
    rows = rows.withColumn(bin_, pick(1)).withColumn("law", F.lit(LAW)).withColumn("shard", pick(2).cast("int")).withColumn("slot", pick(3))
    rows = rows.drop(*[n for names in matched for n in names])
    rank = F.row_number().over(Window.partitionBy(bin_).orderBy(key, doc_id))
    return rows.withColumn("slot", F.col("slot") + rank - F.lit(1))


def shard_digests(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, size, CRC-32 of its text, law, shard, slot and grown_shard (null, as the law isn't `key`)."""
    kept = F.coalesce(F.col(text), F.lit(""))
    light = materialize(docs.select(F.col(doc_id), row_key(kept, F.col(doc_id)).alias("key"), row_size(F.col(text)).alias("size"), F.crc32(kept.cast("binary")).alias("text_crc32")), "shard-rows")
    bins, splitters = histogram(light.select("key", "size"), shards)
    placed = _exchange(docs.sparkSession, light, bins, splitters, "key", "_bin", doc_id)
    return placed.select(doc_id, "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
