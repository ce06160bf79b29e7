"""Near duplicates among embeddings by sorted projection passes.

Equal vectors of a label are one representative with a weight. Each pass gives a representative the concatenated bits of
random hyperplanes through its label's centre and sorts those of a label by them; a vector is compared with a bounded
window of followers, pairs are verified by their cosine, and verified pairs of all passes are united. The order is cut
into partitions, and the rows at each cut are compared again with those beyond it, so that a window is as wide there. A
window bounds what a pass sees of a group, not what is found: two linked vectors are in one component, so the links
inside each component are counted afterwards exactly, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import materialize, require
from rankspark.llm.components import components, local_forest

SIMILAR = 0.98
PASSES = 16
BITS = 48
WINDOW = 24
#: Vectors of a component that one task compares with so many others at a time: in small components few, so that many
#: tasks share the work; in large ones more, so that a row is sent to fewer of them, and never more than memory holds.
BLOCK, LARGE_BLOCK, FEW_BLOCKS = 128, 4096, 64


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are usable, their vectors as doubles): of this width, no null, finite, not zero."""
    values = column.to_pylist()
    rows = [k for k, v in enumerate(values) if v is not None and len(v) == width and None not in v]
    x = np.array([values[k] for k in rows], np.float64).reshape(len(rows), width)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return np.array(rows, np.int64)[good], x[good]


def unit(x: np.ndarray) -> np.ndarray:
    """Scaled first by the largest component, so that tiny and huge vectors keep their directions."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def hyperplanes(width: int, passes: int, bits: int) -> np.ndarray:
    return np.random.default_rng(20_240_401).standard_normal((passes, width, bits))


def _keys(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    powers = np.int64(1) << np.arange(planes.shape[2] - 1, -1, -1, dtype=np.int64)
    return np.stack([((x @ p) > 0).astype(np.int64) @ powers for p in planes], 1)


def _units(base: DataFrame, width: int) -> DataFrame:
    """(id, label, unit vector) of the vectors of a width that can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = matrix(batch.column("v"), width)
            if len(rows):
                take = pa.array(rows)
                flat = pa.array(unit(x).ravel())
                offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("label").take(take), pa.ListArray.from_arrays(offsets, flat)], names=["id", "label", "v"])

    return base.where(F.size("v") == width).mapInArrow(run, "id long, label string, v array<double>")


def representatives(units: DataFrame) -> DataFrame:
    """(id, label, v, copies): equal vectors of a label as one row, with the smallest id of them and their number."""
    return units.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "label", "v", "copies")


def centres(units: DataFrame) -> DataFrame:
    """(label, centre): the mean of each label's vectors, summed in each task before the exchange."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([t.tolist() for _, t in sums.values()], pa.list_(pa.float64()))], names=["label", "n", "v"])

        for batch in batches:
            for lab, row in zip(batch.column("label").to_pylist(), _dense(batch.column("v"))):
                known = sums.get(lab)
                if known is None:
                    sums[lab] = [1, row.copy()]
                else:
                    known[0] += 1
                    known[1] += row
            if len(sums) > 5_000:  # many labels: pass the sums on, the aggregation joins them
                yield out()
                sums = {}
        yield out()

    parts = units.mapInArrow(partial, "label string, n long, v array<double>").select("label", "n", F.posexplode("v").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg((F.sum("x") / F.sum("n")).alias("x"))
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c")).select("label", F.col("c.x").alias("centre"))


def candidates(units: DataFrame, threshold: float, passes: int, bits: int, window: int) -> DataFrame:
    """Verified pairs as local stars (a, b): what the windows of all passes link."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            x = _dense(batch.column("v"))
            if len(x):
                if planes is None or planes.shape[1] != x.shape[1]:
                    planes = hyperplanes(x.shape[1], passes, bits)
                keys = _keys(x - _dense(batch.column("centre")), planes)
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, np.int32)), batch.column("label"), pa.array(keys[:, p]), batch.column("id"), batch.column("v")], names=["pass", "label", "key", "id", "v"])

    names = ["a", "b", "cut", "side", "place", "group", "id", "v"]

    def pairs_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        stars = [p for p in local_forest(pairs) if p[0] != p[1]]
        a, b = (pa.array([p[k] for p in stars], pa.int64()) for k in (0, 1))
        return pa.RecordBatch.from_arrays([a, b, *(pa.nulls(len(stars), t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.float64())))], names=names)

    def edge(cut: int, side: int, x: np.ndarray, ids: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        n = len(ids)
        whole = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.full(n, cut, np.int32)), pa.array(np.full(n, side, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(group.tolist(), pa.string()), pa.array(ids), pa.array(list(x), pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(whole, names=names)

    def near(x: np.ndarray, ids: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
        pairs: list[tuple[int, int]] = []
        for step in range(1, min(window, len(x) - 1) + 1):
            found = np.flatnonzero((np.einsum("ij,ij->i", x[:-step], x[step:]) >= threshold) & (group[:-step] == group[step:]))
            pairs += zip(ids[found].tolist(), ids[found + step].tolist())
        return pairs

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        tail: tuple | None = None
        head: list[tuple] = []
        pairs: list[tuple[int, int]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _dense(batch.column("v")), batch.column("id").to_numpy()
            group = np.array([f"{p}\0{lab}" for p, lab in zip(batch.column("pass").to_pylist(), batch.column("label").to_pylist())], object)
            if sum(len(h[1]) for h in head) < window:
                head.append((x[:window], ids[:window], group[:window]))
            if tail is not None:
                x, ids, group = np.concatenate([tail[0], x]), np.concatenate([tail[1], ids]), np.concatenate([tail[2], group])
            pairs += near(x, ids, group)
            tail = (x[-window:], ids[-window:], group[-window:])
            if len(pairs) > 200_000:
                pairs = local_forest(pairs)
        if tail is not None:
            first = [np.concatenate(part)[:window] for part in zip(*head)]
            yield edge(here, 1, *first)  # the cut before this partition, and the one after it
            yield edge(here + 1, 0, *tail)
        yield pairs_of(pairs)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, held = None, []
        for batch in batches:
            x = _dense(batch.column("v"))
            for k, (c, g, i) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("cut", "group", "id")))):
                if c != cut and held:
                    yield pairs_of(near(*_stacked(held)))
                    held = []
                cut = c
                held.append((x[k], i, g))
        if held:
            yield pairs_of(near(*_stacked(held)))

    keyed = units.select("id", "label", "v").join(materialize(centres(units), "centres"), "label").mapInArrow(explode, "pass int, label string, key long, id long, v array<double>")
    dealt = keyed.repartitionByRange("pass", "label", "key", "id").sortWithinPartitions("pass", "label", "key", "id")
    ddl = "a long, b long, cut int, side int, place int, group string, id long, v array<double>"
    found = materialize(dealt.mapInArrow(compare, ddl), "windows")
    edges = found.where("cut is not null").repartition("cut").sortWithinPartitions("cut", "side", "place")
    return found.where("cut is null").select("a", "b").unionByName(edges.mapInArrow(across, ddl).select("a", "b"))


def _stacked(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.stack([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], object)


def _dense(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def count_links(members: DataFrame, threshold: float, block: int, large: int = LARGE_BLOCK) -> DataFrame:
    """(id, n): how many others of its component each vector links with, exactly. Linked vectors share their label.

    A component's members are dealt into blocks of about `block`, or, where that makes more than FEW_BLOCKS, into
    FEW_BLOCKS larger ones, of about `large` at most; each pair of blocks is one piece of work that fits a task's memory
    at any size of the component, and only counts leave a task. A member counts `copies` times.
    """
    ways = F.greatest(F.least(F.lit(FEW_BLOCKS), F.ceil(F.col("n") / block)), F.ceil(F.col("n") / large)).cast("int")
    sizes = members.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", ways).drop("n")
    dealt = members.join(sizes, "component").withColumn("mine", F.pmod(F.xxhash64("id", F.lit(4)), "blocks").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j")))
    work = dealt.withColumn("w", F.explode(pairs)).select("component", "w.i", "w.j", "mine", "id", "v", "copies")

    def linked(key: tuple, held: list[tuple]) -> list[tuple[int, int]]:
        left = [r for r in held if r[0] == key[1]]
        right = left if key[1] == key[2] else [r for r in held if r[0] == key[2]]
        if not left or not right:
            return []
        x, y = np.array([r[2] for r in left]), np.array([r[2] for r in right])
        mine, theirs = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        weights, others = np.array([r[3] for r in left], np.int64), np.array([r[3] for r in right], np.int64)
        for at in range(0, len(x), 1024):
            link = x[at : at + 1024] @ y.T >= threshold
            if right is left:
                link[np.arange(len(link)), np.arange(at, at + len(link))] = False
            mine[at : at + 1024] = link @ others
            theirs += weights[at : at + 1024] @ link
        sides = [(left, mine)] if right is left else [(left, mine), (right, theirs)]
        return [(r[1], int(n)) for rows, counts in sides for r, n in zip(rows, counts) if n]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        out: list[tuple[int, int]] = []

        def emit(rows: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["id", "n"])

        for batch in batches:
            x = _dense(batch.column("v"))
            columns = [batch.column(c).to_pylist() for c in ("component", "i", "j", "mine", "id", "copies")]
            for k, (c, i, j, mine, id_, copies) in enumerate(zip(*columns)):
                if (c, i, j) != key:
                    out += linked(key, held) if held else []
                    key, held = (c, i, j), []
                    if len(out) > 50_000:
                        yield emit(out)
                        out = []
                held.append((mine, id_, x[k], copies))
        out += linked(key, held) if held else []
        yield emit(out)

    counted = work.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(count, "id long, n long")
    return counted.groupBy("id").agg(F.sum("n").alias("n"))


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = SIMILAR, passes: int = PASSES, bits: int = BITS, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row per vector of df: vec_id, n_links, component_id, kept.

    Vectors that are null, zero, empty, or hold null or non-finite components, and rows without a label, link with
    nothing: 0 links, their own component, kept. Vectors of one width are compared with each other; each width takes its
    own passes. vec_id is taken as a key: rows that repeat an id get the most links and the smallest component of them; a
    row without an id has 0 links, no component, and is kept. An empty table gives no rows.
    """
    require(df, vec_id, vector, label)
    base = df.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and label is not null and v is not null and size(v) > 0")
    widths = [r[0] for r in base.select(F.size("v")).distinct().collect()]
    found = [_of_width(materialize(_units(base, w), "units"), threshold, passes, bits, window, block) for w in sorted(widths)]
    rows = df.select(F.col(vec_id).alias("vec_id"))
    if not found:
        found = [base.select("id", F.col("id").alias("component"), F.lit(0).cast("long").alias("n"))]
    both = found[0]
    for more in found[1:]:
        both = both.unionByName(more)
    both = both.groupBy(F.col("id").alias("_node")).agg(F.min("component").alias("component"), F.max("n").alias("n"))
    rows = rows.join(both, F.col("vec_id") == F.col("_node"), "left")
    component = F.coalesce("component", "vec_id")
    return rows.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _of_width(units: DataFrame, threshold: float, passes: int, bits: int, window: int, block: int) -> DataFrame:
    """(id, component, n) of unit vectors of one width."""
    single = materialize(representatives(units), "representatives")
    found = components(candidates(single, threshold, passes, bits, window))
    found = materialize(found, "components")
    members = single.join(found.withColumnRenamed("node", "id"), "id")
    links = count_links(members, threshold, block)
    linked = single.join(found.withColumnRenamed("node", "id"), "id", "left").join(links, "id", "left")
    own = linked.select("label", "v", F.coalesce("component", "id").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    return units.join(own, ["label", "v"]).select("id", "component", "n")
