"""Connected components of edges in a table, by rounds of joins; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import materialize, tidy


def local_forest(pairs) -> list[tuple[int, int]]:
    """(node, smallest node of its component) for the nodes of some pairs: union-find in one task."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in list(root)]


def _contract(batches, a: str, b: str):
    """Edges of one task as stars: at most one row for each node the task has seen."""
    import pyarrow as pa

    held: list[tuple[int, int]] = []

    def out(forest):
        forest = [f for f in forest if f[0] != f[1]]
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in forest], pa.int64()), pa.array([f[1] for f in forest], pa.int64())], names=[a, b])

    for batch in batches:
        held += zip(batch.column(a).to_pylist(), batch.column(b).to_pylist())
        if len(held) > 400_000:
            held = local_forest(held)
            if len(held) > 300_000:  # many nodes: pass them on, later rounds join them
                yield out(held)
                held = []
    if held:
        yield out(local_forest(held))


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node that is reachable. Nodes without an edge aren't in the result.

    Large-star and small-star rounds: every node is linked to the smallest of its neighbours, until the edges form
    stars. A round joins rows with per-node minima that were aggregated before the exchange; a hub's rows are spread by
    adaptive execution. Rounds grow with the logarithm of the longest path; each is written to the shared folder.
    """
    now = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    now = materialize(now.mapInArrow(tidy("", lambda it: _contract(it, "a", "b")), "a long, b long").distinct(), "edges")
    last = None
    for _ in range(most_rounds):
        # large star: each neighbour that is larger than a node goes to the node's smallest neighbour
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: the smaller neighbours of a node, and the node, go to the smallest of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.hash("a", "b").cast("long")), F.lit(0))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    stars = now.groupBy("a").agg(F.min("b").alias("m"))
    roots = stars.select(F.col("m").alias("node")).distinct().withColumn("component", F.col("node"))
    return stars.select(F.col("a").alias("node"), F.col("m").alias("component")).unionByName(roots)
