"""N-gram Jaccard join by signature trees.

A document's set holds hashes of its distinct five-word shingles; equal sets are one class with one representative.
Representatives meet in the buckets of their smallest shingle hashes, those of very common shingles last: two sets with
a Jaccard similarity of 0.75 share one of the first 25 of their union unless 25 independent draws all miss, a chance
of 0.25**25, and sets of at most 96 shingles use their whole prefix. In a bucket, a signature tree - nodes with
OR-combined token bitmaps and size ranges - is traversed against itself, and node pairs go whose largest possible
overlap is too small. What is left is verified by the exact sets, in two rounds: a spanning forest of each bucket's
candidates, then every candidate pair that still lies between two components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm import hashing
from rankspark.llm.common import materialize, require, tidy
from rankspark.llm.components import components

WORDS = 5
#: Similarity as a fraction: intersection * OVER >= LEAST * union.
LEAST, OVER = 75, 100
DRAWS, POOL = 25, 40
#: Members of a bucket that one task holds at a time.
GROUP = 1024
#: Ids (8 bytes each), or blocks of buckets, that are sent to every executor at most; more are joined by an exchange.
FEW = 1_000_000
LEAF, FANOUT = 8, 8
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; of all its words as one, if there are fewer."""
    data = np.frombuffer((text or "").encode("utf-8").translate(_LOWER), np.uint8)
    edge = np.diff(np.concatenate([[0], (~_SPACE[data]).view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.zeros(0, np.uint64)
    word = hashing.mix(hashing.substrings(hashing.prefix(data), begin, end) + (end - begin).astype(np.uint64))
    take = min(words, len(word))
    x = word[: len(word) - take + 1] + np.uint64(take)
    for k in range(1, take):
        x = hashing.mix(x * np.uint64(3) + word[k : len(word) - take + 1 + k])
    return np.unique(x)


def needed_overlap(n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray | int:
    """The least intersection of two sets of these sizes that links: ceil of LEAST * (n + m) / (LEAST + OVER)."""
    return -(-(LEAST * (n + m)) // (LEAST + OVER))


def width_of(n: int) -> int:
    """Bits of a set's bitmap: a power of two, four times the set's size at least."""
    return max(256, 1 << (4 * max(n, 1) - 1).bit_length())


def bitmap(tokens: np.ndarray) -> np.ndarray:
    width = width_of(len(tokens))
    bits = np.zeros(width, np.uint8)
    bits[((tokens >> np.uint64(20)) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def signature(tokens: np.ndarray) -> np.ndarray:
    """The smallest hashes that buckets are made of: the whole prefix of a small set, a pool of a large one's."""
    n = len(tokens)
    prefix = n - -(-LEAST * n // OVER) + 1
    return tokens[: min(n, max(POOL, 0) if prefix > DRAWS else prefix + POOL - DRAWS)]


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, n, set_key, tokens, bits) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                sets = [shingles(t) for t in batch.column("text").to_pylist()]
                columns = [
                    batch.column("id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([signature(s).view(np.int64) for s in sets], pa.list_(pa.int64())),
                    pa.array([bitmap(s).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "set_key", "tokens", "bits"])

    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return base.mapInArrow(tidy(__name__, run), "id long, n long, set_key binary, tokens array<long>, bits binary")


class SignatureTree:
    """Sets of one bitmap width by size: leaves of LEAF sets, nodes of FANOUT children."""

    def __init__(self, members: np.ndarray, sizes: np.ndarray, bits: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        self.members, sizes, bits = members[order], sizes[order], bits[order]
        spare = sizes - np.bitwise_count(bits).sum(1, dtype=np.int64)  # tokens that share a bit with another
        self.levels = [(bits, sizes, sizes, spare)]
        step = LEAF
        while len(self.levels[-1][0]) > 1:
            b, low, high, extra = self.levels[-1]
            cuts = np.arange(0, len(b), step)
            self.levels.append((np.bitwise_or.reduceat(b, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(extra, cuts)))
            step = FANOUT

    @property
    def bits(self) -> int:
        return self.levels[0][0].shape[1]

    def children(self, level: int) -> int:
        return LEAF if level == 1 else FANOUT


def _may_link(x: tuple, y: tuple, i: np.ndarray, j: np.ndarray, fold: int) -> tuple[np.ndarray, np.ndarray]:
    """Which node pairs have a largest possible overlap that suffices, and the similarity it stands for. fold: y's bitmap is that many times x's width."""
    keep, likeness = np.zeros(len(i), bool), np.zeros(len(i))
    for at in range(0, len(i), 100_000):
        a, b = i[at : at + 100_000], j[at : at + 100_000]
        ybits = y[0][b]
        if fold > 1:
            ybits = np.bitwise_or.reduce(ybits.reshape(len(b), fold, -1), axis=1)
        common = np.bitwise_count(x[0][a] & ybits).sum(1, dtype=np.int64)
        spare = x[3][a] if fold > 1 else np.minimum(x[3][a], y[3][b])
        most = np.minimum(np.minimum(x[2][a], y[2][b]), common + spare)
        keep[at : at + 100_000] = most >= needed_overlap(x[1][a], y[1][b])
        likeness[at : at + 100_000] = most / np.maximum(x[1][a] + y[1][b] - most, 1)
    return keep, likeness[keep]


def dual_traversal(x: SignatureTree, y: SignatureTree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of members of two trees (or of one) that may link, and how alike they can be at most; y's bitmaps are as
    wide as x's or wider."""
    same, fold = x is y, y.bits // x.bits
    lx, ly = len(x.levels) - 1, len(y.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        keep, likeness = _may_link(x.levels[lx], y.levels[ly], i, j, fold)
        i, j = i[keep], j[keep]
        if not len(i) or (lx == 0 and ly == 0):
            break
        if lx >= ly:
            i, j = _descend(i, j, x.children(lx), len(x.levels[lx - 1][0]))
            lx -= 1
            if same:
                j, i = _descend(j, i, x.children(ly), len(x.levels[ly - 1][0]))
                ly -= 1
        else:
            j, i = _descend(j, i, y.children(ly), len(y.levels[ly - 1][0]))
            ly -= 1
        if same:
            once = i <= j if lx else i < j
            i, j = i[once], j[once]
    if same:
        once = i < j
        i, j, likeness = i[once], j[once], likeness[once]
    return x.members[i], y.members[j], likeness


def _descend(parent: np.ndarray, other: np.ndarray, fanout: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    child = (parent[:, None] * fanout + np.arange(fanout)).ravel()
    other = np.repeat(other, fanout)
    real = child < n
    return child[real], other[real]


def bucket_candidates(sizes: np.ndarray, bitmaps: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places in a bucket that may link, and how alike they can be: one tree for each bitmap width; only neighbouring widths can link."""
    widths = np.array([len(b) for b in bitmaps])
    trees = {}
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        trees[w] = SignatureTree(at, sizes[at], np.frombuffer(b"".join(bitmaps[k] for k in at), np.uint64).reshape(len(at), -1))
    left, right, like = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for w, tree in trees.items():
        for other in (w, 2 * w):
            if other in trees:
                a, b, likeness = dual_traversal(tree, trees[other])
                left.append(a)
                right.append(b)
                like.append(likeness)
    return np.concatenate(left), np.concatenate(right), np.concatenate(like)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, list[list]]]:
    """Rows of one key after another from sorted batches."""
    key, held = None, [[] for _ in columns]
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        values = [batch.column(c).to_pylist() for c in columns]
        at = 0
        while at < len(marks):
            upto = at + 1
            while upto < len(marks) and marks[upto] == marks[at]:
                upto += 1
            if marks[at] != key:
                if key is not None:
                    yield key, held
                key, held = marks[at], [[] for _ in columns]
            for h, v in zip(held, values):
                h += v[at:upto]
            at = upto
    if key is not None:
        yield key, held


def _pair_batch(pairs) -> pa.RecordBatch:
    a, b = (pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64()))
    return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket part's candidates a spanning forest of the likeliest pairs, by ids where they are equally likely,
    so that buckets choose the same pairs."""
    out: set[tuple[int, int]] = set()
    for _, (ids, n, bits) in _groups(batches, ["token", "part"], ["id", "n", "bits"]):
        if len(ids) < 2:
            continue
        who = np.array(ids)
        first = np.unique(who, return_index=True)[1]
        who, sizes = who[first], np.array(n)[first]
        i, j, likeness = bucket_candidates(sizes, [bits[k] for k in first])
        low, high = np.minimum(who[i], who[j]), np.maximum(who[i], who[j])
        order = np.lexsort((high, low, -likeness))
        root = {x: x for x in who.tolist()}

        def find(x: int, root=root) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(low[order].tolist(), high[order].tolist()):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                out.add((a, b))
        if len(out) > 100_000:
            yield _pair_batch(list(out))
            out = set()
    yield _pair_batch(list(out))


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every candidate pair of a bucket that lies between two components."""
    out: set[tuple[int, int]] = set()
    for key, (ids, n, bits, component, mine) in _groups(batches, ["token", "i", "j"], ["id", "n", "bits", "component", "mine"]):
        who, comp, side = np.array(ids), np.array(component), np.array(mine)
        if len(who) < 2 or (comp == comp[0]).all():
            continue
        a, b, _ = bucket_candidates(np.array(n), bits)
        keep = (comp[a] != comp[b]) & (who[a] != who[b])
        if key[1] != key[2]:
            keep &= side[a] != side[b]
        out.update(zip(np.minimum(who[a], who[b])[keep].tolist(), np.maximum(who[a], who[b])[keep].tolist()))
        if len(out) > 100_000:
            yield _pair_batch(list(out))
            out = set()
    yield _pair_batch(list(out))


def exact_sets(docs: DataFrame, ids: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, tokens) of some documents: their shingles' 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                blobs = [shingles(t).tobytes() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(blobs, pa.binary())], names=["id", "tokens"])

    few = ids.count() <= FEW
    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(ids) if few else ids, "id", "left_semi")
    return base.mapInArrow(tidy(__name__, run), "id long, tokens binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose exact sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, last, x = [], None, None
            for a, b, s, t in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "sa", "sb"))):
                if a != last:
                    last, x = a, np.frombuffer(s, np.uint64)
                y = np.frombuffer(t, np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                if same >= needed_overlap(len(x), len(y)):
                    out.append((a, b))
            yield _pair_batch(out)

    right = pairs.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("sb")), "b")
    return right.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("sa")), "a").mapInArrow(tidy(__name__, run), "a long, b long")


def _buckets(reps: DataFrame, total: int) -> DataFrame:
    """(id, n, token, size, leader, bits): members of buckets of two and more."""
    pool = reps.select("id", "n", F.posexplode("tokens").alias("at", "token"))
    counts = pool.groupBy("token").agg(F.count("*").alias("size"), F.min("id").alias("leader")).where("size > 1")
    counts = materialize(counts, "bucket-sizes")
    common = counts.where(F.col("size") > max(1024, total // 25_000)).select("token", F.lit(1).alias("hot"))  # a million rows at most
    prefix = F.col("n") - F.ceil(F.col("n") * LEAST / OVER) + 1
    ranked = reps.select("id", "n", F.least(F.lit(DRAWS).cast("long"), prefix).alias("draws"), "tokens")
    hot_tokens = np.sort(common.select("token").toArrow()["token"].to_numpy().astype(np.int64))  # 8 bytes each
    if len(hot_tokens):
        spark = reps.sparkSession
        handle = spark.sparkContext.broadcast(hot_tokens)

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hot = handle.value
            for batch in batches:
                out = []
                for k, tokens in zip(batch.column("draws").to_pylist(), batch.column("tokens").to_pylist()):
                    t = np.array(tokens, np.int64)
                    at = np.minimum(np.searchsorted(hot, t), len(hot) - 1)
                    last = hot[at] == t
                    chosen = np.concatenate([t[~last], t[last]])
                    out.append(chosen if last.any() and k < DRAWS else chosen[:k])
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), pa.array(out, pa.list_(pa.int64()))], names=["id", "n", "tokens"])

        chosen = ranked.mapInArrow(tidy(__name__, choose), "id long, n long, tokens array<long>")
    else:
        chosen = ranked.select("id", "n", F.slice("tokens", F.lit(1), F.col("draws").cast("int")).alias("tokens"))
    drawn = chosen.select("id", "n", F.explode("tokens").alias("token")).join(counts, "token")
    return materialize(drawn.join(reps.select("id", "bits"), "id"), "buckets")


def _meetings(members: DataFrame) -> DataFrame:
    """(token, i, j, mine, id, n, bits, component): members of buckets with several components, sent to each pair of
    blocks (i, j) of their bucket in which they may meet another component.

    A component with more than GROUP members in a bucket has blocks of its own, which never meet each other, so a bucket
    of M members of one component and a few of others costs M / GROUP meetings of these few, not M * M / GROUP.
    """
    parts = members.groupBy("token", "component").agg(F.count("*").alias("c"))
    owner = F.when(F.col("c") > GROUP, F.col("component"))
    blocks = parts.groupBy("token", owner.alias("owner")).agg(F.sum("c").alias("members"), F.count("*").alias("components"))
    ways = F.ceil(F.col("members") / GROUP)
    blocks = blocks.groupBy("token").agg(F.sum("components").alias("all"), F.collect_list(F.struct("owner", ways.alias("ways"))).alias("blocks"))
    blocks = materialize(blocks.where("all > 1").select("token", "blocks"), "blocks")
    few = (blocks.agg(F.sum(F.size("blocks"))).first()[0] or 0) <= FEW
    placed = members.join(F.broadcast(blocks) if few else blocks, "token")  # one exchange of bitmaps at most; what follows is inside a row
    big = F.get(F.filter("blocks", lambda b: b["owner"] == F.col("component")), F.lit(0))["ways"]
    small = F.get(F.filter("blocks", lambda b: b["owner"].isNull()), F.lit(0))["ways"]
    placed = placed.withColumn("owner", F.when(big.isNotNull(), F.col("component"))).withColumn("ways", F.coalesce(big, small))
    mine = F.xxhash64("owner", F.pmod(F.xxhash64("id", F.lit(9)), F.col("ways")))
    met = F.filter("blocks", lambda b: F.col("owner").isNull() | b["owner"].isNull() | (b["owner"] != F.col("owner")))
    others = F.flatten(F.transform(met, lambda b: F.transform(F.sequence(F.lit(0).cast("long"), b["ways"] - 1), lambda k: F.xxhash64(b["owner"], k))))
    work = placed.select("token", mine.alias("mine"), "id", "n", "bits", "component", F.explode(others).alias("other"))
    return work.select("token", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "n", "bits", "component")


def join_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id as `id`, n_shingles, and component_id, the smallest id that links reach.

    Null and blank texts have no shingles and link with nothing. Documents with equal sets are one class; rows that
    repeat an id get the same result. An empty table gives no rows.
    """
    require(docs, doc_id, text)
    sigs = materialize(signatures(docs, doc_id, text), "signatures")
    classes = materialize(sigs.where("n > 0").groupBy("set_key").agg(F.min("id").alias("rep")), "classes")
    own = F.array_contains(F.array(sigs["set_key"]), classes["set_key"])  # no key of the join: rows stay dealt by id alone
    reps = sigs.join(classes, (sigs["id"] == classes["rep"]) & own).select("id", "n", "tokens", "bits").dropDuplicates(["id"])
    reps = materialize(reps, "reps")
    buckets = _buckets(reps, reps.count())
    parts = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("size") / GROUP)))).cast("long")
    dealt = buckets.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id", F.lit(9)), "parts"))
    leaders = dealt.where("parts > 1 and id = leader").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    work = dealt.unionByName(leaders).select("token", "part", "id", "n", "bits")
    tested = materialize(work.repartition("token", "part").sortWithinPartitions("token", "part").mapInArrow(tidy(__name__, _forest), "a long, b long").distinct(), "forest")
    ids = materialize(tested.select(F.col("a").alias("id")).unionByName(tested.select(F.col("b").alias("id"))).distinct(), "ids")
    sets = materialize(exact_sets(docs, ids, doc_id, text), "sets").dropDuplicates(["id"])
    edges = materialize(verified(tested, sets), "edges")
    found = materialize(components(edges), "components-1")
    # what the forests left apart: candidates between components, in buckets that hold more than one
    with_comp = buckets.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    with_comp = materialize(with_comp, "buckets-2")
    left = _meetings(with_comp).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(tidy(__name__, _between), "a long, b long").distinct()
    left = materialize(left.join(tested, ["a", "b"], "left_anti"), "between")
    if left.isEmpty():
        final = found
    else:
        more = left.select(F.col("a").alias("id")).unionByName(left.select(F.col("b").alias("id"))).distinct().join(sets.select("id"), "id", "left_anti")
        more = materialize(more, "ids-2")
        all_sets = materialize(exact_sets(docs, more, doc_id, text), "sets-2").dropDuplicates(["id"]).unionByName(sets)
        final = materialize(components(edges.unionByName(verified(left, all_sets))), "components-2")
    rows = sigs.select("id", "n", "set_key").join(classes, "set_key", "left").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    return rows.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))
