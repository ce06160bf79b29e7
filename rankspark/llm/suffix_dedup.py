"""Removal of long repeated strings by a hash-compared suffix sort.

A byte goes if a string of `length` bytes that covers it starts anywhere else too. Strings are brought together by
anchors: the anchor of a string is the smallest-hashed block (of two fifths of its length) in it, so equal strings have equal anchors
at equal offsets. Blocks that are an anchor once only are dropped by a count; around each other one, the bytes of its
strings form a context. The contexts of an anchor are sorted by their suffixes from the anchor on, and by their prefixes
read backwards, in a merge sort that compares two suffixes in logarithmic time: prefix polynomial hashes and binary
search find their common extension. Neighbours' common extensions, verified byte by byte, tell for each offset which
strings are equal. Anchors with very many contexts take a second way with the same result: their strings' 128-bit hashes
are made distinct in each task, dealt by hash and paired, and the pairs' bytes are compared, run by run, before a string
counts as repeated; where two strings of one hash differ, they are told apart by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm import hashing
from rankspark.llm.common import free_name, materialize, require, tidy, with_fields

LENGTH = 400
#: An anchor with more occurrences than this takes the second way.
MANY = 1024
#: Up to so many runs to compare (40 bytes each) go to all executors; more are joined by an exchange of the texts.
FEW_RUNS = 100_000
#: Bytes of contexts that a task holds before it passes them on.
HELD = 64 << 20
_MASK = (1 << 64) - 1
_LOW = np.uint64((1 << 32) - 1)


def anchors(data: np.ndarray, length: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first string, strings) of each anchor, and prefix hashes: strings that start at first, first + 1,
    ... have this anchor. The smallest hash wins, the leftmost of equal ones."""
    n, none = len(data), np.zeros(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none, none, none, np.zeros(0, np.uint64)
    p = hashing.prefix(data)
    at = np.arange(n - block + 1)
    h = hashing.mix(hashing.substrings(p, at, at + block))
    key = (h & ~_LOW) | at.astype(np.uint64)
    span = length - block + 1  # blocks in a string
    tiled = np.concatenate([key, np.full(-len(key) % span, _MASK, np.uint64)]).reshape(-1, span)
    forward = np.minimum.accumulate(tiled, 1).ravel()
    backward = np.minimum.accumulate(tiled[:, ::-1], 1)[:, ::-1].ravel()
    strings = n - length + 1
    place = (np.minimum(backward[:strings], forward[span - 1 : span - 1 + strings]) & _LOW).astype(np.int64)
    cut = np.flatnonzero(np.diff(place)) + 1
    first = np.concatenate([[0], cut])
    return h[place[first]], place[first], first, np.diff(np.concatenate([first, [strings]])), p


class Contexts:
    """Prefix hashes of some byte strings that are aligned at an anchor, and comparisons of them."""

    def __init__(self, blobs: list[bytes], lefts: list[int]):
        self.blobs, self.lefts = blobs, lefts
        self.hashes = [hashing.prefix(np.frombuffer(b, np.uint8)).tolist() for b in blobs]
        self.inverse = hashing.powers(hashing.INVERSE, max(map(len, blobs)) + 1).tolist()

    def _same(self, i: int, a: int, j: int, b: int, n: int) -> bool:
        p, q, v = self.hashes[i], self.hashes[j], self.inverse
        return ((p[a + n] - p[a]) * v[a] - (q[b + n] - q[b]) * v[b]) & _MASK == 0

    def common(self, i: int, j: int, forward: bool) -> int:
        """Length of the common extension from the anchor on, or back from it, by binary search."""
        a, b = self.lefts[i], self.lefts[j]
        low, high = 0, min(len(self.blobs[i]) - a, len(self.blobs[j]) - b) if forward else min(a, b)
        while low < high:
            n = (low + high + 1) // 2
            if self._same(i, a, j, b, n) if forward else self._same(i, a - n, j, b - n, n):
                low = n
            else:
                high = n - 1
        return low

    def compare(self, i: int, j: int, forward: bool) -> int:
        n = self.common(i, j, forward)
        a, b = (self.lefts[i] + n, self.lefts[j] + n) if forward else (self.lefts[i] - n - 1, self.lefts[j] - n - 1)
        x = self.blobs[i][a] if 0 <= a < len(self.blobs[i]) else -1
        y = self.blobs[j][b] if 0 <= b < len(self.blobs[j]) else -1
        return x - y

    def order(self, forward: bool) -> tuple[list[int], list[int]]:
        """Contexts sorted, and the common extension of each with the one before. Hash collisions are found by a look
        at the bytes; then the bytes themselves are sorted."""
        by = sorted(range(len(self.blobs)), key=cmp_to_key(lambda i, j: self.compare(i, j, forward)))  # a merge sort
        shared = [0] + [self.common(i, j, forward) for i, j in zip(by, by[1:])]
        if all(self._verified(i, j, n, forward) for i, j, n in zip(by, by[1:], shared[1:])):
            return by, shared
        side = [b[c:] if forward else b[:c][::-1] for b, c in zip(self.blobs, self.lefts)]
        by = sorted(range(len(side)), key=side.__getitem__)
        return by, [0] + [_prefix_length(side[i], side[j]) for i, j in zip(by, by[1:])]

    def _verified(self, i: int, j: int, n: int, forward: bool) -> bool:
        a, b = self.lefts[i], self.lefts[j]
        x, y = (self.blobs[i][a : a + n], self.blobs[j][b : b + n]) if forward else (self.blobs[i][a - n : a], self.blobs[j][b - n : b])
        return x == y


def _prefix_length(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    return next((k for k in range(n) if x[k] != y[k]), n)


def repeated_offsets(blobs: list[bytes], lefts: list[int], counts: list[int], length: int, owners: list[int] | None = None) -> list[np.ndarray]:
    """For each context, the offsets d for which the string that starts d bytes before the anchor is in another too.

    Two contexts share the string at d if they agree on d bytes before and length - d bytes from the anchor on: both
    are runs in the two sorted orders, so their classes come from the neighbours' common extensions. With `owners`, the
    number of each context's document (-1: several), only strings of more than one document count.
    """
    if len(blobs) == 1 or (owners is not None and owners[0] >= 0 and len(set(owners)) == 1):
        return [np.zeros(0, np.int64) for _ in blobs]
    c = Contexts(blobs, lefts)
    if len(blobs) == 2:
        low, high = max(0, length - c.order(True)[1][1]), c.order(False)[1][1]
        return [np.arange(max(low, lefts[k] - counts[k] + 1), min(high, lefts[k]) + 1) for k in (0, 1)]
    d = np.arange(max(0, min(x - n + 1 for x, n in zip(lefts, counts))), max(lefts) + 1)
    classes = np.zeros((len(d), len(blobs)), np.int64)
    for forward, need in ((True, length - d), (False, d)):
        by, shared = c.order(forward)
        breaks = np.array(shared)[None, :] < need[:, None]
        breaks[:, 0] = True
        number = np.empty_like(classes)
        number[:, by] = np.cumsum(breaks, 1)
        classes = classes * (len(blobs) + 1) + number
    by = np.argsort(classes, 1, kind="stable")
    ordered = np.take_along_axis(classes, by, 1)
    new = np.ones(ordered.shape, bool)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, new.size))
    twice = sizes > 1
    if owners is not None:
        mine = np.array(owners)[by].ravel()
        twice &= (np.minimum.reduceat(mine, first) != np.maximum.reduceat(mine, first)) | (np.minimum.reduceat(mine, first) < 0)
    found = np.zeros(new.shape, bool)
    np.put_along_axis(found, by, np.repeat(twice, sizes).reshape(new.shape), 1)
    return [d[f & (d <= x) & (d > x - n)] for f, x, n in zip(found.T, lefts, counts)]


def _runs(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last) of each run of consecutive numbers."""
    if len(starts):
        starts = np.sort(starts)
        cut = np.flatnonzero(np.diff(starts) > 1)
        yield from zip(starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.concatenate([cut, [len(starts) - 1]])].tolist())


_PACKED = np.dtype([("h", "<u8"), ("g", "<u8"), ("rid", "<i8"), ("at", "<i8")])
_ROW = "kind int, key long, rid long, first long, lead int, n int, w int, blob binary"
_SPAN = "rid long, first long, n long, lrid long, lfirst long"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    names = ["kind", "key", "rid", "first", "lead", "n", "w", "blob"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _groups(x: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records sorted by hash, the group of each, and which groups hold a string twice (across: in two documents)."""
    x = x[np.lexsort((x["at"], x["rid"], x["g"], x["h"]))]
    new = np.concatenate([[True], (x["h"][1:] != x["h"][:-1]) | (x["g"][1:] != x["g"][:-1])])
    group, first = np.cumsum(new) - 1, np.flatnonzero(new)
    last = np.append(first[1:], len(x)) - 1
    return x, group, (x["rid"][first] != x["rid"][last]) if across else last > first


def _paired(x: np.ndarray, across: bool) -> list[tuple[int, int, int, int, int]]:
    """Runs (rid, first, strings, leader's rid, leader's first) of records that share a hash with another one.

    A group's first record leads it; across documents, records of the first one's document pair with the first record of
    another document.
    """
    if not len(x):
        return []
    x, group, twice = _groups(x, across)
    keep = twice[group]
    x, group = x[keep], group[keep]
    if not len(x):
        return []
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
    leader = first[number]
    member = np.arange(len(x)) != leader
    if across:
        other = np.flatnonzero(x["rid"] != x["rid"][leader])
        second = other[np.concatenate([[True], number[other][1:] != number[other][:-1]])]  # of each group, in order
        own = x["rid"] == x["rid"][leader]
        leader = np.where(own, second[number], leader)
        member |= own
    m, lead = x[member], x[leader[member]]
    gap = m["at"] - lead["at"]
    order = np.lexsort((m["at"], gap, lead["rid"], m["rid"]))
    m, lead, gap = m[order], lead[order], gap[order]
    cut = np.flatnonzero((m["rid"][1:] != m["rid"][:-1]) | (lead["rid"][1:] != lead["rid"][:-1]) | (gap[1:] != gap[:-1]) | (m["at"][1:] != m["at"][:-1] + 1))
    begin, end = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(m) - 1]])
    return list(zip(*(v.tolist() for v in (m["rid"][begin], m["at"][begin], m["at"][end] - m["at"][begin] + 1, lead["rid"][begin], lead["at"][begin]))))


def _spread(length: int, block: int, ways: int, across: bool):
    """Contexts and hashes of a task's texts at repeated anchors; what repeats inside the task is settled here.

    Rows of kind 0: a context; 1: packed hashes of strings; 2: strings that are known to repeat. Across documents, a
    string stands for its other places in a document, which are found when the document is cut.
    """

    def flush(held: dict, many: list[np.ndarray], raws: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for (key, lead, n, blob), owners in held.items():
            again = len({r for r, _ in owners}) > 1 if across else len(owners) > 1
            if again:
                rows += [(2, rid, rid, first, None, n, None, None) for rid, first in owners]
            rows.append((0, key, *owners[0], lead, n, 1 + again, blob))
            if len(rows) >= 5000:
                yield _rows(rows)
                rows = []
        if rows:
            yield _rows(rows)
        if many:
            x, group, twice = _groups(np.concatenate(many), across)
            runs = _paired(x[twice[group]], across)
            if all(raws[a][i : i + n - 1 + length] == raws[b][j : j + n - 1 + length] for a, i, n, b, j in runs):
                for at in range(0, len(runs), 10_000):
                    yield _rows([(2, r, r, i, None, n, None, None) for a, f, n, b, j in runs[at : at + 10_000] for r, i in ((a, f), (b, j))])
                x = x[~twice[group] | np.concatenate([[True], group[1:] != group[:-1]])]  # the others are known by now
            bucket = (x["h"] % np.uint64(ways)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(ways + 1))
            for b in range(ways):
                if cuts[b] < cuts[b + 1]:
                    yield _rows([(1, b, None, None, None, None, None, x[order[cuts[b] : cuts[b + 1]]].tobytes())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        many: list[np.ndarray] = []
        raws: dict[int, bytes] = {}
        size = 0
        for batch in batches:
            for rid, text, known, common in zip(*(batch.column(c).to_pylist() for c in ("rid", "text", "anchors", "many"))):
                raw = text.encode("utf-8")
                h, place, first, n, p = anchors(np.frombuffer(raw, np.uint8), length, block)
                signed = h.view(np.int64)
                for k in np.flatnonzero(np.isin(signed, np.array(known, np.int64))).tolist():
                    a, b, c = int(place[k]), int(first[k]), int(n[k])
                    blob = raw[b : b + c - 1 + length]
                    owners = held.setdefault((int(signed[k]), a - b, c, blob), [])
                    if across and owners and owners[-1][0] == rid:
                        continue
                    owners.append((rid, b))
                    size += len(blob) if len(owners) == 1 else 16
                wide = np.flatnonzero(np.isin(signed, np.array(common, np.int64)))
                if len(wide):
                    starts = np.concatenate([np.arange(first[k], first[k] + n[k]) for k in wide])
                    x = np.zeros(len(starts), _PACKED)
                    whole, half = hashing.substrings(p, starts, starts + length), hashing.substrings(p, starts, starts + length // 2)
                    x["h"], x["g"] = hashing.mix(whole), hashing.mix(hashing.mix(half) + whole * np.uint64(5))
                    x["rid"], x["at"] = rid, starts
                    if across:  # a periodic text has few strings at many places
                        x = x[np.sort(np.unique(x[["h", "g"]], return_index=True)[1])]
                    many.append(x)
                    raws[rid] = raw
                    size += x.nbytes + len(raw)
                if size > HELD:
                    yield from flush(held, many, raws)
                    held, many, raws, size = {}, [], {}, 0
        yield from flush(held, many, raws)

    return run


def _settle(length: int, across: bool):
    """Strings (rid, first, n) of rows that are sorted by kind and key: known to repeat, or, with a leader (lrid,
    lfirst), of the same hashes as the leader's."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] if k < len(r) else None for r in rows], pa.int64()) for k in range(5)], names=["rid", "first", "n", "lrid", "lfirst"])

    def contexts(group: list[tuple]) -> list[tuple]:
        distinct: dict[tuple, list] = {}
        for rid, first, lead, n, w, blob in group:
            distinct.setdefault((lead, n, blob), []).append((rid, first, w))
        keys = list(distinct)
        docs: dict[int, int] = {}
        again, owner = [], []
        for k in keys:
            several = len({r for r, _, _ in distinct[k]}) > 1
            again.append(several or max(w for _, _, w in distinct[k]) > 1 or (not across and len(distinct[k]) > 1))
            owner.append(-1 if again[-1] else docs.setdefault(distinct[k][0][0], len(docs)))
        found = repeated_offsets([k[2] for k in keys], [k[0] for k in keys], [k[1] for k in keys], length, owner if across else None)
        out = []
        for k, twice, offsets in zip(keys, again, found):
            lead, n = k[:2]
            for rid, first, _ in distinct[k]:
                if twice:
                    out.append((rid, first, n))
                else:
                    out += [(rid, first + lead - b, b - a + 1) for a, b in _runs(offsets)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, [], []

        def done() -> list[tuple]:
            if not group:
                return []
            return contexts(group) if key[0] == 0 else _paired(np.concatenate([np.frombuffer(b, _PACKED) for b in group]), across)

        for b in batches:
            for kind, k, rid, first, lead, n, w, blob in zip(*(b.column(c).to_pylist() for c in ("kind", "key", "rid", "first", "lead", "n", "w", "blob"))):
                if kind == 2:
                    out.append((rid, first, n))
                    continue
                if (kind, k) != key:
                    out += done()
                    key, group = (kind, k), []
                group.append((rid, first, lead, n, w, blob) if kind == 0 else blob)
            if len(out) > 20_000:
                yield batch(out)
                out = []
        out += done()
        yield batch(out)

    return run


def _compared(texts: DataFrame, runs: DataFrame, length: int, across: bool) -> DataFrame:
    """(rid, first, n) of runs whose bytes equal their leaders', theirs and the leaders'. Strings of runs that differ,
    though their hashes are equal, are grouped by their bytes."""
    few = runs.count() <= FEW_RUNS
    keys = ["rid", "first", "n", "lrid", "lfirst"]
    blob = F.expr(f"substring(cast(text as binary), cast(at + 1 as int), cast(n + {length - 1} as int))")
    sides = []
    for side, (r, at) in enumerate((("rid", "first"), ("lrid", "lfirst"))):
        wanted = runs.withColumn("at", F.col(at)).withColumn("_own", F.col(r))
        own = texts.select(F.col("rid").alias("_own"), "text")
        sides.append(own.join(F.broadcast(wanted) if few else wanted, "_own").select(*keys, F.lit(side).alias("side"), blob.alias("blob")))
    pairs = sides[0].unionByName(sides[1]).groupBy(*keys).agg(*(F.max(F.when(F.col("side") == k, F.col("blob"))).alias(f"blob{k}") for k in (0, 1)))
    same = F.col("blob0") == F.col("blob1")
    checked = materialize(pairs.select(*keys, *(F.when(~same, F.col(c)).alias(c) for c in ("blob0", "blob1"))), "compared")
    equal = checked.where("blob0 is null")
    out = equal.select("rid", "first", "n").unionByName(equal.select(F.col("lrid").alias("rid"), F.col("lfirst").alias("first"), "n"))
    differ = checked.where("blob0 is not null")
    if differ.isEmpty():
        return out
    one = lambda r, at, b: differ.select(F.col(r).alias("rid"), F.col(at).alias("at"), F.col(b).alias("blob"), F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("k"))
    strings = one("rid", "first", "blob0").unionByName(one("lrid", "lfirst", "blob1"))
    strings = strings.select("rid", (F.col("at") + F.col("k")).alias("first"), F.expr(f"substring(blob, k + 1, {length})").alias("s")).distinct()
    n = F.col("last") > F.col("least") if across else F.col("places") > 1
    again = strings.groupBy("s").agg(F.min("rid").alias("least"), F.max("rid").alias("last"), F.count("*").alias("places")).where(n).select("s")
    return out.unionByName(strings.join(again, "s", "left_semi").select("rid", "first", F.lit(1).cast("long").alias("n")))


def repeats(docs: DataFrame, length: int = LENGTH, block: int | None = None, many: int = MANY, across: bool = False) -> DataFrame:
    """docs: (rid, text), rid the key of what makes a row. (rid, spans): the repeated strings as an array of (first, n)."""
    block = block or length * 2 // 5

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rids, found, weights = [], [], []
            for rid, text in zip(b.column("rid").to_pylist(), b.column("text").to_pylist()):
                if len(text) * 4 >= length:
                    h, c = np.unique(anchors(np.frombuffer(text.encode("utf-8"), np.uint8), length, block)[0], return_counts=True)
                    rids.append(np.full(len(h), rid, np.int64))
                    found.append(h.view(np.int64))
                    weights.append(c.astype(np.int64))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (found, rids, weights)], names=["anchor", "rid", "w"])

    seen = materialize(docs.mapInArrow(tidy(__name__, scan), "anchor long, rid long, w long"), "anchors")
    enough = F.col("least") != F.col("last") if across else F.col("n") > 1
    counts = seen.groupBy("anchor").agg(F.sum("w").alias("n"), F.min("rid").alias("least"), F.max("rid").alias("last")).where(enough).select("anchor", (F.col("n") > many).alias("many"))
    kept = seen.drop("w").join(counts, "anchor").groupBy("rid").agg(F.collect_set(F.when(~F.col("many"), F.col("anchor"))).alias("anchors"), F.collect_set(F.when(F.col("many"), F.col("anchor"))).alias("many"))
    texts = materialize(docs.join(kept, "rid"), "repeat-texts")
    ways = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = texts.mapInArrow(tidy(__name__, _spread(length, block, ways, across)), _ROW)
    settled = materialize(spread.repartition("key").sortWithinPartitions("kind", "key").mapInArrow(tidy(__name__, _settle(length, across)), _SPAN), "strings")
    found, runs = settled.where("lrid is null").select("rid", "first", "n"), settled.where("lrid is not null")
    if not runs.isEmpty():
        found = found.unionByName(_compared(texts, runs, length, across))
    return found.groupBy("rid").agg(F.collect_list(F.struct("first", "n")).alias("spans"))


def other_places(raw: bytes, spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Spans (first, 1) at which the document has the strings of some spans again."""
    data = np.frombuffer(raw, np.uint8)
    starts = np.arange(len(data) - length + 1)
    h = hashing.substrings(hashing.prefix(data), starts, starts + length)
    found = np.zeros(len(starts), bool)
    for first, n in spans:
        found[first : first + n] = True
    again = np.isin(h, h[found]) & ~found
    if not again.any():
        return []
    strings = {raw[i : i + length] for i in np.flatnonzero(found & np.isin(h, h[again])).tolist()}
    return [(i, 1) for i in np.flatnonzero(again).tolist() if raw[i : i + length] in strings]


def covered(spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes (begin, end) that strings (first, n) cover."""
    out: list[list[int]] = []
    for first, n in sorted(spans):
        end = first + n - 1 + length
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(a, b) for a, b in out]


#: What is left of a text: its bytes; its characters, where a cut falls inside a character without that; its digest.
REST = {"bytes": "binary", "text": "string", "sha256": "string"}


def _row_key(doc_id: str, text: str, df: DataFrame):
    """A 64-bit key of (doc_id, text) that no two different rows of df share, as 128 bits of hashes tell."""
    for seed in range(16):
        key, other = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), F.xxhash64(F.col(text), F.col(doc_id), F.lit(seed + 101))
        rows = df.select(key.alias("k"), other.alias("o"))
        if rows.groupBy("k").agg((F.min("o") != F.max("o")).alias("clash")).where("clash").isEmpty():
            return key
    raise RuntimeError("row keys collide with every seed")


def remove_repeats(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, rest: str = "bytes", kept: str = "kept", removed: str = "n_removed", spans: str = "n_spans",
    block: int | None = None, across: bool = False, words: int = 0, many: int = MANY,
) -> DataFrame:
    """df with the number of bytes removed, the number of maximal removed runs, and what is left of the text (see REST).

    Null texts are empty. Strings are judged on the input: all places of a repeated string go, the first too, those in
    the same text too; overlapping ones count. Rows that repeat a document repeat its strings. With `across`, a string
    counts only if two documents hold it (rows with the same id and text are one document). Runs of fewer than `words`
    words stay. `block` is the anchors' width, two fifths of the length if none is given. Texts under `length` bytes
    stay whole. An empty table gives no rows. Other columns named like the results are replaced.
    """
    require(df, doc_id, text)
    base = df.select([F.col(f"`{c}`") for c in df.columns if c in (doc_id, text) or c.lower() not in {kept.lower(), removed.lower(), spans.lower()}])
    rid, whole, found, a, b, c = (free_name(base, x) for x in ("_rid", "_whole", "_found", "_removed", "_spans", "_kept"))
    base = base.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    base = base.withColumn(rid, _row_key(doc_id, whole, base))
    strings = repeats(base.select(F.col(rid).alias("rid"), F.col(whole).alias("text")), length, block, many, across)
    joined = base.join(strings.toDF(rid, found), rid, "left").drop(rid)
    ddl = f"`{a}` long, `{b}` long, `{c}` {REST[rest]}"
    schema = with_fields(joined.drop(whole, found).schema, ddl)
    left = {"bytes": bytes, "text": lambda x: x.decode("utf-8", "ignore"), "sha256": lambda x: hashlib.sha256(x).hexdigest()}[rest]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, strings in zip(batch.column(whole).to_pylist(), batch.column(found).to_pylist()):
                raw, at, parts = t.encode("utf-8"), 0, []
                found_here = [(s["first"], s["n"]) for s in strings or ()]
                if across and found_here:
                    found_here += other_places(raw, found_here, length)
                gone = covered(found_here, length)
                gone = [(begin, end) for begin, end in gone if not words or len(raw[begin:end].split()) >= words]
                for begin, end in gone:
                    parts.append(raw[at:begin])
                    at = end
                rest_ = b"".join([*parts, raw[at:]])
                out.append((len(raw) - len(rest_), len(gone), left(rest_)))
            kinds = [pa.int64(), pa.int64(), pa.binary() if rest == "bytes" else pa.string()]
            through = [batch.column(x) for x in schema.names[:-3]]
            yield pa.RecordBatch.from_arrays([*through, *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], names=schema.names)

    done = joined.mapInArrow(tidy(__name__, cut), schema)
    values = {removed: a, spans: b, kept: c}
    return done.select(*[F.col(f"`{x}`") for x in df.columns if x in base.columns and x not in values], *[F.col(v).alias(k) for k, v in values.items()])


def repeat_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans and the SHA-256 of its remaining bytes."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"))
    found = remove_repeats(rows, "doc_id", "text", length, "sha256", kept="kept_sha256")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
