"""Packing of token sequences by bin completion with branch and bound.

Documents become pieces of at most `capacity` tokens. Only how many pieces have each length matters for the packing, so
the driver plans over a histogram of `capacity` numbers, whatever the size of the corpus: around the largest length left,
undominated fillings are enumerated, the best is used as often as the counts allow, and the search goes back to other
fillings while the waste so far can still beat the incumbent, which best fit gives at the start. Executors then give
each piece its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankspark.llm import latin
from rankspark.llm.common import materialize, per_worker, require, tidy, trim

CAPACITY = 2048
END = 0
#: The pattern of the word tokenizer's pieces, for Latin text.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[{latin.LETTERS}]+|[{latin.NUMBERS}]|[^{latin.SPACES}{latin.LETTERS}{latin.NUMBERS}]+"
CACHED = 400_000
#: Pieces that one task ranks, at any size of the table.
MOST_RANKED = 2_000_000


class WordTokenizer:
    """The tokenizers library's ids, looked up by word: pieces don't influence each other.

    Texts with characters outside the Latin blocks, whose properties differ between Unicode versions, and texts with a
    special token's string are given to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.pattern = re.compile(PIECES)
        self.cache: dict[str, bytes] = {}
        self.whole = re.compile("|".join([latin.BEYOND.pattern, *(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values())]))
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        probe = "It's a Test  of 123 ÉCOLE -- don't\tI'LL x9y <>"
        self.by_word = self.encode_all([probe])[0].tolist() == self._library(probe).tolist()

    by_word = True

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, words: list[str]) -> None:
        """Ids of words that weren't met yet: many in one call, cut where a token ends a word."""
        for at in range(0, len(words), 4000):
            part = words[at : at + 4000]
            ids = self._library(" ".join(part))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                self.cache.update(zip(part, (x.tobytes() for x in np.split(ids, cuts[:-1]))))
            else:
                self.cache.update((w, self._library(w).tobytes()) for w in part)

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; a null text has none. Texts of a vocabulary of another kind go to the library whole."""
        trim(self.cache, CACHED)
        pieces = [None if t and (not self.by_word or self.whole.search(t)) else self.pattern.findall(unicodedata.normalize("NFC", t or "").lower()) for t in texts]
        self._learn(list(set().union(*(p for p in pieces if p)).difference(self.cache)))
        get = self.cache.__getitem__
        return [self._library(t) if p is None else np.frombuffer(b"".join(map(get, p)), "<u4") for t, p in zip(texts, pieces)]


def pieces(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, keep_ids: bool = False, lasting: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if wanted, ids. A null text is an empty one: id 0
    alone. lasting: workers keep the words they have looked up for their next task."""
    require(df, doc_id, text)
    base = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = per_worker(WordTokenizer, tokenizer)
        for batch in (whole.slice(at, 2000) for whole in batches for at in range(0, whole.num_rows, 2000)):
            rows: list[tuple] = []
            ids_kept: list[np.ndarray] = []
            owners: list[int] = []
            for k, ids in enumerate(words.encode_all(batch.column("text").to_pylist())):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                for p, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    owners.append(k)
                    rows.append((p, at, len(part), zlib.crc32(part.tobytes())))
                    if keep_ids:
                        ids_kept.append(part.astype(np.int32))
            columns = [batch.column("doc_id").take(pa.array(owners)), pa.array([r[0] for r in rows], pa.int32())]
            columns += [pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(ids_kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    forget = None if lasting else lambda: per_worker(WordTokenizer, tokenizer).cache.clear()
    return base.mapInArrow(tidy(__name__, run, forget), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


@dataclass(frozen=True)
class Pattern:
    """A way to fill a sequence, and how many sequences are filled so: lengths with how often each is used."""

    lengths: tuple[tuple[int, int], ...]
    times: int

    @property
    def size(self) -> int:
        return sum(n * k for n, k in self.lengths)


def _times(counts: np.ndarray, filling: tuple[int, ...]) -> int:
    need: dict[int, int] = {}
    for n in filling:
        need[n] = need.get(n, 0) + 1
    return min(int(counts[n]) // k for n, k in need.items())


def _take(counts: np.ndarray, filling: tuple[int, ...], times: int) -> np.ndarray:
    left = counts.copy()
    for n in filling:
        left[n] -= times
    return left


def _largest(counts: np.ndarray, upto: int) -> int:
    """The largest length with a piece left, upto at most; 0 if there is none."""
    found = np.flatnonzero(counts[1 : upto + 1])
    return int(found[-1]) + 1 if len(found) else 0


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Around the largest piece left, always the largest that fits."""
    out, counts = [], counts.copy()
    while n := _largest(counts, capacity):
        filling, room = [n], capacity - n
        left = counts.copy()
        left[n] -= 1
        while room and (n := _largest(left, room)):
            take = min(int(left[n]), room // n)
            filling += [n] * take
            left[n] -= take
            room -= n * take
        times = _times(counts, tuple(filling))
        out.append((tuple(filling), times))
        counts = _take(counts, tuple(filling), times)
    return out


#: Budgets of the search, which bound the driver's work, not the rows packed: fillings tried around a piece, other
#: lengths tried at a place, nodes of an enumeration and of the search. Each may be None: without a bound.
MOST_FILLINGS, MOST_TRIED, ENUMERATED, SEARCHED = 6, 12, 1500, 6000


@dataclass(frozen=True)
class Budget:
    """What the search may spend; UNBOUNDED proves the fewest sequences, in time that can grow exponentially."""

    fillings: float = MOST_FILLINGS
    tried: float = MOST_TRIED
    enumerated: float = ENUMERATED
    searched: float = SEARCHED


UNBOUNDED = Budget(math.inf, math.inf, math.inf, math.inf)


def fillings(counts: np.ndarray, capacity: int, budget: Budget = Budget()) -> list[tuple[int, ...]]:
    """Undominated fillings around the largest piece, the least waste first.

    Dominated, and left out: a filling to which a piece can be added, or in which a larger piece left fits instead of one.
    """
    most, spent = budget.fillings, 0
    first = _largest(counts, capacity)
    sizes = np.flatnonzero(counts)[::-1].tolist()
    found: list[tuple[int, tuple[int, ...]]] = []
    least = sizes[-1]
    exhaustive = budget.fillings == math.inf

    def search(room: int, chosen: list[int], upto: int) -> None:
        nonlocal spent
        spent += 1
        if sum(w == 0 for w, _ in found) >= most or spent > budget.enumerated:
            return
        n = min(upto, room)
        smallest_waste = min((w for w, _ in found), default=capacity)
        extended = False
        tried = 0
        while n >= 1 and tried < budget.tried and spent <= budget.enumerated:
            n = _largest(counts, n)
            if not n:
                break
            if counts[n] > chosen.count(n):
                extended = True
                tried += 1
                chosen.append(n)
                search(room - n, chosen, n)
                chosen.pop()
                if not exhaustive and found and min(w for w, _ in found) == 0 and len(chosen) > 1:
                    return  # a perfect filling: nothing further down is better
            n -= 1
        if not extended and (room <= smallest_waste or len(found) < most) and not _dominated(counts, chosen, room):
            found.append((room, tuple(chosen)))

    if least > capacity - first:
        return [(first,)]
    search(capacity - first, [first], first)
    found.sort(key=lambda f: (f[0], len(f[1]), tuple(-n for n in f[1])))
    return [f for _, f in (found if exhaustive else found[: int(most)])]


def _dominated(counts: np.ndarray, chosen: list[int], room: int) -> bool:
    for n in set(chosen[1:]):
        better = _largest(counts, min(n + room, len(counts) - 1))
        if better > n and counts[better] > chosen.count(better):
            return True
    return False


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences that any packing needs: ceil(tokens / capacity), or more, as for each k the pieces longer than capacity
    - k can share a sequence with no piece of k or more, and those longer than half with none of their own kind."""
    counts = np.asarray(counts, np.int64)
    n = np.arange(len(counts))
    mass = counts * n
    best = -(-int(mass.sum()) // capacity)
    above, inside = np.cumsum(counts[::-1])[::-1], np.concatenate([[0], np.cumsum(mass)])
    for k in range(1, capacity // 2 + 1):
        alone = int(above[capacity - k + 1]) if capacity - k + 1 < len(counts) else 0
        half = int(above[capacity // 2 + 1]) - alone if capacity // 2 + 1 < len(counts) else 0
        middle = int(inside[min(capacity - k, len(counts) - 1) + 1] - inside[min(k, len(counts))])
        big = int(inside[min(capacity - k, len(counts) - 1) + 1] - inside[min(capacity // 2 + 1, len(counts))])
        spare = half * capacity - big  # room beside the pieces longer than half
        best = max(best, alone + half + max(0, -(-(middle - big - spare) // capacity)))
    return best


def plan(counts: np.ndarray, capacity: int = CAPACITY, budget: Budget = Budget()) -> list[Pattern]:
    """Patterns that use every piece once. counts[n]: pieces of length n.

    The search ends at a packing that the lower bound proves best, or, when the budget is spent, with the best packing
    found; what it may lack then is its sequences less lower_bound().
    """
    counts = np.asarray(counts, np.int64)
    total = int((counts * np.arange(len(counts))).sum())
    if not total:
        return []
    lower, nodes = lower_bound(counts, capacity), budget.searched
    incumbent = best_fit(counts, capacity)
    fewest = sum(t for _, t in incumbent)
    path: list[tuple[tuple[int, ...], int]] = []
    stack = [(counts, 0, choices_of(counts, capacity, budget))]
    while stack and fewest > lower and nodes > 0:
        left, wasted, choices = stack[-1]
        if not choices:
            stack.pop()
            if path:
                path.pop()
            continue
        filling, times = choices.pop(0)
        nodes -= 1
        now = wasted + times * (capacity - sum(filling))
        if total + now > (fewest - 1) * capacity:  # this choice's waste can't beat the incumbent; another's may
            continue
        after = _take(left, filling, times)
        path.append((filling, times))
        if not after.any():
            fewest, incumbent = sum(t for _, t in path), list(path)
            path.pop()
            continue
        rest = int((after * np.arange(len(after))).sum())
        greedy = best_fit(after, capacity) if nodes % 64 == 0 else None
        if greedy and sum(t for _, t in path) + sum(t for _, t in greedy) < fewest:
            incumbent = path + greedy
            fewest = sum(t for _, t in incumbent)
        if sum(t for _, t in path) + -(-rest // capacity) >= fewest:
            path.pop()
            continue
        stack.append((after, now, choices_of(after, capacity, budget)))
    out = []
    for filling, times in incumbent:
        use: dict[int, int] = {}
        for n in filling:
            use[n] = use.get(n, 0) + 1
        out.append(Pattern(tuple(use.items()), times))
    return out


def choices_of(counts: np.ndarray, capacity: int, budget: Budget) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and how often each is used: as often as the counts allow, then, after all fillings, less often."""
    found = [(f, _times(counts, f)) for f in fillings(counts, capacity, budget)]
    fewer = range(1, max((t for _, t in found), default=0)) if budget.fillings == math.inf else ()
    halves = {t // 2 for _, t in found if t > 1} | {1}
    return found + [(f, k) for k in sorted({*fewer, *halves}, reverse=True) for f, t in found if k < t]


@dataclass(frozen=True)
class Places:
    """For each length, runs of ranks: where a run begins, its first sequence, its offset, pieces per sequence."""

    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length).tolist():
            at = length == n
            begin, first, place, each = self.runs[n]
            r = np.searchsorted(begin, rank[at], side="right") - 1
            inside = rank[at] - begin[r]
            sequence[at] = first[r] + inside // each[r]
            offset[at] = place[r] + inside % each[r] * n
        return sequence, offset


def places(patterns: list[Pattern]) -> Places:
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for p in patterns:
        at = 0
        for n, each in p.lengths:
            runs.setdefault(n, []).append((used.get(n, 0), sequence, at, each))
            used[n] = used.get(n, 0) + each * p.times
            at += n * each
        sequence += p.times
    return Places({n: tuple(np.array(c, np.int64) for c in zip(*r)) for n, r in runs.items()})


def pack(parts: DataFrame, capacity: int = CAPACITY, rows_per_task: int = 512) -> DataFrame:
    """parts (doc_id, piece, length, ...) with sequence_id and offset. parts should be a table: it is read twice.

    Every piece is placed once; an empty table gives no rows. A length that many pieces share is ranked in many
    tasks: its pieces are dealt into buckets by a hash, and a bucket's ranks begin after those of the buckets before. A
    bucket has 1/4,096 of the pieces, MOST_RANKED at most; the driver holds one number for each.
    """
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    histogram = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        histogram[n] = c
    total = int(histogram.sum())
    spark = parts.sparkSession
    each = min(max(rows_per_task, total // 4096), MOST_RANKED)
    buckets = {n: -(-c // each) for n, c in counts.items()}
    many = F.create_map(*[F.lit(x).cast("long") for kv in buckets.items() if kv[1] > 1 for x in kv]) if any(b > 1 for b in buckets.values()) else None
    ways = F.coalesce(many[F.col("length")], F.lit(1)) if many is not None else F.lit(1).cast("long")
    dealt = parts.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", F.lit(6)), ways))
    begins: dict[tuple[int, int], int] = {}
    done: dict[int, int] = {}
    for r in dealt.groupBy("length", "_b").agg(F.count("*").alias("n")).orderBy("length", "_b").collect():  # 2,048 + 4,096 rows at most
        begins[r["length"], r["_b"]] = done.get(r["length"], 0)
        done[r["length"]] = done.get(r["length"], 0) + r["n"]
    rank = F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "start"))
    ranked = dealt.withColumn("_r", rank.cast("long") - 1)
    handle = spark.sparkContext.broadcast((places(plan(histogram, capacity)), begins))  # bounded by the capacity
    names = [c for c in ranked.columns if c not in ("_b", "_r")]
    schema = parts.schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, begin = handle.value
        for batch in batches:
            if batch.num_rows:
                length, b, r = (batch.column(c).to_numpy() for c in ("length", "_b", "_r"))
                rank = r + np.fromiter((begin[k] for k in zip(length.tolist(), b.tolist())), np.int64, len(r))
                sequence, offset = where.of(length, rank)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(tidy(__name__, run), schema)


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, keep_ids: bool = False, lasting: bool = True) -> DataFrame:
    """Tokenize, cut and pack: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset."""
    return pack(materialize(pieces(docs, tokenizer, doc_id, text, capacity, keep_ids, lasting), "pieces"), capacity)
