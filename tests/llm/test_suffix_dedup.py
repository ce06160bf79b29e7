"""Removal of repeated strings against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankspark.llm import suffix_dedup as S
from rankspark.llm.queries import op2_repeats


def brute(texts: list[str], length: int, across: bool = False, least: int = 0) -> list[tuple[int, int, bytes]]:
    """(removed, spans, kept) of each text."""
    raw = [t.encode() for t in texts]
    seen: dict[bytes, list[int]] = {}
    for k, b in enumerate(raw):
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append(k)
    again = {s for s, where in seen.items() if len(set(where) if across else where) > 1}
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in again:
                gone[i : i + length] = b"\1" * length
        for m in re.finditer(b"\1+", bytes(gone)):
            if len(b[m.start() : m.end()].split()) < least:
                gone[m.start() : m.end()] = bytes(m.end() - m.start())
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((sum(gone), len(re.findall(b"\1+", bytes(gone))), kept))
    return out


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))


def corpus(seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    shared = [words(rng, 60) for _ in range(4)]
    texts = [words(rng, rng.randint(1, 60)) + " " + rng.choice(shared)[rng.randint(0, 90) :] + words(rng, rng.randint(0, 30)) for _ in range(40)]
    base = words(rng, 120)
    near = []
    for _ in range(25):  # copies with one changed letter each
        k = rng.randint(0, len(base) - 1)
        near.append(base[:k] + "Z" + base[k + 1 :])
    line = words(rng, 6) + "\n"
    return texts + near + [base, base, "", "x" * 900, "ab" * 450, line * 30, words(rng, 3) + line * 9 + words(rng, 40), "é" * 300, shared[0] + shared[0]]


def check(spark, texts, length, many, across=False, least=0):
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in S.remove_repeats(df, length=length, many=many, across=across, words=least).collect()}
    for k, (removed, spans, kept) in enumerate(brute([t or "" for t in texts], length, across, least)):
        r = got[k]
        assert (r["n_removed"], r["n_spans"], bytes(r["kept"])) == (removed, spans, kept), k


@pytest.mark.parametrize("across", [False, True])
@pytest.mark.parametrize("many", [1024, 1, 8])
@pytest.mark.parametrize("length", [100, 40])
def test_brute_force(spark, length, many, across):
    check(spark, [*corpus(), None], length, many, across)


def test_short_runs_stay(spark):
    check(spark, corpus(5), 40, 1024, True, 14)
    check(spark, corpus(5), 40, 4, False, 14)


def test_an_anchor_very_many_times_in_one_text(spark):
    rng = random.Random(8)
    line = words(rng, 30)
    texts = ["".join(line + words(rng, 12) for _ in range(1200)), words(rng, 40) + line + words(rng, 50), line * 3, words(rng, 90)]
    check(spark, texts, 60, 1024)
    check(spark, texts, 60, 1024, True)


@pytest.mark.parametrize("across", [False, True])
def test_strings_that_share_a_hash_are_told_apart_by_their_bytes(spark, across):
    rng = random.Random(4)
    shared = words(rng, 30)
    texts = [words(rng, 12) + shared[:90] + words(rng, 12) for _ in range(12)] + [shared + shared]
    length = 60
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "rid long, text string").repartition(4).cache()
    records = []  # every string of every text, with hashes that collide across different strings
    for k, t in enumerate(texts):
        x = np.zeros(len(t.encode()) - length + 1, S._PACKED)
        raw = t.encode()
        x["h"] = [raw[i : i + length].count(b"a") for i in range(len(x))]
        x["rid"], x["at"] = k, np.arange(len(x))
        records.append(x)
    runs = spark.createDataFrame(S._paired(np.concatenate(records), across), S._SPAN)
    found = {(r["rid"], r["first"] + k) for r in S._compared(docs, runs, length, across).collect() for k in range(r["n"])}
    where: dict[bytes, set] = {}
    for k, t in enumerate(texts):
        raw = t.encode()
        for i in range(len(raw) - length + 1):
            where.setdefault(raw[i : i + length], set()).add((k, i))
    assert found == {p for places in where.values() if len({k for k, _ in places} if across else places) > 1 for p in places}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=40), min_size=2, max_size=9), st.integers(4, 12))
def test_classes_of_contexts(parts, length):
    """Contexts around a common anchor: strings at each offset against a plain count."""
    blobs, lefts, counts = [], [], []
    for k, p in enumerate(parts):
        left = min(k % 4, length - 2)
        blob = (p[:left].ljust(left, "c") + "#!" + p[left:].ljust(length, "d")).encode()
        blobs.append(blob)
        lefts.append(left)
        counts.append(min(left + 1, len(blob) - length + 1))
    if len(set(zip(blobs, lefts))) < len(blobs):
        return
    found = S.repeated_offsets(blobs, lefts, counts, length)
    strings = [{d: blobs[k][lefts[k] - d : lefts[k] - d + length] for d in range(lefts[k] - counts[k] + 1, lefts[k] + 1)} for k in range(len(blobs))]
    for k, own in enumerate(strings):
        want = [d for d, s in own.items() if any(j != k and other.get(d) == s for j, other in enumerate(strings))]
        assert sorted(found[k].tolist()) == sorted(want)


def test_orders_are_those_of_the_bytes_even_with_colliding_hashes(monkeypatch):
    blobs, lefts = [b"xxabcd", b"yyabce", b"xxabcd1", b"zzab"], [2, 2, 2, 2]
    want = sorted(range(4), key=lambda k: blobs[k][2:])
    assert S.Contexts(blobs, lefts).order(True) == (want, [0, 2, 4, 3])
    monkeypatch.setattr(S.Contexts, "_same", lambda *a: True)
    assert S.Contexts(blobs, lefts).order(True) == (want, [0, 2, 4, 3])


def test_edges(spark):
    df = spark.createDataFrame([(1, "a" * 500, "mine"), (1, "a" * 500, "mine"), (None, None, None), (3, "short", "x")], "doc_id long, text string, kept string")
    rows = S.remove_repeats(df).collect()
    assert len(rows) == 4
    got = sorted((r["doc_id"] or 0, r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows)
    assert got == [(0, 0, 0, b""), (1, 500, 1, b""), (1, 500, 1, b""), (3, 0, 0, b"short")]
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_characters_that_a_cut_breaks_go(spark):
    rng = random.Random(3)
    tail = words(rng, 90)
    df = spark.createDataFrame([(1, "é" + tail), (2, "è" + tail[:-1] + "é")], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in S.remove_repeats(df, rest="text").collect()}[1] in ("é", "é" + tail[-1])


def test_query(spark, tmp_path):
    texts = [t * 3 for t in corpus(2)]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = brute(texts, 400)
    for r in op2_repeats(spark, str(tmp_path)).collect():
        removed, spans, kept = want[r["doc_id"]]
        assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) == (removed, spans, hashlib.sha256(kept).hexdigest())
