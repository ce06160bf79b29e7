"""The Jaccard join against brute force over the words themselves."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankspark.llm import jaccard
from rankspark.llm.queries import op9_jaccard


def word_set(text):
    lowered = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(docs):
    sets = {i: word_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def documents(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 6)))
    base = [[word() for _ in range(rng.choice((3, 5, 8, 40, 150, 400)))] for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for _ in range(3):
            w = list(b)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = word()
            texts.append(rng.choice((" ", "\n", " \t ")).join(w).upper() if rng.random() < 0.1 and "é" not in "".join(w) else " ".join(w))
    common = [word() for _ in range(30)]
    texts += [" ".join(common + [word() for _ in range(rng.randint(5, 60))]) for _ in range(60)]  # a passage that many share
    near = [word() for _ in range(60)]
    for _ in range(60):  # a dense group
        w = list(near)
        w[rng.randrange(60)] = word()
        texts.append(" ".join(w))
    texts += ["", "   ", "a", "A", "a b c d", "a b c d e", "a\xa0b"]
    return list(enumerate(texts)) + [(len(texts), None)]


@pytest.mark.parametrize("group", [1024, 7])
def test_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(jaccard, "GROUP", group)
    docs = documents()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_classes(df).collect()} == brute(docs)


def test_common_shingles_come_last(spark, monkeypatch):
    """With every shingle in a few documents taken as common, nothing is lost."""
    docs = documents(2)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    original = jaccard._buckets
    monkeypatch.setattr(jaccard, "max", lambda *a: 4 if a and a[0] == 1024 else max(*a), raising=False)
    assert original is jaccard._buckets
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_classes(df).collect()} == brute(docs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=2, max_size=40), st.integers(0, 10**6))
def test_trees_lose_no_link(sizes, seed):
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 2**63, 80, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool[: max(s, 2) + 4], s)) for s in sizes]
    n = np.array([len(s) for s in sets])
    a, b, _ = jaccard.bucket_candidates(n, [jaccard.bitmap(s).tobytes() for s in sets])
    got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            same = len(np.intersect1d(sets[i], sets[j]))
            if 100 * same >= 75 * (len(sets[i]) + len(sets[j]) - same):
                assert (i, j) in got


@given(st.integers(0, 3000), st.integers(0, 3000))
def test_needed_overlap(n, m):
    o = int(jaccard.needed_overlap(n, m))
    assert 100 * o >= 75 * (n + m - o) and (o == 0 or 100 * (o - 1) < 75 * (n + m - o + 1))


def test_a_hot_bucket_of_two_components_costs_no_square(spark):
    """4,000 members of one component and 3 of another in a bucket: the few meet the many, the many don't meet each other."""
    rows = [(7, i, 10, b"", 1) for i in range(4000)] + [(7, 5000 + i, 10, b"", 2 + i) for i in range(3)] + [(8, i, 10, b"", 1) for i in range(50)]
    members = spark.createDataFrame(rows, "token long, id long, n long, bits binary, component long")
    got = jaccard._meetings(members).collect()
    assert len(got) == 4000 + 3 * 4 + 3 and {r["token"] for r in got} == {7}
    work = {}
    for r in got:
        work.setdefault((r["i"], r["j"]), []).append(r["id"])
    together = {(a, b) for ids in work.values() for a in ids for b in ids if a < 5000 <= b}
    assert len(together) == 4000 * 3 and any({5000, 5001, 5002} <= set(ids) for ids in work.values())


def test_edges(spark):
    df = spark.createDataFrame([(5, "a b c", "z"), (5, "a b c", "z"), (2, "A  B\nC", None), (None, "a b c", None)], "doc_id long, text string, n_shingles string")
    rows = sorted((r["id"] or -1, r["n_shingles"], r["component_id"]) for r in jaccard.join_classes(df).collect())
    assert rows == [(-1, 1, 2), (2, 1, 2), (5, 1, 2), (5, 1, 2)]
    assert jaccard.join_classes(df.limit(0)).count() == 0
    assert jaccard.join_classes(df.selectExpr("doc_id", "cast(null as string) as text")).where("n_shingles > 0").count() == 0


def test_query(spark, tmp_path):
    spark.createDataFrame(documents(3), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"]: tuple(r)[1:] for r in op9_jaccard(spark, str(tmp_path)).collect()} == brute(documents(3))
