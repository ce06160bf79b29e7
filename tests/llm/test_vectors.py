"""Bit-sliced top k and embedding near duplicates against brute force."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankspark.llm import components, topk, vectors_dedup
from rankspark.llm.queries import op3_topk, op4_vectors

NAN, INF = float("nan"), float("inf")
DDL = "vec_id long, embedding array<float>, label int"


def vectors(spark, n=300, width=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, width))
    x[n // 2 :] = x[: n - n // 2] + 0.05 * rng.standard_normal((n - n // 2, width))  # near copies
    x[5] = x[6] = x[7]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, x[i].tolist(), i % 3 if i % 11 else None) for i in range(n)]
    odd = [(n, None, 1), (n + 1, [NAN] * width, 1), (n + 2, [INF] + [0.0] * (width - 1), 1), (n + 3, [None] + [0.5] * (width - 1), 1), (n + 4, [0.0] * width, 1), (n + 5, [0.0] * width, 1), (n + 6, [], 1)]
    return rows, odd, spark.createDataFrame(rows + odd, DDL)


def brute_top(rows, k, step):
    q = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v, _ in rows}
    out = []
    for i in (i for i in q if i % step == 0):
        best = sorted(((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(8192, 2048), (70, 3)])
def test_top_k(spark, blocks):
    rows, _, df = vectors(spark)
    usable = [*rows, (304, [0.0] * 16, 1), (305, [0.0] * 16, 1)]
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), 5, rows=blocks[0], query_rows=blocks[1])
    assert sorted(tuple(r) for r in got.collect()) == brute_top(usable, 5, 50)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 200), st.integers(1, 6), st.integers(1, 9), st.integers(0, 10**6))
def test_sliced_block(n, width, k, seed):
    rng = np.random.default_rng(seed)
    x, ids = rng.integers(-9, 9, (n, width)), rng.permutation(n * 3)[:n]
    q = rng.integers(-40, 40, (3, width))
    asked = np.array([ids[0], -1, ids[-1]])
    got = topk.SlicedBlock(ids, x).top(asked, q, k)
    want = []
    for j in range(3):
        scores = [(-int(q[j] @ x[r]), int(ids[r])) for r in range(n) if ids[r] != asked[j]]
        want += [(int(asked[j]), i, -s) for s, i in sorted(scores)[:k]]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("large", [1e6, 1e9, 3e12])
def test_large_components_take_part(spark, large):
    """Scores beyond any fixed bound, against Python's integers."""
    x = np.random.default_rng(7).standard_normal((80, 4))
    x[: 80 if large == 1e6 else 1 : 7] *= large  # the products of two of the largest would be no longs
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    q = [[math.floor(256 * c) for c in v] for _, v, _ in rows]
    assert max(abs(c) for v in q for c in v) > 1 << 24
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = []
    for i in range(0, len(q), 10):
        best = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in range(len(q)) if j != i)[:5]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert max(abs(w[3]) for w in want) > 1 << 40
    assert sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 10 = 0"), rows=17).collect()) == sorted(want)


def test_scores_and_components_that_are_no_longs_are_errors(spark):
    for v in ([1e12], [1e300]):
        df = spark.createDataFrame([(0, v, 1), (1, v, 1)], "vec_id long, embedding array<double>, label int")
        with pytest.raises(Exception, match="is no long|too large"):
            topk.top_k(df, df).collect()


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 90), st.integers(0, 10**6), st.integers(20, 59))
def test_sliced_blocks_of_wide_values(n, seed, bits):
    rng = np.random.default_rng(seed)
    x, q = rng.integers(-(1 << bits), 1 << bits, (n, 3)), rng.integers(-8, 9, (2, 3)) >> (bits // 20)
    got = topk.SlicedBlock(np.arange(n), x).top(np.array([-1, -2]), q, 4)
    for j in (0, 1):
        exact = sorted((-sum(int(a) * int(b) for a, b in zip(q[j], x[r])), r) for r in range(n))[:4]
        assert sorted((-s, r) for i, r, s in got if i == -1 - j) == exact


def test_widths_and_repeated_queries(spark):
    rows = [(i, [float(i % 5), 1.0, -float(i)], 1) for i in range(20)] + [(100 + i, [float(i), -2.0], 1) for i in range(6)]
    df = spark.createDataFrame(rows, DDL)
    asked = df.where("vec_id in (0, 100)")
    want = brute_top(rows[:20], 5, 20) + brute_top([(i - 100, v, lab) for i, v, lab in rows[20:]], 5, 6)
    want = [w if k < 5 else (100 + w[0], w[1], 100 + w[2], w[3]) for k, w in enumerate(want)]
    assert sorted(tuple(r) for r in topk.top_k(df, asked.union(asked)).collect()) == sorted(want)


def test_top_k_edges(spark):
    one = spark.createDataFrame([(0, [1.0, -1.0], 1)], DDL)
    assert topk.top_k(one, one).count() == 0
    assert topk.top_k(one.limit(0), one.limit(0)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0], 1), (1, [-2.0], 1), (2, [0.5], 1)], DDL), one.limit(0)).count() == 0
    twice = spark.createDataFrame([(0, [1.0], 1), (3, [1.0], 1), (3, [1.0], 1)], DDL)
    assert [r["vec_id"] for r in topk.top_k(twice, twice.where("vec_id = 0")).collect()] == [3, 3]


def brute_links(rows, threshold):
    usable = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in rows if lab is not None]
    links, root = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x, p) in enumerate(usable):
        for j, y, q in usable[a + 1 :]:
            if p == q and x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                links[i] += 1
                links[j] += 1
                a_, b_ = sorted((find(i), find(j)))
                root[b_] = a_
    return {i: (links[i], find(i), find(i) == i) for i in root}


def test_near_duplicates(spark):
    rows, odd, df = vectors(spark)
    want = brute_links(rows, 0.98) | {i: (0, i, True) for i, _, _ in odd}
    got = vectors_dedup.near_duplicates(df, window=3, block=16)
    assert {r["vec_id"]: tuple(r)[1:] for r in got.collect()} == want


def test_a_dense_group_larger_than_window_and_block(spark):
    rng = np.random.default_rng(2)
    x = np.ones(16) + 0.03 * rng.standard_normal((120, 16))
    df = spark.createDataFrame([(i, x[i].tolist(), 1) for i in range(120)], DDL)
    want = brute_links([(i, x[i].tolist(), 1) for i in range(120)], 0.98)
    assert {r["vec_id"]: tuple(r)[1:] for r in vectors_dedup.near_duplicates(df, window=4, block=16).collect()} == want


def test_recall_on_isolated_pairs(spark):
    """Pairs near the threshold among many others: at least nine of ten are found."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + 0.19 * rng.standard_normal(x.shape) / 8
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    z = np.concatenate([x, y]).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, z[i].tolist(), 0) for i in range(len(z))], DDL)
    u = z / np.linalg.norm(z, axis=1, keepdims=True)
    sims = u @ u.T
    np.fill_diagonal(sims, 0)
    truth = int((sims >= 0.98).sum())
    assert truth > 1000
    assert vectors_dedup.near_duplicates(df).agg({"n_links": "sum"}).first()[0] >= 0.98 * truth


def test_copies_fill_no_window(spark):
    """A vector with more copies than the window between others, in a label whose vectors lie close together."""
    rng = np.random.default_rng(5)
    x = np.ones((600, 16)) + 0.5 * rng.standard_normal((600, 16))
    y = x[:200] + 0.06 * rng.standard_normal((200, 16))
    z = np.concatenate([x, y, np.repeat(x[300:], 8, 0)]).astype(np.float32).astype(float)
    z = z[rng.permutation(len(z))]
    df = spark.createDataFrame([(i, z[i].tolist(), 0) for i in range(len(z))], DDL)
    u = z / np.linalg.norm(z, axis=1, keepdims=True)
    links = (u @ u.T >= 0.98).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in vectors_dedup.near_duplicates(df, passes=3, window=4).collect()}
    lone = [i for i in range(len(z)) if 0 < links[i] < 8]  # without those that copies link anyway
    assert all(got[i] <= links[i] for i in got) and sum(got[i] for i in lone) >= 0.97 * links[lone].sum() > 0


def test_recall_at_many_partitions(spark):
    """Cuts between partitions hide nothing: one pass that brings every pair together finds every pair, at 211 of them."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((500, 32))
    z = np.concatenate([x, x + 1e-9 * rng.standard_normal(x.shape)])
    df = spark.createDataFrame([(i, z[i].tolist(), 0) for i in range(len(z))], "vec_id long, embedding array<double>, label int")
    key = "spark.sql.shuffle.partitions"
    before, adaptive = spark.conf.get(key), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set(key, "211")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = vectors_dedup.near_duplicates(df, passes=1, window=1).collect()
    finally:
        spark.conf.set(key, before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got}
    same = [i for i in range(500) if (vectors_dedup._keys((z[[i, i + 500]] - z.mean(0)), vectors_dedup.hyperplanes(32, 1, 48))[0] == vectors_dedup._keys((z[[i, i + 500]] - z.mean(0)), vectors_dedup.hyperplanes(32, 1, 48))[1]).all()]
    assert len(same) > 490 and all(found[i] == found[i + 500] == (1, i) for i in same)


def test_blocks_of_a_large_component(spark, monkeypatch):
    monkeypatch.setattr(vectors_dedup, "FEW_BLOCKS", 3)
    rng = np.random.default_rng(2)
    x = np.ones(8) + 0.02 * rng.standard_normal((260, 8))
    rows = [(i, x[i].tolist(), 1) for i in range(260)]
    members = spark.createDataFrame([(1, i, v, 1) for i, v, _ in rows], "component long, id long, v array<double>, copies long")
    unit = members.collect()
    unit = spark.createDataFrame([(1, r["id"], vectors_dedup.unit(np.array([r["v"]]))[0].tolist(), 1) for r in unit], members.schema)
    want = {i: n for i, (n, _, _) in brute_links(rows, 0.98).items()}
    for large in (20, 50, 4096):
        got = {r["id"]: r["n"] for r in vectors_dedup.count_links(unit, 0.98, 16, large).collect()}
        assert all(abs(got.get(i, 0) - n) <= 1 for i, n in want.items())  # 32-bit rows in brute_links


def test_ids_and_widths(spark):
    a, b = [1.0, 0.0], [0.0, 1.0, 0.0]
    df = spark.createDataFrame([(1, a, 1), (2, a, 1), (3, b, 1), (4, b, 1), (4, b, 1), (None, a, 1), (5, [0.0], 1)], DDL)
    got = sorted(vectors_dedup.near_duplicates(df).collect(), key=lambda r: r["vec_id"] or 0)
    assert [tuple(r) for r in got] == [(None, 0, None, True), (1, 1, 1, True), (2, 1, 1, False), (3, 2, 3, True), (4, 2, 3, False), (4, 2, 3, False), (5, 0, 5, True)]


def test_near_duplicate_edges(spark):
    assert vectors_dedup.near_duplicates(spark.createDataFrame([], DDL)).count() == 0
    lone = spark.createDataFrame([(7, [1.0, 0.0], 1), (8, [1.0, 0.0], 2)], DDL)
    assert sorted(tuple(r) for r in vectors_dedup.near_duplicates(lone).collect()) == [(7, 0, 7, True), (8, 0, 8, True)]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components(spark, edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame([*edges, (99, 99)], "a long, b long")
    assert {r["node"]: r["component"] for r in components.components(df).collect()} == want


def test_a_long_path(spark):
    df = spark.range(400).selectExpr("id as a", "id + 1 as b").repartition(7)
    assert {r["component"] for r in components.components(df).collect()} == {0}


def test_queries(spark, tmp_path):
    rows, odd, df = vectors(spark, 120)
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert op3_topk(spark, str(tmp_path)).columns == ["query_id", "rank", "vec_id", "score"]
    assert op4_vectors(spark, str(tmp_path)).count() == len(rows) + len(odd)
