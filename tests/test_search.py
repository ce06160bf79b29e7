"""Exclusion modes, ties, blocks, and BM25."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankspark.operators import lexical, search


def scores(spark):
    return spark.createDataFrame([("q", "a", 0, 0.9), ("q", "b", 1, 0.8), ("q", "c", 2, 0.7)], "query_id string, doc_id string, pos long, score double")


def excluded(spark):
    return spark.createDataFrame([("q", "a"), ("q", "a"), ("q", "N/A"), ("q", "zz")], "query_id string, doc_id string")


@pytest.mark.parametrize(("mode", "k", "want"), [("before", 2, ["b", "c"]), ("after", 2, ["b"]), ("mask", 3, ["b", "c", "a"]), ("none", 2, ["a", "b"])])
def test_exclusion_modes(spark, mode, k, want):
    rows = search.search(scores(spark), excluded(spark), mode, k).orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == want
    if mode == "mask":
        assert rows[-1]["score"] == search.MASKED


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        search.search(scores(spark), excluded(spark), "later")


def test_ties_go_by_position(spark):
    tied = spark.createDataFrame([("q", "x", 5, 1.0), ("q", "y", 2, 1.0), ("q", "z", 9, 1.0)], "query_id string, doc_id string, pos long, score double")
    assert [r["doc_id"] for r in search.top_k(tied, 2).orderBy("rank").collect()] == ["y", "x"]


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_dense_is_exact_in_both_ways(spark, monkeypatch, limit):
    monkeypatch.setattr(search, "BROADCAST_BYTES", limit)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 8)).round(2)
    x[10] = x[11]
    corpus = spark.createDataFrame([(f"d{i}", i, x[i].tolist()) for i in range(60)], "doc_id string, pos long, v array<double>")
    queries = spark.createDataFrame([(f"q{i}", x[i].tolist()) for i in range(0, 60, 7)], "query_id string, q array<double>")
    barred = spark.createDataFrame([(f"q{i}", f"d{i}") for i in range(0, 60, 7)], "query_id string, doc_id string")
    got = {(r["query_id"], r["rank"]): r["doc_id"] for r in search.dense(queries, corpus, 5, exclusions=barred).collect()}
    for i in range(0, 60, 7):
        exact = np.add.accumulate(x[i] * x, axis=1)[:, -1]
        order = [j for j in np.lexsort((np.arange(60), -exact)) if j != i][:5]
        assert [got[f"q{i}", k + 1] for k in range(5)] == [f"d{j}" for j in order]


def test_dense_without_queries_or_documents(spark):
    corpus = spark.createDataFrame([("d", 0, [1.0])], "doc_id string, pos long, v array<double>")
    queries = spark.createDataFrame([("q", [1.0])], "query_id string, q array<double>")
    assert search.dense(queries.limit(0), corpus).count() == 0
    assert search.dense(queries, corpus.limit(0)).count() == 0


def test_top_k_limits_groups_before_the_exchange(spark):
    plan = search.top_k(scores(spark), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def bm25_case(spark):
    corpus = spark.createDataFrame([("1", 0, "red apple red"), ("2", 1, "green apple"), ("3", 2, "blue sky"), ("4", 3, None)], "doc_id string, pos long, content string")
    return spark.createDataFrame([("q", "red apple nowhere")], "query_id string, query string"), corpus


def test_bm25_weights(spark):
    queries, corpus = bm25_case(spark)
    got = {r["doc_id"]: r["score"] for r in lexical.bm25(queries, corpus).collect()}
    n, avgdl = 4, 7 / 4
    idf = lambda df: np.log(1 + (n - df + 0.5) / (df + 0.5))
    w = lambda tf, dl, df: idf(df) * tf / (tf + 0.9 * (0.6 + 0.4 * dl / avgdl))
    assert got == pytest.approx({"1": w(1, 2, 1) * w(2, 3, 1) + w(1, 2, 2) * w(1, 3, 2), "2": w(1, 2, 2) * w(1, 2, 2)})


def test_written_index(spark, tmp_path):
    queries, corpus = bm25_case(spark)
    lexical.Index.of(corpus).write(str(tmp_path / "index"), 2)
    kept = lexical.Index.read(spark, str(tmp_path / "index"))
    assert kept.postings.count() == 6
    for weighting in ("bm25", "binary"):
        want = {(r["doc_id"], r["score"]) for r in lexical.bm25(queries, corpus, weighting=weighting).collect()}
        assert {(r["doc_id"], r["score"]) for r in kept.scores(queries, weighting).collect()} == want
    with pytest.raises(ValueError):
        kept.scores(queries, "other")


def test_bm25_zero_padding(spark):
    queries, corpus = bm25_case(spark)
    rows = lexical.bm25(queries, corpus, k=3, pad_zero=True).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"] > 0) for r in rows] == [("1", True), ("2", True), ("3", False)]


def test_english_analyzer(spark):
    from rankspark.operators.analysis import analyze, stem

    known = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "falling": "fall", "happy": "happi", "sky": "sky", "agreed": "agre", "adjustable": "adjust", "probate": "probat", "controll": "control", "rate": "rate", "filing": "file", "triplicate": "triplic", "goodness": "good", "conflated": "conflat", "plastered": "plaster", "feed": "feed"}
    assert {w: stem(w) for w in known} == known
    assert analyze("The user's running DOGS and it") == ["user", "run", "dog"]
    df = spark.createDataFrame([("a", "The cats' hats"), ("b", None)], "doc_id string, content string")
    assert {r["doc_id"]: r["terms"] for r in lexical.analyzed(df, analyzer="english").collect()} == {"a": ["cat", "hat"], "b": []}


def test_best_per_document(spark):
    chunks = spark.createDataFrame([("q", "a", 1.0), ("q", "a", 3.0), ("q", "b", 2.0)], "query_id string, doc_id string, score double")
    assert {r["doc_id"]: r["score"] for r in search.best_per_document(chunks).collect()} == {"a": 3.0, "b": 2.0}


def test_block_join_meets_every_pair_once(spark, monkeypatch):
    queries = spark.range(9).select(F.col("id").cast("string").alias("query_id"))
    corpus = spark.range(25).select(F.col("id").cast("string").alias("doc_id"))
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    monkeypatch.setattr(search, "DOCUMENT_BLOCK", 10)
    assert search.blocks_joined(queries, corpus).distinct().count() == 225


def test_documents_that_contain_an_item(spark):
    """By an item's inner words, against a plain look at every pair."""
    import random

    from rankspark.plans.tables import containing

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("ab\n") for _ in range(rng.randint(0, 2)))
    docs = [(str(i), " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(60)] + [("null", None)]
    cut = lambda t: t[rng.randint(0, 3) : len(t) - rng.randint(0, 9)]
    items = [(str(i), cut(rng.choice(docs[:60])[1])) for i in range(50)] + [("x", "a b"), ("y", "")]
    got = containing(spark.createDataFrame(items, "query_id string, query string"), spark.createDataFrame(docs, "doc_id string, content string"))
    rows = [tuple(r) for r in got.select("query_id", "doc_id").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(q, d) for q, t in items for d, c in docs if c is not None and t in c}
