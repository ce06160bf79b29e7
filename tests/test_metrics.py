"""Metrics on hand-computed cases and against a plain evaluator."""

import math
import random

import pytest

from rankspark.operators import metrics

RUN = [("q1", "d1", 0, 0.9), ("q1", "d2", 1, 0.8), ("q1", "d3", 2, 0.8), ("q1", "d4", 3, 0.5), ("q2", "d1", 0, 0.2), ("q2", "d2", 1, 0.1), ("q3", "a", 0, 3.0), ("q3", "b", 1, 2.0), ("q3", "c", 2, 1.0)]
GOLD = [("q1", "d2", 1), ("q1", "d4", 1), ("q1", "dX", 1), ("q3", "a", 1)]
RUN_DDL, GOLD_DDL = "query_id string, doc_id string, pos long, score double", "query_id string, doc_id string, rel int"


def frames(spark, run=RUN, gold=GOLD):
    return spark.createDataFrame(run, RUN_DDL), spark.createDataFrame(gold, GOLD_DDL)


def test_known_values(spark):
    rows = {r["query_id"]: r for r in metrics.per_query(*frames(spark)).collect()}
    got = [round(rows["q1"][m], 5) for m in ("NDCG@1", "NDCG@5", "MAP@5", "Recall@5", "P@5", "MRR")]
    assert got == [0, 0.43675, 0.27778, 0.66667, 0.4, 0.33333]
    assert all(rows["q2"][m] == 0 for m in metrics.metric_names(oracle=False))
    assert (rows["q3"]["NDCG@1"], rows["q3"]["P@5"], rows["q3"]["MRR"]) == (1, 0.2, 1)


def test_oracle_ties(spark):
    run, gold = frames(spark)
    row = metrics.oracle_per_query(run, gold, (1, 5), depth=2).where("query_id = 'q1'").first()
    assert (row["Oracle NDCG@1"], round(row["Oracle NDCG@5"], 5)) == (1, 0.76536)


def test_unjudged_queries_count_as_zero_or_are_left_out(spark):
    run, gold = frames(spark)
    assert metrics.per_query(run, gold).count() == 3
    assert metrics.per_query(run, gold, skip_unjudged=True).count() == 2
    assert metrics.mean(metrics.per_query(run.limit(0), gold)).first()["MRR"] is None


def plain(run, gold, k):
    """The published formulas, a query at a time."""
    import struct

    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    ranked = [d for d, s in sorted(sorted(run.items(), key=lambda p: p[0], reverse=True), key=lambda p: -single(p[1]))]
    rel = [1 if d in gold else 0 for d in ranked]
    dcg = sum(x / math.log2(i + 2) for i, x in enumerate(rel[:k]))
    best = sum(1 / math.log2(i + 2) for i in range(min(k, len(gold))))
    ap = sum(sum(rel[: i + 1]) / (i + 1) for i in range(min(k, len(rel))) if rel[i])
    first = next((i + 1 for i, x in enumerate(rel) if x), None)
    return (dcg / best if best else 0, ap / len(gold) if gold else 0, sum(rel[:k]) / len(gold) if gold else 0, sum(rel[:k]) / k, 1 / first if first else 0)


def test_against_a_plain_evaluator(spark):
    rng = random.Random(5)
    runs = {f"q{i}": {f"d{j}": round(rng.random(), 1) for j in range(rng.randint(1, 30))} for i in range(12)}
    golds = {q: {f"d{rng.randint(0, 40)}" for _ in range(rng.randint(0, 6))} for q in runs}
    run, gold = frames(spark, [(q, d, int(d[1:]), s) for q, r in runs.items() for d, s in r.items()], [(q, d, 1) for q, g in golds.items() for d in g])
    for row in metrics.per_query(run, gold, (1, 5, 10)).collect():
        for k in (1, 5, 10):
            want = plain(runs[row["query_id"]], golds[row["query_id"]], k)
            assert [row[f"{m}@{k}"] for m in ("NDCG", "MAP", "Recall", "P")] + [row["MRR"]] == pytest.approx(want)


def test_invariants(spark):
    run, gold = frames(spark)
    scaled = run.withColumn("score", run["score"] * 100)
    assert sorted(metrics.per_query(run, gold).collect()) == sorted(metrics.per_query(scaled, gold).collect())
    for r in metrics.per_query(run, gold).collect():
        recalls = [r[f"Recall@{k}"] for k in metrics.CUTOFFS]
        assert recalls == sorted(recalls) and all(r[f"NDCG@{k}"] <= 1 for k in metrics.CUTOFFS)


def test_long_form_and_means_over_domains(spark):
    wide = spark.createDataFrame([("a", 0.1, 0.5), ("b", 0.2, 0.7)], "domain string, `NDCG@10` double, MRR double")
    rows = {(r["domain"], r["metric"], r["k"]): r["value"] for r in metrics.over_domains(metrics.long_form(wide, ["domain"])).collect()}
    assert rows[None, "NDCG", 10] == 0.15 and rows[None, "MRR", None] == 0.6 and rows["b", "MRR", None] == 0.7
