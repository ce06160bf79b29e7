"""Sources, sinks, pairs, judgements, the embedding store, encoders, streams and whole evaluations."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankspark import schemas
from rankspark.operators import cache, encoders, experiments, pairs, qrels
from rankspark.plans import evaluation
from rankspark.sources import readers, sinks


def test_readers(spark, tmp_path):
    path = str(tmp_path / "examples")
    row = ("1", "find", ["a"], None, ["x\\y.png"], [("p\\q.png",), (None,)], None, "extra")
    spark.createDataFrame([row], schemas.EXAMPLES_MULTIMODAL + ", other string").write.parquet(path)
    got = readers.read_multimodal_queries(spark, path, "bio").first()
    assert (got["query_id"], got["negative_ids"], got["positive_images"], got["negative_images"]) == ("1", [], ["p/q.png"], [])
    assert readers.read_queries(spark, path, "bio").first()["image_paths"] == ["x\\y.png"]
    docs = str(tmp_path / "docs")
    spark.createDataFrame([("b", "B"), ("a", "A")], schemas.DOCUMENTS).write.parquet(docs)
    assert [(r["doc_id"], r["pos"]) for r in readers.read_corpus(spark, docs, "bio").orderBy("pos").collect()] == [("a", 0), ("b", 1)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_corpus(spark, str(tmp_path / "nowhere"), "bio")


def test_image_sources(spark, tmp_path):
    png, junk = b"\x89PNG....", b"nothing"
    path = str(tmp_path / "images")
    spark.createDataFrame([("a", png), ("a", png + b"longer"), ("b", junk), ("c", None)], schemas.IMAGES).write.parquet(path)
    assert [(r["path"], bytes(r["bytes"])) for r in readers.read_images(spark, path, "bio").collect()] == [("a", png + b"longer")]
    folder = tmp_path / "dir" / "sub"
    folder.mkdir(parents=True)
    (folder / "x.PNG").write_bytes(png)
    (folder / "y.txt").write_bytes(junk)
    assert [r["path"].endswith("sub/x.PNG") for r in readers.read_image_directory(spark, str(tmp_path / "dir")).collect()] == [True]
    lines = tmp_path / "q.jsonl"
    lines.write_text('{"id": "1", "image_paths": ["a"]}\n{"id": "1", "image_paths": ["b"]}\n{"id": "2"}\n')
    assert {r["query_id"]: r["image_paths"] for r in readers.read_query_images_jsonl(spark, str(lines)).collect()} == {"1": ["b"], "2": []}


def test_configuration_and_sinks(spark, tmp_path):
    assert readers.read_model_config(str(tmp_path), "m") == {"query": "", "document": ""}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "default.json").write_text('{"instructions": {"query": "Q"}}')
    assert readers.read_model_config(str(tmp_path), "m") == {"query": "Q", "document": ""}
    run = spark.createDataFrame([("m", "bio", "q", "b", 0.5, 2), ("m", "bio", "q", "a", 0.9, 1)], schemas.RUN)
    path = sinks.run_folder(str(tmp_path), "text_pair", "m")
    assert path.endswith("it2it_m") and readers.read_run_if_complete(spark, path) is None
    sinks.write_run(run, path)
    assert readers.read_run_if_complete(spark, path).count() == 2
    assert list(json.loads(sinks.run_as_json(run).first()["scores"]).items()) == [("a", 0.9), ("b", 0.5)]
    summary = spark.createDataFrame([("bio", "MRR", 0.5), (None, "MRR", 0.5)], "domain string, metric string, value double")
    out = sinks.write_summary(summary, "m", "text_text", str(tmp_path / "out" / "summary.json"))
    assert out == {"model": "m", "task_type": "text_text", "domains": {"bio": {"MRR": 0.5}}, "aggregated": {"MRR": 0.5}} == json.loads((tmp_path / "out" / "summary.json").read_text())


def test_pairs_and_their_judgements(spark):
    docs = spark.createDataFrame([("d/aa_1.txt", "one"), ("d/bb_2.txt", "two")], "doc_id string, content string")
    images = spark.createDataFrame([("d/d_aa_0001/i1.png",), ("d/d_aa_0001/i2.png",), ("other.png",)], "path string")
    found = pairs.expand_pairs(docs, images, "d")
    assert sorted(r["doc_id"] for r in found.collect()) == ["d/aa_1.txt|||__NO_IMAGE__", "d/aa_1.txt|||d/d_aa_0001/i1.png", "d/aa_1.txt|||d/d_aa_0001/i2.png", "d/bb_2.txt|||__NO_IMAGE__"]
    gold = spark.createDataFrame([("q", "d/aa_1.txt"), ("q", "gone")], "query_id string, doc_id string")
    assert qrels.for_pairs(gold, found).count() == 3
    direct = found.unionByName(spark.createDataFrame([("d/aa_1.txt", None, None, None)], found.schema))
    assert qrels.for_pairs(gold, direct).count() == 4
    assert qrels.gold_coverage(gold, direct).first()[1:] == (2, 1)
    queries = spark.createDataFrame([("q", ["g", "g"], ["p"]), ("r", ["h"], [])], "query_id string, gold_ids array<string>, positive_images array<string>")
    assert sorted(tuple(r) for r in qrels.for_images(queries).collect()) == [("q", "p", 1), ("r", "h", 1)]
    assert qrels.from_lists(queries).count() == 2


def test_images_of_queries_keep_their_order(spark):
    queries = spark.createDataFrame([("q", ["b\\2", "none", "a/1"])], "query_id string, image_paths array<string>")
    images = spark.createDataFrame([("a/1", b"1"), ("b/2", b"2")], "path string, bytes binary")
    assert pairs.gathered_images(pairs.query_images(queries, images)).first()["paths"] == ["b/2", "a/1"]


def test_store(spark, tmp_path):
    store = cache.EmbeddingStore(spark, str(tmp_path / "store"), "m", "bio")
    docs = spark.createDataFrame([("1", "one"), ("2", "two")], "id string, content string")
    assert store.encode_missing(docs, encoders.HashingEncoder(8), 1) == 2
    assert store.encode_missing(docs, encoders.HashingEncoder(8), 2) == 0
    changed = spark.createDataFrame([("1", "one"), ("2", "TWO and more"), ("3", None)], "id string, content string")
    assert store.encode_missing(changed, encoders.HashingEncoder(8), 3) == 2
    got = {r["id"]: r["embedding"] for r in store.gather(changed).collect()}
    assert got["2"] == pytest.approx(encoders.HashingEncoder(8).encode_text(["TWO and more"])[0].tolist()) and got["3"] == [0.0] * 8
    with pytest.raises(KeyError):
        store.gather(spark.createDataFrame([("9", "x")], "id string, content string"))
    assert cache.EmbeddingStore(spark, str(tmp_path / "store"), "m", "law").rows().count() == 0
    store.compact(str(tmp_path / "compact"))
    assert cache.EmbeddingStore(spark, str(tmp_path / "compact"), "m", "bio").rows().count() == 3


def test_encoders(spark):
    class Flaky:
        dim = 2

        def __init__(self):
            self.calls = 0

        def encode_text(self, texts):
            self.calls += 1
            if self.calls < 3:
                raise RuntimeError("later")
            return np.ones((len(texts), 2))

    flaky = Flaky()
    assert encoders.Retrying(flaky, wait_seconds=0).encode_text(["a"]).shape == (1, 2) and flaky.calls == 3
    with pytest.raises(RuntimeError):
        encoders.Retrying(Flaky(), tries=2, wait_seconds=0).encode_text(["a"])
    with pytest.raises(KeyError):
        encoders.registered("none")
    images = spark.createDataFrame([("a", b"xyz"), ("b", None)], "path string, bytes binary")
    got = {r["path"]: r["embedding"] for r in encoders.encode_images(images, encoders.HashingEncoder(4)).collect()}
    assert got["b"] is None and len(got["a"]) == 4


def test_stream_fills_the_store(spark, tmp_path):
    from rankspark.streaming.cache_stream import encode_stream, stream_documents

    source, store = str(tmp_path / "in"), cache.EmbeddingStore(spark, str(tmp_path / "store"), "m", "bio")
    ddl = "id string, content string"
    for batch in ([("1", "a"), ("1", "a")], [("2", "b"), ("1", "a")]):
        spark.createDataFrame(batch, ddl).write.mode("append").parquet(source)
        encode_stream(stream_documents(spark, source, ddl), store, encoders.HashingEncoder(4), str(tmp_path / "checkpoint")).awaitTermination(120)
    assert sorted(r["id"] for r in store.rows().collect()) == ["1", "2"]


def test_whole_evaluation(spark):
    corpus = spark.createDataFrame([("1", 0, "red apple"), ("2", 1, "blue sky"), ("3", 2, "green sea")], "doc_id string, pos long, content string")
    queries = spark.createDataFrame([("q", "blue sky")], "query_id string, query string")
    gold = spark.createDataFrame([("q", "2", 1)], "query_id string, doc_id string, rel int")
    for run in (evaluation.dense_run(queries, corpus, encoders.registered("hashing")), evaluation.bm25_run(queries, corpus)):
        row = evaluation.report(run, gold, (1, 10)).first()
        assert row["NDCG@1"] == row["Oracle NDCG@1"] == row["MRR"] == 1.0
    keyed = run.withColumn("domain", F.lit("d"))
    rows = evaluation.summary(keyed, gold.withColumn("domain", F.lit("d")), (1,)).collect()
    assert {(r["domain"], r["metric"]): r["value"] for r in rows}[None, "NDCG"] == 1.0


def test_missing_images_in_fused_search(spark):
    docs = spark.createDataFrame([("1", 0, [1.0, 0.0], [0.0, 1.0]), ("2", 1, [1.0, 0.0], None), ("3", 2, None, [0.0, 1.0])], "doc_id string, pos long, text_vec array<double>, image_vec array<double>")
    asked = spark.createDataFrame([("q", [1.0, 0.0], None)], "query_id string, text_vec array<double>, image_vec array<double>")
    assert [r["doc_id"] for r in evaluation.fused_run(asked, docs, None, 3).orderBy("rank").collect()] == ["2", "1", "3"]


def test_experiments(spark):
    assert experiments.grid_of(spark, {"text": ["a", "b"], "pair": ["a"]}, ["x", "y"]).count() == 6
    assert experiments.config_key(model="a", debug=True) != experiments.config_key(model="a", debug=False)
    assert experiments.config_key(a=1, b=2) == experiments.config_key(b=2, a=1)
