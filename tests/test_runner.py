"""Tasks from files to summaries, profiles and commands."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankspark import cli, schemas
from rankspark.functions import images
from rankspark.operators import profiles
from rankspark.operators.encoders import HashingEncoder
from rankspark.operators.tokens import cut_by_tokenizer
from rankspark.plans.runner import Settings, domain_run, run
from rankspark.sources import readers


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    docs = [("bio/aa01_1.txt", "the red apple falls"), ("bio/bb02_2.txt", "blue sky above"), ("bio/cc03_3.txt", "green sea below")]
    spark.createDataFrame(docs, schemas.DOCUMENTS).write.parquet(str(root / "documents/bio"))
    queries = [("1", "red apple", ["bio/aa01_1.txt"], ["N/A"], ["q1.png"], [("bio/bio_aa01_0001\\i.png",)], None), ("2", "sea below", ["bio/cc03_3.txt"], ["bio/bb02_2.txt"], None, None, None)]
    spark.createDataFrame(queries, schemas.EXAMPLES_MULTIMODAL).write.parquet(str(root / "examples/bio"))
    png = lambda s: b"\x89PNG" + s
    spark.createDataFrame([("bio/bio_aa01_0001/i.png", png(b"apple")), ("bio/bio_bb02_0001/i.png", png(b"0000"))], schemas.IMAGES).write.parquet(str(root / "images/bio"))
    spark.createDataFrame([("q1.png", png(b"apple"))], schemas.IMAGES).write.parquet(str(root / "query_images/bio"))
    return root


def settings(files, task, model, **more):
    where = {"documents": "documents", "examples": "examples", "document_images": "images", "query_images": "query_images", "output": "out"}
    return Settings(task, model, ("bio",), **{k: str(files / v) for k, v in where.items()}, **more)


@pytest.mark.parametrize(("task", "model"), [("text_text", "bm25"), ("text_text", "hashing"), ("multimodal_text", "hashing"), ("text_image", "hashing"), ("text_pair", "hashing")])
def test_tasks(spark, files, task, model):
    out = run(spark, settings(files, task, model))
    assert out["task_type"] == task and len(out["domains"]["bio"]) == 31
    assert out["aggregated"]["Recall@10"] == (0.5 if task == "text_image" else 1.0)  # one query has no positive image


def probe():
    class Probe:
        """Texts by their letters, images by their length; texts with images by both."""

        dim = 3

        def encode_text(self, texts):
            return [[float(t.count("e")), float(t.count("a")), 1.0] for t in texts]

        def encode_image(self, images):
            return [[float(len(b)), 0.0, -1.0] for b in images]

        def encode_joint(self, texts, images):
            return [[float((t or "").count("e")), float((t or "").count("a")), float(len(b or b""))] for t, b in zip(texts, images)]

    return Probe()  # a class of its own function goes to the workers by value


def test_blank_images_are_fused_by_side(spark, files):
    """A query without an image is fused with a blank one's vector, a document of texts alone with nothing."""
    run_, _ = domain_run(spark, settings(files, "multimodal_text", "clip"), "bio", probe())
    got = {r["doc_id"]: r["score"] for r in run_.where("query_id = '2'").collect()}
    white = probe().encode_image([images.blank_image()])[0]
    q = (np.array(probe().encode_text(["sea below"])[0]) + white) / 2
    for doc, text in (("bio/aa01_1.txt", "the red apple falls"), ("bio/cc03_3.txt", "green sea below")):
        v = np.array(probe().encode_text([text])[0])
        assert got[doc] == pytest.approx(100 * q @ v / np.linalg.norm(q) / np.linalg.norm(v), rel=1e-5)


def test_joint_encoders_take_text_and_image(spark, files):
    run_, judged = domain_run(spark, settings(files, "text_pair", "gme-qwen2-vl-2b"), "bio", probe())
    rows = {r["doc_id"]: r["score"] for r in run_.where("query_id = '1'").collect()}
    q, v = (np.array(probe().encode_joint([t], [b])[0]) for t, b in (("red apple", b"\x89PNGapple"), ("the red apple falls", b"\x89PNGapple")))
    assert rows["bio/aa01_1.txt|||bio/bio_aa01_0001/i.png"] == pytest.approx(100 * q @ v / np.linalg.norm(q) / np.linalg.norm(v), rel=1e-5)
    assert judged.count() > 0
    with pytest.raises(ValueError, match="encode_joint"):
        domain_run(spark, settings(files, "text_pair", "gme-qwen2-vl-2b"), "bio", HashingEncoder())


def test_of_images_that_repeat_a_path_the_last_row_stays(spark, tmp_path):
    rows = [("a.png", b"\x89PNG long bytes first"), ("b.png", b"\x89PNG"), ("a.png", b"\x89PNG2"), ("b.png", b"no image")]
    spark.createDataFrame(rows, schemas.IMAGES).coalesce(1).write.parquet(str(tmp_path / "images"))
    got = {r["path"]: bytes(r["bytes"]) for r in readers.read_images(spark, str(tmp_path / "images"), "d").collect()}
    assert got == {"a.png": b"\x89PNG2", "b.png": b"\x89PNG"}


def test_runs_are_reused_and_stores_filled(spark, files):
    s = settings(files, "text_text", "hashing", cache=str(files / "cache"), debug=True)
    assert run(spark, s) == run(spark, s)
    assert s.key() != settings(files, "text_text", "hashing").key()
    kept = spark.read.parquet(str(files / "cache"))
    assert kept.groupBy("modality").count().orderBy("modality").collect()[0]["count"] == 2


def test_profiles(spark):
    assert "bm25" in profiles.names("text_text") and "bm25" not in profiles.names("text_pair")
    df = spark.createDataFrame([("some text",)], "a string")
    steps = ("instruct", "chars:12", "prompt:search", "cut:2", "blank:x", "word:100")
    assert df.select(profiles.prepare(F.col("a"), steps, "In {task}: ", F.lit("d"))).first()[0] == "search_query: In"
    with pytest.raises(ValueError):
        profiles.prepare(F.col("a"), ("other",))
    for task in profiles.TASKS:
        for profile in profiles.PROFILES[task].values():
            profiles.prepare(F.col("a"), profile.query)
            profiles.prepare(F.col("a"), profile.document)


def test_commands(capsys):
    assert cli.main(["grid", "--tasks", "text_image", "--domains", "a", "b", "--dry-run", "--models", "clip", "siglip"]) == []
    assert capsys.readouterr().out.splitlines() == ["text_image clip a b", "text_image siglip a b"]
    with pytest.raises(SystemExit):
        cli.main(["task", "--task", "text_pair", "--model", "bm25", "--domains", "a"])


def test_cut_by_tokenizer(spark):
    class Letters:
        def encode(self, text):
            return [ord(c) for c in text]

        def decode(self, ids):
            return "".join(map(chr, ids))

    df = spark.createDataFrame([("abcdef",), ("ab",), (None,), ("",)], "content string")
    assert [r[0] for r in cut_by_tokenizer(df, Letters(), 3).collect()] == ["abc", "ab", None, ""]
