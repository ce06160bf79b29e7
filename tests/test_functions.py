"""Column functions on hand-computed cases."""

import math

import pytest
from pyspark.sql import functions as F

from rankspark.functions import images as I
from rankspark.functions import text as T
from rankspark.functions import vectors as V


def values(spark, column, rows, ddl="a string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ddl)
    return [r[0] for r in df.select(column).collect()]


@pytest.mark.parametrize(("h", "w", "want"), [(224, 224, (224, 224)), (1, 1, (56, 56)), (14, 14, (56, 56)), (42, 70, (56, 56)), (100, 333, (112, 336)), (5000, 5000, (3556, 3556)), (10, 3000, (28, 2996)), (28, 6000, (28, 5600))])
def test_smart_resize(spark, h, w, want):
    assert tuple(spark.range(1).select(I.smart_resize(F.lit(h), F.lit(w)).alias("z")).first()["z"]) == want


@pytest.mark.parametrize(("text", "limit", "want"), [("hello world foo", 11, "hello world"), ("hello world foo", 13, "hello world"), ("abcdefghij klm", 12, "abcdefghij"), ("  short  ", 150, "short"), ("nospaceatallinhere", 10, "nospaceata"), ("one two three four", 12, "one two thre"), (None, 5, None), ("\n\t x\n", 9, "x")])
def test_truncate_at_word(spark, text, limit, want):
    assert values(spark, T.truncate_at_word(F.col("a"), limit), [text]) == [want]


def test_ids(spark):
    assert values(spark, T.base_key_of_passage(F.col("a")), ["academia/a7beca61_6123.txt", "foo.txt"]) == ["a7beca61", "foo.txt"]
    assert values(spark, T.base_key_of_image(F.col("a"), F.lit("academia")), ["academia/academia_a7beca61_0002/image_1.webp", "x/y.png"]) == ["a7beca61", ""]
    assert values(spark, T.base_key_of_image(F.col("a"), F.lit("a.b")), ["a.b_0f_1", "axb_0f_1"]) == ["0f", ""]
    assert values(spark, T.norm_id(F.col("a")), ["../.hid/x", "./a//b/./c/", "/x"]) == ["hid/x", "a/b/c", "x"]
    assert values(spark, T.pair_base(T.pair_id(F.col("a"), F.lit(None).cast("string"))), ["p"]) == ["p"]


def test_prompts(spark):
    assert values(spark, T.instruct(F.col("a"), "do {task}: ", F.lit("t")), ["x"]) == ["do t: x"]
    assert values(spark, T.instruct(F.col("a"), "{task} <{query}>", F.lit("t")), ["x"]) == ["t <x>"]
    assert values(spark, T.fill_template(F.col("a"), F.lit(False), True, "find"), ["x", None]) == ["Instruct: find\nQuery: x", "Instruct: find\nQuery: "]
    assert values(spark, T.fill_template(F.col("a"), F.lit(True), False), ["x"]) == ["<image>\nx"]
    assert values(spark, T.instruction_length(F.col("a")), ["Instruct: a b\nQuery: c", "<image> a Query: x", "c"]) == [3, 577, 0]
    assert values(spark, T.blank_guard(F.col("a")), [" \n", None, "x"]) == [" ", " ", "x"]


def test_ladder(spark):
    fits = lambda c: F.length(c) <= 60
    long = "word " * 60
    assert values(spark, T.truncate_ladder(F.col("a"), fits), [long, "ab"]) == [("word " * 12).strip(), "ab"]
    assert values(spark, T.truncate_ladder(F.col("a"), lambda c: F.lit(False)), [long, " x"]) == ["word word word word", "document"]


def test_uris_and_extensions(spark):
    uris = ["http://a", "https://a", "file:///b", "data:image/png;base64,QUI=", "c/d.png"]
    assert values(spark, I.uri_kind(F.col("a")), uris) == ["http", "http", "file", "data", "path"]
    assert values(spark, I.uri_payload(F.col("a")), uris) == ["http://a", "https://a", "/b", "QUI=", "c/d.png"]
    assert bytes(values(spark, I.data_uri_bytes(F.col("a")), uris[3:4])[0]) == b"AB"
    assert values(spark, I.has_image_extension(F.col("a")), ["x.JPG", "x.tiff", "x.svg", "x", "a.png/b"]) == [True, True, False, False, False]


def test_vectors(spark):
    rows, ddl = [([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>"
    assert values(spark, V.l2_normalize(F.col("a")), rows, ddl) == [[0.6, 0.8]]
    assert values(spark, V.l2_normalize(F.col("b"), "add"), rows, ddl) == [[0.0, 0.0]]
    assert values(spark, V.cosine(F.col("a"), F.col("b")), rows, ddl) == [0.0]
    assert values(spark, V.cosine(F.col("a"), F.col("b"), guard=False), rows, ddl) == [None]
    assert values(spark, V.layer_norm(F.col("a")), rows, ddl)[0] == pytest.approx([-0.5 / math.sqrt(0.25 + 1e-5), 0.5 / math.sqrt(0.25 + 1e-5)])
    assert values(spark, V.rms_norm(F.col("a")), rows, ddl)[0] == pytest.approx([3 / math.sqrt(12.5), 4 / math.sqrt(12.5)], rel=1e-5)
    assert values(spark, V.fuse_missing(F.col("a"), F.lit(None).cast("array<double>"), "zero"), rows, ddl) == [[1.5, 2.0]]
    assert values(spark, V.fuse_missing(F.col("a"), F.lit(None).cast("array<double>")), rows, ddl) == [[3.0, 4.0]]
    assert values(spark, V.rotate_half(F.array(*[F.lit(float(i)) for i in range(4)])), rows, ddl) == [[-2.0, -3.0, 0.0, 1.0]]
    with pytest.raises(ValueError):
        V.fuse_missing(F.col("a"), F.col("b"), "other")


def test_pooling(spark):
    df = spark.createDataFrame([("k", 0, 0, [9.0, 9.0]), ("k", 1, 1, [1.0, 2.0]), ("k", 2, 1, [3.0, 4.0]), ("k", 3, 0, [7.0, 7.0])], "k string, i int, m int, v array<double>")
    assert V.mean_pool(df, ["k"], "v", "m").first()["v"] == [2.0, 3.0]
    assert V.last_pool(df, ["k"], "v", "i", "m").first()["v"] == [3.0, 4.0]
    assert V.last_pool(df, ["k"], "v", "i").first()["v"] == [7.0, 7.0]
    assert V.first_pool(df, ["k"], "v", "i").first()["v"] == [9.0, 9.0]
    assert [r["offset"] for r in V.cumulative_offsets(df, ["k"], "i", "m").orderBy("i").collect()] == [0, 0, 1, 2]
    assert spark.range(1).select(V.position_ids(F.array(*[F.lit(x) for x in (0, 0, 1, 1, 1)])).alias("p")).first()["p"] == [1, 1, 0, 1, 2]
