"""BPE against the tokenizers library, merge rules and round trips."""

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rankspark.llm import bpe
from rankspark.llm.queries import op1_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY, OWN, TABLE = Tokenizer.from_file(PATH), bpe.ByteBpe(PATH), bpe.OffsetTable(PATH)
ODD = ["", " ", "  a  b\n\n c\t", "<|endoftext|>x<|endoftext|> <|endof", "it's we'LL I'M", "日本語 ٣٤ é ½²", "a" * 3000, "ab" * 700, "!" * 300 + "\n" * 40, "\x00\x01\x85\x1c", "👩‍👩‍👧 mixed Привет"]


@pytest.mark.parametrize("text", ODD)
def test_like_the_library(text):
    ids = OWN.encode(text)
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want
    assert TABLE.decode(ids) == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x2FF, exclude_categories=["Cs", "Cn"]), max_size=80))
def test_any_text(text):
    ids = OWN.encode(text)
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert TABLE.decode(ids) == text


@given(st.binary(min_size=1, max_size=24))
@settings(max_examples=300, deadline=None)
def test_backtracking_gives_what_the_merge_rules_give(raw):
    assert [OWN.token[i] for i in OWN.encode_piece(raw)] == OWN.merged(raw)


def test_compatibility_table():
    import random

    rng = random.Random(1)
    ids = [i for i in OWN.token if OWN.merged_whole(i)]
    short = [i for i in ids if len(OWN.token[i]) <= 3]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(1500)] + [(rng.choice(short), rng.choice(short)) for _ in range(3000)] + [(i, i) for i in rng.sample(ids, 500)]
    for a, b in pairs:
        x, y = OWN.token[a], OWN.token[b]
        assert OWN.compatible(a, b) == (OWN.merged(x + y) == [x, y]), (x, y)


def test_decoding_of_ids_that_are_no_text():
    import numpy as np

    assert TABLE.decode(np.array([], np.int64)) == ""
    assert TABLE.decode(np.array([-1, 10**6])) == ""
    half = next(i for i, b in OWN.token.items() if b == b"\xc3")
    assert TABLE.decode(np.array([half])) == "�"


def test_columns(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "y"), (3, "", None)], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, PATH), PATH)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert (rows[1]["decoded"], rows[2]["decoded"], rows[2]["ids"], rows[3]["ids"]) == ("hello world", "", [], [])
    assert bpe.encode(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(df, PATH, "nowhere")


def test_query(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate([*ODD, None])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in op1_bpe(spark, str(tmp_path)).collect():
        ids = LIBRARY.encode(rows[r["doc_id"]][1] or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(",".join(map(str, ids))), digest(LIBRARY.decode(ids, skip_special_tokens=False)))


def test_a_vocabulary_with_a_token_of_300_bytes(tmp_path):
    import json

    spec = json.loads(open(PATH, encoding="utf-8").read())
    letters = [*bpe.byte_alphabet()]
    merges = [("a" * n, "a" * n) for n in (1, 2, 4, 8, 16, 32, 64, 128)] + [("a" * 256, "a" * 32), ("a" * 288, "a" * 8), ("a" * 296, "a" * 4), ("b", "a" * 4)]
    tokens = letters + [x + y for x, y in merges]
    spec["model"] |= {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": [list(m) if isinstance(spec["model"]["merges"][0], list) else " ".join(m) for m in merges]}
    spec["added_tokens"] = []
    (tmp_path / "own.json").write_text(json.dumps(spec), encoding="utf-8")
    own, library = bpe.ByteBpe(str(tmp_path / "own.json")), Tokenizer.from_file(str(tmp_path / "own.json"))
    assert own.reach == 300
    for text in ["a" * n for n in (1, 299, 300, 301, 600, 1000, 4999)] + ["b" + "a" * 700, "a" * 300 + "b" + "a" * 305]:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert own.encode("a" * 300).tolist() == [tokens.index("a" * 300)]


def test_very_long_texts():
    for text in ("word and word, " * 80_000, "ab" * 150_000, "é" * 100_000):
        ids = OWN.encode(text)
        assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids and TABLE.decode(ids) == text
