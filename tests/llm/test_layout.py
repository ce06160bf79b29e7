"""Sharding, packing and the pipeline."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rankspark.llm import common, langid, packing, sharding, toxicity
from rankspark.llm.queries import op5_sharding, op6_packing
from tests.llm.test_jaccard import brute as plain_classes
from tests.llm.test_suffix_dedup import brute

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def shard_rows(spark, rows, shards=6):
    return sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shards).collect()


def laws(rows, n, shards, largest):
    sizes, slots = Counter(), {}
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == n and all(0 <= s < shards for s in sizes)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    ideal = sum(sizes.values()) / shards
    assert all(abs(sizes[s] - ideal) <= 2 * largest + 0.03 * ideal for s in range(shards))


def test_sizes_are_near_equal(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "x" * int(n) + str(i)) for i, n in enumerate(rng.integers(0, 300, 3000))] + [(9000, None), (9001, "")]
    laws(shard_rows(spark, rows), len(rows), 6, 320)


def test_a_group_with_a_third_of_the_rows_is_cut_and_others_stay_whole(spark):
    rows = [(i, "hot" * 20) for i in range(1500)] + [(10_000 + i, f"text {i // 2} " * 5) for i in range(3000)]
    got = shard_rows(spark, rows)
    laws(got, len(rows), 6, 80)
    homes = {}
    for r in got:
        homes.setdefault(r["text"], set()).add(r["shard"])
    assert len(homes["hot" * 20]) > 1 and sum(len(h) > 1 for h in homes.values()) <= 6


def test_shard_edges(spark):
    assert shard_rows(spark, [(1, "a")][:0]) == []
    few = shard_rows(spark, [(1, "a"), (2, "b")], 24)
    assert len(few) == 2 and {r["slot"] for r in few} == {0}
    same = shard_rows(spark, [(1, "a")] * 50, 4)
    assert sorted(r["slot"] for r in same) == list(range(50))
    clash = spark.createDataFrame([(1, "a", "s", 5)], "doc_id long, text string, shard string, _key int")
    assert sharding.shard(clash).columns == ["doc_id", "text", "_key", "size", "law", "shard", "slot"]
    nulls = sharding.shard(spark.createDataFrame([(None, None), (None, "é")], "doc_id long, text string"), 2).collect()
    assert sorted(r["size"] for r in nulls) == [8, 10]


def test_shard_query(spark, tmp_path):
    spark.createDataFrame([(i, f"é{i}") for i in range(500)] + [(500, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = op5_sharding(spark, str(tmp_path)).collect()
    assert rows[0].asDict().keys() == {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    for r in rows:
        raw = f"é{r['doc_id']}".encode() if r["doc_id"] < 500 else b""
        assert (r["size"], r["text_crc32"], r["grown_shard"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), None, "bytes")


TEXTS = ["", "It's a Test  of 123 ÉCOLE -- don't\tI'LL", "日本語 mixed ΑΣΣΑΣ", "<|endoftext|>a<|startoftext|>", "ﬁ é é", "x\x85y\xa0z\x1cq", "İstanbul ǅ"]


def test_ids_like_the_library():
    got = packing.WordTokenizer(PATH).encode_all([*TEXTS, None])
    assert [g.tolist() for g in got[:-1]] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in TEXTS] and not len(got[-1])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]), max_size=60), max_size=5))
def test_any_ids_like_the_library(texts):
    got = packing.WordTokenizer.__new__(packing.WordTokenizer)
    got.__dict__ = TOKENIZER.__dict__
    assert [g.tolist() for g in got.encode_all(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


TOKENIZER = packing.WordTokenizer(PATH)


def valid(counts, patterns, capacity):
    used = Counter()
    for p in patterns:
        assert p.size <= capacity and p.times > 0
        for n, k in p.lengths:
            used[n] += k * p.times
    assert {n: c for n, c in enumerate(counts) if c} == dict(used)
    return sum(p.times for p in patterns)


def plain_shards(rows, shards):
    """The law by plain Python: rows in key order, splitters where the bytes before them are nearest to their share, moved
    to the nearest edge of a group of equal texts if that is within FOR_GROUPS of a shard."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k]["key"], rows[k]["doc_id"]))
    edges, bins = [0], []  # rows of one key are one bin
    for k in order:
        if bins and rows[bins[-1][0]]["key"] == rows[k]["key"]:
            bins[-1].append(k)
            edges[-1] += rows[k]["size"]
        else:
            bins.append([k])
            edges.append(edges[-1] + rows[k]["size"])
    total = edges[-1]
    whole = [j for j in range(len(bins) + 1) if j in (0, len(bins)) or rows[bins[j][0]]["key"] >> 32 != rows[bins[j - 1][0]]["key"] >> 32]
    cuts = []
    for i in range(1, shards):
        t = total * i // shards
        near, group = (min(c, key=lambda j: abs(edges[j] - t)) for c in (range(len(edges)), whole))
        pick = group if abs(edges[group] - t) <= sharding.FOR_GROUPS * total / shards else near
        cuts.append(max(pick, cuts[-1] if cuts else 0))
    shard, slot, used = {}, {}, Counter()
    for j, members in enumerate(bins):
        for k in members:
            shard[k] = sum(c <= j for c in cuts)
            slot[k] = used[shard[k]]
            used[shard[k]] += 1
    return shard, slot


@pytest.mark.parametrize("shards,seed", [(6, 1), (24, 2), (3, 3)])
def test_shards_against_plain_python(spark, shards, seed):
    """Every row's shard and slot: the histogram's bins end at single keys here, so nothing is within a tolerance only."""
    rng = np.random.default_rng(seed)
    rows = [(i, "t" * int(rng.integers(1, 400)) + str(i % 211)) for i in range(900)] + [(1000 + i, "copy " * 30) for i in range(500)] + [(5000, None), (5001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    keyed = df.withColumn("key", sharding.row_key(F.coalesce("text", F.lit("")), F.col("doc_id")))
    size = sharding.row_size(F.col("text"))
    given = [r.asDict() for r in keyed.select("doc_id", "key", size.alias("size")).collect()]
    shard, _ = plain_shards(given, shards)
    want = {r["doc_id"]: shard[k] for k, r in enumerate(given)}
    got = sharding.shard(df, shards).collect()
    total = sum(r["size"] for r in given)
    off = Counter()
    for r in got:
        if r["shard"] != want[r["doc_id"]]:
            off[min(r["shard"], want[r["doc_id"]])] += r["size"]
    assert all(b <= max(sharding.TOLERANCE, 2 * sharding.FOR_GROUPS) * total / shards + 2 * 500 for b in off.values())
    by_shard = {}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values()) and len(got) == len(rows)


def fewest(lengths, capacity):
    """Exhaustive search."""
    best = len(lengths)

    def put(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= capacity and bins[i] not in bins[:i]:
                put(k + 1, bins[:i] + [bins[i] + lengths[k]] + bins[i + 1 :])
        put(k + 1, [*bins, lengths[k]])

    put(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_plans_against_exhaustive_search(lengths):
    counts = np.bincount(lengths, minlength=21)
    best = fewest(sorted(lengths, reverse=True), 20)
    assert packing.lower_bound(counts, 20) <= best
    assert valid(counts, packing.plan(counts, 20), 20) == valid(counts, packing.plan(counts, 20, packing.UNBOUNDED), 20) == best


def test_a_third_of_all_pieces_just_over_half_a_sequence():
    """Copies that can't be paired: the lower bound knows it, so the plan is proved best."""
    counts = np.bincount(np.concatenate([np.full(10_000, 1100), np.random.default_rng(2).integers(1, 1500, 20_000)]), minlength=2049)
    n = valid(counts, packing.plan(counts), 2048)
    assert packing.lower_bound(counts) <= n <= packing.lower_bound(counts) + 2
    alone = np.bincount([1100] * 500 + [1000] * 3, minlength=2049)
    assert valid(alone, packing.plan(alone), 2048) == packing.lower_bound(alone) == 502


def test_large_plans_reach_the_bound():
    counts = np.bincount(np.random.default_rng(1).integers(1, 1500, 30_000), minlength=2049)
    n = valid(counts, packing.plan(counts), 2048)
    assert n <= -(-int((counts * np.arange(2049)).sum()) // 2048) + 1
    assert packing.plan(np.zeros(2049)) == []


def check_packing(rows, docs):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    for i, text in docs:
        ids = np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [p["start"] for p in parts] == list(range(0, len(ids), 2048))
        for p in parts:
            piece = ids[p["start"] : p["start"] + 2048]
            assert (p["length"], p["ids_crc32"]) == (len(piece), zlib.crc32(piece.tobytes()))
    return len(by_sequence)


def test_packing_query(spark, tmp_path):
    docs = [(i, "some words here " * (i % 97 * i % 1200)) for i in range(200)] + [(300 + i, "copy of a text " * 9) for i in range(700)] + [(2000, None), (2001, "z" * 5000), *((2100 + k, t) for k, t in enumerate(TEXTS))]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows = op6_packing(spark, str(tmp_path)).collect()
    n = check_packing(rows, docs)
    assert n <= -(-sum(r["length"] for r in rows) // 2048) + 2


def test_packing_edges(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "a b", 2), (1, "a b", 2)], "doc_id long, text string, length int")
    rows = packing.pack_documents(df, PATH, keep_ids=True).collect()
    assert sorted(tuple(r["ids"])[-1] for r in rows) == [0, 0, 0] and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


def pipeline_docs():
    rng = np.random.default_rng(4)
    words = [f"w{a}{b}n" for a in "aeiou" for b in "bcdfghjklm"]
    text = lambda n: " ".join(rng.choice(words, n))
    passage = " ".join(f"{a}shared{b}" for a in "abcdefgh" for b in "opqrstuv")
    rows = [(i, text(60), "en") for i in range(300)]
    rows += [(400 + i, text(60) + (" grublingo" if i < 60 else ""), "en") for i in range(120)]
    base = text(100)
    rows += [(600, base, "en"), (601, base, "en"), (602, base + " tail", "en"), (603, f"{text(40)} {passage} {text(40)}", "en"), (604, f"{text(50)} {passage} {text(30)}", "en")]
    rows += [(700, None, "en"), (701, "", None), (702, "12 34", "en"), (703, text(50), None), (704, text(6000), "en"), (300, text(60), "en"), (None, text(50), "en")]
    return [(i, t, lang, "src", len(t or ""), "extra") for i, t, lang in rows], passage


DDL = "doc_id long, text string, lang string, source string, n_chars long, `_keep` string"


def test_heaps_shrink_between_jobs_of_a_cluster(spark, monkeypatch):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: next(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    seen = [whole()]
    for act in (lambda: common.shrink_heaps(spark), lambda: common.materialize(spark.range(3).toDF("x"), "three"), lambda: common.bound_batches(spark)):
        monkeypatch.setattr(common, "on_cluster", lambda _: True)
        act()
        seen.append(whole())
    assert [b - a >= 2 for a, b in zip(seen, seen[1:])] == [True] * 3  # the driver's call and an executor's task


def test_stages(spark, tmp_path):
    rows, passage = pipeline_docs()
    docs = spark.createDataFrame(rows, DDL)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(400 + i, 1, int(i < 60)) for i in range(120)] + [(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept, where = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, where, str(tmp_path)).write.parquet(str(tmp_path / name))
        where = spark.read.parquet(str(tmp_path / name))
        kept[name] = where.collect()
        if name != "packing":
            assert where.columns == docs.columns
    ids = {name: {r["doc_id"] for r in rows} for name, rows in kept.items()}
    everything = {r[0] for r in rows}
    assert everything - ids["language"] == {700, 701, 702}
    assert ids["language"] - ids["toxicity"] == set(range(400, 460))
    assert ids["toxicity"] - ids["near duplicates"] == {601, 602}
    assert next(r for r in kept["language"] if r["doc_id"] == 703)["lang"] == "en"
    cut = {r["doc_id"]: r for r in kept["repeated strings"]}
    assert ids["repeated strings"] == ids["near duplicates"]
    assert all(passage not in cut[i]["text"] and cut[i]["n_chars"] == len(cut[i]["text"]) < 600 for i in (603, 604))
    assert check_packing(kept["packing"], [(i, r["text"]) for i, r in cut.items() if i is not None]) > 1
    once = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or -1, r["piece"], r["ids_crc32"]) for r in once) == sorted((r["doc_id"] or -1, r["piece"], r["ids_crc32"]) for r in kept["packing"])


def test_the_passage_stage_against_brute_force(spark, tmp_path):
    """Passages of 50 to 60 short words, 240 to 400 bytes, in two or three documents each; lines repeated in one."""
    rng = np.random.default_rng(9)
    text = lambda n: " ".join("".join(rng.choice(list("aeioubdfgklmn"), rng.integers(1, 9))) for _ in range(n))
    docs = {i: text(int(rng.integers(20, 200))) for i in range(120)}
    passages = [text(51 + k % 10) for k in range(12)] + [text(44), text(47)]
    for k, p in enumerate(passages):
        for j in range(2 + k % 2):
            docs[3 * k + j] = f"{docs[3 * k + j]} {p} {text(30)}"
    docs[100] = docs[100] + (text(60) + "\n") * 4  # as often as it likes within itself
    docs[101] = ""
    rows = [(i, t, "en", "src", len(t), "extra") for i, t in docs.items()] + [(500, None, "en", "src", 0, "extra")]
    found = corpus_pipeline.remove_repeated_strings(spark, spark.createDataFrame(rows, DDL).repartition(4), str(tmp_path))
    got = {r["doc_id"]: r for r in found.collect()}
    want = brute(list(docs.values()), corpus_pipeline.PASSAGE_BYTES, True, corpus_pipeline.PASSAGE_WORDS)
    for (i, t), (removed, _, kept) in zip(docs.items(), want):
        assert got[i]["text"] == kept.decode() and got[i]["n_chars"] == len(kept.decode()) and (removed > 0) == (i < 42 and i // 3 < 12 and i % 3 < 2 + i // 3 % 2)
    assert got[500]["text"] is None and all(p not in r["text"] for r in got.values() if r["text"] for p in passages[:12])


def test_the_pipeline_against_plain_python(spark, tmp_path):
    """run() against the stages' rules, text by text and pair by pair."""
    rows, _ = pipeline_docs()
    rows = [r for r in dict.fromkeys(rows) if r[0] is not None and r[0] < 705][:-1]
    spark.createDataFrame(rows, DDL).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(400 + i, 1, int(i < 60)) for i in range(120)] + [(i, 1, 0) for i in range(300)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    fold = lambda i, n: zlib.crc32(str(i).encode()) % n
    model = langid.fit([(t, lang) for i, t, lang, *_ in rows if lang and fold(i, 4) != 2])
    said = langid.label(model, [r[1] for r in rows])
    left = {r[0]: r[1] for r, (pred, score, _) in zip(rows, said) if pred != "und" and (score >= corpus_pipeline.LEAST_LANGUAGE or len(r[1].split()) < corpus_pipeline.FEW_WORDS)}
    grammar = toxicity.fit([(left[i], y) for i, _, y in labels if i in left and fold(i, 3) != 1])
    left = {i: t for i, t in left.items() if grammar.score(t)[0] < corpus_pipeline.TOXIC_FROM}
    left = {i: left[i] for i, (_, component) in plain_classes(list(left.items())).items() if i == component}
    cut = brute(list(left.values()), corpus_pipeline.PASSAGE_BYTES, True, corpus_pipeline.PASSAGE_WORDS)
    left = {i: kept.decode() for i, (_, _, kept) in zip(left, cut)}
    assert sum(removed > 0 for removed, _, _ in cut) == 2 and 300 < len(left) < len(rows) - 60
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(left)
    n = check_packing(packed, list(left.items()))
    lengths = np.bincount([r["length"] for r in packed], minlength=packing.CAPACITY + 1)
    assert n == packing.lower_bound(lengths)


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_an_empty_table(spark, tmp_path, stage):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    empty = spark.createDataFrame([], DDL)
    assert corpus_pipeline.STAGES[stage][1](spark, empty, str(tmp_path)).count() == 0
