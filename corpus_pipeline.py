"""A training corpus from raw documents: five stages, each by one operator of rankspark.llm.

A stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of docs. Null, empty and
very long texts, ties, repeated rows, empty tables and further columns go through every stage. Python workers let go of
what they have looked up at each task's end, as workers of several stages are alive at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.llm import jaccard, langid, packing, suffix_dedup, toxicity
from rankspark.llm.common import bound_batches, crc_bucket, free_name, materialize, remove, step

#: A text whose words tell less than this for its language is rejected: it is junk, not a text in a learned language. In
#: texts of fewer words than the second number, which two languages may share, that is no evidence, and they stay if they
#: have a letter of a learned script.
LEAST_LANGUAGE = 0.1
FEW_WORDS = 5
TOXIC_FROM = 0.7
#: A passage is a string of so many words that two documents hold. In prose of the corpus' languages 50 words are 247 bytes
#: at least, so strings of PASSAGE_BYTES find every such passage; runs of fewer words stay.
PASSAGE_WORDS = 50
PASSAGE_BYTES = 240


def _names(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those whose words belong to no learned language, go. A null lang is filled in.

    A short text in a script that was learned stays, and a labelled document stays if the model has nothing on its language, or no evidence either way on its words (their
    script wasn't learned). If there is no labelled row to learn from, only documents without a letter go.
    """
    bound_batches(spark)
    model = langid.train(docs.where(F.coalesce(crc_bucket("doc_id", 4), F.lit(0)) != 2))
    pred, score = free_name(docs, "_lang"), free_name(docs, "_score")
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(docs, model, pred=pred, score=score, spans=None, lasting=False)
    short = (F.size(F.split(F.trim("text"), r"\s+")) < FEW_WORDS) & F.col("text").rlike(langid.letters_of(model))
    unread = (F.trim(F.col("lang")) != "") & ((F.col(score) == 0) | ~F.col("lang").isin(model.languages))
    kept = found.where((F.col(pred) != langid.UNKNOWN) & ((F.col(score) >= LEAST_LANGUAGE) | short | F.coalesce(unread, F.lit(False))))
    return kept.select([F.coalesce(F.col("lang"), F.col(pred)).alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores as toxic go. It is learned from labels of the documents that are still here."""
    bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    grammar = toxicity.train(docs, labels.where(crc_bucket("doc_id", 3) != 1))
    score = free_name(docs, "_toxicity")
    return toxicity.score(docs, grammar, out=score, hits=None, lasting=False).where(F.col(score) < TOXIC_FROM).select(_names(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays. Of rows that repeat an id, one stays;
    rows without an id have no group and stay."""
    bound_batches(spark)
    keep, named = free_name(docs, "_keep"), docs.where("doc_id is not null")
    first = jaccard.join_classes(named).where("id = component_id").select(F.col("id").alias(keep)).distinct()
    kept = named.join(first, F.col("doc_id") == F.col(keep), "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null")).select(_names(docs))


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that two documents hold are cut out of the texts, at all places, and n_chars follows. What a document
    repeats within itself alone stays. Documents stay, also those that nothing is left of; null texts stay null."""
    bound_batches(spark)
    kept, removed, spans = (free_name(docs, x) for x in ("_kept", "_removed", "_spans"))
    found = suffix_dedup.remove_repeats(docs, length=PASSAGE_BYTES, rest="text", kept=kept, removed=removed, spans=spans, across=True, words=PASSAGE_WORDS)
    text = F.when(F.col(removed) > 0, F.col(kept)).otherwise(F.col("text"))
    length = F.when(F.col(removed) > 0, F.length(kept).cast("long")).otherwise(F.col("n_chars"))
    return found.select([text.alias(c) if c == "text" else length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts as pieces of at most 2,048 tokens in as few sequences: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset."""
    bound_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), lasting=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("toxicity", remove_toxic),
    ("near duplicates", drop_near_duplicates),
    ("repeated strings", remove_repeated_strings),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each is written to the shared folder and read again as the next one's input. What a
    stage has written besides, and its input if an earlier stage wrote it, goes when its output is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with step(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{k + 1}", outer=True)
        if before:
            remove(spark, before)
        before = docs.inputFiles()[0].rsplit("/", 1)[0] if docs.inputFiles() else None
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the language model, the grammar and the packing; a test holds run() against the stages' rules in plain
#: Python: labels and scores text by text, all pairs of word sets, a count of all strings, the tokenizers library.
ORACLE_SQL = None
