"""The corpus pipeline: from raw documents to packed training sequences.

Each stage works on all rows that its predecessor kept; all but the last
return the columns of ``documents``. The filtering stages write what they keep
as a table in the shared checkpoint folder, so every stage reads each text a
fixed number of times, whatever the stages after it do, and a lost executor
costs no earlier stage. The session's settings are the same after a stage as
before it.

Scale and defined cases are those of the operators, which have no bound on
rows, text length or group size. Null ids, null and empty texts, repeated rows,
extra columns and empty tables are taken by every stage.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, language, packing, simhash, toxicity
from tessera.llm.runtime import bounded_batches, stored


def _bounded(stage):
    """The stage run and stored with texts going to Python workers a few megabytes at a time."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with bounded_batches(spark):
            return stored(stage(spark, docs, sf_dir))

    return run


@_bounded
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more for toxicity go.

    The lexicon is learned from the labels of ``sf_dir`` and the texts of
    ``docs`` outside the held-out fold. Null and empty texts score 0 and stay.
    """
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


@_bounded
def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: null texts and those without a letter.

    Where no language was learned all texts with a letter stay.
    """
    return language.keep_identified(docs)


@_bounded
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of texts that are equal without white space stays: the longest, then that of the smallest id."""
    return exact_dedup.keep_one(docs)


@_bounded
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each class of linked fingerprints stays: that of the smallest id, null last.

    Fingerprints over runs of four words link at four differing bits, which
    only close copies reach.
    """
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens; every token is in one piece."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unidentified),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("packing", pack),
]

#: SQL can express neither the models nor the tokenizer; tests/llm/test_corpus_queries.py compares all stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        rows = stage(spark, rows, sf_dir)
    return rows
