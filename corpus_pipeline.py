"""The corpus pipeline: quality, exact dedup, near dedup, mixing, tokens.

``STAGES`` lists (name, function); each function takes ``(spark, docs, sf_dir)``.
A stage works on all rows its predecessor kept, written as Parquet and read
again.  All but the last return the columns of ``documents``; the last returns the
token counts and digests of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hashsieve.llm import bpe, exact_dedup, minhash, mixing, quality
from hashsieve.llm.common import table, written

NEAR = 80  # per cent of shingles of five words that near copies share; the contract of op1 alone asks for 85


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id."""
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest id."""
    return minhash.representatives(docs, similarity=NEAR)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates whose expected token totals match the target weights: tempered shares of the languages, no repeats."""
    return mixing.mixed(docs, mixing.solve(docs, mixing.language_labels(docs)))


def count_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every whole text, encoded and decoded."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_domains),
    ("bpe", count_tokens),
]

#: Classifiers, MinHash and BPE cannot be written in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
