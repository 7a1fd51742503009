"""From raw documents to packed sequences: five stages, each over all that the one before kept.

All stages take empty tables, null and empty texts (both count as empty), very long ones, and further columns of any name,
which all but the last stage keep. Rows with a null id are judged by their text like others, but take no part in near copies. Of rows
that repeat an id and a text, exact deduplication keeps one; rows that repeat an id with another text are rows of their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gritline.llm import exact, near_copies, packing, pii, quality
from gritline.operators.skew import stage

VOCABULARY = "byte_bpe_50k.json"
SEQUENCE = 2048


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier selects; it is fitted on labelled ones among ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.drop_poor(docs, quality.train(docs, labels))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal text, the one with the largest id."""
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return near_copies.drop_near_copies(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs, pii.train(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per token piece with its place in a sequence of at most 2,048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path(VOCABULARY), SEQUENCE)


STAGES = [
    ("quality", select_quality),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

# Fitting a classifier, merging tokens and best fit are beyond SQL; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``; each stage is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, work in STAGES:
        docs = stage(work(spark, docs, sf_dir))
    return docs
