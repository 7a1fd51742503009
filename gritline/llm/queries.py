"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from gritline.llm import (
    bpe,
    conversations,
    exact,
    huffman,
    importance,
    packing,
    passages,
    pii,
    quality,
    simhash,
    token_counts,
    topk,
    toxicity,
)
from gritline.llm.oracles import ORACLES as ORACLES
from gritline.operators.skew import shared_dir

WORDS = "word_bpe_49k.json"
BYTES = "byte_bpe_50k.json"
SEQUENCE = 2048


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_read(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(_read(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(WORDS)
    ids = bpe.encode(_read(spark, sf_dir, "documents"), path)
    decoded = bpe.decode(ids, path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path(BYTES), SEQUENCE)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), 20)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    return toxicity.severity(documents, toxicity.train(documents, _read(spark, sf_dir, "labels")))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("bigint")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    found = pii.personal_data(documents, pii.train(documents))
    base = F.filter("spans", lambda s: s.base)
    counts = [_count(base, kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))
    return counts.withColumn("over_limit", F.col("n_tokens") > SEQUENCE)


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    return quality.quality(documents, quality.train(documents, _read(spark, sf_dir, "labels")))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    huffman.write_ids(_read(spark, sf_dir, "documents"), public_tokenizers.path(BYTES), folder)
    return huffman.read_ids(spark, folder).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damage(_read(spark, sf_dir, "conversations"))
    return conversations.digests(damaged, conversations.audits(damaged))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_simhash": op2_simhash,
    "op3_bpe": op3_bpe,
    "op4_packing": op4_packing,
    "op5_topk": op5_topk,
    "op6_toxicity": op6_toxicity,
    "op7_pii": op7_pii,
    "op8_token_counts": op8_token_counts,
    "op9_passages": op9_passages,
    "op10_quality": op10_quality,
    "op11_resample": op11_resample,
    "op12_id_files": op12_id_files,
    "op13_conversations": op13_conversations,
    "pipeline": corpus_pipeline.run,
}
