"""The queries of this subpackage: opN_<name>, and the pipeline where corpus_pipeline.py is there."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, covertree, decontaminate, minhash, pii, shards, substrings, tokens, toxicity
from .scratch import scratch_path

#: Vocabulary file of the token queries, and its number of ids.
TOKENIZER, VOCABULARY = public_tokenizers.path("byte_bpe_50k.json"), 50257
TOKEN_LIMIT = 1024
SHARDS = 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard_by_bytes(_table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, cache = _table(spark, sf_dir, "documents"), scratch_path(spark, "token-cache")
    tokens.count_tokens(docs, TOKENIZER, cache)  # an empty cache: every distinct text is encoded
    counted = tokens.count_tokens(docs, TOKENIZER, cache)  # a full one: none is
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op6_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op7_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.packed_round_trip(_table(spark, sf_dir, "documents"), TOKENIZER, VOCABULARY)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), TOKENIZER)


def op9_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), minhash.MinMax(shingle=3, numerator=85))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_table(spark, sf_dir, "documents"), window=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_shards": op2_shards,
    "op3_pii": op3_pii,
    "op4_decontamination": op4_decontamination,
    "op5_token_counts": op5_token_counts,
    "op6_covertree": op6_covertree,
    "op7_packed_ids": op7_packed_ids,
    "op8_bpe": op8_bpe,
    "op9_minmax": op9_minmax,
    "op10_repeats": op10_repeats,
}
ORACLES: dict[str, str] = {"op4_decontamination": decontaminate.ORACLE}
