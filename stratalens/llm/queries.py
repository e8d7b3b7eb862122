"""The corpus operators as queries over the given tables."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm import (
    bpe, conversation_repair, digest_index, fingerprints, line_templates, mixing, oracles, periodic_runs, quality_rules,
    ranking, secrets, sharding, simhash, warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """Path of an installed tokenizer file."""
    return importlib.import_module("public_tokenizers").path(name)


def op1_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(_table(spark, sf_dir, "documents"))


def op2_pairwise_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer())


def op4_warc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.ranked(warc.round_trip(_table(spark, sf_dir, "pages")))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
                        "urlkey", "timestamp", "rank")


def op5_simhash_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(_table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(_table(spark, sf_dir, "documents"))


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_templates.dedup(_table(spark, sf_dir, "documents"), dropped="dropped_lines")
    return rows.select("doc_id", F.size("dropped_lines").cast("bigint").alias("n_dropped"),
                       F.array_join(F.col("dropped_lines").cast("array<string>"), ",").alias("dropped_lines"), "text")


def op9_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_table(spark, sf_dir, "documents"), shards=16)
    return placed.withColumn("law", F.lit("key"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judged(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words", "base_failed", "kept")


def op11_streamed_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(_table(spark, sf_dir, "conversations"), damage=True)


def op12_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_index.groups(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.detect(_table(spark, sf_dir, "documents"), damage=True)


QUERIES = {
    "op1_multiset_hash": op1_multiset_hash,
    "op2_pairwise_ranking": op2_pairwise_ranking,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_warc_merge": op4_warc_merge,
    "op5_simhash_grid": op5_simhash_grid,
    "op6_source_mix": op6_source_mix,
    "op7_secret_scan": op7_secret_scan,
    "op8_line_templates": op8_line_templates,
    "op9_jump_shards": op9_jump_shards,
    "op10_quality_rules": op10_quality_rules,
    "op11_streamed_repair": op11_streamed_repair,
    "op12_digest_index": op12_digest_index,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE = {
    "op4_warc_merge": oracles.WARC,
    "op10_quality_rules": oracles.QUALITY_RULES,
    "op12_digest_index": oracles.DIGEST_INDEX,
}
