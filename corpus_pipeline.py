"""From raw documents to token ids in five stages, each one operator of stratalens.llm.

Every stage takes what its predecessor kept, as stored Parquet; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm import bpe, line_templates, mixing, quality_rules, simhash
from stratalens.llm.queries import tokenizer
from stratalens.sources.staging import staged_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the thresholds of their language and source."""
    return quality_rules.filter_rows(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents stay in the first of them only."""
    return line_templates.dedup(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of op5 join (fingerprints over three-word
    shingles, at most 2 bits apart), or texts that share 0.8 of their five-word shingles."""
    return simhash.dedup(docs, width=5, least=0.8, grid=3)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens and the token ids in place of the text."""
    return bpe.encode(docs, tokenizer())


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_copy_stage),
    ("source_mixing", mixing_stage),
    ("bpe_encoding", encoding_stage),
]

#: Hashes of shingles and the tokenizer's merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = staged_path(spark, f"pipeline/{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
