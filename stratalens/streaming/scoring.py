"""Scoring files as they arrive.

Scoring is row-wise, so a stream needs no state, no watermark and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from stratalens.operators.rules import classify_by_rules
from stratalens.plans.scored import Step, score_by_rules, score_files


def file_stream(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
    max_files_per_trigger: int = 64,
) -> DataFrame:
    return (
        spark.readStream.format(fmt).schema(schema)
        .option("maxFilesPerTrigger", max_files_per_trigger).load(path)
    )


def score_stream(
    files: DataFrame, classify: Step = classify_by_rules, score: Step = score_by_rules,
) -> DataFrame:
    return score_files(files, classify, score)


def write_scores(scored: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append scored files to a table; progress lives in ``checkpoint``."""
    return (
        scored.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )
