"""Project payloads as they arrive: read, validated, scored or rejected.

Each micro-batch of payload files goes to two tables, of scored files and of rejected
records with their reasons. A batch writes folders of its own, named by its number, and
replaces what an interrupted attempt at the same batch left there: however often a batch
is repeated, its rows are there once. A batch holds whole files, so a payload without a
project id gets the same name as in a batch read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from stratalens.operators.rules import classify_by_rules
from stratalens.plans.scored import Step, score_by_rules, score_files
from stratalens.schema import payload_schema
from stratalens.sources.projects import checked_files, payload_rows, sorted_out, split_sources, with_origin

SCORED, REJECTED, BATCH = "scored", "rejected", "batch"


def payload_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 64) -> DataFrame:
    payloads = (spark.readStream.schema(payload_schema())
                .option("maxFilesPerTrigger", max_files_per_trigger).json(path))
    return with_origin(payloads)


def store_batch(
    payloads: DataFrame, number: int, out: str, classify: Step = classify_by_rules, score: Step = score_by_rules,
) -> None:
    """Write the scored and the rejected rows of one batch of payloads."""
    checked = checked_files(payload_rows(payloads)).persist()  # parsed and checked once, written to two tables
    valid, rejected = sorted_out(checked)
    files, _ = split_sources(valid)
    score_files(files, classify, score).write.mode("overwrite").parquet(f"{out}/{SCORED}/{BATCH}={number}")
    rejected.write.mode("overwrite").parquet(f"{out}/{REJECTED}/{BATCH}={number}")
    checked.unpersist()


def write_payload_scores(
    payloads: DataFrame, out: str, checkpoint: str, classify: Step = classify_by_rules,
    score: Step = score_by_rules, **trigger,
) -> StreamingQuery:
    """Score what arrives below ``out``; progress lives in ``checkpoint``."""
    return (payloads.writeStream.foreachBatch(lambda batch, number: store_batch(batch, number, out, classify, score))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def stored_tables(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """The scored and the rejected rows of all batches."""
    return spark.read.parquet(f"{out}/{SCORED}"), spark.read.parquet(f"{out}/{REJECTED}")
