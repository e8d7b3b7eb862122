"""Quality report of every project."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from stratalens.operators.rollups import (
    WORKING_COLS, layer_rollup, layer_sums, project_rollup, quality_summary,
)
from stratalens.sources.staging import staged

FILE_COLS = [
    "project_id", "file_seq", "file_name", "file_path", "layer", "quality_score",
    "quality_label", "quality_emoji", "quality_display", "issues",
]


class QualityReport(NamedTuple):
    projects: DataFrame
    layers: DataFrame
    files: DataFrame


def files_worst_first(files: DataFrame) -> DataFrame:
    """Files of each project in ascending score order. The sort is a range
    partitioning over project, score and position, so one project may span
    many partitions."""
    return files.orderBy("project_id", "quality_score", "file_seq")


def analyze_quality(scored: DataFrame, stage: bool = True) -> QualityReport:
    """With ``stage`` the layer sums, input of both rollups, are stored, so
    the files are summed once."""
    sums = layer_sums(scored)
    if stage:
        sums = staged(sums, "layer_sums")
    layers = layer_rollup(sums)
    projects = quality_summary(project_rollup(sums), layers).drop(*WORKING_COLS)
    stamped = projects.withColumn(
        "analysis_date", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    )
    return QualityReport(stamped, layers, files_worst_first(scored.select(*FILE_COLS)))
