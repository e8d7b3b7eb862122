"""From file metrics to one scored row per file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from stratalens.functions.issues import issue_count, issues
from stratalens.functions.layers import report_layer, resolved_layer
from stratalens.functions.scores import (
    clip_score, rule_score, score_display, score_emoji, score_label,
)
from stratalens.operators.rules import classify_by_rules

Step = Callable[[DataFrame], DataFrame]

SCORED_COLS = [
    "project_id", "file_seq", "file_name", "file_path", "architecture_pattern",
    "layer", "resolved_layer", "type", "confidence",
    "quality_score", "quality_label", "quality_emoji", "quality_display",
    "issues", "n_issues", "loc", "imports", "total_cross_layer_deps", "has_source",
]


def score_by_rules(df: DataFrame) -> DataFrame:
    return df.withColumn("quality_score", clip_score(rule_score()))


def with_band(df: DataFrame) -> DataFrame:
    score = F.col("quality_score")
    return df.withColumns({
        "quality_label": score_label(score),
        "quality_emoji": score_emoji(score),
        "quality_display": score_display(score),
    })


def score_files(
    files: DataFrame, classify: Step = classify_by_rules, score: Step = score_by_rules,
) -> DataFrame:
    """Label, confidence, score, band and issues of every file. ``classify``
    adds ``type`` and ``confidence``, ``score`` adds ``quality_score``; both
    are row-wise, so this also runs on a stream."""
    if "has_source" not in files.columns:
        files = files.withColumn("has_source", F.lit(False))
    result = with_band(score(classify(files))).withColumns({
        "resolved_layer": resolved_layer(),
        "issues": issues(),
        "n_issues": issue_count(),
        "layer": report_layer(F.col("layer")),
    })
    return result.select(*[c for c in SCORED_COLS if c in result.columns])
