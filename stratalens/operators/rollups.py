"""Scores rolled up to layers and projects.

Files are read once: they are summed per (project, layer, architecture) with
map-side combining, and everything else is computed from those few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratalens.functions.numeric import (
    SCORE_BITS, exact_mean, exact_sum, round_exact, whole_text,
)
from stratalens.functions.scores import score_display, score_emoji, score_label
from stratalens.operators.parts import grown
from stratalens.operators.violations import fill, first_architecture, per_architecture
from stratalens.schema import CLEAN

# Columns of project rows that later steps use and reports leave out.
WORKING_COLS = ["overall_mean", "labelled_files", "last_seq"]

# Fixed value: points a fixed issue is expected to bring back.
POINTS_PER_ISSUE = 1.5

# Summary texts.
OVERALL_LINE = "Overall project quality: {label} ({score}/100)"
STRONGEST_LINE = "✅ Strongest layer: {layer} ({score}/100 {emoji})"
WEAKEST_LINE = "⚠️  Weakest layer: {layer} ({score}/100 {emoji})"
ISSUES_LINE = "📋 {issues} issues found across {files} files"
NO_VIOLATIONS = "✅ No architectural violations detected in {n} files"
VIOLATIONS_PART = "⚠️ {v} violations across {n} files"
SEVERITY_PARTS = {"CRITICAL": "🔴 {k} CRITICAL", "HIGH": "🟠 {k} HIGH", "MEDIUM": "🟡 {k} MEDIUM"}
PART_SEPARATOR = "  |  "


def layer_sums(scored: DataFrame) -> DataFrame:
    """Additive measures per (project, layer, architecture)."""
    return per_architecture(
        scored,
        F.count(F.lit(1)).alias("n"),
        exact_sum(F.col("quality_score"), SCORE_BITS).alias("score_total"),
        F.sum("n_issues").alias("issues"),
        F.count_if(F.col("n_issues") > 0).alias("with_issues"),
        F.count_if(F.col("type") != CLEAN).alias("labelled"),
        F.sum("loc").alias("loc"),
        F.sum("imports").alias("imports"),
        F.sum("total_cross_layer_deps").alias("deps"),
        by=("layer",),
    )


def layer_rollup(sums: DataFrame) -> DataFrame:
    """Mean score and band of each layer, best first inside its project. The
    band follows the unrounded mean, the order the rounded one."""
    mean = exact_mean(F.col("score_total"), F.col("n"), SCORE_BITS)
    order = Window.partitionBy("project_id").orderBy(F.desc("mean_score"), "first_seq")
    totals = sums.groupBy("project_id", "layer").agg(
        F.sum("n").alias("n"), F.sum("score_total").alias("score_total"),
        F.min("first_seq").alias("first_seq"),
    )
    return (
        totals.withColumn("mean", mean)
        .select(
            "project_id", "layer",
            F.col("n").alias("file_count"),
            round_exact(F.col("mean"), 1).alias("mean_score"),
            score_label(F.col("mean")).alias("quality_label"),
            score_emoji(F.col("mean")).alias("quality_emoji"),
            score_display(F.col("mean")).alias("quality_display"),
            "first_seq",
        )
        .withColumn("position", F.row_number().over(order).cast("bigint"))
    )


def project_rollup(sums: DataFrame) -> DataFrame:
    """Overall score, size averages and issue totals of each project."""
    totals = sums.groupBy("project_id").agg(
        F.sum("n").alias("n"),
        F.sum("score_total").alias("score_total"),
        F.sum("issues").alias("issues"),
        F.sum("with_issues").alias("with_issues"),
        F.sum("labelled").alias("labelled"),
        F.sum("loc").alias("loc"),
        F.sum("imports").alias("imports"),
        F.sum("deps").alias("deps"),
        first_architecture(),
        F.max("last_seq").alias("last_seq"),
    )
    n = F.col("n").cast("double")
    overall = F.col("overall")
    projected = F.least(F.lit(100.0), overall + F.col("issues") * F.lit(POINTS_PER_ISSUE))
    return totals.withColumn(
        "overall", exact_mean(F.col("score_total"), F.col("n"), SCORE_BITS)
    ).select(
        "project_id", "architecture_pattern",
        F.col("n").alias("total_files_analyzed"),
        round_exact(overall, 1).alias("overall_score"),
        score_label(overall).alias("overall_label"),
        score_emoji(overall).alias("overall_emoji"),
        score_display(overall).alias("overall_display"),
        round_exact(F.col("loc") / n, 1).alias("avg_loc"),
        round_exact(F.col("imports") / n, 1).alias("avg_imports"),
        round_exact(F.col("deps") / n, 2).alias("avg_cross_layer_deps"),
        F.col("with_issues").alias("files_with_violations"),
        F.col("issues").alias("total_issues_found"),
        round_exact(projected, 1).alias("projected_score_after_fixes"),
        overall.alias("overall_mean"),
        F.col("labelled").alias("labelled_files"),
        "last_seq",
    )


def _layer_line(text: str, layer: Column) -> Column:
    return fill(text, layer=layer["layer"], score=whole_text(layer["mean_score"]),
                emoji=layer["quality_emoji"])


def quality_summary(projects: DataFrame, layers: DataFrame) -> DataFrame:
    """Project rows with a text naming the overall band, the strongest and
    weakest layer and the issue totals. Equal layers rank by first file."""
    entry = F.struct("mean_score", (-F.col("first_seq")).alias("_rank"), "layer", "quality_emoji")
    ends = layers.groupBy("project_id").agg(
        F.max(entry).alias("best"), F.min(entry).alias("worst"),
        F.count(F.lit(1)).alias("n_layers"),
    )
    summary = F.concat_ws(
        "\n",
        fill(OVERALL_LINE, label=F.col("overall_label"), score=whole_text(F.col("overall_mean"))),
        _layer_line(STRONGEST_LINE, F.col("best")),
        F.when(F.col("n_layers") > 1, _layer_line(WEAKEST_LINE, F.col("worst"))),
        fill(ISSUES_LINE, issues=F.col("total_issues_found"), files=F.col("files_with_violations")),
    )
    return (
        projects.join(grown(ends), "project_id").withColumn("summary", summary)
        .drop("best", "worst", "n_layers")
    )


def violation_counts(details: DataFrame) -> DataFrame:
    """Per project: files over all groups, and groups of each severity."""
    return details.groupBy("project_id").agg(
        F.sum("n_files").alias("total_violations"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITY_PARTS],
    )


def violation_summary(projects: DataFrame, details: DataFrame) -> DataFrame:
    """Add ``total_violations`` and a one-line summary to project rows."""
    counts = violation_counts(details)
    joined = projects.join(grown(counts), "project_id", "left")
    total = F.coalesce("total_violations", F.lit(0).cast("bigint"))
    n = F.col("total_files_analyzed")
    parts = [fill(VIOLATIONS_PART, v=F.col("total_violations"), n=n)]
    for severity, text in SEVERITY_PARTS.items():
        count = F.col(severity.lower())
        parts.append(F.when(count > 0, fill(text, k=count)))
    summary = F.when(total == 0, fill(NO_VIOLATIONS, n=n)).otherwise(
        F.concat_ws(PART_SEPARATOR, *parts)
    )
    return (
        joined.withColumns({"violation_summary": summary, "total_violations": total})
        .drop(*[s.lower() for s in SEVERITY_PARTS])
    )
