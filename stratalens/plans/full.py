"""Combined report: quality, anti-patterns, review, fixes and blended scores.

Stages read and write tables, so a reviewer can work between them: run
``analyze_full`` without replies, send the requests, run it again with them.
Leaving all replies out gives the model-only report.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from stratalens.operators.fixes import fix_suggestions
from stratalens.operators.hybrid import (
    hybrid_scores, project_assessments, read_assessments, reply_scores, with_findings,
)
from stratalens.operators.parts import grown
from stratalens.operators.review import (
    apply_verdicts, clean_candidates, clean_files, discoveries, final_members, member_lists,
    merge_discoveries, rejected_counts, reviewed_details, with_status,
)
from stratalens.operators.rollups import (
    WORKING_COLS, layer_rollup, layer_sums, project_rollup, quality_summary, violation_summary,
)
from stratalens.operators.violations import part_groups
from stratalens.plans.quality import FILE_COLS
from stratalens.plans.scored import with_band
from stratalens.schema import CLEAN
from stratalens.sources.staging import staged


class Replies(NamedTuple):
    """Raw reply tables, each with a ``reply`` text column."""
    verdicts: DataFrame | None = None     # project_id, type[, part]
    clean_checks: DataFrame | None = None  # project_id, file_seq
    assessments: DataFrame | None = None   # project_id[, part]
    fixes: DataFrame | None = None         # project_id, type


class Review(NamedTuple):
    """Findings after review; input of the request builders and the report."""
    verdict_groups: DataFrame
    status: DataFrame
    found: DataFrame | None
    details: DataFrame
    members: DataFrame
    files: DataFrame


class FullReport(NamedTuple):
    projects: DataFrame
    layers: DataFrame
    files: DataFrame
    details: DataFrame
    detail_files: DataFrame
    clean_files: DataFrame
    fixes: DataFrame


def review_findings(scored: DataFrame, replies: Replies = Replies(), stage: bool = True) -> Review:
    """Verdicts, rechecks and merged groups. ``scored`` should be a stored
    table; with ``stage`` the group and file tables used by several later
    steps are stored too."""
    keep = staged if stage else (lambda df, name: df)
    groups = keep(part_groups(scored), "part_groups")
    verdict_groups = keep(apply_verdicts(groups, replies.verdicts), "verdict_groups")
    status = with_status(scored, verdict_groups)
    found = None
    if replies.clean_checks is not None:
        found = keep(discoveries(clean_candidates(status), replies.clean_checks), "discoveries")
    details = keep(reviewed_details(merge_discoveries(verdict_groups, found)), "details")
    files = with_findings(status, found, details)
    return Review(
        verdict_groups, status, found, details, final_members(status, found), files
    )


def _project_flags(review: Review, assessments: DataFrame | None) -> DataFrame:
    """Review outcome per project, from group rows."""
    flags = review.verdict_groups.groupBy("project_id").agg(
        F.max("attempted").alias("llm_enhanced"),
        F.max("any_source").alias("any_source"),
    ).join(grown(rejected_counts(review.verdict_groups)), "project_id", "left").withColumn(
        "false_positives_filtered", F.coalesce("n_rejected", F.lit(0).cast("bigint"))
    ).drop("n_rejected")
    if assessments is None:
        blank = flags.withColumns({
            "assessed": F.lit(False), "quality_reasoning": F.lit(""),
            "quality_strengths": F.array().cast("array<string>"),
            "quality_improvements": F.array().cast("array<string>"),
        })
    else:
        none = F.array().cast("array<string>")
        used = F.col("any_source")
        sizes = review.verdict_groups.groupBy("project_id", "part").agg(F.sum("n_files").alias("n_files"))
        blank = flags.join(grown(project_assessments(assessments, sizes)), "project_id", "left").withColumns({
            "assessed": used & F.col("reasoning").isNotNull(),
            "quality_reasoning": F.coalesce(F.when(used, F.col("reasoning")), F.lit("")),
            "quality_strengths": F.coalesce(F.when(used, F.col("strengths")), none),
            "quality_improvements": F.coalesce(F.when(used, F.col("improvements")), none),
        }).drop("overall_score", "reasoning", "strengths", "improvements")
    method = (
        F.when(~F.col("any_source"), "ml_only").when(F.col("assessed"), "hybrid")
        .when(F.col("llm_enhanced"), "ml_adjusted").otherwise("ml_only")
    )
    return blank.withColumn("scoring_method", method).drop("assessed", "any_source")


def blended_files(review: Review, assessments: DataFrame | None) -> DataFrame:
    scores = None if assessments is None else reply_scores(assessments)
    return with_band(hybrid_scores(review.files, scores))


def analyze_full(
    scored: DataFrame, replies: Replies = Replies(), stage: bool = True,
) -> FullReport:
    """``scored`` comes from ``score_files`` and should be a stored table, as
    it is read more than once."""
    keep = staged if stage else (lambda df, name: df)
    review = review_findings(scored, replies, stage)
    assessments = None
    if replies.assessments is not None:
        assessments = read_assessments(replies.assessments, review.verdict_groups)
    # what the report and its sums show of a file; the rest of the review need not move with it
    files = keep(blended_files(review, assessments).select(
        *FILE_COLS, "architecture_pattern", "type", "n_issues", "loc", "imports", "total_cross_layer_deps",
        "scoring_method", "in_clean_list"), "files")

    sums = keep(layer_sums(files), "layer_sums")
    layers = layer_rollup(sums)
    projects = violation_summary(
        quality_summary(project_rollup(sums), layers).withColumnRenamed("summary", "quality_summary"),
        review.details,
    ).join(grown(_project_flags(review, assessments)), "project_id").drop(*WORKING_COLS)
    stamped = projects.withColumn(
        "analysis_date", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    )
    sourced = review.verdict_groups.groupBy("project_id").agg(F.max("any_source").alias("_any"))
    with_source = review.details.filter(F.col("type") != CLEAN).join(
        grown(sourced.filter("_any").drop("_any")), "project_id", "left_semi"
    )
    return FullReport(
        projects=stamped,
        layers=layers,
        files=files.select(*FILE_COLS, "scoring_method"),
        details=review.details,
        detail_files=member_lists(review.members),
        clean_files=files.filter("in_clean_list").select("project_id", "file_seq", "file_name"),
        fixes=fix_suggestions(with_source, replies.fixes),
    )
