"""File scores blended from the model and a reviewer's assessment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stratalens.functions.numeric import clip, round_exact
from stratalens.functions.replies import with_assessment
from stratalens.operators.parts import grown
from stratalens.operators.review import first_readable, per_part, reply_keys
from stratalens.schema import KEY

# Blend weights, penalties by severity and bonuses.
MODEL_WEIGHT, REPLY_WEIGHT = 0.4, 0.6
PENALTIES = {"CRITICAL": 15, "HIGH": 10, "MEDIUM": 5, "LOW": 2}
CLEAN_BONUS = 5
CLEARED_BONUS = 3

NAME_KEY = ["project_id", "part", "file_name"]


def penalty(severity: Column) -> Column:
    chain = None
    for name, points in PENALTIES.items():
        hit = severity == name
        chain = F.when(hit, points) if chain is None else chain.when(hit, points)
    return chain.otherwise(0)


def read_assessments(replies: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Readable assessments, one per (project, part). A table without ``part``
    speaks for all parts that ``groups`` (part groups) reach."""
    read = first_readable(with_assessment(replies), reply_keys(replies, "project_id"), "assessment")
    read = read.select(*[c for c in read.columns if c != "assessment"], "assessment.*")
    return read if groups is None else per_part(read, groups, "project_id")


def project_assessments(assessments: DataFrame, part_sizes: DataFrame | None = None) -> DataFrame:
    """Assessment of each project from all its readable parts: texts in part
    order, and the mean of the overall scores, weighted by the files of the
    part (``part_sizes``: project_id, part, n_files). One part stands as it is."""
    score = F.col("overall_score").try_cast("double")
    sized = assessments.withColumns({"_score": score, "n_files": F.lit(1)}) if part_sizes is None else (
        assessments.withColumn("_score", score).join(grown(part_sizes), ["project_id", "part"]))
    scored = F.when(F.col("_score").isNotNull(), F.col("n_files"))
    fields = ["part", "reasoning", "strengths", "improvements"]
    # one entry per part of the project
    parts = sized.groupBy("project_id").agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("_parts"),
        F.count("_score").alias("_n"), F.min("_score").alias("_only"),
        (F.sum(F.col("_score") * F.col("n_files")) / F.sum(scored)).alias("_mean"),
    )

    def texts(name: str) -> Column:
        return F.flatten(F.filter(F.transform("_parts", lambda p: p[name]), lambda x: x.isNotNull()))

    return parts.select(
        "project_id", F.when(F.col("_n") == 1, F.col("_only")).otherwise(F.col("_mean")).alias("overall_score"),
        F.array_join(F.filter(F.transform("_parts", lambda p: p["reasoning"]), lambda x: x.isNotNull()), "\n")
        .alias("reasoning"),
        texts("strengths").alias("strengths"), texts("improvements").alias("improvements"),
    )


def reply_scores(assessments: DataFrame) -> DataFrame:
    """Reply score per file name, one row each; ``reply_score`` is null where
    the reply gives no number. Of a name given twice the last entry counts."""
    entries = assessments.select(
        "project_id", "part", F.posexplode(F.map_entries("file_scores")).alias("_at", "_entry")
    ).select("project_id", "part", F.col("_entry.key").alias("file_name"), "_at",
             F.col("_entry.value").try_cast("double").alias("_score"))
    return entries.groupBy(*NAME_KEY).agg(
        F.max_by("_score", "_at").alias("reply_score"), F.lit(True).alias("has_reply_score"),
    )


def file_findings(found: DataFrame, details: DataFrame) -> DataFrame:
    """Penalties and findings added to files by discoveries. Severities go to
    the (project, type, part) that have a discovery, not to all parts."""
    asked = found.select("project_id", "type", "part").distinct()
    severities = asked.join(grown(details.select("project_id", "type", "severity")), ["project_id", "type"])
    rows = found.select(*KEY, "part", "type").join(grown(severities), ["project_id", "type", "part"])
    return rows.groupBy(*KEY, "part").agg(
        F.sum(penalty(F.col("severity"))).alias("found_penalty"),
        F.sort_array(F.collect_set(F.struct("type", "severity"))).alias("found"),
    )


def with_findings(
    status: DataFrame, found: DataFrame | None, details: DataFrame,
) -> DataFrame:
    """File rows with ``penalty``, ``findings`` (type and severity of every
    group the file is in) and the clean and cleared flags."""
    own = (F.col("type") != "clean") & F.col("is_valid")
    own_finding = F.array(F.struct("type", "severity"))
    nothing = F.array().cast("array<struct<type:string,severity:string>>")
    base = status.withColumns({
        "cleared": ~F.col("is_valid"),
        "penalty": F.when(own, penalty(F.col("severity"))).otherwise(0).cast("bigint"),
        "findings": F.when(own, own_finding).otherwise(nothing),
    })
    listed_clean = (F.col("type") == "clean") | F.col("cleared")
    if found is None:
        return base.withColumn("in_clean_list", listed_clean)
    extra = file_findings(found, details)
    joined = base.join(grown(extra), [*KEY, "part"], "left")
    return joined.withColumns({
        "in_clean_list": listed_clean & F.col("found").isNull(),
        "penalty": F.col("penalty") + F.coalesce("found_penalty", F.lit(0)),
        "findings": F.concat("findings", F.coalesce("found", nothing)),
    }).drop("found", "found_penalty")


def hybrid_scores(files: DataFrame, scores: DataFrame | None) -> DataFrame:
    """Replace ``quality_score`` by the blended one.

    ``files`` come from ``with_findings``. In a project with source, a file
    the assessment scored blends model and reply; any other is adjusted by
    its findings. Without source the model score stands. ``model_score``
    keeps the score before.
    """
    if scores is None:
        joined = files.withColumns({
            "reply_score": F.lit(None).cast("double"), "has_reply_score": F.lit(None).cast("boolean"),
        })
    else:
        joined = files.join(grown(scores), NAME_KEY, "left")
    model = F.col("model_score")
    blended = F.lit(MODEL_WEIGHT) * model + F.lit(REPLY_WEIGHT) * F.coalesce("reply_score", model)
    adjusted = (
        model - F.col("penalty")
        + F.when(F.col("in_clean_list"), CLEAN_BONUS).otherwise(0)
        + F.when(F.col("cleared"), CLEARED_BONUS).otherwise(0)
    )
    method = (
        F.when(~F.col("any_source"), "ml_only")
        .when(F.col("has_reply_score"), "hybrid")
        .otherwise("ml_adjusted")
    )
    raw = (
        F.when(F.col("scoring_method") == "hybrid", blended)
        .when(F.col("scoring_method") == "ml_adjusted", adjusted)
        .otherwise(model)
    )
    return (
        joined.withColumn("model_score", F.col("quality_score"))
        .withColumn("scoring_method", method)
        .withColumn("quality_score", round_exact(clip(raw), 1))
        .drop("reply_score", "has_reply_score")
    )


def hybrid_overall(model_overall: Column, reply_overall: Column) -> Column:
    """Project score from the model mean and the reply's overall score; the
    model mean alone where the reply has no number."""
    reply = reply_overall.try_cast("double")
    blend = F.lit(MODEL_WEIGHT) * model_overall + F.lit(REPLY_WEIGHT) * reply
    return round_exact(F.coalesce(blend, model_overall), 1)
