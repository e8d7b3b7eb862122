"""Fix suggestions per violation, from the catalogue and optional replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stratalens.functions.text import or_else
from stratalens.operators.parts import grown
from stratalens.schema import CLEAN
from stratalens.sources.catalog import SCHEMA, fallback_entry, with_catalog


def fix_suggestions(details: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """One row per violation. Layer and problem come from the detail, else
    from the catalogue; the advice is always the catalogue's. A type outside
    the catalogue gets the entry of ``clean``. ``replies`` hold the text of
    an external fix by (project, type) or, for requests, (request, position)."""
    fallback = dict(zip([f.split()[0] for f in SCHEMA.split(", ")], fallback_entry()))
    violations = details.filter(~F.coalesce("type", F.lit("")).isin(CLEAN, ""))
    keep = violations.columns
    known = with_catalog(violations).select(*keep, *[
        F.when(F.col("catalog_usual_layer").isNotNull(), F.col(f"catalog_{c}"))
        .otherwise(F.lit(fallback[c])).alias(f"catalog_{c}")
        for c in ("usual_layer", "impact_points", "description", "recommendation",
                  "before_code", "after_code")
    ])
    if replies is None:
        joined = known.withColumn("reply", F.lit(None).cast("string"))
    else:
        # of several, the first that says anything, in text order
        told = replies.filter(F.length(F.coalesce("reply", F.lit(""))) > 0)
        keys = ["request_id", "position"] if "request_id" in replies.columns else ["project_id", "type"]
        told = told.groupBy(*keys).agg(F.min("reply").alias("reply"))
        joined = known.join(grown(told), keys, "left")
    reply = F.coalesce("reply", F.lit(""))
    return joined.select(
        *[c for c in ("request_id",) if c in keep], "project_id", "position",
        F.col("type").alias("anti_pattern"),
        or_else(F.col("affected_layer"), F.col("catalog_usual_layer")).alias("layer"),
        "severity",
        F.col("catalog_impact_points").alias("impact_points"),
        or_else(F.col("description"), F.col("catalog_description")).alias("problem"),
        F.col("catalog_recommendation").alias("recommendation"),
        "n_files",
        F.col("catalog_before_code").alias("before_code"),
        F.col("catalog_after_code").alias("after_code"),
        reply.alias("ai_fix"), (reply != "").alias("ai_powered"),
    )


def with_files(fixes: DataFrame, member_lists: DataFrame) -> DataFrame:
    """Fix rows with the affected file names, one row per part."""
    lists = member_lists.withColumnRenamed("type", "anti_pattern")
    return fixes.join(grown(lists), ["project_id", "anti_pattern"])


def fix_totals(fixes: DataFrame) -> DataFrame:
    return fixes.groupBy("project_id").agg(F.count(F.lit(1)).alias("total_fixes"))
