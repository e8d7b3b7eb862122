"""Anti-pattern findings grouped by type.

Input is a scored table: one row per file with ``type``, ``confidence``,
``resolved_layer`` and the identity columns (see ``plans.scored``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratalens.functions.numeric import SHARE_BITS, exact_mean, exact_sum, round_exact
from stratalens.operators.parts import grown, with_part
from stratalens.schema import CLEAN
from stratalens.sources.catalog import severity_rank, with_catalog

GROUP = ["project_id", "type"]
PART_GROUP = ["project_id", "type", "part"]


def violations_only(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("type") != CLEAN)


def _group_measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_files"),
        F.sort_array(F.collect_set("resolved_layer")).alias("layers"),
        exact_sum(F.col("confidence"), SHARE_BITS).alias("confidence_total"),
        F.min("file_seq").alias("first_seq"),
        F.max("file_seq").alias("last_seq"),
    ]


def mean_confidence(total: Column, count: Column) -> Column:
    return round_exact(exact_mean(total, count, SHARE_BITS), 2)


def part_groups(scored: DataFrame) -> DataFrame:
    """Measures of each (project, type, part), clean files included."""
    return with_part(scored).groupBy(*PART_GROUP).agg(
        *_group_measures(),
        F.count_if("has_source").alias("n_with_source"),
    )


def violation_groups(scored: DataFrame) -> DataFrame:
    """One row per (project, anti-pattern). Sums and sets combine before the
    shuffle; the affected files themselves are in ``violation_files``."""
    groups = violations_only(scored).groupBy(*GROUP).agg(*_group_measures())
    return groups.withColumn(
        "confidence", mean_confidence(F.col("confidence_total"), F.col("n_files"))
    )


def violation_files(members: DataFrame) -> DataFrame:
    """Affected file names in file order, one row per (project, type, part)."""
    ordered = F.sort_array(F.collect_list(F.struct("file_seq", "file_name")))
    return with_part(violations_only(members)).groupBy(*PART_GROUP).agg(
        F.transform(ordered, lambda x: x["file_name"]).alias("files")
    )


def clean_file_lists(scored: DataFrame) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("file_seq", "file_name")))
    return with_part(scored.filter(F.col("type") == CLEAN)).groupBy("project_id", "part").agg(
        F.transform(ordered, lambda x: x["file_name"]).alias("clean_files")
    )


def detail_order(df: DataFrame, *first_appearance: str) -> DataFrame:
    """Number the details of a project from 1, worst severity first. A project
    has at most as many details as there are anti-pattern types."""
    order = Window.partitionBy("project_id").orderBy(
        severity_rank(F.col("severity")), *first_appearance, "type"
    )
    return df.withColumn("position", F.row_number().over(order).cast("bigint"))


def violation_details(scored: DataFrame) -> DataFrame:
    """Detail row per (project, anti-pattern) from model results alone."""
    enriched = with_catalog(violation_groups(scored)).select(
        "project_id", "type",
        F.col("catalog_severity").alias("severity"),
        F.array_join("layers", ", ").alias("affected_layer"),
        "confidence", "n_files",
        F.col("catalog_description").alias("description"),
        F.col("catalog_recommendation").alias("recommendation"),
        "first_seq", "last_seq",
    )
    return detail_order(enriched, "first_seq")


def violations_by_type(labelled: DataFrame) -> DataFrame:
    """How many files and projects each anti-pattern hits in the corpus."""
    per_project = violations_only(labelled).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"))
    return per_project.groupBy("type").agg(
        F.sum("n").alias("files"), F.count(F.lit(1)).alias("projects")
    )


# Summary texts.
NO_VIOLATIONS = "✅ No violations in {n} files"
SOME_VIOLATIONS = "⚠️ {v} violations across {n} files"


def fill(text: str, **values: Column) -> Column:
    """Put column values into the named places of a fixed text."""
    pieces, rest = [], text
    for name, value in sorted(values.items(), key=lambda item: text.index("{" + item[0] + "}")):
        before, rest = rest.split("{" + name + "}", 1)
        pieces += [F.lit(before), value.cast("string")]
    return F.concat(*pieces, F.lit(rest))


def per_architecture(scored: DataFrame, *measures: Column, by: tuple = ()) -> DataFrame:
    """Fixed-width measures per project and architecture, one row for most
    projects. The first file's architecture is then picked from these rows;
    picking it from the files would need a text in the aggregation buffer,
    which makes Spark sort all files instead of hashing them."""
    return scored.groupBy("project_id", *by, "architecture_pattern").agg(
        F.min("file_seq").alias("first_seq"), F.max("file_seq").alias("last_seq"), *measures
    )


def first_architecture() -> Column:
    first = F.min(F.struct("first_seq", "architecture_pattern"))
    return first["architecture_pattern"].alias("architecture_pattern")


def project_architectures(scored: DataFrame) -> DataFrame:
    """Architecture of each project's first file, and its last position."""
    return per_architecture(scored).groupBy("project_id").agg(
        first_architecture(), F.max("last_seq").alias("last_seq")
    )


def antipattern_summary(scored: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Project row of the anti-pattern analysis: architecture of the first
    file, file and violation totals, and a one-line summary. ``projects``
    (one ``project_id`` per row) adds those without files, as empty and of
    unknown architecture."""
    measures = [
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("type") != CLEAN).alias("found"),
    ]
    totals = per_architecture(scored, *measures).groupBy("project_id").agg(
        first_architecture(),
        F.sum("n").alias("total_files_analyzed"),
        F.sum("found").alias("total_violations"),
    )
    if projects is not None:
        zero = F.lit(0).cast("bigint")
        totals = projects.select("project_id").join(grown(totals), "project_id", "left").withColumns({
            "architecture_pattern": F.coalesce("architecture_pattern", F.lit("unknown")),
            "total_files_analyzed": F.coalesce("total_files_analyzed", zero),
            "total_violations": F.coalesce("total_violations", zero),
        })
    n, v = F.col("total_files_analyzed"), F.col("total_violations")
    return totals.withColumn(
        "summary",
        F.when(v == 0, fill(NO_VIOLATIONS, n=n)).otherwise(fill(SOME_VIOLATIONS, v=v, n=n)),
    )
