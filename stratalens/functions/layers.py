"""Architectural layer of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WHITESPACE = " \t\n\r\x0b\x0c"


def flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def number(name: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def stated_layer() -> Column:
    """The layer as sent, lower-cased; no inference."""
    return F.lower(F.col("layer"))


def resolved_layer() -> Column:
    """The stated layer, or one inferred from signals where none is stated."""
    stated = F.btrim(F.lower(F.col("layer")), F.lit(WHITESPACE))
    known = stated.isNotNull() & ~stated.isin("", "unknown", "none")
    return (
        F.when(known, stated)
        .when(flag("has_http_handling"), F.lit("controller"))
        .when((number("repository_deps") > 0) & flag("has_data_access"), F.lit("service"))
        .when(flag("has_data_access"), F.lit("repository"))
        .otherwise(F.lit("service"))
    )


def report_layer(layer: Column) -> Column:
    """Layer shown in reports: as sent, ``unknown`` when missing or empty."""
    return F.coalesce(F.nullif(layer, F.lit("")), F.lit("unknown"))


def resolve_layer(df: DataFrame) -> DataFrame:
    return df.withColumn("resolved_layer", resolved_layer())
