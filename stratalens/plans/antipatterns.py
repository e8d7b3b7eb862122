"""Anti-pattern report of every project, from model results alone."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from stratalens.operators.violations import (
    antipattern_summary, violation_details, violation_files,
)


class AntipatternReport(NamedTuple):
    projects: DataFrame
    details: DataFrame
    detail_files: DataFrame


def analyze_antipatterns(
    scored: DataFrame, projects: DataFrame | None = None,
) -> AntipatternReport:
    """``projects`` names projects to report even if they have no files."""
    return AntipatternReport(
        antipattern_summary(scored, projects), violation_details(scored), violation_files(scored)
    )
