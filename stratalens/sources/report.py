"""Writing reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stratalens.operators.parts import grown, spread, with_part
from stratalens.plans.full import FullReport


def write_report(report: tuple, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Each table of a report in its own folder under ``path``."""
    for name, df in report._asdict().items():
        df.write.format(fmt).mode(mode).save(f"{path}/{name}")


def _listed(df: DataFrame, keys: list[str], name: str, *order: str) -> DataFrame:
    """Rows of a bounded group as one ordered array of structs."""
    fields = [c for c in df.columns if c not in (*keys, *order)]
    entry = F.struct(*order, *fields)
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias(name))


def nested_reports(report: FullReport, last_seq: DataFrame) -> DataFrame:
    """The report as one nested row per (project, part).

    Every row carries the project's figures, its layers and findings, and the
    files of the part, worst first, also by layer and by finding. A project of up to one part's files gives
    one complete row. ``last_seq`` is ``project_id, last_seq``.
    """
    keys = ["project_id", "part"]
    layers = _listed(report.layers, ["project_id"], "layer_scores", "position")
    details = _listed(
        report.details.drop("first_seq", "last_seq"), ["project_id"], "anti_patterns", "position"
    )
    fixes = _listed(report.fixes, ["project_id"], "fix_suggestions", "position")
    placed = with_part(report.files)
    files = _listed(placed, keys, "files", "quality_score", "file_seq")
    worst_first = F.sort_array(F.collect_list(F.struct("quality_score", "file_seq", "file_name")))
    by_layer = placed.groupBy(*keys, "layer").agg(
        F.transform(worst_first, lambda x: x["file_name"]).alias("files"))
    layer_files = _listed(by_layer, keys, "layer_files", "layer")
    member_lists = _listed(report.detail_files, keys, "anti_pattern_files", "type")
    clean = with_part(report.clean_files).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("file_seq", "file_name"))).alias("_clean")
    ).select(*keys, F.transform("_clean", lambda x: x["file_name"]).alias("clean_files"))
    projects = report.projects.join(grown(last_seq), "project_id").join(grown(layers), "project_id")
    for table in (details, fixes):
        projects = projects.join(grown(table), "project_id", "left")
    rows = spread(projects, "last_seq").drop("last_seq").join(grown(files), keys)
    for table in (layer_files, member_lists, clean):
        rows = rows.join(grown(table), keys, "left")
    return rows
