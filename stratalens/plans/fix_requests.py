"""Fixes for violations that a caller names, without scored files.

A request lists violations of one project, each with its files, and may bring
a map from file name to text. The result is a fix row per violation, the
prompt for an external fix, and the number of fixes per request.

Everything is keyed by the request and the position of the violation in it.
A type may be listed any number of times, a project may send any number of
requests, and a request need not name its project.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stratalens.operators.fixes import fix_suggestions, fix_totals
from stratalens.operators.requests import MAX_FIX_FILES, MAX_SOURCE_LINES, prompts_of, shown_section
from stratalens.operators.violations import GROUP
from stratalens.schema import CLEAN
from stratalens.sources.projects import with_defaults
from stratalens.sources.staging import staged

REQUEST = (
    "project_id long, architecture_pattern string, file_sources map<string,string>, "
    "anti_patterns array<struct<type:string,files:array<string>,affected_layer:string,"
    "severity:string,description:string>>"
)


class FixInput(NamedTuple):
    details: DataFrame   # a row per violation
    shown: DataFrame     # the same with their architecture, and names and source of the first files as text
    requests: DataFrame  # request_id, project_id, architecture_pattern, total_fixes


class FixReport(NamedTuple):
    fixes: DataFrame
    prompts: DataFrame
    totals: DataFrame


OWNER, VIOLATION = ["request_id"], ["request_id", "position"]


def read_fix_requests(spark: SparkSession, path: str) -> FixInput:
    return fix_input(spark.read.schema(REQUEST).json(path))


def fix_input(requests: DataFrame) -> FixInput:
    """Tables of the requests, which are numbered and stored once, with the texts of the files
    that a prompt shows. Optional fields take their defaults; ``clean`` and unnamed entries are
    dropped, the others keep their place in the request as ``position``, from 1."""
    named = F.flatten(F.transform("anti_patterns", lambda x: first_files(x["files"])))
    texts = F.filter(F.map_entries("file_sources"), lambda x: (F.length(x["value"]) > 0) & F.array_contains(named, x["key"]))
    numbered = requests.withColumn("request_id", F.monotonically_increasing_id())
    stored = staged(numbered.withColumn("texts", texts).drop("file_sources"), "requests", "zstd")
    asked = lambda kind: ~F.coalesce(kind, F.lit("")).isin(CLEAN, "")
    entries = stored.select(
        "request_id", "project_id", "architecture_pattern", "texts", F.posexplode("anti_patterns").alias("_at", "_entry")
    ).select("request_id", "project_id", "architecture_pattern", "texts",
             (F.col("_at") + 1).cast("bigint").alias("position"), "_entry.*").filter(asked(F.col("type")))
    entries = with_defaults(entries.withColumn("files", F.coalesce("files", F.array().cast("array<string>"))), "fix")
    detail = [*VIOLATION, "project_id", "type", "affected_layer", "severity", "description",
              F.size("files").cast("bigint").alias("n_files")]
    details = entries.select(*detail)
    # a prompt has all it needs in its request, so nothing is joined for it
    sections = F.transform("_shown", lambda x: x["section"])
    names = F.transform("_shown", lambda x: F.concat(F.lit("  - "), x["file_name"]))
    some = F.size("_shown") > 0
    shown = entries.select(*detail, "architecture_pattern", shown_files().alias("_shown")).withColumns({
        "_names": F.when(some, F.array_join(names, "\n")), "_sources": F.when(some, F.array_join(sections, "\n\n")),
        "n_sources": F.size(F.array_compact(sections)).cast("bigint"), "n_shown": F.size("_shown").cast("bigint")}).drop("_shown")
    fixes = F.size(F.filter("anti_patterns", lambda x: asked(x["type"])))
    given = stored.select(
        "request_id", "project_id", F.coalesce("architecture_pattern", F.lit("layered")).alias("architecture_pattern"),
        F.when(F.col("anti_patterns").isNull(), 0).otherwise(fixes).cast("bigint").alias("total_fixes"))
    return FixInput(details, shown, given)


def first_files(files: Column) -> Column:
    return F.slice(F.coalesce(files, F.array().cast("array<string>")), 1, MAX_FIX_FILES)


def shown_files() -> Column:
    """The first files of an entry with the shown part of their text, looked up in the request
    that both are in; one without a text stays, one given several is listed with each."""
    def with_text(name: Column) -> Column:
        given = F.filter("texts", lambda x: x["key"] == name)
        sections = F.array_sort(F.transform(given, lambda x: shown_section(x["key"], x["value"], MAX_SOURCE_LINES)))
        listed = F.when(F.size(given) > 0, sections).otherwise(F.array(F.lit(None).cast("string")))
        return F.transform(listed, lambda section: F.struct(name.alias("file_name"), section.alias("section")))

    return F.flatten(F.transform(first_files(F.col("files")), with_text))


def suggest_fixes(given: FixInput, replies: DataFrame | None = None) -> FixReport:
    """``replies`` hold the texts of external fixes by (request, position), or for all
    violations of a type in a project by (project, type)."""
    fixes = fix_suggestions(given.details, replies)
    prompts = prompts_of(given.shown, [*VIOLATION, *GROUP])
    return FixReport(fixes, prompts, given.requests.drop("architecture_pattern"))
