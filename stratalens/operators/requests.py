"""Request tables for an external reviewer.

Each row holds one complete prompt. Prompts that list files or their source
cover one part of a project, and those with source a slice of it whose bytes
are bounded; ordinary projects have one part and so one prompt. All wording is
this engine's own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratalens.functions.numeric import SCORE_BITS, exact_mean, exact_sum, whole_text
from stratalens.functions.text import or_else, truncate_lines
from stratalens.operators.hybrid import PENALTIES
from stratalens.operators.parts import PLACE, grown, passes, spread, with_part
from stratalens.operators.review import rejected_counts
from stratalens.operators.violations import (
    GROUP, PART_GROUP, first_architecture, mean_confidence, per_architecture, project_architectures,
)
from stratalens.schema import CLEAN, KEY
from stratalens.sources.catalog import with_catalog
from stratalens.sources.staging import staged

#: Source texts: a table of them, or what adds ``source_name`` and ``source_code`` to rows that
#: name a file by KEY, given the rows and the kind of join.
Sources = DataFrame | Callable[[DataFrame, str], DataFrame]

# Lines of source shown per file, files named in a fix request.
MAX_SOURCE_LINES = 300
MAX_FIX_FILES = 5
#: Bytes of source in one validation request. One file's section has half of them at most.
MAX_REQUEST_BYTES = 400_000
SECTION_CUT = "\n... cut, the line is too long to show"

VERDICT_FORMAT = (
    'Answer with one JSON object: {"is_valid": true|false, "reasoning": "...", '
    '"description": "...", "recommendation": "...", "before_code": "...", '
    '"after_code": "...", "severity": "..."}'
)
CLEAN_CHECK_FORMAT = (
    'Answer with one JSON object: {"has_issues": true|false, "anti_patterns": '
    '[{"type": "...", "severity": "...", "description": "...", '
    '"recommendation": "...", "before_code": "...", "after_code": "..."}]}'
)
ASSESSMENT_FORMAT = (
    'Answer with one JSON object: {"overall_score": 0-100, "reasoning": "...", '
    '"file_scores": {"<file name>": 0-100}, "strengths": ["..."], '
    '"improvements": ["..."]}'
)
GUIDE = "Guide: " + ", ".join(f"{name} about -{points}" for name, points in PENALTIES.items())

# Short names a recheck may report.
SHORT_NAMES = (
    "no_validation, layer_skip, missing_transaction, business_logic_in_controller, "
    "reversed_dependency, tight_coupling, broad_catch"
)


def _lines(*pieces: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in pieces])


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), value.cast("string"))


def source_sections(sources: DataFrame, max_lines: int, owner: list[str] = ["project_id"]) -> DataFrame:
    """Shown part of each text under its file name. Cutting comes before any
    join or grouping, so only what is shown is shuffled."""
    section = shown_section(F.col("file_name"), F.col("source_code"), max_lines)
    return sources.select(*source_keys(sources, owner), section.alias("section"))


def shown_section(name: Column, text: Column, max_lines: int) -> Column:
    return F.concat(F.lit("=== "), name, F.lit(" ===\n"), truncate_lines(text, max_lines))


def with_sections(
    wanted: DataFrame, sources: Sources, max_lines: int, how: str = "inner", owner: list[str] = ["project_id"],
) -> DataFrame:
    """``wanted`` with the shown part of each row's text. ``wanted`` has the columns that go
    on only: where texts are looked up they take these along, and move next to their group."""
    if isinstance(sources, DataFrame):
        return wanted.join(grown(source_sections(sources, max_lines, owner)), source_keys(sources, owner), how)
    section = shown_section(F.col("source_name"), F.col("source_code"), max_lines)
    return sources(wanted, how).withColumn("section", section).drop("source_name", "source_code")


def source_keys(sources: DataFrame, owner: list[str] = ["project_id"]) -> list[str]:
    """Texts go by position where it is known, else by name."""
    return KEY if "file_seq" in sources.columns else [*owner, "file_name"]


def joined_sections(section: Column, *order: str, separator: str = "\n\n") -> Column:
    """Texts of a bounded group in the given order."""
    listed = F.sort_array(F.collect_list(F.struct(*order, section.alias("_text"))))
    return F.array_join(F.transform(listed, lambda x: x["_text"]), separator)


def sliced(texts: DataFrame, keys: list[str], max_bytes: int) -> DataFrame:
    """Sections cut to half of ``max_bytes``, with the slice of their group that each is in.

    A section is in slice k if the bytes before it, in file order, end in the k-th half of
    the budget. None is longer than a half, so a slice has ``max_bytes`` at most, none is
    empty, and every section is in exactly one. A group is a part, a bounded number of files.
    """
    half = max_bytes // 2
    # a code point has four bytes at most
    short = F.concat(F.substring("section", 1, (half - len(SECTION_CUT)) // 4), F.lit(SECTION_CUT))
    cut = texts.withColumn("section", F.when(F.octet_length("section") <= half, F.col("section")).otherwise(short))
    before = Window.partitionBy(*keys).orderBy("file_seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("section")).over(before), F.lit(0))
    return cut.withColumn("slice", F.floor(start / half).cast("bigint"))


def validation_requests(
    scored: DataFrame, verdict_groups: DataFrame, sources: Sources,
    max_lines: int = MAX_SOURCE_LINES, max_bytes: int = MAX_REQUEST_BYTES,
    n_files: int = 0, kept: Callable[[DataFrame], DataFrame] = lambda made: made,
) -> DataFrame:
    """Requests per reviewed (project, type, part): what was predicted and
    the source of every affected file of the part, in slices of at most
    ``max_bytes`` of source; most parts have one.

    Where the texts of ``n_files`` affected files are too many to move at once, the requests
    are made in passes by part, and what ``kept`` gives of each pass is stored."""
    architectures = spread(project_architectures(scored), "last_seq").drop("last_seq")
    # the head shows the whole group, whatever part the request covers
    whole = verdict_groups.groupBy(*GROUP).agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("layers")))).alias("layers"),
        mean_confidence(F.sum("confidence_total"), F.sum("n_files")).alias("confidence"),
    )
    asked = verdict_groups.filter("asked").drop("layers", "confidence").join(grown(architectures), PLACE).join(
        grown(whole), GROUP
    ).select(
        *PART_GROUP, "architecture_pattern", "catalog_display_name", "catalog_severity",
        "catalog_description", "layers", "confidence",
    )
    members = with_part(scored.filter(F.col("type") != CLEAN)).select(*KEY, "type", "part")
    several = passes(n_files, *PLACE)
    if len(several) == 1:
        return kept(_prompted(asked, members, sources, max_lines, max_bytes))
    asked = staged(asked, "asked")
    return reduce(DataFrame.unionByName, [
        staged(kept(_prompted(asked.filter(mine), members.filter(mine), sources, max_lines, max_bytes)), "requests")
        for mine in several])


def _prompted(
    asked: DataFrame, members: DataFrame, sources: Sources, max_lines: int, max_bytes: int,
) -> DataFrame:
    texts = sliced(with_sections(members, sources, max_lines), PART_GROUP, max_bytes)
    blocks = texts.groupBy(*PART_GROUP, "slice").agg(
        joined_sections(F.col("section"), "file_seq").alias("_sources"),
        F.count(F.lit(1)).alias("n_files"), F.sum(F.octet_length("section")).alias("source_bytes"),
    )
    layer = F.array_join("layers", ", ")
    prompt = _lines(
        "Review a predicted anti-pattern against the source.",
        _labelled("Predicted", F.col("catalog_display_name")),
        _labelled("Type", F.col("type")),
        _labelled("Architecture", F.col("architecture_pattern")),
        _labelled("Layer", layer),
        _labelled("Confidence", F.concat(whole_text(F.col("confidence") * 100), F.lit("%"))),
        _labelled("Severity", F.col("catalog_severity")),
        _labelled("Meaning", F.col("catalog_description")),
        "",
        F.col("_sources"),
        "",
        "Say whether the source really shows it. If so describe it and fix it with the "
        "names used in the source; if not say why.",
        VERDICT_FORMAT,
    )
    return asked.join(grown(blocks), PART_GROUP).select(
        *PART_GROUP, "slice", "architecture_pattern", layer.alias("affected_layer"), "confidence",
        F.col("catalog_severity").alias("severity"), "n_files", "source_bytes", prompt.alias("prompt"),
    )


def clean_check_requests(
    candidates: DataFrame, sources: Sources, max_lines: int = MAX_SOURCE_LINES,
) -> DataFrame:
    """One request per low-confidence clean file."""
    asked = candidates.select(*KEY, "architecture_pattern", "layer")
    if isinstance(sources, DataFrame):
        found = asked.join(grown(sources.select(*KEY, "file_name", "source_code")), KEY)
    else:
        found = sources(asked, "inner").withColumnRenamed("source_name", "file_name")
    texts = found.withColumn("_shown", truncate_lines(F.col("source_code"), max_lines))
    prompt = _lines(
        "This file was predicted free of anti-patterns, with little confidence.",
        _labelled("File", F.col("file_name")),
        _labelled("Architecture", F.col("architecture_pattern")),
        _labelled("Layer", F.col("layer")),
        "",
        F.col("_shown"),
        "",
        F.concat(F.lit("Look for: "), F.lit(SHORT_NAMES)),
        CLEAN_CHECK_FORMAT,
    )
    return texts.select(*KEY, "file_name", "layer", prompt.alias("prompt"))


def model_overall(scored: DataFrame) -> DataFrame:
    """Mean model score per project over distinct file names, of which the
    last file counts."""
    by_name = scored.groupBy("project_id", "file_name").agg(
        F.max_by("quality_score", "file_seq").alias("_score")
    )
    return by_name.groupBy("project_id").agg(
        exact_mean(exact_sum(F.col("_score"), SCORE_BITS), F.count(F.lit(1)), SCORE_BITS)
        .alias("model_overall")
    )


def project_counts(
    files: DataFrame, details: DataFrame, verdict_groups: DataFrame, scored: DataFrame | None = None,
) -> DataFrame:
    """Figures in the head of an assessment request, per project. Model means
    need the ``scored`` files only, not the joined review rows."""
    sizes = per_architecture(
        files,
        F.count(F.lit(1)).alias("n"), F.count_if("in_clean_list").alias("clean"),
        F.max("any_source").alias("any"),
    ).groupBy("project_id").agg(
        F.sum("n").alias("n_files"), F.sum("clean").alias("n_clean"),
        F.max("last_seq").alias("last_seq"), F.max("any").alias("any_source"),
        first_architecture(),
    )
    findings = details.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_violations"))
    rejected = rejected_counts(verdict_groups)
    joined = (
        sizes.join(grown(findings), "project_id", "left").join(grown(rejected), "project_id", "left")
        .join(grown(model_overall(files if scored is None else scored)), "project_id")
    )
    zero = F.lit(0).cast("bigint")
    return joined.withColumns({
        "n_violations": F.coalesce("n_violations", zero),
        "n_rejected": F.coalesce("n_rejected", zero),
    })


def assessment_requests(
    files: DataFrame, members: DataFrame, details: DataFrame, verdict_groups: DataFrame,
    scored: DataFrame | None = None,
) -> DataFrame:
    """One request per (project, part) with source: project figures, a line
    per file of the part and a line per finding in it. ``files`` come from
    ``with_findings``, ``members`` from ``member_lists``."""
    counts = project_counts(files, details, verdict_groups, scored).filter("any_source")
    head = spread(counts, "last_seq").drop("last_seq", "any_source")
    names = F.transform(
        F.array_sort(F.array_distinct("findings")),
        lambda f: F.concat(f["type"], F.lit(" ("), f["severity"], F.lit(")")),
    )
    line = F.concat(
        F.lit("- "), F.col("file_name"), F.lit(" (layer: "), F.col("layer"),
        F.lit(", model score: "), whole_text(F.col("quality_score")), F.lit("/100) "),
        F.when(F.size("findings") > 0, F.array_join(names, ", ")).otherwise(CLEAN),
    )
    file_lines = files.groupBy("project_id", "part").agg(
        joined_sections(line, "file_seq", separator="\n").alias("_files")
    )
    finding_line = F.concat(
        F.lit("- "), F.col("type"), F.lit(" ["), F.col("severity"), F.lit("]: "),
        F.array_join("files", ", "), F.when(F.col("llm_validated"), " (reviewed)").otherwise(""),
    )
    told = details.select("project_id", "type", "position", "severity", "llm_validated")
    finding_lines = members.join(grown(told), GROUP).groupBy("project_id", "part").agg(
        joined_sections(finding_line, "position", separator="\n").alias("_findings")
    )
    prompt = _lines(
        "Assess the quality of a project from these findings.",
        _labelled("Architecture", F.col("architecture_pattern")),
        _labelled("Files", F.col("n_files")),
        _labelled("Model score", F.concat(whole_text(F.col("model_overall")), F.lit("/100"))),
        _labelled("Confirmed violations", F.col("n_violations")),
        _labelled("Clean files", F.col("n_clean")),
        _labelled("Rejected predictions", F.col("n_rejected")),
        "",
        F.col("_files"),
        "",
        F.coalesce("_findings", F.lit("No violations.")),
        "",
        GUIDE,
        ASSESSMENT_FORMAT,
    )
    return head.join(grown(file_lines), PLACE).join(grown(finding_lines), PLACE, "left").select(
        *PLACE, "architecture_pattern", "n_files", "n_violations", "n_clean", "n_rejected",
        "model_overall", prompt.alias("prompt"),
    )


def first_members(members: DataFrame, limit: int = MAX_FIX_FILES, violation: list[str] = GROUP) -> DataFrame:
    """The first files of each violation. The rank filter is applied
    before the shuffle too, so only a few rows per group move."""
    order = Window.partitionBy(*violation).orderBy("origin", "file_seq")
    return members.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def fix_requests(
    details: DataFrame, members: DataFrame, sources: Sources | None,
    architectures: DataFrame, max_lines: int = MAX_SOURCE_LINES,
    owner: list[str] = ["project_id"], violation: list[str] = GROUP,
) -> DataFrame:
    """One request per violation: the first files by name, how many more
    there are, and their source where given. ``architectures`` has one row
    per ``owner`` of violations, ``members`` come from ``final_members``.
    The keys of ``violation`` are unique in ``details``."""
    top = first_members(members, violation=violation)
    if sources is None:
        with_code = top.withColumn("section", F.lit(None).cast("string"))
    else:
        keys = source_keys(sources, owner) if isinstance(sources, DataFrame) else KEY
        wanted = top.select(*dict.fromkeys([*violation, *keys, "rank", "file_name"]))
        with_code = with_sections(wanted, sources, max_lines, "left", owner)
    name = F.concat(F.lit("  - "), F.col("file_name"))
    shown = with_code.groupBy(*violation).agg(
        joined_sections(name, "rank", separator="\n").alias("_names"),
        joined_sections(F.col("section"), "rank").alias("_sources"),
        F.count("section").alias("n_sources"),
        F.count(F.lit(1)).alias("n_shown"),
    )
    return fix_prompts(details, shown, architectures, owner, violation)


def fix_prompts(
    details: DataFrame, shown: DataFrame, architectures: DataFrame,
    owner: list[str] = ["project_id"], violation: list[str] = GROUP,
) -> DataFrame:
    """``shown`` has the first files and their source as text, a row per violation that has
    files; it is joined last, so that only narrow rows move for the other joins."""
    zero = F.lit(0).cast("bigint")
    rows = details.filter(F.col("type") != CLEAN).join(
        grown(architectures.select(*owner, "architecture_pattern")), owner
    ).join(grown(shown), violation, "left").withColumns({
        "n_shown": F.coalesce("n_shown", zero), "n_sources": F.coalesce("n_sources", zero),
    })
    return prompts_of(rows, [*owner, *violation, *GROUP])


def prompts_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The prompt of each violation, made in its row: a detail with its architecture and
    ``_names``, ``_sources``, ``n_sources`` and ``n_shown``."""
    more = F.col("n_files") - F.col("n_shown")
    before, after = F.col("catalog_before_code"), F.col("catalog_after_code")
    example = F.when(
        F.coalesce(before, F.lit("")) != "",
        F.concat(F.lit("\nExample before:\n"), before, F.lit("\nExample after:\n"), after),
    )
    prompt = _lines(
        "Suggest a fix for an anti-pattern.",
        _labelled("Anti-pattern", F.col("catalog_display_name")),
        _labelled("Architecture", F.col("architecture_pattern")),
        _labelled("Layer", or_else(F.col("affected_layer"), F.col("catalog_usual_layer"))),
        _labelled("Severity", F.col("severity")),
        "Files:",
        F.col("_names"),
        F.when(more > 0, F.concat(F.lit("  - and "), more.cast("string"), F.lit(" more"))),
        _labelled("Problem", or_else(F.col("description"), F.col("catalog_description"))),
        F.when(F.col("n_sources") > 0, F.concat(F.lit("\nSource:\n"), F.col("_sources"))),
        example,
        "Give a recommendation, a short example before and after, and tips.",
    )
    return with_catalog(rows).select(
        *dict.fromkeys(keys), "architecture_pattern", "n_files", "n_shown", "n_sources",
        prompt.alias("prompt"),
    )
