"""Merging reviewer replies into model findings.

A reviewer (an external model or a person) works outside Spark: requests are
tables (``operators.requests``), replies come back as tables of raw text.
Every reply is optional; a missing or unreadable one leaves the model's own
result in place.

A group is reviewed per part (see ``operators.parts``); a verdict speaks for
the files of its part. Ordinary projects have one part, so one verdict. Where
a group has several, its detail row has the worst severity and the texts of
all kept parts, and the type counts as rejected only if no part keeps it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stratalens.functions.numeric import SHARE_BITS, exact_sum
from stratalens.functions.replies import parse_reply, truthy, with_object
from stratalens.functions.text import or_else
from stratalens.operators.parts import PLACE, grown, spread, with_part
from stratalens.operators.violations import (
    GROUP, PART_GROUP, detail_order, mean_confidence,
)
from stratalens.schema import CLEAN, CLEAN_CHECK_REPLY, KEY, VERDICT_REPLY
from stratalens.sources.catalog import severity_rank, with_catalog

# Fixed value: clean files below this confidence are checked again.
RECHECK_BELOW = 0.70
DISCOVERED_REASON = "Found when a low-confidence clean file was checked again"
NO_REPLY_REASON = "No readable review, model result kept"
NO_SOURCE_REASON = "No source to review"

TEXTS = ["reasoning", "description", "recommendation", "before_code", "after_code"]


def first_readable(read: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key the value read from the first readable reply in text order.
    Unreadable replies, whose value is null, never displace a readable one."""
    return read.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min_by(value, "reply").alias(value)
    )


def reply_keys(replies: DataFrame, *keys: str) -> list[str]:
    """The keys of a reply table, with its part where it has one."""
    return [*keys, *[c for c in ("part",) if c in replies.columns]]


def per_part(read: DataFrame, groups: DataFrame, *keys: str) -> DataFrame:
    """Rows by ``keys`` and part. A table without ``part`` speaks for every
    part of its project or group; ``groups`` tell how far these reach."""
    if "part" in read.columns:
        return read
    reach = groups.groupBy(*keys).agg(F.max("last_seq").alias("last_seq"))
    return spread(read.join(grown(reach), list(keys)), "last_seq").drop("last_seq")


def project_state(groups: DataFrame) -> DataFrame:
    """Per project: whether any file has source, and whether review runs at
    all (source and at least one model finding)."""
    state = groups.groupBy("project_id").agg(
        F.max(F.col("n_with_source") > 0).alias("any_source"),
        F.max(F.col("type") != CLEAN).alias("has_findings"),
        F.max("last_seq").alias("project_last_seq"),
    )
    return state.withColumn("attempted", F.col("any_source") & F.col("has_findings"))


def with_project_state(groups: DataFrame) -> DataFrame:
    """Part groups with the state of their project, joined part by part."""
    state = spread(project_state(groups), "project_last_seq").drop("project_last_seq")
    return groups.join(grown(state), PLACE)


def read_verdicts(replies: DataFrame) -> DataFrame:
    """Fields of the readable verdicts, one per key. Where a part was sent in slices, it is
    valid if any slice's verdict says so, and has the texts of the first that does (of the
    first at all if none does)."""
    keys = reply_keys(replies, *GROUP)
    each = [*keys, *[c for c in ("slice",) if c in replies.columns]]
    read = first_readable(with_object(replies), each, "obj")
    fields = read.withColumn("_reply", parse_reply(F.col("obj"), VERDICT_REPLY)).select(
        *each,
        truthy(F.col("obj"), "is_valid", absent=True).alias("is_valid"),
        *[F.col("_reply")[c].alias(c) for c in (*TEXTS, "severity")],
    )
    if each != keys:
        said = F.struct("is_valid", *TEXTS, "severity")
        fields = fields.groupBy(*keys).agg(
            F.min_by(said, F.struct((~F.col("is_valid")).alias("no"), "slice")).alias("_said")).select(*keys, "_said.*")
    return fields.withColumn("_read", F.lit(True))


def apply_verdicts(groups: DataFrame, verdicts: DataFrame | None) -> DataFrame:
    """Part groups (``part_groups``) with their verdict: ``is_valid`` (false marks a false
    positive), whether a reply backs it, and the reply's texts. Only groups
    of reviewed projects with source in hand can be rejected."""
    groups = with_catalog(with_project_state(groups))
    asked = F.col("attempted") & (F.col("type") != CLEAN) & (F.col("n_with_source") > 0)
    groups = groups.withColumn("asked", asked)
    if verdicts is None:
        blank = {c: F.lit(None).cast("string") for c in (*TEXTS, "severity")}
        joined = groups.withColumns({
            "is_valid": F.lit(True), "_read": F.lit(None).cast("boolean"), **blank,
        })
    else:
        answers = per_part(read_verdicts(verdicts), groups, *GROUP)
        joined = groups.join(grown(answers), PART_GROUP, "left")
    backed = F.col("asked") & F.coalesce("_read", F.lit(False))
    severity = or_else(F.when(backed, F.col("severity")), F.col("catalog_severity"))
    texts = {c: F.when(backed, F.coalesce(c, F.lit(""))).otherwise("") for c in TEXTS[1:]}
    reason = (
        F.when(backed, F.coalesce("reasoning", F.lit("")))
        .when(F.col("asked"), NO_REPLY_REASON)
        .when(F.col("attempted") & (F.col("type") != CLEAN), NO_SOURCE_REASON)
        .otherwise("")
    )
    return joined.withColumns({
        "llm_validated": backed,
        "is_valid": ~backed | F.coalesce("is_valid", F.lit(True)),
        "severity": severity,
        "reasoning": reason,
        **texts,
    }).drop("_read")


STATUS_COLS = ["is_valid", "llm_validated", "severity", "any_source", "attempted"]


def with_status(scored: DataFrame, verdicts_applied: DataFrame) -> DataFrame:
    """File rows with the verdict on their group. At most one part's files
    share a join key."""
    status = verdicts_applied.select(*PART_GROUP, *STATUS_COLS)
    return with_part(scored).join(grown(status), PART_GROUP)


def false_positives(status: DataFrame) -> DataFrame:
    return status.filter(~F.col("is_valid"))


def rejected_counts(verdicts_applied: DataFrame) -> DataFrame:
    """Rejected types per project: a type counts when no part keeps it."""
    groups = verdicts_applied.groupBy(*GROUP).agg(F.max("is_valid").alias("_kept"))
    return groups.filter(~F.col("_kept")).groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n_rejected")
    )


def clean_candidates(status: DataFrame, below: float = RECHECK_BELOW) -> DataFrame:
    """Files labelled clean with little confidence that can be read again.
    Files cleared by a verdict carry no clean confidence and are left alone;
    an unknown confidence counts as certain."""
    return status.filter(
        (F.col("type") == CLEAN) & F.col("attempted") & F.col("has_source")
        & (F.coalesce("confidence", F.lit(1.0)) < below)
    )


def discoveries(candidates: DataFrame, replies: DataFrame) -> DataFrame:
    """Findings reported for rechecked files: one row per finding."""
    asked = candidates.select(*KEY, "part", "file_name", "layer")
    answers = asked.select(*KEY).join(grown(replies), KEY)
    read = asked.join(grown(first_readable(with_object(answers), KEY, "obj")), KEY)
    found = (
        read.filter(truthy(F.col("obj"), "has_issues", absent=False))
        .withColumn("_reply", parse_reply(F.col("obj"), CLEAN_CHECK_REPLY))
        .select(*KEY, "part", "file_name", "layer", F.posexplode("_reply.anti_patterns"))
    )
    finding = F.col("col")
    return found.filter(F.coalesce(finding["type"], F.lit("")) != "").select(
        *KEY, "part", "file_name", "layer",
        finding["type"].alias("type"), F.col("pos"),
        F.coalesce(finding["severity"], F.lit("MEDIUM")).alias("severity"),
        *[F.coalesce(finding[c], F.lit("")).alias(c) for c in TEXTS[1:]],
    )


def _kept_rows(verdicts_applied: DataFrame) -> DataFrame:
    kept = verdicts_applied.filter((F.col("type") != CLEAN) & F.col("is_valid"))
    return kept.select(
        *GROUP, "n_files", "layers", "confidence_total", "first_seq", "last_seq",
        F.struct(
            F.lit(0).alias("origin"), "first_seq", F.lit(0).alias("pos"), "severity",
            "llm_validated", *TEXTS,
        ).alias("verdict"),
    )


def _found_rows(found: DataFrame) -> DataFrame:
    per_type = found.withColumn(
        "verdict",
        F.struct(
            F.lit(1).alias("origin"), F.col("file_seq").alias("first_seq"), "pos", "severity",
            F.lit(True).alias("llm_validated"), F.lit(DISCOVERED_REASON).alias("reasoning"),
            *TEXTS[1:],
        ),
    )
    return per_type.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sort_array(F.collect_set("layer")).alias("layers"),
        exact_sum(F.lit(0.0), SHARE_BITS).alias("confidence_total"),
        F.min("file_seq").alias("first_seq"),
        F.max("file_seq").alias("last_seq"),
        F.min("verdict").alias("verdict"),
    )


def _merged_verdict(verdicts: Column) -> Column:
    """One verdict of those of all parts, in part order: the worst severity,
    and every different text on a line of its own."""
    first = F.get(verdicts, F.lit(0))
    own = F.filter(verdicts, lambda x: x["origin"] == first["origin"])
    worst = F.array_min(F.transform(
        own, lambda x: F.struct(severity_rank(x["severity"]).alias("rank"), x["severity"].alias("name"))))

    def texts(name: str) -> Column:
        given = F.filter(F.transform(own, lambda x: x[name]), lambda x: F.length(x) > 0)
        return F.array_join(F.array_distinct(given), "\n")

    return F.struct(
        first["origin"].alias("origin"), first["first_seq"].alias("first_seq"),
        first["pos"].alias("pos"), worst["name"].alias("severity"),
        F.exists(own, lambda x: x["llm_validated"]).alias("llm_validated"),
        *[texts(c).alias(c) for c in TEXTS],
    )


def merge_discoveries(verdicts_applied: DataFrame, found: DataFrame | None) -> DataFrame:
    """Groups after review, one row per (project, anti-pattern), with what the
    verdicts of all its parts say. A discovery joins an existing group and
    leaves its verdict alone; a new group takes the verdict of its first
    discovery. Works on group rows, not on files."""
    rows = _kept_rows(verdicts_applied)
    if found is not None:
        rows = rows.unionByName(_found_rows(found))
    # one verdict per part of the project
    merged = rows.groupBy(*GROUP).agg(
        F.sum("n_files").cast("bigint").alias("n_files"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("layers")))).alias("layers"),
        F.sum("confidence_total").alias("confidence_total"),
        F.max("last_seq").alias("last_seq"),
        F.sort_array(F.collect_list("verdict")).alias("_verdicts"),
    )
    return merged.withColumn("verdict", _merged_verdict(F.col("_verdicts"))).drop("_verdicts")


# Fixed value: layout of a fix given inline with a verdict.
INLINE_FIX = [
    "💡 RECOMMENDATION:\n", "\n\n🔧 EXAMPLE FIX:\n// ❌ BEFORE\n", "\n\n// ✅ AFTER\n",
]


def reviewed_details(groups: DataFrame) -> DataFrame:
    """Detail rows after review. Reply texts win over catalogue texts; a
    backed verdict with example code also yields an inline fix."""
    verdict = F.col("verdict")
    rows = with_catalog(groups).select(
        "project_id", "type", "n_files", "last_seq",
        or_else(verdict["severity"], F.col("catalog_severity")).alias("severity"),
        F.array_join("layers", ", ").alias("affected_layer"),
        mean_confidence(F.col("confidence_total"), F.col("n_files")).alias("confidence"),
        or_else(verdict["description"], F.col("catalog_description")).alias("description"),
        or_else(verdict["recommendation"], F.col("catalog_recommendation"))
        .alias("recommendation"),
        verdict["llm_validated"].alias("llm_validated"),
        verdict["description"].alias("llm_description"),
        verdict["before_code"].alias("before"), verdict["after_code"].alias("after"),
        verdict["origin"].alias("origin"), verdict["first_seq"].alias("first_seq"),
        verdict["pos"].alias("pos"),
        F.col("catalog_impact_points").alias("impact_points"),
    )
    text = F.concat(
        F.lit(INLINE_FIX[0]), F.col("recommendation"), F.lit(INLINE_FIX[1]), F.col("before"),
        F.lit(INLINE_FIX[2]), F.col("after"),
    )
    has_example = F.col("llm_validated") & ((F.col("before") != "") | (F.col("after") != ""))
    fix = F.struct(
        F.col("description").alias("problem"), "recommendation",
        F.col("before").alias("before_code"), F.col("after").alias("after_code"),
        text.alias("ai_fix"), "impact_points",
    )
    detailed = rows.withColumn("fix_suggestion", F.when(has_example, fix))
    return detail_order(detailed, "origin", "first_seq", "pos").drop(
        "before", "after", "origin", "pos", "impact_points"
    )


def clean_files(status: DataFrame, found: DataFrame | None) -> DataFrame:
    """Files without a finding after review: labelled clean or cleared by a
    verdict, less those a recheck found something in."""
    clean = status.filter((F.col("type") == CLEAN) | ~F.col("is_valid"))
    return clean if found is None else clean.join(grown(found), [*KEY, "part"], "left_anti")


def final_members(status: DataFrame, found: DataFrame | None) -> DataFrame:
    """Which file belongs to which group after review, one row each."""
    kept = status.filter((F.col("type") != CLEAN) & F.col("is_valid")).select(
        *KEY, "part", "file_name", "type", F.lit(0).alias("origin"),
    )
    if found is None:
        return kept
    return kept.unionByName(
        found.select(*KEY, "part", "file_name", "type", F.lit(1).alias("origin"))
    )


def member_lists(members: DataFrame) -> DataFrame:
    """File names of each group, one row per (project, type, part): model
    findings in file order, then discoveries."""
    ordered = F.sort_array(F.collect_list(F.struct("origin", "file_seq", "file_name")))
    return members.groupBy(*PART_GROUP).agg(
        F.transform(ordered, lambda x: x["file_name"]).alias("files")
    )


def ambiguous_names(files: DataFrame) -> DataFrame:
    """File names used more than once in a project. Reply scores name files
    by ``file_name`` only, so these share one reply score."""
    return files.groupBy("project_id", "file_name").agg(
        F.count(F.lit(1)).alias("n_files")
    ).filter("n_files > 1")
