"""Every operator as a query over the given tables: ``(spark, sf_dir) -> DataFrame``.

Lists come out as ordered joined text and counts as BIGINT, so that results
compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stratalens.functions.features import (
    ANTIPATTERN_FEATURES, QUALITY_FEATURES, antipattern_features, quality_features,
)
from stratalens.functions.issues import derive_issues
from stratalens.functions.layers import resolve_layer
from stratalens.functions.replies import parse_reply, truthy, with_assessment, with_object
from stratalens.functions.scores import rule_score, score_label
from stratalens.functions.text import truncate_lines
from stratalens.operators import compiled, evaluate, fixes, hybrid, models, requests, review, rollups
from stratalens.operators import violations as v
from stratalens.operators.parts import passes, with_file_seq, with_part
from stratalens.operators.rules import classify_by_rules, rule_label
from stratalens.plans.antipatterns import analyze_antipatterns
from stratalens.plans.fix_requests import FixInput, read_fix_requests, suggest_fixes
from stratalens.plans.full import FullReport, Replies, analyze_full, blended_files, review_findings
from stratalens.plans.quality import analyze_quality, files_worst_first
from stratalens.plans.scored import score_files, with_band
from stratalens.queries import fixtures as fx
from stratalens.schema import KEY, OPTIONAL_SIGNAL_COLS, REQUIRED_COLS, VERDICT_REPLY, raw_file_type
from stratalens.sources import projects as src
from stratalens.sources.catalog import catalog, display_name
from stratalens.sources.report import nested_reports, write_report
from stratalens.sources.staging import shuffles_dropped, staged, staged_path
from stratalens.sources.tables import order_records, project_files, source_lookup, source_texts, stored, table
from stratalens.streaming.payloads import payload_stream, stored_tables, write_payload_scores
from stratalens.streaming.scoring import file_stream, score_stream, write_scores

Query = Callable[[SparkSession, str], DataFrame]


def _text(column: str, separator: str = " | ") -> Column:
    return F.array_join(column, separator).alias(column)


def _long(*columns: str) -> list[Column]:
    return [F.col(c).cast("bigint").alias(c) for c in columns]


# ---- reading and checking -------------------------------------------------

def payload_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write project payloads as JSON, read them back, validate and score."""
    files = with_part(project_files(spark, sf_dir))
    fields = ["file_name", "file_path", "layer", *REQUIRED_COLS, *OPTIONAL_SIGNAL_COLS]
    entry = F.struct("file_seq", F.struct(*fields).alias("file"))
    payloads = files.groupBy("project_id", "part").agg(
        F.min("file_seq").alias("first_seq"),
        F.sort_array(F.collect_list(entry)).alias("_files"),
    ).select("project_id", "first_seq", F.transform("_files", lambda x: x["file"]).alias("files"))
    path = staged_path(spark, "payloads")
    payloads.write.json(path)
    valid, _ = src.validate_files(src.read_projects(spark, path))
    return valid.select(
        "project_id", "file_seq", "file_name", "layer", "architecture_pattern",
        "loc", "total_cross_layer_deps", "has_validation", "uses_new_keyword",
    )


def _raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = order_records(spark, sf_dir)
    fields = ["layer", *REQUIRED_COLS, *OPTIONAL_SIGNAL_COLS]
    return records.select(
        "project_id", F.col("file_id").alias("file_seq"), "file_name", "file_path",
        *[F.col(c).cast("string").alias(c) for c in fields],
    )


def valid_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = src.validate_files(_raw_records(spark, sf_dir))
    return valid.select("project_id", "file_seq", "loc", "imports", "has_data_access",
                        "has_broad_catch")


def rejected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = src.validate_files(_raw_records(spark, sf_dir))
    return rejected.select("project_id", "file_seq", _text("reasons", "; "))


def defaulted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality-score records of all orders; missing metrics take defaults."""
    records = order_records(spark, sf_dir).withColumn("layer", F.nullif("layer", F.lit("unknown")))
    filled = src.with_defaults(records, "quality")
    return filled.select("file_id", "layer", "loc", "avg_cc", "total_cross_layer_deps",
                         "has_business_logic", "violates_layer_separation")


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source table, with each text cut to ten lines."""
    texts = source_texts(spark, sf_dir)
    cut = truncate_lines(F.col("source_code"), 10)
    return texts.select(
        *KEY, F.length("source_code").cast("bigint").alias("n_chars"),
        F.length(cut).cast("bigint").alias("shown_chars"), F.right(cut, F.lit(40)).alias("ending"),
    )


def catalog_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue entries with the number of files that carry them."""
    labelled = classify_by_rules(project_files(spark, sf_dir))
    counts = labelled.groupBy("type").agg(F.count(F.lit(1)).alias("files"))
    return catalog(spark).join(counts, "type", "left").select(
        "type", "severity", *_long("impact_points"), "usual_layer",
        F.coalesce("files", F.lit(0)).cast("bigint").alias("files"),
    )


def aligned_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regressor inputs in a model's own order; one it lists is not derived."""
    wanted = ["violation_score", "loc", "layer_service", "comment_ratio"]
    return quality_features(project_files(spark, sf_dir), ["file_id"], wanted)


# ---- projections ----------------------------------------------------------

def resolved_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_layer(project_files(spark, sf_dir)).select(
        "project_id", "file_id", "layer", "resolved_layer"
    )


def antipattern_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = antipattern_features(project_files(spark, sf_dir), ["file_id"])
    logs = [c for c in ANTIPATTERN_FEATURES if c.endswith("_deps")]
    return rows.withColumns({c: F.round(c, 9) for c in logs})


def quality_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_features(project_files(spark, sf_dir), ["file_id"])


def file_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_issues(project_files(spark, sf_dir)).select(
        "file_id", _text("issues"), F.size("issues").cast("bigint").alias("n_issues")
    )


def file_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_files(project_files(spark, sf_dir), fx.classify_with_confidence)
    return scored.select(
        *KEY, "layer", "quality_score", "quality_label", "quality_emoji", "quality_display",
        *_long("n_issues"),
    )


def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable names of reported types, catalogued or not."""
    kinds = fx.found(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("findings"))
    return display_name(kinds)


def parsed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = with_object(fx.verdict_replies(spark, sf_dir))
    return replies.select(
        *v.PART_GROUP, F.col("obj").isNotNull().alias("was_read"),
        F.when(F.col("obj").isNotNull(), truthy(F.col("obj"), "is_valid", True)).alias("is_valid"),
        parse_reply(F.col("obj"), VERDICT_REPLY).alias("r"),
    ).select(*v.PART_GROUP, "was_read", "is_valid", "r.reasoning", "r.description", "r.severity")


def parsed_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = with_assessment(fx.assessment_replies(spark, sf_dir)).withColumnRenamed("assessment", "a")
    return a.select(
        "project_id", "part", F.col("a").isNotNull().alias("was_read"),
        "a.overall_score", "a.reasoning",
        F.array_join("a.improvements", ", ").alias("improvements"),
        F.size(F.map_keys("a.file_scores")).cast("bigint").alias("n_scores"),
    ).withColumn("n_scores", F.when(F.col("was_read"), F.col("n_scores")))


# ---- groups and rollups ---------------------------------------------------

def rule_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_by_rules(project_files(spark, sf_dir)).select("file_id", "type", "confidence")


def violations_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.violations_by_type(classify_by_rules(project_files(spark, sf_dir)))


def violation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.violation_groups(fx.scored(spark, sf_dir)).select(
        *v.GROUP, "n_files", _text("layers", ", "), "confidence", "first_seq", "last_seq"
    )


def violation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.violation_files(fx.scored(spark, sf_dir)).select(*v.PART_GROUP, _text("files", ", "))


def clean_file_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.clean_file_lists(fx.scored(spark, sf_dir)).select(
        "project_id", "part", _text("clean_files", ", ")
    )


def violation_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze_antipatterns(fx.scored(spark, sf_dir)).details.select(
        "project_id", "position", "type", "severity", "affected_layer", "confidence", "n_files"
    )


def antipattern_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's project, those without files included."""
    projects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"))
    return analyze_antipatterns(fx.scored(spark, sf_dir), projects).projects


def layer_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.layer_rollup(rollups.layer_sums(fx.scored(spark, sf_dir)))


def project_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = rollups.project_rollup(rollups.layer_sums(fx.scored(spark, sf_dir)))
    return projects.drop(*rollups.WORKING_COLS)


def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze_quality(fx.scored(spark, sf_dir)).projects.select("project_id", "summary")


def worst_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_worst_first(fx.scored(spark, sf_dir)).select(
        "project_id", "file_name", "layer", "quality_score", _text("issues")
    )


def violation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = fx.scored(spark, sf_dir)
    projects = rollups.project_rollup(rollups.layer_sums(scored))
    return rollups.violation_summary(projects, v.violation_details(scored)).select(
        "project_id", "total_violations", "violation_summary"
    )


# ---- review ---------------------------------------------------------------

def verdicts_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.verdict_groups(spark, sf_dir).filter("type <> 'clean'")
    return rows.select(
        *v.PART_GROUP, "attempted", "asked", "is_valid", "llm_validated", "severity",
        "reasoning", "description", "recommendation",
    )


def false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.false_positives(fx.status(spark, sf_dir)).select(*KEY, "file_name", "type")


def clean_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.clean_candidates(fx.status(spark, sf_dir)).select(
        *KEY, "file_name", "layer", "confidence"
    )


def discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.found(spark, sf_dir).select(
        *KEY, "type", *_long("pos"), "severity", "layer", "description"
    )


def discoveries_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _review(spark, sf_dir)[1].details.select(
        "project_id", "position", "type", "severity", "affected_layer", "confidence", "n_files",
        "llm_validated", "llm_description",
        F.coalesce("fix_suggestion.ai_fix", F.lit("")).alias("inline_fix"),
        F.coalesce("fix_suggestion.impact_points", F.lit(0)).cast("bigint").alias("impact_points"),
    )


def merged_file_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.member_lists(_review(spark, sf_dir)[1].members).select(*v.PART_GROUP, _text("files", ", "))


def clean_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, done = _review(spark, sf_dir)
    return review.clean_files(done.status, done.found).select(
        *KEY, "file_name"
    )


def ambiguous_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names shared inside a project when files are named by layer and digit."""
    files = project_files(spark, sf_dir).withColumn(
        "file_name", F.concat(F.col("layer"), (F.col("file_id") % 7).cast("string"))
    )
    return review.ambiguous_names(files)


def _review(spark: SparkSession, sf_dir: str):
    scored = fx.scored(spark, sf_dir)
    replies = Replies(fx.verdict_replies(spark, sf_dir), fx.clean_check_replies(spark, sf_dir))
    return scored, review_findings(scored, replies)


def hybrid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, done = _review(spark, sf_dir)
    assessments = hybrid.read_assessments(fx.assessment_replies(spark, sf_dir))
    return blended_files(done, assessments).select(
        *KEY, "model_score", "quality_score", "quality_label", "quality_display",
        "scoring_method", "penalty", "in_clean_list", "cleared",
    )


def hybrid_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = fx.scored(spark, sf_dir)
    means = requests.model_overall(scored)
    sizes = with_part(scored).groupBy("project_id", "part").agg(F.count(F.lit(1)).alias("n_files"))
    replies = hybrid.project_assessments(
        hybrid.read_assessments(fx.assessment_replies(spark, sf_dir)), sizes)
    joined = means.join(replies.select("project_id", "overall_score"), "project_id", "left")
    return joined.select(
        "project_id",
        hybrid.hybrid_overall(F.col("model_overall"), F.col("overall_score")).alias("overall"),
    )


def large_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three projects that hold all files, so of several parts each: verdicts
    that differ by part, an unreadable reply beside every readable one."""
    def make() -> DataFrame:
        # projects one after the other; none of the given ones has a million files
        files = fx.scored(spark, sf_dir).withColumn("_order", F.col("project_id") * 1_000_000 + F.col("file_seq"))
        files = files.withColumn("project_id", F.col("project_id") % 3).drop("file_seq")
        return with_file_seq(files, "_order").drop("_order")

    groups = v.part_groups(stored(spark, sf_dir, "large_projects", make))
    kind, part = F.col("type"), F.col("part")
    reply = F.concat(
        F.lit('{"is_valid": '), ((part + F.length(kind)) % 3 != 0).cast("string"),
        F.lit(', "description": "part '), part.cast("string"),
        F.lit('", "severity": "'), F.when(part % 2 == 0, "LOW").otherwise("CRITICAL"), F.lit('"}'),
    )
    answers = groups.filter("type <> 'clean'").select(
        *v.PART_GROUP, F.explode(F.array(F.lit("I cannot"), reply)).alias("reply"))
    applied = review.apply_verdicts(groups, answers)
    details = review.reviewed_details(review.merge_discoveries(applied, None))
    return details.join(review.rejected_counts(applied), "project_id", "left").select(
        "project_id", "position", "type", "severity", "affected_layer", "confidence", "n_files",
        "llm_validated", "llm_description", F.coalesce("n_rejected", F.lit(0)).alias("n_rejected"),
    )


# ---- requests -------------------------------------------------------------

def _validation_requests(spark: SparkSession, sf_dir: str, kept: Callable[[DataFrame], DataFrame], **bounds: int) -> DataFrame:
    scored = fx.scored(spark, sf_dir)
    groups = review.apply_verdicts(v.part_groups(scored), None)
    sent = v.violations_only(scored).filter("has_source").count()
    return requests.validation_requests(
        scored, groups, source_lookup(spark, sf_dir), n_files=sent, kept=kept, **bounds)


def validation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validation_requests(spark, sf_dir, lambda made: made.select(
        *v.PART_GROUP, "architecture_pattern", "affected_layer", "confidence", "severity",
        "n_files", F.md5("prompt").alias("prompt_md5"),
    ))


def validation_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests within 4,000 bytes of source each."""
    return _validation_requests(spark, sf_dir, lambda made: made.select(
        *v.PART_GROUP, "slice", "n_files", "source_bytes", (F.col("source_bytes") <= 4000).alias("fits"),
        F.md5("prompt").alias("prompt_md5")), max_bytes=4000)


def clean_check_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = requests.clean_check_requests(
        review.clean_candidates(fx.status(spark, sf_dir)), source_lookup(spark, sf_dir)
    )
    return made.select(*KEY, "layer", F.md5("prompt").alias("prompt_md5"))


def assessment_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, done = _review(spark, sf_dir)
    made = requests.assessment_requests(
        done.files, review.member_lists(done.members), done.details, done.verdict_groups, scored
    )
    return made.select(
        "project_id", "part", "architecture_pattern", "n_files", "n_violations", "n_clean",
        "n_rejected", F.md5("prompt").alias("prompt_md5"),
    )


def fix_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = fx.scored(spark, sf_dir)
    members = with_part(v.violations_only(scored)).withColumn("origin", F.lit(0))
    made = requests.fix_requests(
        v.violation_details(scored), members, source_lookup(spark, sf_dir),
        v.antipattern_summary(scored),
    )
    return made.select(
        *v.GROUP, "architecture_pattern", "n_files", "n_shown", "n_sources",
        F.md5("prompt").alias("prompt_md5"),
    )


# ---- fixes ----------------------------------------------------------------

def fixes_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = fx.scored(spark, sf_dir)
    rows = fixes.with_files(fixes.fix_suggestions(v.violation_details(scored)),
                            v.violation_files(scored))
    return rows.select(
        "project_id", "position", "anti_pattern", "layer", "severity", *_long("impact_points"),
        "n_files", "part", _text("files", ", "), "ai_powered",
    )


def fixes_with_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes of reviewed findings, short names included."""
    made = fixes.fix_suggestions(_review(spark, sf_dir)[1].details, fx.fix_replies(spark, sf_dir))
    return made.select(
        "project_id", "position", "anti_pattern", "layer", *_long("impact_points"), "n_files",
        "ai_fix", "ai_powered",
    )


def _fix_inputs(spark: SparkSession, sf_dir: str) -> list[FixInput]:
    """The fix requests of all projects. So many that their texts would fill the disks are
    written and read in passes by project, each over the files of the one before, which
    has stored what it keeps."""
    senders = project_files(spark, sf_dir).filter("has_source AND project_id % 2 = 0").count()
    path = staged_path(spark, "fix-requests")
    return [_fix_input(spark, sf_dir, mine, path) for mine in passes(senders, "project_id")]


def _fix_input(spark: SparkSession, sf_dir: str, mine: Column, path: str) -> FixInput:
    """Fix requests of some projects written as JSON and read back. Even projects send their
    sources; second entries lack the severity, third ones the layer. Some
    projects list every type twice, some send their request twice, some
    without their id and some without violations."""
    scored = fx.scored(spark, sf_dir).filter(mine)
    lists = v.violation_files(scored).groupBy(*v.GROUP).agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "files"))), lambda x: x["files"])).alias("files"))
    entry = F.struct(
        "position", "type", "files",
        F.when(F.col("position") != 3, F.col("affected_layer")).alias("affected_layer"),
        F.when(F.col("position") != 2, F.col("severity")).alias("severity"), "description",
    )
    listed = v.violation_details(scored).join(lists, v.GROUP).groupBy("project_id").agg(
        F.sort_array(F.collect_list(entry)).alias("_once"))
    texts = source_texts(spark, sf_dir).filter("project_id % 2 = 0").filter(mine).groupBy("project_id").agg(
        F.map_from_entries(F.collect_list(F.struct("file_name", "source_code"))).alias("file_sources"))
    architectures = v.antipattern_summary(scored).select("project_id", "architecture_pattern")
    requests_ = listed.join(texts, "project_id", "left").join(architectures, "project_id")
    divides = lambda n: F.col("project_id") % n == 0
    entries = F.when(divides(13), F.array_except("_once", "_once")).when(divides(5), F.concat("_once", "_once"))
    sent = F.explode(F.when(divides(7), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    made = requests_.withColumn("anti_patterns", entries.otherwise(F.col("_once"))).withColumn("_sent", sent).withColumn(
        "project_id", F.when(~divides(11), F.col("project_id"))).drop("_once", "_sent")
    with shuffles_dropped(spark):
        made.write.json(path, mode="overwrite", compression="gzip")
    return read_fix_requests(spark, path)


def fix_request_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes with the number of fixes of their request; a request without
    violations has one row without a fix."""
    reports = [suggest_fixes(given, fx.fix_replies(spark, sf_dir)) for given in _fix_inputs(spark, sf_dir)]
    return reduce(DataFrame.unionByName, [
        report.totals.join(report.fixes.drop("project_id"), "request_id", "left").select(
            "project_id", "position", "anti_pattern", "layer", "severity", *_long("impact_points"),
            "problem", "n_files", "ai_fix", "ai_powered", "total_fixes",
        ) for report in reports])


def fix_request_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        suggest_fixes(given).prompts.select(
            *v.GROUP, "position", "architecture_pattern", "n_files", "n_shown", "n_sources", F.md5("prompt").alias("prompt_md5"))
        for given in _fix_inputs(spark, sf_dir)])


def fix_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixes.fix_totals(fixes.fix_suggestions(v.violation_details(fx.scored(spark, sf_dir))))


# ---- evaluation -----------------------------------------------------------

def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with the stated layer as expectation, labels without it as
    prediction: single-file prediction never sees the layer."""
    prefix = F.when(F.col("layer") == "unknown", "E-").otherwise("F-")
    stated = project_files(spark, sf_dir).withColumns({
        "name": F.concat(prefix, F.col("file_id")), "expected": rule_label(),
    })
    blind = stated.withColumn("layer", F.lit(None).cast("string"))
    return blind.select(
        "name", "architecture_pattern", "expected", rule_label().alias("predicted")
    )


def accuracy_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accuracy(_cases(spark, sf_dir), "expected")


def accuracy_by_arch(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _cases(spark, sf_dir).withColumn("case_bucket", evaluate.case_bucket())
    return evaluate.accuracy(cases, "case_bucket")


def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.class_report(accuracy_by_class(spark, sf_dir))


def run_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.compare_runs(fx.scored(spark, sf_dir), fx.after_run(spark, sf_dir))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.file_transitions(fx.scored(spark, sf_dir), fx.after_run(spark, sf_dir))


def transitions_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run lacks every fifth file of a project and has every
    seventh a second time under a new path; all positions have moved."""
    after = fx.after_run(spark, sf_dir).filter("file_seq % 5 <> 4")
    extra = after.filter("file_seq % 7 = 3").withColumns({
        "file_path": F.concat(F.lit("new/"), F.col("file_path")),
        "file_name": F.concat(F.lit("New"), F.col("file_name")),
    })
    moved = after.withColumn("file_seq", F.col("file_seq") + 1).unionByName(extra)
    return evaluate.file_transitions(fx.scored(spark, sf_dir), moved).drop("file_seq")


def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the rule score against a score built from the line items."""
    files = project_files(spark, sf_dir).select(
        rule_score().alias("quality_score"),
        (F.lit(100.0) - F.col("total_cross_layer_deps") * 6 - F.col("avg_cc") * 4).alias("label"),
    )
    rows = evaluate.quality_metrics(files)
    return rows.withColumns({c: F.round(c, 6) for c in ("rmse", "mae", "r2")})


def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-fold errors of the mean score per layer and architecture, for the rule score."""
    files = project_files(spark, sf_dir).select(
        "file_id", "layer", "architecture_pattern", rule_score().alias("label"))
    fit = lambda train: models.fit_group_means(train, ["layer", "architecture_pattern"])
    rows = evaluate.cross_validated(files, fit, evaluate.fold_of(F.col("file_id"), 5), 5)
    return rows.withColumns({c: F.round(c, 6) for c in evaluate.CV_FIGURES})


# ---- full report ----------------------------------------------------------

def full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = analyze_full(fx.scored(spark, sf_dir), fx.replies(spark, sf_dir))
    return report.projects.drop("analysis_date").withColumns({
        "quality_strengths": F.array_join("quality_strengths", ", "),
        "quality_improvements": F.array_join("quality_improvements", ", "),
    })


def full_report_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze_full(fx.scored(spark, sf_dir), fx.replies(spark, sf_dir)).layers


def full_report_model_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without replies and without source the report is the model's own."""
    scored = fx.scored(spark, sf_dir).withColumn("has_source", F.lit(False))
    report = analyze_full(scored)
    return report.projects.select(
        "project_id", "overall_score", "total_violations", "scoring_method", "llm_enhanced",
        "false_positives_filtered", "violation_summary", "quality_summary",
    )


def _named_lists(column: str, name: str) -> Column:
    """Lists of files by name as one text."""
    entries = F.transform(column, lambda x: F.concat(x[name], F.lit(":"), F.array_join(x["files"], ",")))
    return F.coalesce(F.array_join(entries, ";"), F.lit("")).alias(column)


def nested_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested report rows written as JSON and read back, then measured."""
    scored = fx.scored(spark, sf_dir)
    report = analyze_full(scored, fx.replies(spark, sf_dir))
    last = scored.groupBy("project_id").agg(F.max("file_seq").alias("last_seq"))
    path = staged_path(spark, "nested")
    # all that a report tells of a file moves in about a quarter of the bytes of a text
    several = passes(scored.count() // 4, "project_id")
    if len(several) > 1:
        report = report._replace(projects=staged(report.projects, "projects"))
    for mine in several:
        nested = nested_reports(FullReport(*[table.filter(mine) for table in report]), last.filter(mine))
        with shuffles_dropped(spark):
            nested.write.json(path, mode="append", compression="gzip")
    back = spark.read.schema(nested.schema).json(path)
    return back.select(
        "project_id", "part", "overall_score", "total_violations",
        F.size("layer_scores").cast("bigint").alias("n_layers"),
        F.coalesce(F.size("anti_patterns"), F.lit(0)).cast("bigint").alias("n_anti_patterns"),
        F.size("files").cast("bigint").alias("n_files"),
        F.element_at("files", 1)["file_name"].alias("worst_file"),
        F.coalesce(F.array_join("clean_files", ", "), F.lit("")).alias("clean_files"),
        _named_lists("layer_files", "layer"), _named_lists("anti_pattern_files", "type"),
    )


def written_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality report written table by table; rows and a checksum of their
    contents read back per table."""
    report = analyze_quality(fx.scored(spark, sf_dir))
    path = staged_path(spark, "report")
    write_report(report, path)
    contents = {"projects": ["project_id", "overall_score", "summary"], "layers": ["project_id", "layer"],
                "files": ["project_id", "file_name", "layer", "quality_score"]}
    counts = []
    for name in report._fields:
        row = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in contents[name]]))
        number = F.conv(F.substring(row, 1, 8), 16, 10).cast("bigint")
        counts.append(spark.read.parquet(f"{path}/{name}").agg(
            F.count(F.lit(1)).alias("row_count"), F.sum(number).alias("checksum"),
        ).select(F.lit(name).alias("table_name"), "row_count", "checksum"))
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result


# ---- models and streams ---------------------------------------------------

def rf_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random forest fitted on four fifths of the files, applied to the rest."""
    files = project_files(spark, sf_dir).withColumn("expected", rule_label())
    train, test = models.hash_split(files, "file_id")
    model = models.fit_antipattern(train)
    return models.predict_antipattern(test, model).select(
        "file_id", "expected", "type", "confidence"
    )


def gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees fitted to the rule score, applied to the rest."""
    files = project_files(spark, sf_dir).withColumn("label", rule_score())
    train, test = models.hash_split(files, "file_id")
    model = models.fit_quality(train)
    return models.predict_quality(test, model).select("file_id", "label", "quality_score")


def _scored_by_models(spark: SparkSession, sf_dir: str):
    """Both models fitted, saved and loaded again, with the regressor's own
    feature list read from a metadata file beside it."""
    files = project_files(spark, sf_dir).withColumns({"expected": rule_label(), "label": rule_score()})
    train, test = models.mod_split(files, "file_id")
    names = QUALITY_FEATURES[::-1]
    path = staged_path(spark, "models")
    models.save_models(path, models.fit_antipattern(train), models.fit_quality(train, names=names))
    spark.createDataFrame([(names,)], "feature_names array<string>").coalesce(1).write.json(f"{path}/meta")
    classifier, regressor = models.load_models(spark, path)
    listed = models.feature_columns(spark, f"{path}/meta")
    return test, lambda df: with_band(models.predict_quality(
        models.predict_antipattern(df, classifier), regressor, listed))


def compiled_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out files scored by two saved models and by the SQL compiled from their node
    tables; whether both agree."""
    files = project_files(spark, sf_dir).withColumns({"expected": rule_label(), "label": rule_score()})
    train, test = models.mod_split(files, "file_id")
    path = staged_path(spark, "models")
    models.save_models(path, models.fit_antipattern(train, trees=8, depth=6), models.fit_quality(train, trees=8, depth=4))
    classifier, regressor = models.load_models(spark, path)
    told = models.predict_quality(models.predict_antipattern(test, classifier), regressor).select(
        "file_id", "expected", F.col("type").alias("_type"), F.col("confidence").alias("_confidence"), F.col("quality_score").alias("_score"))
    again = compiled.compiled_quality(
        compiled.compiled_antipattern(test, compiled.classifier_sql(spark, f"{path}/antipattern")),
        compiled.regressor_sql(spark, f"{path}/quality"))
    both = told.join(again.select("file_id", "type", "confidence", "quality_score"), "file_id")
    return both.select("file_id", "expected", (F.col("type") == F.col("_type")).alias("types_agree"),
                       (F.abs(F.col("confidence") - F.col("_confidence")) < 1e-9).alias("confidences_agree"),
                       (F.col("quality_score") == F.col("_score")).alias("scores_agree"))


def _checked(scored: DataFrame) -> DataFrame:
    """What must hold for every prediction, whatever the trees look like."""
    score, confidence = F.col("quality_score"), F.col("confidence")
    return scored.select(
        "file_id", "expected",
        F.col("type").isin(models.LABELS).alias("type_known"),
        ((confidence > 0) & (confidence <= 1)).alias("confidence_fits"),
        ((score >= 0) & (score <= 100)).alias("score_fits"),
        (F.col("quality_label") == score_label(score)).alias("band_fits"),
        (F.col("type") == F.col("expected")).alias("_hit"), score.alias("_score"), "label",
    )


def saved_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out files scored by loaded models; also whether the models reach
    an accuracy of 0.8 and an R² of 0.7 there."""
    test, score = _scored_by_models(spark, sf_dir)
    rows = _checked(score(test))
    path = staged_path(spark, "model_scores")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    r2 = evaluate.quality_metrics(rows, score="_score").first()["r2"]
    accuracy = rows.agg(F.avg(F.col("_hit").cast("double"))).first()[0]
    return rows.drop("_hit", "_score", "label").withColumns({
        "r2_reached": F.lit((r2 or 0.0) >= 0.7), "accuracy_reached": F.lit((accuracy or 0.0) >= 0.8),
    })


def saved_models_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same held-out files arriving as a stream."""
    test, score = _scored_by_models(spark, sf_dir)
    path, out = staged_path(spark, "model-stream-in"), staged_path(spark, "model-stream-out")
    test.write.parquet(path)
    rows = _checked(score(file_stream(spark, path, test.schema))).drop("_hit", "_score", "label")
    write_scores(rows, out, staged_path(spark, "model-stream-progress")).awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored files as a stream, scored and appended to a table."""
    files = project_files(spark, sf_dir)
    path = staged_path(spark, "stream-in")
    files.write.parquet(path)
    out = staged_path(spark, "stream-out")
    scored = score_stream(file_stream(spark, path, files.schema), fx.classify_with_confidence)
    write_scores(scored, out, staged_path(spark, "stream-progress")).awaitTermination()
    return spark.read.schema(scored.schema).parquet(out).select(
        *KEY, "type", "confidence", "quality_score", "quality_display", _text("issues")
    )


def payload_stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of all projects in three arrivals, records without metrics among them, with
    the stream started anew for each; the rows of both tables it writes."""
    fields = [c for c in raw_file_type().names if c != "source_code"]
    records = _raw_records(spark, sf_dir).groupBy("project_id").agg(
        F.array_sort(F.collect_list(F.struct("file_seq", F.struct(*fields).alias("file")))).alias("_files"))
    payloads = staged(records.select("project_id", F.transform("_files", lambda x: x["file"]).alias("files")), "payloads")
    path, out, progress = (staged_path(spark, f"payload-stream-{x}") for x in ("in", "out", "progress"))
    for arrival in range(3):
        payloads.filter(F.col("project_id") % 3 == arrival).write.mode("append").json(path)
        write_payload_scores(payload_stream(spark, path), out, progress).awaitTermination()
    good, bad = stored_tables(spark, out)
    nothing = lambda kind: F.lit(None).cast(kind)
    scored = good.select("project_id", "file_name", F.lit("scored").alias("outcome"), "type", "quality_score", F.lit("").alias("reasons"))
    return scored.union(bad.select("project_id", "file_name", F.lit("rejected"), nothing("string"), nothing("double"),
                                   _text("reasons", "; ")))


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        payload_files, valid_files, rejected_files, defaulted_files, source_lines,
        catalog_usage, aligned_features,
        resolved_layers, antipattern_inputs, quality_inputs, file_issues, file_scores,
        display_names, parsed_replies, parsed_assessments,
        rule_labels, violations_by_type, violation_groups, violation_files, clean_file_lists,
        violation_details, antipattern_summary, layer_rollup, project_rollup, quality_summary,
        worst_files, violation_summary,
        verdicts_applied, false_positives, clean_candidates, discoveries, discoveries_merged,
        merged_file_lists, large_projects, clean_files, ambiguous_names, hybrid_scores, hybrid_overall,
        validation_requests, validation_slices, clean_check_requests, assessment_requests, fix_requests,
        fixes_static, fixes_with_replies, fix_request_rows, fix_request_prompts, fix_totals,
        accuracy_by_class, accuracy_by_arch, class_report, run_delta, transitions,
        transitions_changed, quality_metrics, cross_validation,
        full_report, full_report_layers, full_report_model_only, nested_report, written_report,
        rf_predictions, gbt_scores, compiled_models, saved_models, saved_models_stream, stream_scores, payload_stream_scores,
    )
}
