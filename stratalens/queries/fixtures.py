"""Predictions, replies and a second run derived from the order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stratalens.operators.review import (
    apply_verdicts, clean_candidates, discoveries, with_status,
)
from stratalens.operators.rules import classify_by_rules
from stratalens.operators.violations import PART_GROUP, part_groups, violation_groups
from stratalens.operators.parts import grown, with_part
from stratalens.plans.full import Replies
from stratalens.plans.scored import score_files
from stratalens.sources.tables import project_files, stored

FENCED = ("```json\n", "\n```")
PROSE = ("My answer: ", " That is all.")


def classify_with_confidence(files: DataFrame) -> DataFrame:
    """Rule labels with a confidence between 0.50 and 0.99."""
    confidence = F.lit(0.5) + (F.col("file_id") % 50) * F.lit(0.01)
    return classify_by_rules(files).withColumn("confidence", confidence)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored files as a stored table, as a user would keep it."""
    return stored(spark, sf_dir, "scored", lambda: score_files(
        project_files(spark, sf_dir), classify_with_confidence))


def after_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files after repairs: validated, separated, transactional."""
    files = project_files(spark, sf_dir)
    layer = F.col("layer")
    repaired = files.withColumns({
        "has_validation": F.lit(True),
        "violates_layer_separation": F.lit(False),
        "repository_deps": F.when(layer == "controller", 0.0).otherwise(F.col("repository_deps")),
        "has_transaction": F.when(layer == "service", True).otherwise(F.col("has_transaction")),
    })
    return score_files(repaired, classify_with_confidence)


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("project_id"), "c_nationkey", "c_acctbal"
    )


def wrapped(json: Column, form: Column) -> Column:
    """A reply in one of four shapes: plain, fenced, inside prose, broken."""
    return (
        F.when(form == 0, json)
        .when(form == 1, F.concat(F.lit(FENCED[0]), json, F.lit(FENCED[1])))
        .when(form == 2, F.concat(F.lit(PROSE[0]), json, F.lit(PROSE[1])))
        .otherwise(F.expr("'no answer {'"))
    )


def text_json(**fields: Column) -> Column:
    """A JSON object with the fields in the given order."""
    pieces: list[Column] = []
    for i, (name, value) in enumerate(fields.items()):
        pieces += [F.lit(("{" if i == 0 else ", ") + f'"{name}": '), value]
    return F.concat(*pieces, F.lit("}"))


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def _verdict_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to validation requests. Customers in debt never answer."""
    groups = part_groups(scored(spark, sf_dir)).filter("type <> 'clean'")
    rows = groups.join(grown(_customers(spark, sf_dir)), "project_id").filter("c_acctbal >= 0")
    kind = F.col("type")
    valid = (F.col("c_nationkey") + F.length(kind)) % 5 != 0
    json = text_json(
        is_valid=valid.cast("string"),
        reasoning=quoted(F.concat(F.lit("seen in "), F.col("n_files"), F.lit(" files"))),
        description=F.when(valid, quoted(F.concat(F.lit("found "), kind))).otherwise('""'),
        recommendation=F.when(F.length(kind) % 2 == 0, quoted(F.concat(F.lit("repair "), kind)))
        .otherwise('""'),
        before_code=F.when(F.length(kind) % 3 == 0, quoted(F.lit("old();"))).otherwise('""'),
        after_code=F.when(F.length(kind) % 3 != 1, quoted(F.lit("fresh();"))).otherwise('""'),
        severity=F.when(F.length(kind) % 4 == 0, quoted(F.lit("HIGH"))).otherwise('""'),
    )
    return rows.select(*PART_GROUP, wrapped(json, F.col("c_nationkey") % 4).alias("reply"))


def _clean_check_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers for files labelled clean: filled orders have a finding, large
    ones two."""
    files = classify_with_confidence(project_files(spark, sf_dir)).filter("type = 'clean'")
    controller = F.col("layer") == "controller"
    first = text_json(
        type=quoted(F.when(controller, "layer_skip_in_layered").otherwise("layer_skip")),
        severity=quoted(F.when(F.col("loc") > 250, "HIGH").otherwise("LOW")),
        description=quoted(F.concat(F.lit("missed in "), F.col("file_name"))),
        recommendation=quoted(F.lit("use a service")),
        before_code=quoted(F.lit("repo.find();")),
        after_code=quoted(F.lit("service.find();")),
    )
    second = F.lit(', {"type": "broad_catch", "description": "catches all"}')
    json = text_json(
        has_issues=(F.col("order_status") == "F").cast("string"),
        anti_patterns=F.concat(
            F.lit("["), first, F.when(F.col("loc") > 300, second).otherwise(""), F.lit("]")
        ),
    )
    return files.select(
        "project_id", "file_seq", wrapped(json, F.col("c_nationkey") % 4).alias("reply")
    )


def _assessment_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to assessment requests. Some files get no score, some a text,
    some a number outside 0..100; some projects get no overall score."""
    files = with_part(project_files(spark, sf_dir))
    key = F.concat(F.lit('"'), F.col("file_name"), F.lit('": '))
    score = F.when(F.col("file_id") % 11 == 0, F.lit('"n/a"')).otherwise(
        (F.col("file_id") * 37 % 121 - 10).cast("string")
    )
    entry = F.when(F.col("order_status") != "P", F.concat(key, score))
    per_part = files.groupBy("project_id", "part").agg(
        F.array_sort(F.collect_list(entry)).alias("entries"),
        F.min("c_nationkey").alias("c_nationkey"),
        F.min("c_acctbal").alias("c_acctbal"),
    )
    overall = F.when(F.col("c_nationkey") % 7 == 0, F.lit("")).otherwise(
        F.concat(F.lit('"overall_score": '), (F.col("c_nationkey") * 4).cast("string"), F.lit(", "))
    )
    json = F.concat(
        F.lit("{"), overall, F.lit('"reasoning": "looks fair", "file_scores": {'),
        F.array_join("entries", ", "),
        F.lit('}, "strengths": ["layers"], "improvements": ["tests", "names"]}'),
    )
    # Customers in debt never answer.
    return per_part.filter("c_acctbal >= 0").select(
        "project_id", "part", wrapped(json, F.col("c_nationkey") % 4).alias("reply")
    )


def _fix_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = violation_groups(scored(spark, sf_dir))
    rows = groups.join(grown(_customers(spark, sf_dir)), "project_id").filter("c_acctbal >= 0")
    return rows.select(
        "project_id", "type", F.concat(F.lit("Move it. Files: "), F.col("n_files")).alias("reply")
    )


def verdict_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "verdict_replies", lambda: _verdict_replies(spark, sf_dir))


def clean_check_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "clean_check_replies", lambda: _clean_check_replies(spark, sf_dir))


def assessment_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "assessment_replies", lambda: _assessment_replies(spark, sf_dir))


def fix_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "fix_replies", lambda: _fix_replies(spark, sf_dir))


def replies(spark: SparkSession, sf_dir: str) -> Replies:
    return Replies(
        verdict_replies(spark, sf_dir), clean_check_replies(spark, sf_dir),
        assessment_replies(spark, sf_dir), fix_replies(spark, sf_dir),
    )


def verdict_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_verdicts(
        part_groups(scored(spark, sf_dir)), verdict_replies(spark, sf_dir)
    )


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_status(scored(spark, sf_dir), verdict_groups(spark, sf_dir))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discoveries(
        clean_candidates(status(spark, sf_dir)), clean_check_replies(spark, sf_dir)
    )
