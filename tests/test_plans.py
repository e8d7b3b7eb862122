"""Plans that must hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from stratalens.operators import requests, rollups, violations as v
from stratalens.queries import fixtures as fx
from stratalens.queries.spark_queries import QUERIES
from stratalens.sources.report import nested_reports

LAZY = [
    "resolved_layers", "antipattern_inputs", "quality_inputs", "file_issues", "file_scores",
    "rule_labels", "violations_by_type", "violation_groups", "violation_files",
    "violation_details", "antipattern_summary", "layer_rollup", "project_rollup", "worst_files",
    "violation_summary", "verdicts_applied", "clean_candidates", "discoveries_merged",
    "validation_requests", "clean_check_requests", "fix_requests", "fixes_static",
    "accuracy_by_class", "run_delta", "transitions",
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins_and_no_python(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "SinglePartition"):
        assert bad not in text or (name == "accuracy_by_class" and bad == "SinglePartition")


def test_rollups_hash_files_and_read_few_columns(spark, sf_dir):
    text = plan(rollups.layer_rollup(rollups.layer_sums(fx.scored(spark, sf_dir))))
    assert "SortAggregate" not in text
    read = text[text.index("ReadSchema"):]
    assert "quality_score" in read and "file_path" not in read and "issues:array" not in read


def test_fix_requests_limit_rows_before_the_shuffle(spark, sf_dir):
    members = v.violations_only(fx.scored(spark, sf_dir)).withColumn("origin", F.lit(0))
    text = plan(requests.first_members(members))
    assert "row_number(), 5, Partial" in text


@pytest.mark.parametrize("name", ["validation_requests", "assessment_requests", "nested_report", "discoveries_merged", "clean_files"])
def test_no_text_or_file_list_is_gathered_by_project_alone(spark, sf_dir, name, monkeypatch):
    """Without broadcasts, what is placed by project only holds project figures,
    never source text, prompts, file lists or rows per part."""
    from stratalens.queries import spark_queries

    plans = []
    monkeypatch.setattr(spark_queries, "nested_reports", lambda *a: plans.append(nested_reports(*a)) or plans[-1])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES[name](spark, sf_dir) if name != "nested_report" else
                    (QUERIES[name](spark, sf_dir), plans[-1])[1])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if re.search(r"Exchange hashpartitioning\(project_id#\d+L, \d+\)", line):
            below = lines[i + 1].rpartition("output=")[2]
            assert not re.search(r"\b(_sources|source_code|section|_files|files|prompt|part)#", below), (line, below)
