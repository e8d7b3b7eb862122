import json
import random

import pytest
from helpers import files, record
from pyspark.sql import functions as F

from stratalens.functions import features, issues, numeric, scores
from stratalens.functions.layers import report_layer, resolve_layer
from stratalens.functions.replies import truthy, with_assessment, with_object
from stratalens.functions.text import truncate_lines


def column(spark, values, kind, expr):
    """Values of ``expr`` over a one-column table, in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_rounding_equals_python(spark):
    rng = random.Random(3)
    xs = [rng.random() * 100 for _ in range(500)]
    xs += [k / 10 + 0.05 for k in range(500)] + [k / 100 + 0.005 for k in range(0, 9000, 11)]
    for digits in (1, 2):
        got = column(spark, xs, "double", numeric.round_exact(F.col("x"), digits))
        assert got == [round(x, digits) for x in xs]
    halves = [62.5, 63.5, 0.5, 99.5, 61.49]
    assert column(spark, halves, "double", numeric.whole_text(F.col("x"))) == [
        f"{x:.0f}" for x in halves]


def test_bands_and_display(spark):
    xs = [100.0, 90.0, 89.9, 75.0, 74.9, 60.0, 59.9, 40.0, 39.9, 0.0]
    assert column(spark, xs, "double", scores.score_label(F.col("x"))) == [
        "Excellent", "Excellent", "Good", "Good", "Fair", "Fair", "Poor", "Poor",
        "Critical", "Critical"]
    assert column(spark, [62.5], "double", scores.score_display(F.col("x"))) == ["🟠 Fair (62/100)"]
    raw = [-3.0, 130.0, 45.25, 45.35]
    assert column(spark, raw, "double", scores.clip_score(F.col("x"))) == [
        0.0, 100.0, 45.2, round(45.35, 1)]


def test_layer_resolution(spark):
    rows = [
        (record(layer=" Controller\n"), "controller"),
        (record(layer="none", has_http_handling=True), "controller"),
        (record(layer="", repository_deps=1, has_data_access=True), "service"),
        (record(layer=None, has_data_access=True), "repository"),
        (record(layer="UNKNOWN"), "service"),
        (record(layer="gateway", has_http_handling=True), "gateway"),
    ]
    df = files(spark, *[{**r, "file_seq": i} for i, (r, _) in enumerate(rows)])
    got = resolve_layer(df).orderBy("file_seq").select("resolved_layer").collect()
    assert [r[0] for r in got] == [want for _, want in rows]
    assert column(spark, ["", None, "Service"], "string", report_layer(F.col("x"))) == [
        "unknown", "unknown", "Service"]


def test_issue_texts(spark):
    df = files(
        spark,
        record(file_seq=0, layer="Controller", violates_layer_separation=True,
               has_business_logic=True, has_http_handling=True, repository_deps=1,
               total_cross_layer_deps=6.9, imports=31, loc=300.5),
        record(file_seq=1, layer="service", has_data_access=True, controller_deps=1),
        record(file_seq=2, layer="entity", methods=6, has_business_logic=True),
        record(file_seq=3, layer="controller", has_http_handling=True, has_validation=True,
               total_cross_layer_deps=5, imports=30, loc=300),
    )
    got = issues.derive_issues(df).withColumn("n", issues.issue_count()).orderBy("file_seq")
    rows = got.select("issues", "n").collect()
    assert rows[0]["issues"] == [
        "Layer separation violation", "Business logic in controller", "Missing input validation",
        "Direct repository access (layer skip)", "High cross-layer deps (6)",
        "High import count (31)", "Large file (300 LOC)"]
    assert rows[1]["issues"] == ["Missing @Transactional", "Reverse dependency on Controller"]
    assert rows[2]["issues"] == ["Entity too complex (>5 methods)", "Business logic in entity"]
    assert rows[3]["issues"] == []
    assert [r["n"] for r in rows] == [len(r["issues"]) for r in rows]


def test_quality_features_by_hand(spark):
    df = files(spark, record(
        layer="Controller", loc=1999, methods=60, imports=100, annotations=70,
        repository_deps=2, total_cross_layer_deps=8, has_business_logic=True,
        violates_layer_separation=True))
    row = features.quality_features(df).first().asDict()
    assert len(row) == 33
    assert (row["loc"], row["methods"], row["imports"], row["annotations"]) == (1500, 50, 80, 60)
    assert row["import_ratio"] == 80 / 1501 and row["dep_per_loc"] == 8 / 1501
    assert row["violation_score"] == 3 + 2 + 1 + 2.5
    assert row["controller_has_repo_dep"] == row["controller_biz_logic"] == 1
    assert row["layer_controller"] == 1 and row["layer_service"] == 0
    usecase = features.quality_features(files(spark, record(layer="usecase"))).first().asDict()
    assert not any(v for k, v in usecase.items() if k.startswith("layer_"))


@pytest.mark.parametrize("text", [
    "", "a", "a\n", "a\nb\nc", "a\nb\nc\n", "a\r\nb\rc\x0bd\x0ce", "\n\n\n\n", "a b\u0085c\x1cd",
    "a\r\n\r\nb\n\rc",
])
def test_truncation_equals_splitlines(spark, text):
    lines = text.splitlines()
    want = text if len(lines) <= 2 else (
        "\n".join(lines[:2]) + f"\n// ... ({len(lines) - 2} more lines truncated)")
    assert column(spark, [text], "string", truncate_lines(F.col("x"), 2)) == [want]


REPLIES = {
    '{"a": 1}': {"a": 1},
    '  {"a": 1}\n': {"a": 1},
    '```json\n{"a": 1}\n```': {"a": 1},
    '```\n{"a": 1}\n```  \n': {"a": 1},
    '```json\n{"a": 1}': {"a": 1},
    'Well: {"a": {"b": "}"}} so.': {"a": {"b": "}"}},
    '{"a": 1} and {': {"a": 1},
    '{"a": 1} and }': None,
    '{"a": 1} and more': {"a": 1},
    '{}': None, '[1]': None, '7': None, 'no': None, '': None, '```': None, '{"a": ': None,
}


def test_reply_objects(spark):
    df = spark.createDataFrame(list(enumerate(REPLIES)), "i int, reply string")
    got = with_object(df).orderBy("i").select("obj").collect()
    assert [r[0] and json.loads(r[0]) for r in got] == list(REPLIES.values())


def test_truth_of_any_json_value(spark):
    cases = ['true', 'false', 'null', '0', '0.0', '2', '""', '"false"', '[]', '[0]', '{}', '{"x": 0}']
    texts = [f'{{"is_valid": {c}, "z": 1}}' for c in cases] + ['{"z": 1}']
    want = [bool(json.loads(t).get("is_valid", True)) for t in texts]
    assert column(spark, texts, "string", truthy(F.col("x"), "is_valid", absent=True)) == want


def test_assessments(spark):
    texts = [
        '{"overall_score": 80, "file_scores": {"A": 1, "B": "n/a", "C": null}}',
        'Sure.\n```json\n{"overall_score": "70"}\n```\nBye.',
        '{"file_scores": {"A": 1}}',
        '```json\n{"overall_score": 5,\n```\n"reasoning": "r"}',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, reply string")
    rows = [r["assessment"] for r in with_assessment(df).orderBy("i").collect()]
    assert rows[0]["overall_score"] == "80"
    assert rows[0]["file_scores"] == {"A": "1", "B": "n/a", "C": None}
    assert rows[1]["overall_score"] == "70" and rows[2] is None
    assert rows[3]["reasoning"] == "r"
