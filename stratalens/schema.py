"""Column groups and record schemas shared by every operator.

One row is one source file of one project. ``project_id`` names the project
and ``file_seq`` is the file's position inside it (0, 1, 2, ...); the pair
identifies a file. ``file_name`` and ``file_path`` are for display.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Field names of the input records.
SIZE_COLS = ["loc", "methods", "classes", "avg_cc", "imports", "annotations"]
DEPENDENCY_COLS = [
    "controller_deps", "service_deps", "repository_deps", "entity_deps",
    "adapter_deps", "port_deps", "usecase_deps", "gateway_deps",
    "total_cross_layer_deps",
]
SIGNAL_COLS = [
    "has_business_logic", "has_data_access", "has_http_handling",
    "has_validation", "has_transaction", "violates_layer_separation",
]
OPTIONAL_SIGNAL_COLS = ["uses_new_keyword", "has_broad_catch"]

NUMERIC_COLS = ["architecture_confidence", *SIZE_COLS, *DEPENDENCY_COLS]
REQUIRED_COLS = ["architecture_pattern", *NUMERIC_COLS, *SIGNAL_COLS]
KEY = ["project_id", "file_seq"]

# Defaults of the quality-score input; every other numeric
# field defaults to 0 and every signal to false.
QUALITY_DEFAULTS = {"layer": "controller", "avg_cc": 1.0}

CLEAN = "clean"


def file_schema(with_source: bool = True) -> T.StructType:
    """Typed schema of one file record."""
    fields = [
        T.StructField("project_id", T.LongType(), False),
        T.StructField("file_seq", T.LongType(), False),
        T.StructField("file_name", T.StringType(), False),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("layer", T.StringType(), True),
        T.StructField("architecture_pattern", T.StringType(), False),
    ]
    fields += [T.StructField(c, T.DoubleType(), False) for c in NUMERIC_COLS]
    fields += [T.StructField(c, T.BooleanType(), False) for c in SIGNAL_COLS]
    fields += [T.StructField(c, T.BooleanType(), True) for c in OPTIONAL_SIGNAL_COLS]
    if with_source:
        fields.append(T.StructField("source_code", T.StringType(), True))
    return T.StructType(fields)


def raw_file_type() -> T.StructType:
    """Untyped file record of a JSON payload: every field read as text, so
    that bad values reach validation instead of failing the read."""
    names = ["file_name", "file_path", "layer", *REQUIRED_COLS,
             *OPTIONAL_SIGNAL_COLS, "source_code"]
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


def payload_schema() -> T.StructType:
    """A project payload ``{"files": [...]}``. ``project_id`` tells projects
    apart; ``first_seq`` lets one very large project be sent in pieces."""
    return T.StructType([
        T.StructField("project_id", T.LongType(), True),
        T.StructField("first_seq", T.LongType(), True),
        T.StructField("files", T.ArrayType(raw_file_type()), True),
    ])


VERDICT_REPLY = T.StructType([
    T.StructField("reasoning", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("recommendation", T.StringType()),
    T.StructField("before_code", T.StringType()),
    T.StructField("after_code", T.StringType()),
    T.StructField("severity", T.StringType()),
])

FINDING = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("recommendation", T.StringType()),
    T.StructField("before_code", T.StringType()),
    T.StructField("after_code", T.StringType()),
])

CLEAN_CHECK_REPLY = T.StructType([
    T.StructField("anti_patterns", T.ArrayType(FINDING)),
])

ASSESSMENT_REPLY = T.StructType([
    T.StructField("overall_score", T.StringType()),
    T.StructField("reasoning", T.StringType()),
    T.StructField("file_scores", T.MapType(T.StringType(), T.StringType())),
    T.StructField("strengths", T.ArrayType(T.StringType())),
    T.StructField("improvements", T.ArrayType(T.StringType())),
])
