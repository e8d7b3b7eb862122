"""Reading reviewer replies, which are JSON wrapped in more or less prose.

A reply counts as read when it holds one non-empty JSON object. Everything
else gives null, and the caller falls back to the model's own result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from stratalens.functions.layers import WHITESPACE
from stratalens.schema import ASSESSMENT_REPLY

FENCE = "```"


def _trim(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def without_outer_fence(text: Column) -> Column:
    """Drop a fence line that opens the reply and the fence that closes it."""
    body = _trim(text)
    opened = F.regexp_replace(body, "\\A" + FENCE + "[^\\n]*\\n?", "")
    unfenced = F.regexp_replace(opened, FENCE + "\\s*\\z", "")
    return F.when(F.startswith(body, F.lit(FENCE)), unfenced).otherwise(body)


def without_fence_lines(text: Column) -> Column:
    """Drop every line that starts with a fence."""
    lines = F.split(_trim(text), "\n", -1)
    kept = F.filter(lines, lambda line: ~F.startswith(_trim(line), F.lit(FENCE)))
    return F.array_join(kept, "\n")


def _is_object(text: Column) -> Column:
    """True for exactly one non-empty JSON object. JSON functions stop at the
    end of the first value, so text after it is caught by reading the reply
    as the only element of an array."""
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    return F.coalesce(alone & (F.size(F.json_object_keys(text)) > 0), F.lit(False))


def with_object(df: DataFrame, clean: Callable[[Column], Column] = without_outer_fence) -> DataFrame:
    """Add ``obj``, the JSON object in ``reply``: the cleaned text itself; where
    that is no JSON at all, the span from its first to its last brace; else
    null. An object inside a list is not read.

    Generating the single value keeps later filters above this step. Pushed
    below it, each mention of ``obj`` would read the reply text again.
    """
    text = F.col("_text")
    # Only looked at where the whole text is no JSON.
    span = F.regexp_extract(text, "(?s)\\{.*\\}", 0)
    is_json = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    other_json = F.coalesce(is_json, F.lit(False)) & F.try_parse_json(text).isNotNull()
    obj = F.when(_is_object(text), text).when(~other_json & _is_object(span), span)
    return (
        df.withColumn("_text", clean(F.col("reply")))
        .select(*df.columns, F.explode_outer(F.array(obj)).alias("obj"))
    )


def with_assessment(df: DataFrame) -> DataFrame:
    """Add ``assessment``, the fields of a project assessment; one without
    ``overall_score`` counts as unread."""
    read = with_object(df, without_fence_lines)
    has_overall = F.array_contains(F.json_object_keys("obj"), "overall_score")
    return read.withColumn(
        "assessment", F.when(has_overall, F.from_json("obj", ASSESSMENT_REPLY))
    ).drop("obj")


def parse_reply(obj: Column, schema: T.StructType) -> Column:
    """Fields of a reply object; null where unread."""
    return F.when(obj.isNotNull(), F.from_json(obj, schema))


def truthy(obj: Column, field: str, absent: bool) -> Column:
    """Truth of a JSON field of any type: null, false, 0 and empty values are
    false, anything else is true, a missing field is ``absent``."""
    value = F.try_variant_get(F.try_parse_json(obj), f"$.{field}", "variant")
    kind = F.schema_of_variant(value)
    text = F.get_json_object(obj, f"$.{field}")
    return (
        F.when(kind.isNull(), F.lit(absent))
        .when(kind == "VOID", F.lit(False))
        .when(kind == "BOOLEAN", text == "true")
        .when(kind == "STRING", text != "")
        .when(F.startswith(kind, F.lit("ARRAY")), F.json_array_length(text) > 0)
        .when(F.startswith(kind, F.lit("OBJECT")), F.size(F.json_object_keys(text)) > 0)
        .otherwise(text.try_cast("double") != 0)
    )
