"""Rule-based issues of one file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stratalens.functions.layers import flag, number, stated_layer

# Issue texts, in report order. {n} is the metric cut to a whole number.
ISSUE_TEXTS = {
    "layer_separation": "Layer separation violation",
    "controller_logic": "Business logic in controller",
    "controller_validation": "Missing input validation",
    "controller_repository": "Direct repository access (layer skip)",
    "service_transaction": "Missing @Transactional",
    "service_controller": "Reverse dependency on Controller",
    "entity_size": "Entity too complex (>5 methods)",
    "entity_logic": "Business logic in entity",
    "cross_layer_deps": "High cross-layer deps ({n})",
    "imports": "High import count ({n})",
    "lines": "Large file ({n} LOC)",
}


def _conditions() -> dict[str, Column]:
    layer = F.coalesce(stated_layer(), F.lit(""))
    controller, service, entity = (layer == x for x in ("controller", "service", "entity"))
    return {
        "layer_separation": flag("violates_layer_separation"),
        "controller_logic": controller & flag("has_business_logic"),
        "controller_validation":
            controller & flag("has_http_handling") & ~flag("has_validation"),
        "controller_repository": controller & (number("repository_deps") > 0),
        "service_transaction":
            service & flag("has_data_access") & ~flag("has_transaction"),
        "service_controller": service & (number("controller_deps") > 0),
        "entity_size": entity & (number("methods") > 5),
        "entity_logic": entity & flag("has_business_logic"),
        "cross_layer_deps": number("total_cross_layer_deps") > 5,
        "imports": number("imports") > 30,
        "lines": number("loc") > 300,
    }


_MEASURED = {"cross_layer_deps": "total_cross_layer_deps", "imports": "imports", "lines": "loc"}


def _text(name: str) -> Column:
    text = ISSUE_TEXTS[name]
    if name not in _MEASURED:
        return F.lit(text)
    before, after = text.split("{n}")
    value = F.col(_MEASURED[name])
    # beyond 2**53 every double is whole, and BIGINT may not hold it
    whole = F.when(F.abs(value) < float(1 << 53), value.cast("bigint").cast("string")).otherwise(
        F.format_string("%.0f", value))
    return F.concat(F.lit(before), whole, F.lit(after))


def issues() -> Column:
    return F.array_compact(
        F.array(*[F.when(cond, _text(name)) for name, cond in _conditions().items()])
    )


def issue_count() -> Column:
    """Number of issues without building their texts, for rollups."""
    total = None
    for cond in _conditions().values():
        total = cond.cast("int") if total is None else total + cond.cast("int")
    return total


def derive_issues(df: DataFrame) -> DataFrame:
    return df.withColumn("issues", issues())
