"""Model inputs derived from file metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stratalens.functions.layers import flag, number, resolved_layer, stated_layer
from stratalens.schema import (
    DEPENDENCY_COLS, OPTIONAL_SIGNAL_COLS, QUALITY_DEFAULTS, SIGNAL_COLS, SIZE_COLS,
)

# Order of the classifier's input columns.
ANTIPATTERN_FEATURES = [
    "layer", "architecture_pattern", "architecture_confidence",
    *SIZE_COLS, *DEPENDENCY_COLS,
    "has_business_logic", "has_data_access", "has_http_handling",
    "has_validation", "has_transaction",
    "uses_new_keyword", "has_broad_catch",
    "violates_layer_separation", "layer_arch",
]
CATEGORICAL_FEATURES = ["layer", "architecture_pattern", "layer_arch"]

# Upper limits of the regressor's size columns and the layers
# that get an indicator column.
SIZE_LIMITS = {"loc": 1500.0, "methods": 50.0, "imports": 80.0, "annotations": 60.0}
INDICATOR_LAYERS = ["adapter", "controller", "entity", "port", "repository", "service"]
REGRESSOR_DEPS = [
    "controller_deps", "service_deps", "repository_deps", "adapter_deps",
    "port_deps", "total_cross_layer_deps",
]
QUALITY_FEATURES = [
    *SIZE_COLS, *REGRESSOR_DEPS, *SIGNAL_COLS,
    "import_ratio", "annotation_density", "method_density", "dep_per_loc",
    "violation_score",
    "controller_has_repo_dep", "service_missing_tx", "entity_too_complex",
    "controller_biz_logic",
    *[f"layer_{name}" for name in INDICATOR_LAYERS],
]


def antipattern_feature_columns() -> list[Column]:
    layer = resolved_layer()
    arch = F.coalesce(F.col("architecture_pattern"), F.lit("layered"))
    special = {
        "layer": layer,
        "architecture_pattern": arch,
        "layer_arch": F.concat_ws("_", layer, arch),
        "architecture_confidence": number("architecture_confidence", 0.8),
    }
    special.update({c: F.log1p(number(c)) for c in DEPENDENCY_COLS})
    special.update({c: flag(c) for c in [*SIGNAL_COLS, *OPTIONAL_SIGNAL_COLS]})
    return [special.get(c, number(c)).alias(c) for c in ANTIPATTERN_FEATURES]


def antipattern_features(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Classifier inputs: log-scaled dependency counts, resolved layer and the
    layer-by-architecture interaction."""
    return df.select(*(keep or []), *antipattern_feature_columns())


def violation_score() -> Column:
    return (
        3 * flag("violates_layer_separation").cast("int")
        + 2 * flag("has_business_logic").cast("int")
        + (1 - flag("has_validation").cast("int"))
        + F.lit(0.5) * F.least(number("total_cross_layer_deps"), F.lit(5.0))
    ).cast("double")


def quality_feature_columns() -> dict[str, Column]:
    size = {}
    for name in SIZE_COLS:
        value = number(name, QUALITY_DEFAULTS.get(name, 0.0))
        limit = SIZE_LIMITS.get(name)
        size[name] = value if limit is None else F.least(value, F.lit(limit))
    lines = size["loc"] + F.lit(1.0)
    layer = F.coalesce(stated_layer(), F.lit(QUALITY_DEFAULTS["layer"]))
    is_controller = layer == "controller"
    columns = dict(size)
    columns.update({c: number(c) for c in REGRESSOR_DEPS})
    columns.update({c: flag(c) for c in SIGNAL_COLS})
    columns["import_ratio"] = size["imports"] / lines
    columns["annotation_density"] = size["annotations"] / lines
    columns["method_density"] = size["methods"] / lines
    columns["dep_per_loc"] = number("total_cross_layer_deps") / lines
    columns["violation_score"] = violation_score()
    columns["controller_has_repo_dep"] = is_controller & (number("repository_deps") > 0)
    columns["service_missing_tx"] = (
        (layer == "service") & flag("has_data_access") & ~flag("has_transaction")
    )
    columns["entity_too_complex"] = (layer == "entity") & (size["methods"] > 5)
    columns["controller_biz_logic"] = is_controller & flag("has_business_logic")
    columns.update({f"layer_{name}": layer == name for name in INDICATOR_LAYERS})
    return {name: col.cast("double") for name, col in columns.items()}


def quality_features(
    df: DataFrame, keep: list[str] | None = None, columns: list[str] | None = None,
) -> DataFrame:
    """Regressor inputs in the order of ``columns`` (the model's own list);
    a listed column this engine does not derive is 0."""
    derived = quality_feature_columns()
    wanted = columns or QUALITY_FEATURES
    return df.select(
        *(keep or []),
        *[derived.get(c, F.lit(0.0)).alias(c) for c in wanted],
    )
