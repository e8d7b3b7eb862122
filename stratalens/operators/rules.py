"""Deterministic rule classifier: labels for fitting, and a stand-in where no
fitted model is at hand. The first rule that holds gives the label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stratalens.functions.layers import flag, number, resolved_layer
from stratalens.schema import CLEAN

# Fixed value: annotations from which a core class counts as framework-bound.
ANNOTATION_LIMIT = 12


def _first_of(rules: list[tuple[Column, Column | str]], otherwise: str = CLEAN) -> Column:
    chain = None
    for condition, label in rules:
        value = F.lit(label) if isinstance(label, str) else label
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain.otherwise(F.lit(otherwise))


def rule_label(layer: Column | None = None) -> Column:
    """Label of a file. Rules are grouped by layer, which keeps their order
    within a layer and mentions the layer expression only once per layer."""
    layer = resolved_layer() if layer is None else layer
    arch = F.col("architecture_pattern")
    layered = arch.isin("layered", "mvc")
    hexagonal = arch == "hexagonal"
    clean_arch = arch == "clean_architecture"
    uses_repository = number("repository_deps") > 0
    data = flag("has_data_access")
    annotated = number("annotations") >= ANNOTATION_LIMIT
    no_gateway = uses_repository & (number("gateway_deps") == 0)
    controller = _first_of([
        (layered & uses_repository, "layer_skip_in_layered"),
        (clean_arch & (number("repository_deps") + number("entity_deps") > 0),
         "outer_depends_on_inner_clean"),
        (layered & flag("has_business_logic"), "business_logic_in_controller_layered"),
        (flag("has_http_handling") & ~flag("has_validation"), "no_validation"),
    ])
    service = _first_of([
        (layered & (number("controller_deps") > 0), "reversed_dependency_in_layered"),
        (hexagonal & uses_repository & data, "missing_port_adapter_in_hexagonal"),
        (clean_arch & no_gateway, "missing_gateway_interface_clean"),
        (hexagonal & annotated, "framework_dependency_in_domain_hexagonal"),
        (clean_arch & annotated, "usecase_framework_coupling_clean"),
        (layered & data & ~flag("has_transaction"), "missing_transaction_in_layered"),
    ])
    usecase = _first_of([
        (clean_arch & no_gateway, "missing_gateway_interface_clean"),
        (clean_arch & annotated, "usecase_framework_coupling_clean"),
    ])
    return _first_of([
        (flag("uses_new_keyword"), "tight_coupling_new_keyword"),
        (flag("has_broad_catch"), "broad_catch"),
        (layer == "controller", controller),
        (layer == "service", service),
        (layer == "usecase", usecase),
        ((layer == "adapter") & hexagonal & (number("port_deps") == 0),
         "adapter_without_port_hexagonal"),
        ((layer == "entity") & clean_arch & annotated, "entity_framework_coupling_clean"),
    ])


def classify_by_rules(df: DataFrame) -> DataFrame:
    """Add ``type`` and ``confidence``; a rule is always certain."""
    placed = df.withColumn("_layer", resolved_layer())  # found once, asked for by many rules
    return placed.withColumns({"type": rule_label(F.col("_layer")), "confidence": F.lit(1.0)}).drop("_layer")
