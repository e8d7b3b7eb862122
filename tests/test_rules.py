"""One case for each rule and its near misses, and the repair scenarios."""

from helpers import files, record

from stratalens.operators.evaluate import compare_runs, file_transitions
from stratalens.operators.rules import classify_by_rules
from stratalens.plans.scored import score_files

CASES = [
    (dict(uses_new_keyword=True, has_broad_catch=True), "tight_coupling_new_keyword"),
    (dict(has_broad_catch=True, layer="controller", repository_deps=2), "broad_catch"),
    (dict(layer="controller", repository_deps=1), "layer_skip_in_layered"),
    (dict(layer="controller", repository_deps=1, architecture_pattern="mvc"), "layer_skip_in_layered"),
    (dict(layer="controller", repository_deps=1, architecture_pattern="hexagonal"), "clean"),
    (dict(controller_deps=3), "reversed_dependency_in_layered"),
    (dict(controller_deps=3, architecture_pattern="hexagonal"), "clean"),
    (dict(layer="controller", entity_deps=1, architecture_pattern="clean_architecture"),
     "outer_depends_on_inner_clean"),
    (dict(layer="controller", entity_deps=1), "clean"),
    (dict(layer="adapter", architecture_pattern="hexagonal"), "adapter_without_port_hexagonal"),
    (dict(layer="adapter", port_deps=1, architecture_pattern="hexagonal"), "clean"),
    (dict(repository_deps=1, has_data_access=True, architecture_pattern="hexagonal"),
     "missing_port_adapter_in_hexagonal"),
    (dict(layer="usecase", repository_deps=1, architecture_pattern="clean_architecture"),
     "missing_gateway_interface_clean"),
    (dict(repository_deps=1, gateway_deps=1, architecture_pattern="clean_architecture"), "clean"),
    (dict(annotations=12, architecture_pattern="hexagonal"),
     "framework_dependency_in_domain_hexagonal"),
    (dict(annotations=11, architecture_pattern="hexagonal"), "clean"),
    (dict(layer="usecase", annotations=12, architecture_pattern="clean_architecture"),
     "usecase_framework_coupling_clean"),
    (dict(layer="entity", annotations=12, architecture_pattern="clean_architecture"),
     "entity_framework_coupling_clean"),
    (dict(layer="controller", has_business_logic=True), "business_logic_in_controller_layered"),
    (dict(has_data_access=True), "missing_transaction_in_layered"),
    (dict(has_data_access=True, has_transaction=True), "clean"),
    (dict(layer="controller", has_http_handling=True), "no_validation"),
    (dict(layer="controller", has_http_handling=True, has_validation=True), "clean"),
    (dict(layer="unknown", has_http_handling=True), "no_validation"),
]


def test_each_rule(spark):
    df = files(spark, *[record(file_seq=i, **given) for i, (given, _) in enumerate(CASES)])
    got = classify_by_rules(df).orderBy("file_seq").select("type", "confidence").collect()
    assert [r["type"] for r in got] == [want for _, want in CASES]
    assert {r["confidence"] for r in got} == {1.0}


SCENARIOS = {
    "layered": (
        [dict(layer="controller", repository_deps=2, has_business_logic=True,
              has_http_handling=True, violates_layer_separation=True, total_cross_layer_deps=3),
         dict(has_data_access=True, repository_deps=2, total_cross_layer_deps=3),
         dict(has_data_access=True, has_transaction=True)],
        [dict(layer="controller", service_deps=1, has_http_handling=True, has_validation=True,
              total_cross_layer_deps=1),
         dict(has_data_access=True, has_transaction=True, repository_deps=2, total_cross_layer_deps=3),
         dict(has_data_access=True, has_transaction=True)],
        ["fixed", "fixed", "clean"],
    ),
    "clean_architecture": (
        [dict(layer="controller", entity_deps=1, violates_layer_separation=True),
         dict(layer="usecase", repository_deps=1), dict(layer="entity")],
        [dict(layer="controller", usecase_deps=1, has_validation=True),
         dict(layer="usecase", repository_deps=1, gateway_deps=1), dict(layer="entity", annotations=12)],
        ["fixed", "fixed", "regression"],
    ),
    "mvc": (
        [dict(layer="controller", repository_deps=1, has_http_handling=True),
         dict(controller_deps=1), dict(layer="entity")],
        [dict(layer="controller", has_http_handling=True),
         dict(), dict(layer="entity")],
        ["changed", "fixed", "clean"],
    ),
}


def test_repair_scenarios(spark):
    for pid, (arch, (before, after, want)) in enumerate(SCENARIOS.items()):
        runs = [
            score_files(files(spark, *[
                record(project_id=pid, file_seq=i, architecture_pattern=arch, **given)
                for i, given in enumerate(run)]))
            for run in (before, after)
        ]
        rows = file_transitions(*runs).orderBy("file_seq").collect()
        assert [r["transition"] for r in rows] == want
        delta = compare_runs(*runs).first()
        removed = sum(w == "fixed" for w in want) - sum(w == "regression" for w in want)
        assert delta["violations_removed"] == removed
        assert (delta["outcome"] == "improved") == (delta["score_delta"] > 0 and removed > 0)
