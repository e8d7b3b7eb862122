import json

import pytest
from helpers import files, record
from pyspark.sql import functions as F

from stratalens.operators import violations as v
from stratalens.operators.evaluate import accuracy
from stratalens.operators.fixes import fix_suggestions, with_files
from stratalens.operators.models import feature_columns
from stratalens.operators.parts import spread, with_file_seq
from stratalens.plans.quality import analyze_quality
from stratalens.plans.scored import score_files
from stratalens.schema import OPTIONAL_SIGNAL_COLS, REQUIRED_COLS
from stratalens.sources import projects as src
from stratalens.sources.catalog import ENTRIES, TEXTS, catalog, severity_rank
from stratalens.sources.report import write_report


def payload(*records: dict, **extra) -> dict:
    keep = ["file_name", "file_path", "layer", *REQUIRED_COLS, *OPTIONAL_SIGNAL_COLS, "source_code"]
    return {**extra, "files": [{k: r[k] for k in keep if k in r} for r in records]}


def written(tmp_path, *payloads: dict) -> str:
    path = tmp_path / "payloads.json"
    path.write_text("\n".join(json.dumps(p) for p in payloads))
    return str(path)


def test_payloads_keep_file_order(spark, tmp_path):
    path = written(
        tmp_path,
        payload(record(file_name="B"), record(file_name="A", source_code="x\ny"), project_id=7),
        payload(record(file_name="C"), project_id=7, first_seq=2),
    )
    valid, rejected = src.validate_files(src.read_projects(spark, path))
    rows = valid.orderBy("file_seq").select("file_seq", "file_name", "loc", "source_code").collect()
    assert [tuple(r) for r in rows] == [(0, "B", 1.0, None), (1, "A", 1.0, "x\ny"), (2, "C", 1.0, None)]
    assert rejected.count() == 0
    assert score_files(src.split_sources(valid)[0]).count() == 3


def test_bad_records_are_rejected_with_reasons(spark, tmp_path):
    missing = record(file_name="m")
    missing.pop("loc")
    path = written(
        tmp_path,
        payload(
            missing,
            {**record(file_name="n"), "avg_cc": "much"},
            {**record(file_name="g"), "imports": -1},
            {**record(file_name="b"), "has_validation": "maybe"},
            {**record(file_name="ok"), "loc": "12.5", "has_validation": "Yes"},
            project_id=1,
        ),
        payload(project_id=2),
    )
    valid, rejected = src.validate_files(src.read_projects(spark, path))
    ok = valid.collect()
    assert [(r["file_name"], r["loc"], r["has_validation"]) for r in ok] == [("ok", 12.5, True)]
    reasons = {(r["project_id"], r["file_name"]): r["reasons"] for r in rejected.collect()}
    assert reasons == {
        (1, "m"): ["loc missing"], (1, "n"): ["avg_cc not a number"],
        (1, "g"): ["imports negative"], (1, "b"): ["has_validation not a truth value"],
        (2, None): [src.NO_FILES],
    }


def test_optional_fields_take_defaults(spark, tmp_path):
    bare = {k: val for k, val in record(file_name="x").items()
            if k not in ("layer", "source_code", *OPTIONAL_SIGNAL_COLS)}
    valid, _ = src.validate_files(
        src.read_projects(spark, written(tmp_path, payload(bare, project_id=1))))
    row = valid.first()
    assert (row["layer"], row["uses_new_keyword"], row["has_broad_catch"]) == ("unknown", False, False)
    empty = spark.createDataFrame([(1,)], "project_id long")
    quality = src.with_defaults(empty, "quality").first()
    assert (quality["layer"], quality["avg_cc"], quality["loc"], quality["has_validation"]) == (
        "controller", 1.0, 0.0, False)


def test_sources(spark):
    df = files(spark, record(file_seq=0, source_code="a"), record(file_seq=1, source_code=""),
               record(file_seq=2))
    narrow, texts = src.split_sources(df)
    assert "source_code" not in narrow.columns
    flags = [r[0] for r in narrow.orderBy("file_seq").select("has_source").collect()]
    assert flags == [True, False, False]
    assert [r["source_code"] for r in texts.collect()] == ["a"]
    maps = spark.createDataFrame([(1, {"A": "x", "B": ""})], "project_id long, file_sources map<string,string>")
    assert [tuple(r) for r in src.sources_from_maps(maps).collect()] == [(1, "A", "x")]


def test_catalog(spark):
    rows = catalog(spark).collect()
    assert len(rows) == 15 and {r["type"] for r in rows} == set(TEXTS)
    assert [e[0] for e in ENTRIES][-1] == "clean"
    df = spark.createDataFrame([(x,) for x in ("LOW", "odd", "CRITICAL")], "s string")
    assert [r[0] for r in df.select(severity_rank(F.col("s"))).collect()] == [3, 5, 0]


def test_fix_rows(spark):
    details = spark.createDataFrame(
        [(1, 1, "broad_catch", "LOW", "", 2, ""), (1, 2, "odd_one", "HIGH", "port", 1, "p"),
         (1, 3, "clean", "NONE", "", 1, ""), (1, 4, "", "NONE", "", 1, "")],
        "project_id long, position long, type string, severity string, affected_layer string, "
        "n_files long, description string")
    replies = spark.createDataFrame([(1, "odd_one", "do it"), (1, "broad_catch", "")],
                                    "project_id long, type string, reply string")
    rows = {r["anti_pattern"]: r for r in fix_suggestions(details, replies).collect()}
    assert set(rows) == {"broad_catch", "odd_one"}
    known, odd = rows["broad_catch"], rows["odd_one"]
    assert (known["layer"], known["impact_points"], known["ai_powered"]) == ("Any", -6, False)
    assert known["problem"] == TEXTS["broad_catch"][1]
    assert (odd["layer"], odd["impact_points"], odd["problem"]) == ("port", 0, "p")
    assert odd["recommendation"] == TEXTS["clean"][2]
    assert (odd["ai_fix"], odd["ai_powered"]) == ("do it", True)
    lists = spark.createDataFrame([(1, "odd_one", 0, ["F"])],
                                  "project_id long, type string, part long, files array<string>")
    assert with_files(fix_suggestions(details), lists).first()["files"] == ["F"]


def test_model_metadata(spark, tmp_path):
    path = tmp_path / "meta.json"
    path.write_text(json.dumps({"feature_names": ["loc", "other"], "n": 2}, indent=1))
    assert feature_columns(spark, str(path)) == ["loc", "other"]
    assert len(feature_columns(spark, str(tmp_path / "none.json"))) == 33


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_reports_are_written_table_by_table(spark, tmp_path, fmt):
    scored = score_files(files(spark, record(), record(file_seq=1, layer="entity")))
    report = analyze_quality(scored)
    write_report(report, str(tmp_path / "r"), fmt)
    for name, df in report._asdict().items():
        assert spark.read.format(fmt).load(str(tmp_path / "r" / name)).count() == df.count()


def test_positions_are_dense_for_any_bucket_width(spark):
    ids = [(p, i) for p in (1, 2) for i in (3, 900, 17, 40, 41, 2000, 5)]
    df = spark.createDataFrame(ids, "project_id long, id long")
    for width in (1, 10, 1 << 20):
        rows = with_file_seq(df, "id", width).collect()
        got = {p: [r["id"] for r in sorted(rows, key=lambda r: r["file_seq"]) if r["project_id"] == p]
               for p in (1, 2)}
        assert got == {p: sorted(i for q, i in ids if q == p) for p in (1, 2)}
        assert sorted(r["file_seq"] for r in rows if r["project_id"] == 1) == list(range(7))


def test_spread_covers_every_part(spark):
    df = spark.createDataFrame([(1, 0), (2, 999), (3, 1000), (4, 4_097_000)], "project_id long, last long")
    counts = spread(df, "last").groupBy("project_id").agg(
        F.count("part").alias("n"), F.max("part").alias("m"), F.count_distinct("part").alias("d"))
    assert {r["project_id"]: (r["n"], r["m"], r["d"]) for r in counts.collect()} == {
        1: (1, 0, 1), 2: (1, 0, 1), 3: (2, 1, 2), 4: (4098, 4097, 4098)}


def test_fix_request_defaults(spark):
    asked = spark.createDataFrame([(1, 1, "broad_catch", 1)],
                                  "project_id long, position long, type string, n_files long")
    row = fix_suggestions(src.with_defaults(asked, "fix")).first()
    assert (row["layer"], row["severity"], row["problem"]) == (
        "unknown", "MEDIUM", TEXTS["broad_catch"][1])


def test_empty_input(spark):
    none = score_files(files(spark, record()).filter("false"))
    wanted = spark.createDataFrame([(4,)], "project_id long")
    assert [tuple(r) for r in v.antipattern_summary(none, wanted).collect()] == [
        (4, "unknown", 0, 0, "✅ No violations in 0 files")]
    cases = spark.createDataFrame([], "expected string, predicted string")
    assert accuracy(cases, "expected").count() == 0
    assert v.violation_details(none).count() == 0
    assert analyze_quality(none).projects.count() == 0
