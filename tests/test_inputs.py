"""Replies, payloads and runs that do not look as expected."""

import json

import pytest
from helpers import files, record
from pyspark.sql import functions as F

from stratalens.functions.issues import derive_issues
from stratalens.functions.replies import with_object
from stratalens.functions.text import title_name
from stratalens.operators import evaluate, hybrid, models, requests, review
from stratalens.plans.fix_requests import fix_input, suggest_fixes
from stratalens.plans.scored import score_files
from stratalens.schema import NUMERIC_COLS, SIGNAL_COLS, payload_schema
from stratalens.sources.catalog import catalog
from stratalens.sources.projects import read_projects, validate_files, with_origin
from stratalens.streaming.payloads import payload_stream, store_batch, stored_tables, write_payload_scores


def test_objects_inside_lists_are_not_read(spark):
    shapes = {
        '{"is_valid": false}': '{"is_valid": false}', '[{"is_valid": false}]': None,
        'So: {"is_valid": false} done': '{"is_valid": false}', '"{}"': None, "I cannot": None, "": None,
        '```json\n[{"is_valid": false}]\n```': None, '[1] {"a": 1}': '{"a": 1}', "{}": None,
    }
    df = spark.createDataFrame([(s,) for s in shapes], "reply string")
    assert {r.reply: r.obj for r in with_object(df).collect()} == shapes


def test_unreadable_replies_never_displace_readable_ones(spark):
    rows = [(1, "a", 0, "I cannot"), (1, "a", 0, '{"is_valid": false}'), (1, "b", 0, "no"), (1, "a", 1, None),
            (1, "c", 0, '{"is_valid": true, "description": "x"}'), (1, "c", 0, '{"is_valid": false}')]
    got = review.read_verdicts(spark.createDataFrame(rows, "project_id long, type string, part long, reply string")).collect()
    assert {(r.type, r.part): r.is_valid for r in got} == {("a", 0): False, ("c", 0): False}


def test_repeated_file_scores_count_once_and_last(spark):
    reply = '{"overall_score": 5, "file_scores": {"A.java": 10, "B.java": 20, "A.java": 30}}'
    read = hybrid.read_assessments(spark.createDataFrame([(1, 0, reply), (1, 0, "sorry")], "project_id long, part long, reply string"))
    got = {r.file_name: r.reply_score for r in hybrid.reply_scores(read).collect()}
    assert got == {"A.java": 30.0, "B.java": 20.0}


def test_assessments_of_all_parts_count(spark):
    def reply(score, word):
        return json.dumps({"overall_score": score, "reasoning": word, "strengths": [word], "improvements": []})

    rows = [(1, 0, reply(10, "a")), (1, 1, reply(40, "b")), (1, 2, reply("n/a", "c")), (2, 0, reply(33, "d"))]
    read = hybrid.read_assessments(spark.createDataFrame(rows, "project_id long, part long, reply string"))
    sizes = spark.createDataFrame([(1, 0, 1000), (1, 1, 500), (1, 2, 10), (2, 0, 3)], "project_id long, part long, n_files long")
    got = {r.project_id: (r.overall_score, r.reasoning, r.strengths) for r in hybrid.project_assessments(read, sizes).collect()}
    assert got == {1: (20.0, "a\nb\nc", ["a", "b", "c"]), 2: (33.0, "d", ["d"])}


def test_payloads_without_a_number_stay_apart(spark, tmp_path):
    lines = [{"files": [{"file_name": "A.java"}]}, {"project_id": "text", "files": [{"file_name": "B.java"}]},
             {"files": [{"file_name": "A.java"}]}, {"project_id": 7, "files": [{"file_name": "C.java"}]}]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, lines)))
    rows = read_projects(spark, str(tmp_path / "p.json")).select("project_id", "file_name").collect()
    assert len({r.project_id for r in rows}) == 4 and 7 in {r.project_id for r in rows}


def test_numbers_must_be_finite_and_may_be_huge(spark):
    given = [record(file_seq=i) for i in range(4)]
    df = files(spark, *given).withColumn("loc", F.col("loc").cast("string"))
    odd = F.create_map(*[F.lit(x) for pair in {0: "NaN", 1: "Infinity", 2: "1e30", 3: "12"}.items() for x in pair])
    good, bad = validate_files(df.withColumn("loc", odd[F.col("file_seq").cast("int")]))
    assert {r.file_seq: r.reasons for r in bad.select("file_seq", "reasons").collect()} == {
        0: ["loc not finite"], 1: ["loc not finite"]}
    texts = {r.file_seq: r.issues for r in derive_issues(good).collect()}
    assert texts[2] == ["Large file (1000000000000000000000000000000 LOC)"] and texts[3] == []


def test_title_case_after_every_non_letter(spark):
    keys = ["god-class", "no_validation", "x2y", "élan_vital", "", "A__b"]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", title_name(F.col("k")).alias("t"))
    assert {r.k: r.t for r in df.collect()} == {k: k.replace("_", " ").title() for k in keys}


def test_catalogue_needs_no_python_rows(spark):
    assert catalog(spark).count() == 15
    assert "ExistingRDD" not in catalog(spark)._jdf.queryExecution().executedPlan().toString()


def test_runs_are_compared_by_path(spark):
    before = score_files(files(spark, record(file_seq=0, file_path="a", has_broad_catch=True), record(file_seq=1, file_path="b")))
    after = score_files(files(spark, record(file_seq=0, file_path="new"), record(file_seq=1, file_path="a", has_broad_catch=True)))
    got = {(r.file_name, r.transition) for r in evaluate.file_transitions(before, after).collect()}
    assert got == {("F0.java", "changed"), ("F1.java", "removed"), ("F0.java", "added")}


def test_fix_requests_with_defaults_and_sources(spark):
    schema = ("project_id long, architecture_pattern string, file_sources map<string,string>, anti_patterns "
              "array<struct<type:string,files:array<string>,affected_layer:string,severity:string,description:string>>")
    given = [(1, None, {"A.java": "class A", "Z.java": "class Z", "E.java": ""},
              [("clean", ["Q.java"], None, None, None), ("no_validation", [f"{c}.java" for c in "ABCDEFG"], None, None, None),
               ("", [], None, None, None), ("own_kind", None, "service", "LOW", "told")]),
             (2, "mvc", None, [("broad_catch", ["A.java"], "service", "HIGH", None)]), (3, "mvc", None, [])]
    report = suggest_fixes(fix_input(spark.createDataFrame(given, schema)))
    rows = {(r.project_id, r.anti_pattern): (r.position, r.layer, r.severity, r.n_files) for r in report.fixes.collect()}
    assert rows == {(1, "no_validation"): (2, "unknown", "MEDIUM", 7), (1, "own_kind"): (4, "service", "LOW", 0),
                    (2, "broad_catch"): (1, "service", "HIGH", 1)}
    prompts = {(r.project_id, r.type): r for r in report.prompts.collect()}
    asked = prompts[1, "no_validation"]
    assert asked.n_sources == 1 and "class A" in asked.prompt and "Z.java" not in asked.prompt and "and 2 more" in asked.prompt
    assert prompts[2, "broad_catch"].n_sources == 0 and (1, "own_kind") in prompts
    assert {r.project_id: r.total_fixes for r in report.totals.collect()} == {1: 2, 2: 1, 3: 0}


REQUESTS = ("project_id long, architecture_pattern string, file_sources map<string,string>, anti_patterns "
            "array<struct<type:string,files:array<string>,affected_layer:string,severity:string,description:string>>")


def test_repeated_types_repeated_projects_and_no_project(spark):
    one = ("broad_catch", ["A.java"], "service", "HIGH", "first")
    two = ("broad_catch", ["B.java", "C.java"], "controller", "LOW", "second")
    given = [(1, "mvc", {"A.java": "class A"}, [one, two]), (1, "layered", {"A.java": "other A"}, [one]),
             (None, "mvc", {"B.java": "class B"}, [two]), (None, "mvc", None, None)]
    requests = fix_input(spark.createDataFrame(given, REQUESTS))
    ids = {(r.project_id, r.architecture_pattern, r.total_fixes): r.request_id for r in requests.requests.collect()}
    first, own, empty = ids[1, "mvc", 2], ids[None, "mvc", 1], ids[None, "mvc", 0]
    told = spark.createDataFrame([(first, 2, "only this one")], "request_id long, position long, reply string")
    report = suggest_fixes(requests, told)
    fixes = {(r.request_id, r.position): r for r in report.fixes.collect()}
    assert len(fixes) == 4 and fixes[first, 2].n_files == 2 and fixes[first, 1].problem == "first"
    assert [k for k, r in fixes.items() if r.ai_powered] == [(first, 2)]
    prompts = {(r.request_id, r.position): r.prompt for r in report.prompts.collect()}
    assert set(prompts) == set(fixes)
    assert "class A" in prompts[first, 1] and "other A" not in prompts[first, 1] and "C.java" in prompts[first, 2]
    assert "class B" in prompts[own, 1] and empty not in {k for k, _ in prompts}


def test_payload_names_do_not_depend_on_the_split(spark, tmp_path):
    body = {"files": [{"file_name": "A.java", "loc": "1"}]}
    lines = [json.dumps({**body, "padding": "x" * (i % 50)}) for i in range(400)]
    lines += [json.dumps({"files": []})] * 5 + [json.dumps({"project_id": 7, **body})]
    for part in range(3):
        (tmp_path / f"p{part}.json").write_text("\n".join(lines))
    seen = []
    try:
        for cores, size in ((2, "128m"), (4, "10k"), (64, "2k")):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(cores))
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            ids = [r.project_id for r in read_projects(spark, str(tmp_path)).select("project_id").collect()]
            assert len(ids) == 3 * 406 and len(set(ids)) == 3 * 405 + 1
            seen.append(sorted(ids))
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] == seen[2]


def test_payload_stream_equals_the_batch(spark, tmp_path):
    good = {c: 1 for c in NUMERIC_COLS} | {c: True for c in SIGNAL_COLS} | {"architecture_pattern": "mvc", "file_path": "p"}
    said = lambda **more: json.dumps({"files": [{**good, "file_name": "A.java", **more}, {"file_name": "B.java"}]})
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for i in range(3):
        lines = [said(), said(), said(loc=-1), json.dumps({"project_id": i, "files": [{**good, "file_name": "C.java"}]}), "{}", "no json"]
        (source / f"{i}.json").write_text("\n".join(lines))
        write_payload_scores(payload_stream(spark, str(source), 1), out, str(tmp_path / "progress")).awaitTermination()
    scored, rejected = stored_tables(spark, out)
    valid, bad = validate_files(read_projects(spark, str(source)))
    rows = lambda df, *c: sorted(map(tuple, df.select("project_id", "file_seq", *c).collect()))
    expected = rows(score_files(valid), "type", "quality_score"), rows(bad, "reasons")
    assert len(expected[0]) == 9 and len(expected[1]) > 9
    assert (rows(scored, "type", "quality_score"), rows(rejected, "reasons")) == expected
    # a batch that is repeated after a failure leaves its rows once
    again = with_origin(spark.read.schema(payload_schema()).json(str(source / "1.json")))
    number = scored.select("batch", "project_id").filter("project_id = 1").first()["batch"]
    store_batch(again, number, out)
    scored, rejected = stored_tables(spark, out)
    assert (rows(scored, "type", "quality_score"), rows(rejected, "reasons")) == expected


def test_cross_validated_figures_reach_the_metadata(spark, tmp_path):
    rows = [(i, i % 3, float(i % 3 * 10 + i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, g long, label double")
    figures = evaluate.cross_validated(df, lambda t: models.fit_group_means(t, ["g"]), evaluate.fold_of(F.col("k"), 5), 5)
    held, train = [], []
    for fold in range(5):
        means = {g: [y for k, h, y in rows if h == g and k % 5 != fold] for g in range(3)}
        wrong = lambda inside: [(sum(means[g]) / len(means[g]) - y) ** 2 for k, g, y in rows if (k % 5 == fold) == inside]
        held.append((sum(wrong(True)) / len(wrong(True))) ** 0.5)
        train.append((sum(wrong(False)) / len(wrong(False))) ** 0.5)
    mean = sum(held) / 5
    expected = (mean, (sum((h - mean) ** 2 for h in held) / 5) ** 0.5, mean - sum(train) / 5)
    assert tuple(figures.first())[:3] == pytest.approx(expected)
    models.write_metadata(spark, str(tmp_path / "meta"), ["b", "a"], figures)
    assert models.feature_columns(spark, str(tmp_path / "meta")) == ["b", "a"]
    stored = spark.read.json(str(tmp_path / "meta")).select("performance.*").first()
    assert [stored[c] for c in evaluate.CV_FIGURES] == pytest.approx(expected)
    assert models.feature_columns(spark, str(tmp_path / "none")) == models.QUALITY_FEATURES


def test_requests_are_bounded_in_bytes(spark):
    sizes = [10, 900, 30, 5000, 400, 400, 400, 1, 2000]
    texts = spark.createDataFrame([(1, "t", 0, i, "é" * n) for i, n in enumerate(sizes)],
                                  "project_id long, type string, part long, file_seq long, section string")
    rows = requests.sliced(texts, ["project_id", "type", "part"], 2000).orderBy("file_seq").collect()
    assert [r.file_seq for r in rows] == list(range(len(sizes)))
    slices = {}
    for r in rows:
        slices.setdefault(r.slice, []).append(len(r.section.encode()))
    assert all(sum(s) <= 2000 for s in slices.values()) and len(slices) > 3
    assert rows[3].section.endswith(requests.SECTION_CUT) and rows[1].section.endswith(requests.SECTION_CUT)
    assert [rows[i].section for i in (0, 2, 4, 7)] == ["é" * sizes[i] for i in (0, 2, 4, 7)]


def test_verdicts_of_slices_meet_in_their_part(spark):
    said = lambda ok, why: json.dumps({"is_valid": ok, "reasoning": why})
    rows = [(1, "a", 0, 0, said(False, "none here")), (1, "a", 0, 2, said(True, "late")), (1, "a", 0, 1, said(True, "first")),
            (1, "b", 0, 1, said(False, "no")), (1, "b", 0, 0, "unreadable"), (1, "b", 0, 2, said(False, "nor here")),
            (1, "c", 0, 0, "unreadable")]
    replies = spark.createDataFrame(rows, "project_id long, type string, part long, slice long, reply string")
    got = {r.type: (r.is_valid, r.reasoning) for r in review.read_verdicts(replies).collect()}
    assert got == {"a": (True, "first"), "b": (False, "no")}
