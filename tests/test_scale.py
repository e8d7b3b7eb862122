"""What must not move or be stored, whatever the size of the tables."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.operators import parts, requests, review
from stratalens.operators import violations as v
from stratalens.plans import full
from stratalens.plans.fix_requests import REQUEST, fix_input, suggest_fixes
from stratalens.queries import fixtures as fx, spark_queries
from stratalens.queries.spark_queries import QUERIES
from stratalens.schema import NUMERIC_COLS, OPTIONAL_SIGNAL_COLS, REQUIRED_COLS, SIGNAL_COLS
from stratalens.sources import projects, tables
from stratalens.sources.staging import CLEANUP, staged
from stratalens.sources.tables import source_lookup, source_texts


def unaided_plan(spark, make) -> str:
    """Plan without broadcasts."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return make()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.mark.parametrize("name", ["fix_requests", "validation_requests", "validation_slices", "clean_check_requests"])
def test_texts_do_not_move_to_meet_their_file(spark, sf_dir, name):
    lines = unaided_plan(spark, lambda: QUERIES[name](spark, sf_dir)).split("\n")
    met = [lines[i + 1] for i, line in enumerate(lines) if re.search(r"Exchange hashpartitioning\(project_id#\d+L, file_seq#\d+L,", line)]
    assert met and not [x for x in met if re.search(r"\b(text|source_code|section|_shown)#", x.rpartition("output=")[2] or x)]


def test_lines_move_once_and_files_without_names(spark, sf_dir, monkeypatch):
    assert unaided_plan(spark, lambda: tables._line_counts(spark, sf_dir)).count("Exchange hashpartitioning") == 1
    made = {}
    monkeypatch.setattr(tables, "stored", lambda spark, sf_dir, name, make: made.setdefault(name, make()))
    lines = unaided_plan(spark, lambda: tables.project_files(spark, sf_dir)).split("\n")
    moved = [lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert moved and not [x for x in moved if re.search(r"\b(file_name|file_path|avg_cc)#", x)]


def test_a_file_has_a_row_for_each_row_of_its_document(spark, tmp_path):
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write("customer", [(1, "MACHINERY", 3, 5.0), (2, None, 4, -5.0)], "c_custkey long, c_mktsegment string, c_nationkey int, c_acctbal double")
    write("orders", [(10, 1, "F", "1-URGENT"), (11, 1, "O", "4-NOT SPECIFIED"), (13, 2, "P", None), (None, 2, "F", "5-LOW"), (14, 2, "F", "5-LOW")],
          "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")
    write("lineitem", [(k, s, n, 2.0, 0.1, 0.0, "A", "F") for k, s, n in
                       [(10, 7, 1), (10, 7, 2), (10, 8, 3), (10, None, 4), (11, 7, 1), (13, 7, 1), (None, 7, 1)]],
          "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string")
    write("documents", [(0, 5), (0, 6), (1, 4), (3, 0), (4, None)], "doc_id long, n_chars long")
    rows = tables.project_files(spark, str(tmp_path)).collect()
    got = sorted((r.project_id, r.file_id, r.file_seq, r.doc_id, r.has_source, r.avg_cc, r.loc) for r in rows)
    assert got == [(1, 10, 0, 0, True, 1.5, 16.0)] * 2 + [(1, 11, 1, 1, False, 1.25, 4.0), (2, 13, 0, 3, False, 1.25, 4.0)]


def test_texts_of_all_files_are_not_stored(spark, sf_dir):
    read = unaided_plan(spark, lambda: source_texts(spark, sf_dir))
    assert "documents.parquet" in read and "source_code:string" not in read


def test_looked_up_texts_are_those_of_the_table(spark, sf_dir):
    scored = fx.scored(spark, sf_dir)
    members = v.violations_only(scored).withColumn("origin", F.lit(0))
    made = [requests.fix_requests(v.violation_details(scored), members, given, v.antipattern_summary(scored))
            for given in (source_texts(spark, sf_dir), source_lookup(spark, sf_dir))]
    assert made[0].exceptAll(made[1]).count() == made[1].exceptAll(made[0]).count() == 0
    assert made[1].filter("n_sources > 0").count() and made[1].filter("n_sources < n_shown").count()
    asked = review.clean_candidates(fx.status(spark, sf_dir))
    checks = [requests.clean_check_requests(asked, given) for given in (source_texts(spark, sf_dir), source_lookup(spark, sf_dir))]
    assert checks[0].exceptAll(checks[1]).count() == checks[1].exceptAll(checks[0]).count() == 0


def test_fix_requests_keep_and_move_shown_texts_only(spark):
    names = [f"{c}.java" for c in "ABCDEFG"]
    given = [(1, "mvc", {n: f"class {n}" for n in names},
              [("no_validation", names, "service", "LOW", "told"), ("broad_catch", [None, "F.java", "Q.java"], "service", "LOW", "told"),
               ("clean", ["G.java"], None, None, None)]),
             (None, None, None, [("broad_catch", ["A.java"], None, None, None), ("broad_catch", [], None, None, None)])]
    made = fix_input(spark.createDataFrame(given, REQUEST))
    stored = made.requests.inputFiles()[0].rpartition("/")[0]
    kept = spark.read.parquet(stored).select(F.explode("texts.key").alias("k"))
    assert {r.k for r in kept.collect()} == {"A.java", "B.java", "C.java", "D.java", "E.java", "F.java"} | {"G.java"}
    prompts = {(r.project_id, r.position): r for r in suggest_fixes(made).prompts.collect()}
    assert {k: (r.n_files, r.n_shown, r.n_sources) for k, r in prompts.items()} == {
        (1, 1): (7, 5, 5), (1, 2): (3, 3, 1), (None, 1): (1, 1, 0), (None, 2): (0, 0, 0)}
    assert "class E.java" in prompts[1, 1].prompt and "class F.java" not in prompts[1, 1].prompt
    assert "=== F.java ===\nclass F.java" in prompts[1, 2].prompt and "Files:\nProblem:" in prompts[None, 2].prompt
    plan = unaided_plan(spark, lambda: suggest_fixes(made).prompts)
    assert not re.search(r"Exchange hashpartitioning\(request_id#\d+L, file_name", plan)


def shuffle_files(spark) -> set:
    kept = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {kept.apply(i).name() for i in range(kept.size()) if kept.apply(i).name().startswith("shuffle_")}


def test_shuffle_files_go_with_the_write(spark):
    before = shuffle_files(spark)
    summed = spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).agg(F.collect_list("id").alias("ids"))
    kept = staged(summed, "sums")
    deadline = time.time() + 20
    while shuffle_files(spark) - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and spark.conf.get(CLEANUP, None) is None
    assert kept.select(F.explode("ids")).count() == summed.select(F.explode("ids")).count() == 1000


def test_every_row_is_in_one_pass(spark, monkeypatch):
    rows = spark.range(1000).select(F.when(F.col("id") % 9 > 0, F.col("id")).alias("project_id"), (F.col("id") % 3).alias("part"))
    assert rows.filter(parts.passes(parts.PASS_FILES, *parts.PLACE)[0]).count() == 1000
    monkeypatch.setattr(parts, "PASS_FILES", 300)
    dealt = [rows.filter(mine).count() for mine in parts.passes(1000, *parts.PLACE)]
    assert len(dealt) == 4 and sum(dealt) == 1000 and min(dealt) > 100


@pytest.mark.parametrize("name", ["fix_request_rows", "fix_request_prompts"])
def test_fix_requests_are_written_in_passes(spark, sf_dir, monkeypatch, name):
    whole = QUERIES[name](spark, sf_dir)
    paths, read, written = set(), spark_queries.read_fix_requests, []

    def counted(spark, path):
        paths.add(path)
        written.append(spark.read.text(path).count())
        return read(spark, path)

    monkeypatch.setattr(spark_queries, "read_fix_requests", counted)
    monkeypatch.setattr(parts, "PASS_FILES", 200)
    passed = QUERIES[name](spark, sf_dir)
    assert len(written) > 2 and min(written) > 0
    # the files of a pass take the place of those of the one before, and no request is lost
    assert len(paths) == 1 and spark.read.text(paths.pop()).count() == written[-1] < sum(written)
    assert whole.exceptAll(passed).count() == passed.exceptAll(whole).count() == 0 < whole.count()


def test_prompts_are_made_in_the_row_of_their_request(spark):
    given = [(1, "mvc", {"A.java": "class A"}, [("broad_catch", ["A.java"], "service", "LOW", "told")])]
    made = fix_input(spark.createDataFrame(given, REQUEST))
    assert "hashpartitioning" not in unaided_plan(spark, lambda: suggest_fixes(made).prompts)


def test_nested_reports_are_stored_packed_and_files_without_their_review(spark, sf_dir, monkeypatch):
    paths, columns, named, keep = [], {}, spark_queries.staged_path, full.staged
    monkeypatch.setattr(spark_queries, "staged_path", lambda spark, name: paths.append(named(spark, name)) or paths[-1])
    monkeypatch.setattr(full, "staged", lambda df, name: columns.setdefault(name, df.columns) and keep(df, name))
    rows = spark_queries.nested_report(spark, sf_dir).count()
    written = {r.path for r in spark.read.format("binaryFile").load(paths[-1]).select("path").collect()}
    assert rows and written and all(x.endswith(".json.gz") for x in written)
    assert {"file_path", "issues", "in_clean_list"} < set(columns["files"])
    assert not {"findings", "reasoning", "severity", "resolved_layer"} & set(columns["files"])


def test_nested_reports_are_written_in_passes(spark, sf_dir, monkeypatch):
    whole = spark_queries.nested_report(spark, sf_dir)
    made, nest = [], spark_queries.nested_reports
    monkeypatch.setattr(spark_queries, "nested_reports", lambda *a: made.append(nest(*a)) or made[-1])
    monkeypatch.setattr(parts, "PASS_FILES", 150)
    passed = spark_queries.nested_report(spark, sf_dir)
    assert len(made) > 1 and whole.exceptAll(passed).count() == passed.exceptAll(whole).count() == 0 < whole.count()
    sizes = [m.count() for m in made]
    assert min(sizes) > 0 and sum(sizes) == whole.count()


def test_validation_requests_are_made_in_passes(spark, sf_dir, monkeypatch):
    whole, kept, keep = spark_queries.validation_requests(spark, sf_dir), [], requests.staged
    monkeypatch.setattr(requests, "staged", lambda df, name: kept.append(name) or keep(df, name))
    monkeypatch.setattr(parts, "PASS_FILES", 150)
    passed = spark_queries.validation_requests(spark, sf_dir)
    assert kept[0] == "asked" and kept.count("requests") > 1
    assert whole.exceptAll(passed).count() == passed.exceptAll(whole).count() == 0 < whole.count()


@pytest.mark.parametrize("name", ["assessment_requests", "verdicts_applied", "false_positives", "hybrid_scores", "clean_files"])
def test_only_the_catalogue_is_broadcast(spark, sf_dir, name):
    """However small a table looks, one with rows per project, group or file never passes the driver."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" in plan and set(re.findall(r"BroadcastHashJoin \[(.*?)#", plan)) <= {"type"}


def test_every_labelled_row_counts_in_the_ranking(spark):
    from stratalens.llm import ranking

    names = ["a", "b"]
    rows = [(1, 0.2 + 0.6 * (i % 97) / 97, (i % 7) / 7) for i in range(9000)] + [(0, 0.5 * (i % 89) / 89, (i % 5) / 5) for i in range(3000)]
    known = spark.createDataFrame(rows, "_label int, a double, b double").repartition(7)
    seen = ranking.binned_sums(known, names, np.array([1.0, -1.0]))
    assert [n.sum() for n, _, _ in seen] == [9000, 3000]
    model = ranking.fit_all(known, names)
    assert model == ranking.fit_all(known.repartition(3), names) and model.weights[0] > abs(model.weights[1])
    u = np.sort([a * model.weights[0] + b * model.weights[1] for _, a, b in rows])
    assert abs(model.cut - (u[2999] + u[3000]) / 2) < 1e-9
    near = ranking.fit(np.array([r[1:] for r in rows[:900]]), np.array([r[1:] for r in rows[9000:9400]]), 0.25)
    assert np.allclose(near.weights, model.weights, atol=0.5)


def test_payloads_are_derived_once_for_all_arrivals(spark, sf_dir, monkeypatch):
    seen, made = spark.sparkContext.accumulator(0), spark_queries._raw_records

    def counted(spark, sf_dir):
        def count(batches):
            for batch in batches:
                seen.add(len(batch))
                yield batch

        records = made(spark, sf_dir)
        return records.mapInPandas(count, records.schema)

    monkeypatch.setattr(spark_queries, "_raw_records", counted)
    rows = spark_queries.payload_stream_scores(spark, sf_dir).count()
    assert rows == seen.value == made(spark, sf_dir).count()


def test_fields_are_read_from_their_text_once_for_both_tables(spark):
    words = [" True", "YES\t", "0", "maybe", None, "true", "false", "TRUE", "f", ""]
    given = [(1, i, "F", "p", "x" if i == 8 else "3.5", word) for i, word in enumerate(words)]
    names = [c for c in (*REQUIRED_COLS, *OPTIONAL_SIGNAL_COLS, "source_code") if c not in ("loc", "has_validation")]
    rows = spark.createDataFrame(given, "project_id long, file_seq long, file_name string, file_path string, loc string, has_validation string")
    rows = rows.withColumns({c: F.lit("1") if c in [*NUMERIC_COLS, *SIGNAL_COLS, *OPTIONAL_SIGNAL_COLS] else F.lit("service") for c in names})
    valid, rejected = projects.validate_files(rows)
    assert rejected.columns == [*rows.columns, "reasons"]
    assert {r.file_seq: (r.has_validation, r.loc) for r in valid.collect()} == {
        0: (True, 3.5), 1: (True, 3.5), 2: (False, 3.5), 5: (True, 3.5), 6: (False, 3.5), 7: (True, 3.5)}
    assert {r.file_seq: r.reasons for r in rejected.collect()} == {
        3: ["has_validation not a truth value"], 4: ["has_validation missing"], 8: ["loc not a number"], 9: ["has_validation not a truth value"]}
    checked = projects.checked_files(rows).persist()
    try:
        for df in projects.sorted_out(checked):  # what follows the stored rows reads no text again
            above = df._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
            assert "InMemoryRelation" in df._jdf.queryExecution().optimizedPlan().toString() and "cast(" not in above and "trim(" not in above
    finally:
        checked.unpersist()
