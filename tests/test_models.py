import duckdb
import pytest
from pyspark.sql import functions as F

from stratalens.functions.scores import rule_score
from stratalens.operators import compiled, models
from stratalens.operators.evaluate import quality_metrics
from stratalens.operators.rules import rule_label
from stratalens.plans.scored import score_files
from stratalens.queries import fixtures as fx
from stratalens.sources.staging import staged_path
from stratalens.sources.tables import project_files
from stratalens.streaming.scoring import file_stream, score_stream, write_scores


def test_fit_save_load_and_score(spark, sf_dir, tmp_path):
    files = project_files(spark, sf_dir).withColumns(
        {"expected": rule_label(), "label": rule_score()})
    train, test = models.hash_split(files, "file_id")
    assert train.count() + test.count() == files.count()
    classifier = models.fit_antipattern(train, trees=20, depth=8)
    regressor = models.fit_quality(train, trees=10)
    models.save_models(str(tmp_path / "m"), classifier, regressor)
    again = models.load_models(spark, str(tmp_path / "m"))

    labelled = models.predict_antipattern(test, again[0])
    hits = labelled.agg(F.avg((F.col("type") == F.col("expected")).cast("int"))).first()[0]
    assert hits > 0.7
    assert labelled.filter("confidence <= 0 or confidence > 1").count() == 0
    first = models.predict_antipattern(test, classifier).select("file_id", "type", "confidence")
    assert first.exceptAll(labelled.select("file_id", "type", "confidence")).count() == 0

    scored = models.predict_quality(test, again[1])
    metrics = quality_metrics(scored).first()
    assert metrics["r2"] > 0.8
    for name in ("rmse", "mae", "r2"):
        assert abs(metrics[name] - models.regression_error(scored, name)) < 1e-9

    # Both models plug into the scored table, unseen layers included.
    odd = test.withColumn("layer", F.lit("vault"))
    full = score_files(odd, lambda df: models.predict_antipattern(df, again[0]),
                       lambda df: models.predict_quality(df, again[1]))
    assert full.count() == test.count()
    assert full.filter("quality_score < 0 or quality_score > 100 or type is null").count() == 0


def test_stream_equals_batch_over_several_batches(spark, sf_dir):
    files = project_files(spark, sf_dir)
    path, out = staged_path(spark, "in"), staged_path(spark, "out")
    files.repartition(5).write.parquet(path)
    stream = score_stream(
        file_stream(spark, path, files.schema, max_files_per_trigger=2), fx.classify_with_confidence)
    query = write_scores(stream, out, staged_path(spark, "progress"))
    query.awaitTermination()
    assert len(query.recentProgress) >= 3
    got = spark.read.schema(stream.schema).parquet(out)
    want = score_files(files, fx.classify_with_confidence)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_compiled_models_give_the_same_in_another_engine(spark, sf_dir, tmp_path):
    files_ = project_files(spark, sf_dir).withColumns({"expected": rule_label(), "label": rule_score()})
    path = str(tmp_path / "models")
    models.save_models(path, models.fit_antipattern(files_, trees=5, depth=5), models.fit_quality(files_, trees=5, depth=4))
    classifier, regressor = models.load_models(spark, path)
    odd = files_.withColumn("layer", F.when(F.col("file_id") % 3 == 0, "unheard of").otherwise(F.col("layer")))
    told = models.predict_quality(models.predict_antipattern(odd, classifier), regressor)
    expected = {r.file_id: (r.type, r.confidence, r.quality_score) for r in told.collect()}
    sql = compiled.classifier_sql(spark, f"{path}/antipattern"), compiled.regressor_sql(spark, f"{path}/quality")
    rows = compiled.compiled_quality(compiled.compiled_antipattern(odd, sql[0]), sql[1]).collect()
    assert {r.file_id: (r.type, pytest.approx(r.confidence), r.quality_score) for r in rows} == expected
    # the same text, but for lists, in another engine
    for name, made in (("c", models.classifier_inputs(odd)), ("r", models.regressor_inputs(odd))):
        made.select("file_id", *[c for c in made.columns if c.startswith(models.INPUT)]).write.parquet(str(tmp_path / name))
    votes = compiled.classifier_sql(spark, f"{path}/antipattern", compiled.DUCKDB)
    theirs = duckdb.sql(f"""
        SELECT file_id, {compiled.DUCKDB.best.format('v', 'v')} AS best, raw
        FROM (SELECT file_id, {votes} AS v FROM '{tmp_path}/c/*.parquet')
        JOIN (SELECT file_id, {sql[1]} AS raw FROM '{tmp_path}/r/*.parquet') USING (file_id)""").fetchall()
    assert len(theirs) == len(expected)
    for file_id, best, raw in theirs:
        assert models.LABELS[best - 1] == expected[file_id][0]
        assert min(max(raw, 0.0), 100.0) == pytest.approx(expected[file_id][2], abs=0.0501)


def test_training_rows_are_dealt_to_bounded_tasks(spark, sf_dir, monkeypatch):
    sizes = lambda df: [r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()]
    few = spark.range(0, 1000, 1, 4).withColumn("x", F.col("id") * 2.0)
    assert models.training_rows(few) is few
    dealt = models.training_rows(few, 90)
    assert max(sizes(dealt)) <= 90 and sum(sizes(dealt)) == 1000
    assert few.exceptAll(dealt).count() == 0 and models.training_rows(few.limit(0), 90).count() == 0
    # a fit trains on such rows, on all of them, and on its inputs alone
    files = project_files(spark, sf_dir).withColumns({"expected": rule_label(), "label": rule_score()})
    seen = []

    class Watched:
        def __init__(self, stages):
            pass

        def fit(self, rows):
            seen.append(rows)

    monkeypatch.setattr(models, "Pipeline", Watched)
    monkeypatch.setattr(models, "TRAINING_ROWS", 100)
    models.fit_antipattern(files)
    models.fit_quality(files)
    assert [max(sizes(rows)) <= 100 and rows.count() for rows in seen] == [files.count()] * 2
    assert all(c.startswith(models.INPUT) or c in ("label", "label_index") for rows in seen for c in rows.columns)
