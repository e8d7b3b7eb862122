"""Accuracy of predictions and comparison of two runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from stratalens.functions.numeric import round_exact
from stratalens.operators.rollups import layer_sums, project_rollup
from stratalens.schema import CLEAN

# Fixed value: cases with this name prefix form their own bucket.
EDGE_PREFIX = "E-"
EDGE = "edge"


def case_bucket() -> Column:
    """Architecture of a labelled case, edge cases apart."""
    return F.when(F.startswith("name", F.lit(EDGE_PREFIX)), EDGE).otherwise(
        F.col("architecture_pattern")
    )


def accuracy(cases: DataFrame, by: str | None = None) -> DataFrame:
    """Share of cases whose prediction equals the expected label: per value
    of ``by`` and, under the name ``(all)``, over everything. The total is
    summed from the group rows."""
    hit = F.coalesce(F.col("predicted") == F.col("expected"), F.lit(False))
    key = F.lit("(all)") if by is None else F.col(by)
    groups = cases.groupBy(key.alias("bucket")).agg(
        F.count_if(hit).alias("passed"), F.count(F.lit(1)).alias("total")
    )
    rows = groups
    if by is not None:
        rows = groups.rollup("bucket").agg(
            F.sum("passed").alias("passed"), F.sum("total").alias("total"),
            F.grouping("bucket").alias("_all"),
        ).withColumn("bucket", F.when(F.col("_all") == 1, "(all)").otherwise(F.col("bucket"))).drop("_all")
    share = F.col("passed") * 100.0 / F.col("total")
    return rows.withColumn("accuracy", round_exact(share, 1))


def class_report(per_class: DataFrame) -> DataFrame:
    """One text line per expected class, classes in order."""
    line = F.concat(
        F.col("bucket"), F.lit(" | "), F.col("passed").cast("string"), F.lit("/"),
        F.col("total").cast("string"), F.lit(" ("), F.col("accuracy").cast("string"), F.lit("%)"),
    )
    return per_class.select(line.alias("value"), "bucket").orderBy("bucket").select("value")


def run_totals(scored: DataFrame) -> DataFrame:
    """Project figures compared between runs, from one pass over the files."""
    return project_rollup(layer_sums(scored)).select(
        "project_id", "overall_score", F.col("labelled_files").alias("total_violations"),
        "files_with_violations",
    )


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Project figures of two runs and what became of the project."""
    figures = ["overall_score", "total_violations", "files_with_violations"]
    old = run_totals(before).withColumnsRenamed({c: f"{c}_before" for c in figures})
    new = run_totals(after).withColumnsRenamed({c: f"{c}_after" for c in figures})
    delta = F.col("score_delta")
    fewer = F.col("total_violations_after") < F.col("total_violations_before")
    outcome = (
        F.when((delta > 0) & fewer, "improved")
        .when(delta > 0, "partly improved")
        .when((delta == 0) & (F.col("total_violations_after") == 0), "already clean")
        .otherwise("not improved")
    )
    return (
        old.join(new, "project_id")
        .withColumns({
            "score_delta": round_exact(
                F.col("overall_score_after") - F.col("overall_score_before"), 1),
            "violations_removed":
                F.col("total_violations_before") - F.col("total_violations_after"),
            "files_with_violations_removed":
                F.col("files_with_violations_before") - F.col("files_with_violations_after"),
        })
        .withColumn("outcome", outcome)
    )


def file_transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per file path: labels and scores of both runs and the kind of change.
    A file that only one run has is ``added`` or ``removed``; its other side
    and its score change are null. ``file_seq`` and ``file_name`` are those of
    the run before, else of the run after."""
    old = before.select("project_id", "file_path", F.col("file_seq").alias("_seq"),
                        F.col("file_name").alias("_name"), F.col("type").alias("type_before"),
                        F.col("quality_score").alias("score_before"))
    new = after.select("project_id", "file_path", *[F.col(c) for c in ("file_seq", "file_name")],
                       F.col("type").alias("type_after"), F.col("quality_score").alias("score_after"))
    was, now = F.col("type_before") == CLEAN, F.col("type_after") == CLEAN
    kind = (
        F.when(F.col("type_before").isNull(), "added").when(F.col("type_after").isNull(), "removed")
        .when(was & now, "clean").when(~was & now, "fixed")
        .when(was & ~now, "regression").otherwise("changed")
    )
    delta = round_exact(F.col("score_after") - F.col("score_before"), 1)
    joined = old.join(new, ["project_id", "file_path"], "full")
    return joined.select(
        "project_id", F.coalesce("_seq", "file_seq").alias("file_seq"),
        F.coalesce("_name", "file_name").alias("file_name"), "type_before", "score_before",
        "type_after", "score_after", kind.alias("transition"), delta.alias("score_delta"),
    )


def quality_metrics(df: DataFrame, label: str = "label", score: str = "quality_score") -> DataFrame:
    """RMSE, MAE and R² of predicted against actual scores, in one pass."""
    actual, error = F.col(label), F.col(score) - F.col(label)
    return df.agg(
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (1 - F.sum(error * error) / (F.var_pop(actual) * F.count(actual))).alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )


#: Mean held-out error over the folds, its deviation, and how much larger it is than in training.
CV_FIGURES = ["cv_rmse", "cv_std", "overfit_gap"]


def fold_of(key: Column, folds: int) -> Column:
    """Fold of a whole-number key, as any engine can compute it."""
    return F.pmod(key, F.lit(folds)).cast("int")


def cross_validated(
    df: DataFrame, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], fold: Column, folds: int,
    label: str = "label", score: str = "quality_score",
) -> DataFrame:
    """One row of CV_FIGURES. ``fit`` takes training rows and gives a step that adds ``score``.

    One model is fitted per fold, without that fold's rows. All models then score all rows in
    one pass, so each has its error on the held-out and on the training rows.
    """
    rows = df.withColumn("_fold", fold)
    steps = [fit(rows.filter(F.col("_fold") != i).drop("_fold")) for i in range(folds)]
    for i, step in enumerate(steps):
        rows = step(rows).withColumnRenamed(score, f"_score{i}")

    def error(i: int, held: bool) -> Column:
        squared = (F.col(f"_score{i}") - F.col(label)) * (F.col(f"_score{i}") - F.col(label))
        return F.sqrt(F.avg(F.when((F.col("_fold") == i) == held, squared)))

    errors = rows.agg(*[error(i, True).alias(f"_held{i}") for i in range(folds)],
                      *[error(i, False).alias(f"_train{i}") for i in range(folds)], F.count(F.lit(1)).alias("n"))
    mean = lambda columns: sum(columns[1:], columns[0]) / folds
    held, train = ([F.col(f"_{name}{i}") for i in range(folds)] for name in ("held", "train"))
    away = [(h - mean(held)) * (h - mean(held)) for h in held]
    return errors.select(mean(held).alias("cv_rmse"), F.sqrt(mean(away)).alias("cv_std"),
                         (mean(held) - mean(train)).alias("overfit_gap"), "n")
