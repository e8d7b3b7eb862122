"""Fitting and applying the two models with Spark ML."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import (
    IndexToString, OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from stratalens.functions.features import (
    ANTIPATTERN_FEATURES, CATEGORICAL_FEATURES, QUALITY_FEATURES, antipattern_feature_columns,
    quality_feature_columns,
)
from stratalens.functions.scores import clip_score
from stratalens.sources.catalog import ENTRIES
from stratalens.sources.staging import staged_path

LABELS = [entry[0] for entry in ENTRIES]
#: Prefix of the columns that hold model inputs.
INPUT = "f_"
#: Most training rows of a task. Trees are grown over rows kept as objects, about half a
#: kilobyte each, and a task's rows are put into memory, or read back from disk, as one block.
TRAINING_ROWS = 250_000


def _with_inputs(df: DataFrame, columns: dict) -> DataFrame:
    """Add model inputs under their own prefix, next to the file's columns."""
    return df.withColumns({f"{INPUT}{name}": col for name, col in columns.items()})


def classifier_inputs(df: DataFrame) -> DataFrame:
    columns = dict(zip(ANTIPATTERN_FEATURES, antipattern_feature_columns()))
    numeric = {
        name: col if name in CATEGORICAL_FEATURES else col.cast("double")
        for name, col in columns.items()
    }
    return _with_inputs(df, numeric)


def regressor_inputs(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    derived = quality_feature_columns()
    return _with_inputs(
        df, {name: derived.get(name, F.lit(0.0)) for name in names or QUALITY_FEATURES}
    )


def training_rows(df: DataFrame, most: int | None = None) -> DataFrame:
    """All rows of ``df``, dealt to tasks of ``most`` at most. A scan makes tasks by the bytes of
    its files, and many millions of narrow rows are few bytes; where a task would have more rows,
    they are stored in files of ``most`` rows, each of which is read as a task of its own."""
    most = most or TRAINING_ROWS
    sizes = df.groupBy(F.spark_partition_id().alias("_task")).agg(F.count(F.lit(1)).alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= most:
        return df
    path = staged_path(df.sparkSession, "training")
    df.write.option("maxRecordsPerFile", most).parquet(path)
    reader = df.sparkSession.newSession()  # its settings hold for this table alone
    for setting in ("maxPartitionBytes", "openCostInBytes"):  # as dear to open as to read: a file is a task
        reader.conf.set(f"spark.sql.files.{setting}", "1g")
    return reader.read.schema(df.schema).parquet(path)


def fit_antipattern(
    files: DataFrame, label: str = "expected", trees: int = 40, depth: int = 10, seed: int = 7,
) -> PipelineModel:
    """Random forest over the classifier inputs. Unseen categories get a slot
    of their own; the label order is the catalogue's and travels along.
    Each row's node in each tree is kept from level to level, not looked for from the root."""
    categories = [f"{INPUT}{c}" for c in CATEGORICAL_FEATURES]
    numeric = [f"{INPUT}{c}" for c in ANTIPATTERN_FEATURES if c not in CATEGORICAL_FEATURES]
    index = StringIndexer(
        inputCols=categories, outputCols=[f"{c}_index" for c in categories], handleInvalid="keep",
    )
    encode = OneHotEncoder(
        inputCols=[f"{c}_index" for c in categories],
        outputCols=[f"{c}_vector" for c in categories], handleInvalid="keep",
    )
    assemble = VectorAssembler(
        inputCols=[*numeric, *[f"{c}_vector" for c in categories]], outputCol="features",
    )
    forest = RandomForestClassifier(
        labelCol="label_index", featuresCol="features", predictionCol="label_prediction",
        numTrees=trees, maxDepth=depth, seed=seed,
        cacheNodeIds=True, checkpointInterval=-1,  # a level's nodes are those of the last, one step on
    )
    decode = IndexToString(inputCol="label_prediction", outputCol="type", labels=LABELS)
    indexed = StringIndexerModel.from_labels(
        LABELS, inputCol=label, outputCol="label_index", handleInvalid="error"
    ).transform(classifier_inputs(files))
    rows = training_rows(indexed.select("label_index", *categories, *numeric))
    return Pipeline(stages=[index, encode, assemble, forest, decode]).fit(rows)


def predict_antipattern(files: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``type`` and ``confidence``, the highest class probability."""
    scored = model.transform(classifier_inputs(files))
    return scored.select(
        *files.columns, "type",
        F.array_max(vector_to_array("probability")).alias("confidence"),
    )


def fit_quality(
    files: DataFrame, label: str = "label", trees: int = 20, depth: int = 5, seed: int = 7,
    names: list[str] | None = None,
) -> PipelineModel:
    """Boosted trees over the 33 regressor inputs, or those of ``names`` in
    that order."""
    inputs = [f"{INPUT}{c}" for c in names or QUALITY_FEATURES]
    assemble = VectorAssembler(inputCols=inputs, outputCol="features")
    boosted = GBTRegressor(
        labelCol=label, featuresCol="features", predictionCol="raw_score",
        maxIter=trees, maxDepth=depth, seed=seed,
    )
    rows = training_rows(regressor_inputs(files, names).select(label, *inputs))
    return Pipeline(stages=[assemble, boosted]).fit(rows)


def predict_quality(
    files: DataFrame, model: PipelineModel, names: list[str] | None = None,
) -> DataFrame:
    """Add ``quality_score``: the prediction limited to 0..100, one decimal.
    ``names`` is the feature list of the model's metadata."""
    scored = model.transform(regressor_inputs(files, names))
    return scored.select(*files.columns, clip_score(F.col("raw_score")).alias("quality_score"))


def regression_error(df: DataFrame, metric: str, label: str = "label") -> float:
    return RegressionEvaluator(
        labelCol=label, predictionCol="quality_score", metricName=metric
    ).evaluate(df)


def hash_split(df: DataFrame, *keys: str, test_share: int = 20) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of the keys, the same in every run."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(100))
    return df.filter(bucket >= test_share), df.filter(bucket < test_share)


def mod_split(df: DataFrame, key: str, one_in: int = 5) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a whole-number key, as any engine can do it."""
    held = F.col(key) % one_in == 0
    return df.filter(~held), df.filter(held)


def save_models(path: str, classifier: PipelineModel, regressor: PipelineModel) -> None:
    classifier.write().overwrite().save(f"{path}/antipattern")
    regressor.write().overwrite().save(f"{path}/quality")


def load_models(spark: SparkSession, path: str) -> tuple[PipelineModel, PipelineModel]:
    return PipelineModel.load(f"{path}/antipattern"), PipelineModel.load(f"{path}/quality")


def fit_group_means(train: DataFrame, keys: list[str], label: str = "label"):
    """The simplest regressor: the mean label of each group, the overall mean for groups
    not seen. Gives a step that adds ``quality_score``."""
    spots = {k: f"_group_{k}" for k in keys}
    means = train.groupBy(*[F.col(k).alias(spots[k]) for k in keys]).agg(F.avg(label).alias("_mean"))
    overall = train.agg(F.avg(label).alias("_overall"))  # one row

    def step(df: DataFrame) -> DataFrame:
        same = [df[k].eqNullSafe(means[spots[k]]) for k in keys]
        scored = df.join(means, same, "left").join(F.broadcast(overall))
        return scored.withColumn("quality_score", F.coalesce("_mean", "_overall")).drop("_mean", "_overall", *spots.values())

    return step


def write_metadata(spark: SparkSession, meta_path: str, names: list[str], performance: DataFrame | None = None) -> None:
    """A model's metadata file: its feature list and, as ``performance``, a row of figures."""
    listed = spark.range(1).select(F.split(F.lit("\n".join(names)), "\n").alias("feature_names"))
    if performance is not None:
        listed = listed.join(performance.select(F.struct(*performance.columns).alias("performance")))
    listed.coalesce(1).write.mode("overwrite").json(meta_path)


def feature_columns(spark: SparkSession, meta_path: str) -> list[str]:
    """Feature list of a model's metadata file, the default list without one."""
    try:
        meta = spark.read.json(meta_path, multiLine=True)
    except AnalysisException:  # no such file
        return list(QUALITY_FEATURES)
    if "feature_names" not in meta.columns:
        return list(QUALITY_FEATURES)
    return list(meta.select("feature_names").first()[0])
