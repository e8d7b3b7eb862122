"""Saved tree ensembles as SQL expressions.

A saved model's node table becomes one expression over the model's input columns: nested
``CASE`` per tree, added up. It runs in whole-stage code without the model, on a stream
too, and as text in other engines (``dialect``). The text grows with the model alone: its
nodes, bounded by the number and depth of the trees, are read to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stratalens.functions.features import ANTIPATTERN_FEATURES, CATEGORICAL_FEATURES, QUALITY_FEATURES
from stratalens.functions.scores import clip_score
from stratalens.operators.models import INPUT, LABELS, classifier_inputs, regressor_inputs


@dataclass
class Dialect:
    """How an engine writes lists."""

    literal: str
    added: str
    best: str
    total: str

    def summed(self, lists: list[str]) -> str:
        result = lists[0]
        for one in lists[1:]:
            result = self.added.format(a=result, b=one)
        return result


SPARK = Dialect("array({})", "zip_with({a}, {b}, (x, y) -> x + y)", "array_position({}, array_max({}))",
                "aggregate({}, 0D, (s, x) -> s + x)")
DUCKDB = Dialect("[{}]", "list_transform(list_zip({a}, {b}), lambda t: t[1] + t[2])", "list_position({}, list_max({}))",
                 "list_sum({})")


def _stage(spark: SparkSession, path: str, kind: str) -> str:
    """Folder of a saved pipeline's stage of this kind."""
    files = spark.read.text(f"{path}/stages/*/metadata").select(
        "value", F.col("_metadata.file_path").alias("file"))
    row = files.filter(F.get_json_object("value", "$.class").endswith(kind)).first()
    return row["file"].rsplit("/metadata/", 1)[0]


def _nodes(spark: SparkSession, stage: str) -> list[tuple[float, dict]]:
    """(weight, nodes by id) of every tree, in order."""
    trees: dict[int, dict] = {}
    for row in spark.read.parquet(f"{stage}/data").select("treeID", "nodeData.*").collect():
        trees.setdefault(row["treeID"], {})[row["id"]] = row
    weights = {r[0]: r[1] for r in spark.read.parquet(f"{stage}/treesMetadata").toDF("tree", "about", "weight")
               .select("tree", "weight").collect()}
    return [(weights[i], trees[i]) for i in sorted(trees)]


def _number(value: float) -> str:
    return f"{value!r}e0" if "e" not in repr(value) else repr(value)


def _tree(nodes: dict, tests, leaf, at: int = 0) -> str:
    """Nested CASE of a tree; ``tests`` gives the text of a split, ``leaf`` that of a leaf."""
    node = nodes[at]
    if node["leftChild"] < 0:
        return leaf(node)
    left, right = (_tree(nodes, tests, leaf, node[side]) for side in ("leftChild", "rightChild"))
    return f"CASE WHEN {tests(node['split'])} THEN {left} ELSE {right} END"


def regressor_sql(spark: SparkSession, path: str, names: list[str] | None = None) -> str:
    """The raw score of a saved regressor over the columns of ``regressor_inputs``."""
    columns = [f"{INPUT}{c}" for c in names or QUALITY_FEATURES]
    test = lambda s: f"{columns[s['featureIndex']]} <= {_number(s['leftCategoriesOrThreshold'][0])}"
    parts = [f"{_number(weight)} * ({_tree(nodes, test, lambda n: _number(n['prediction']))})"
             for weight, nodes in _nodes(spark, _stage(spark, path, "GBTRegressionModel"))]
    return " + ".join(parts)


def classifier_sql(spark: SparkSession, path: str, dialect: Dialect = SPARK) -> str:
    """The votes of a saved classifier, a list in the order of LABELS, over the columns of
    ``classifier_inputs``."""
    labels = spark.read.parquet(f"{_stage(spark, path, 'StringIndexerModel')}/data").first()["labelsArray"]
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = [f"{INPUT}{c}" for c in ANTIPATTERN_FEATURES if c not in CATEGORICAL_FEATURES]
    for name, known in zip(CATEGORICAL_FEATURES, labels):  # a slot per known value and one for all others
        column = f"{INPUT}{name}"
        slots = [f"{column} = {quoted(x)}" for x in known]
        slots.append(f"{column} IS NULL OR {column} NOT IN ({', '.join(map(quoted, known))})")
        values += [f"(CASE WHEN {s} THEN 1e0 ELSE 0e0 END)" for s in slots]

    def test(split) -> str:
        value, bounds = values[split["featureIndex"]], split["leftCategoriesOrThreshold"]
        if split["numCategories"] < 0:
            return f"{value} <= {_number(bounds[0])}"
        return f"{value} IN ({', '.join(map(_number, bounds))})"

    def shares(node) -> str:
        counts = list(node["impurityStats"])
        return dialect.literal.format(", ".join(_number(c / sum(counts)) for c in counts))

    trees = [_tree(nodes, test, shares) for _, nodes in _nodes(spark, _stage(spark, path, "RandomForestClassificationModel"))]
    return dialect.summed(trees)


def compiled_quality(files: DataFrame, sql: str, names: list[str] | None = None) -> DataFrame:
    """As ``predict_quality``, without the model."""
    return regressor_inputs(files, names).select(*files.columns, clip_score(F.expr(sql)).alias("quality_score"))


def compiled_antipattern(files: DataFrame, sql: str) -> DataFrame:
    """As ``predict_antipattern``, without the model."""
    votes = classifier_inputs(files).select(*files.columns, F.expr(sql).alias("_votes"))
    labels = F.array(*[F.lit(x) for x in LABELS])
    best = F.expr(SPARK.best.format("_votes", "_votes")).cast("int")
    share: Column = F.array_max("_votes") / F.expr(SPARK.total.format("_votes"))
    return votes.select(*files.columns, F.get(labels, best - 1).alias("type"), share.alias("confidence"))
