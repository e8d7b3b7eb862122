"""Reading, defaulting and validating file records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stratalens.functions.layers import WHITESPACE
from stratalens.schema import (
    DEPENDENCY_COLS, NUMERIC_COLS, OPTIONAL_SIGNAL_COLS, QUALITY_DEFAULTS, REQUIRED_COLS,
    SIGNAL_COLS, SIZE_COLS, payload_schema, raw_file_type,
)

NOT_NEGATIVE = [*SIZE_COLS, *DEPENDENCY_COLS]
NO_FILES = "no files"
#: Prefix of a field's typed value, next to its text.
TYPED = "_typed_"
#: Equal payloads of a file that one task unfolds.
ALIKE = 1000

# Defaults of a fix request.
FIX_DEFAULTS = {
    "architecture_pattern": "layered", "affected_layer": "unknown", "severity": "MEDIUM",
    "description": "",
}

# Texts accepted as a truth value.
TRUE_TEXTS = ["1", "true", "t", "yes", "y", "on"]
FALSE_TEXTS = ["0", "false", "f", "no", "n", "off"]


def read_projects(spark: SparkSession, path: str, fmt: str = "json", **options: str) -> DataFrame:
    """File rows of project payloads ``{"files": [...]}``, see ``payload_rows``.
    Other formats hold one file per row already and are read as they are."""
    if fmt != "json":
        return spark.read.format(fmt).options(**options).load(path)
    return payload_rows(with_origin(spark.read.schema(payload_schema()).options(**options).json(path)))


def with_origin(payloads: DataFrame) -> DataFrame:
    """Payloads read from files, batch or stream, with the file each came from."""
    return payloads.select("*", F.col("_metadata.file_path").alias("_file"))


def payload_rows(payloads: DataFrame) -> DataFrame:
    """A row per file of the payloads, every field as text. ``file_seq`` is the position in
    the payload. One without files keeps one row without a file, for validation to report.

    A payload without a numeric ``project_id`` is a project of its own. It is known by its
    file, its content and, where a file repeats the content, by a number of occurrence: so
    its name depends neither on how files are split among tasks nor on a batch. Only these
    payloads are grouped, equal ones before the shuffle.
    """
    named = payloads.filter("project_id IS NOT NULL").select("project_id", "first_seq", "files")
    alike = payloads.filter("project_id IS NULL").groupBy("_file", "first_seq", "files").agg(
        F.count(F.lit(1)).alias("_n"))
    # occurrences in runs of ALIKE, so that no task unfolds all of them
    runs = alike.withColumn("_from", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n", F.lit(ALIKE).cast("bigint"))))
    runs = runs.repartition("_file", "files", "_from")
    last = F.least(F.col("_from") + (ALIKE - 1), F.col("_n"))
    bare = runs.withColumn("_occurrence", F.explode(F.sequence("_from", last))).select(
        F.xxhash64("_file", "first_seq", "files", "_occurrence").alias("project_id"), "first_seq", "files")
    exploded = named.union(bare).select(
        "project_id", F.coalesce("first_seq", F.lit(0)).cast("bigint").alias("first_seq"),
        F.posexplode_outer("files").alias("pos", "file"),
    )
    return exploded.select(
        "project_id", (F.col("first_seq") + F.coalesce("pos", F.lit(0))).alias("file_seq"),
        F.col("pos").isNotNull().alias("has_file"),
        *[F.col(f"file.{name}").alias(name) for name in raw_file_type().names],
    )


def as_boolean(text: Column) -> Column:
    given = text.cast("string")
    word = F.lower(F.btrim(given, F.lit(WHITESPACE)))
    # JSON's own spelling needs no trimming
    return F.when(given == "true", True).when(given == "false", False).when(
        word.isin(TRUE_TEXTS), True).when(word.isin(FALSE_TEXTS), False)


def as_double(value: Column) -> Column:
    return value.cast("string").try_cast("double")


def with_defaults(df: DataFrame, kind: str = "file") -> DataFrame:
    """Fill optional fields of a file record, every field of a quality-score
    record (``kind="quality"``) or those of a fix request (``kind="fix"``);
    absent columns are added."""
    if kind == "fix":
        defaults = {c: F.lit(value) for c, value in FIX_DEFAULTS.items()}
        defaults["files"] = F.array().cast("array<string>")
    elif kind == "file":
        defaults = {"layer": F.lit("unknown"), "source_code": F.lit(None).cast("string")}
        defaults.update({c: F.lit(False) for c in OPTIONAL_SIGNAL_COLS})
    else:
        numbers = [c for c in NUMERIC_COLS
                   if c not in ("architecture_confidence", "entity_deps", "usecase_deps", "gateway_deps")]
        defaults = {"layer": F.lit(QUALITY_DEFAULTS["layer"])}
        defaults.update({c: F.lit(float(QUALITY_DEFAULTS.get(c, 0.0))) for c in numbers})
        defaults.update({c: F.lit(False) for c in SIGNAL_COLS})
    return df.withColumns({
        c: F.coalesce(F.col(c), value) if c in df.columns else value
        for c, value in defaults.items()
    })


def _problems(columns: list[str]) -> Column:
    checks = []
    for name in REQUIRED_COLS + ["file_name", "file_path"]:
        checks.append(F.when(F.col(name).isNull(), F.lit(f"{name} missing")))
    for name in NUMERIC_COLS:
        value = F.col(f"{TYPED}{name}")
        checks.append(F.when(F.col(name).isNotNull() & value.isNull(), F.lit(f"{name} not a number")))
        endless = F.isnan(value) | (F.abs(value) == float("inf"))
        checks.append(F.when(endless, F.lit(f"{name} not finite")))
    for name in NOT_NEGATIVE:
        checks.append(F.when(F.col(f"{TYPED}{name}") < 0, F.lit(f"{name} negative")))
    for name in [*SIGNAL_COLS, *OPTIONAL_SIGNAL_COLS]:
        if name in columns:
            bad = F.col(name).isNotNull() & F.col(f"{TYPED}{name}").isNull()
            checks.append(F.when(bad, F.lit(f"{name} not a truth value")))
    # sound rows, most of all, are told by generated code; listing is not
    none = F.coalesce(*checks).isNull()
    listed = F.when(none, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*checks)))
    if "has_file" not in columns:
        return listed
    return F.when(F.col("has_file"), listed).otherwise(F.array(F.lit(NO_FILES)))


def checked_files(df: DataFrame) -> DataFrame:
    """The rows with their typed values, each read from its text once, and the ``reasons`` to
    reject them, none for those that meet the contract."""
    typed = {f"{TYPED}{c}": as_double(F.col(c)) for c in NUMERIC_COLS}
    typed.update({f"{TYPED}{c}": as_boolean(F.col(c))
                  for c in [*SIGNAL_COLS, *OPTIONAL_SIGNAL_COLS] if c in df.columns})
    return df.withColumns(typed).withColumn("reasons", _problems(df.columns))


def sorted_out(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed rows without a reason to reject them, and the others as they came."""
    typed = [c for c in checked.columns if c.startswith(TYPED)]
    valid = checked.filter(F.size("reasons") == 0).withColumns({c.removeprefix(TYPED): F.col(c) for c in typed})
    return with_defaults(valid.drop("reasons", "has_file", *typed)), checked.filter(F.size("reasons") > 0).drop(*typed)


def validate_files(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed rows that meet the contract, and the others with their reasons."""
    return sorted_out(checked_files(df))


def split_sources(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files without their text but with ``has_source``, and the texts apart,
    so that wide text does not travel through joins that never look at it."""
    has = F.length(F.coalesce("source_code", F.lit(""))) > 0
    return files.withColumn("has_source", has).drop("source_code"), sources_of(files)


def sources_of(files: DataFrame) -> DataFrame:
    return files.filter(F.length("source_code") > 0).select(
        "project_id", "file_seq", "file_name", "source_code"
    )


def sources_from_maps(df: DataFrame, column: str = "file_sources") -> DataFrame:
    """Texts of a ``{file name: text}`` map per project; empty ones dropped."""
    return df.select("project_id", F.explode(column).alias("file_name", "source_code")).filter(
        F.length("source_code") > 0
    )
