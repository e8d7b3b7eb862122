"""Intermediate tables written to shared storage.

A result used by several later steps is written once and read back with only
the columns each step needs. Unlike cached blocks it survives the loss of
executors, and it cuts the lineage.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark removes the shuffle files of an execution as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else the session's warehouse.
    Both are places that the driver and all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def staged_path(spark: SparkSession, name: str) -> str:
    """A new folder. All of an application's folders share one parent, which
    can be dropped when the application is done."""
    run = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/stratalens/{run}/{uuid.uuid4().hex}/{name}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """For writes whose result is read back and not computed again: their shuffle files go
    when the write ends, else they stay on the executors' disks until the driver's garbage
    collector comes by. Should a plan run again after all, Spark makes its shuffles anew."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` and return a reader over the written table."""
    path = staged_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
