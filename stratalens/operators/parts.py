"""Bounded pieces of a project.

A project may be any size, up to a large share of the whole corpus, so nothing
here gathers a project in one place. ``part`` numbers runs of ``PART_FILES``
consecutive files; lists, texts and joins that need file rows together are
keyed by ``(project_id, part)``, which holds at most ``PART_FILES`` files. A
project of up to that many files has the single part 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PART_FILES = 1000
PLACE = ["project_id", "part"]
_SPAN = 4096
#: Files whose texts one job moves. More are moved in passes, one after the other.
PASS_FILES = 5_000_000


def grown(df: DataFrame) -> DataFrame:
    """For the right side of a join that has rows per project, group or file. Its size on disk
    says little about its size as a broadcast, which passes through the driver, so such joins
    are sorted merges whatever the sizes."""
    return df.hint("merge")


def part_of(file_seq: Column) -> Column:
    return F.floor(file_seq / F.lit(PART_FILES)).cast("bigint")


def with_part(df: DataFrame) -> DataFrame:
    return df.withColumn("part", part_of(F.col("file_seq")))


def passes(n_files: int, *keys: str) -> list[Column]:
    """Conditions that deal the rows of so many files to passes by ``keys``; every row meets one
    of them. Where the texts of all files fit into one pass, all rows do."""
    n = max(-(-n_files // PASS_FILES), 1)
    return [F.pmod(F.xxhash64(*keys), F.lit(n)) == k for k in range(n)] if n > 1 else [F.lit(True)]


def spread(per_project: DataFrame, last_seq: str) -> DataFrame:
    """One copy of a project-level row for each part of the project, for
    joining onto file-level rows by ``(project_id, part)``. Two explodes, so
    that no array is longer than the number of 4096-part spans."""
    last_part = part_of(F.col(last_seq))
    spans = per_project.withColumn("_last", last_part).withColumn(
        "_span", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_last") / _SPAN)))
    )
    start = F.col("_span") * _SPAN
    return spans.withColumn(
        "part",
        F.explode(F.sequence(start, F.least(start + (_SPAN - 1), F.col("_last")))),
    ).drop("_span", "_last")


def with_file_seq(df: DataFrame, order_col: str, width: int = 1 << 20) -> DataFrame:
    """Number the files of each project 0, 1, 2, ... by a whole-number column
    that is unique inside the project.

    Rows are numbered inside ``(project, order_col // width)``, which cannot
    hold more than ``width`` rows, and shifted by the sizes of the earlier
    buckets. Only bucket sizes meet per project, never the files.
    """
    keys = ["project_id", "_bucket"]
    bucketed = df.withColumn("_bucket", F.floor(F.col(order_col) / F.lit(width)))
    local = bucketed.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*keys).orderBy(order_col))
    )
    sizes = bucketed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy("project_id").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(*keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        local.join(grown(offsets), keys)
        .withColumn("file_seq", (F.col("_offset") + F.col("_local") - 1).cast("bigint"))
        .drop("_bucket", "_local", "_offset")
    )
