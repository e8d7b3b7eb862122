"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

import stratalens
from stratalens.sources.staging import staged

SPACE = " \t\n\x0b\f\r"
GAP = r"[ \t\n\x0B\f\r]+"

#: Rows, and bytes of texts and arrays, of a table that may be broadcast. Beyond either,
#: joins are shuffled and salted.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16_000_000
#: A hot key's rows are spread over so many salts.
SALTS = 32


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's code to the Python workers, once per application, so that
    they need no copy of their own. Spark distributes the archive; the driver's
    temporary folder holds nothing but this code."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(stratalens.__file__).parent
    archive = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def text_of(column: Column | str) -> Column:
    """The text, a null as the empty one."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(""))


def words(text: Column) -> Column:
    """Runs of characters other than U+0020 and U+0009 to U+000D, in order."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


#: Bits of a row's number for its place in its file.
PLACE_BITS = 40


def _placed(df: DataFrame) -> DataFrame:
    """The columns of ``df`` with the path of each row's file and the place in the file."""
    meta = df.metadataColumn("_metadata")
    return df.select("*", meta["file_path"].alias("_path"), meta["row_index"].alias("_place"))


def with_row(df: DataFrame, name: str) -> DataFrame:
    """Number the rows of a stored table by file (in the order of the paths) and place in the
    file. However a read splits the files among tasks, a row keeps its number. What is no
    stored table is written down first, so only reads of the result agree."""
    try:
        placed = _placed(df)
    except AnalysisException:
        df = staged(df, "rows")
        placed = _placed(df)
    # the listing writes "file:///a" where a row has "file:/a"
    paths = sorted(path.replace(":///", ":/", 1) for path in df.inputFiles())
    if len(paths) < 2:
        return placed.withColumn(name, F.col("_place")).drop("_path", "_place")
    # one literal text of all paths; a row per file of the table
    files = df.sparkSession.range(1).select(
        F.posexplode(F.split(F.lit("\n".join(paths)), "\n")).alias("_file", "_path"))
    if len(paths) <= BROADCAST_ROWS:
        files = F.broadcast(files)
    # a path that the listing lacks must not lose its rows unnoticed
    file = F.coalesce(F.col("_file").cast("bigint"),
                      F.raise_error(F.concat(F.lit("file not listed: "), F.col("_path"))).cast("bigint"))
    return (placed.join(files, "_path", "left")
            .withColumn(name, F.shiftleft(file, PLACE_BITS) + F.col("_place")).drop("_path", "_file", "_place"))


def given(df: DataFrame) -> DataFrame:
    """Each row as one struct ``_given``, so that no column of it can clash with a working
    one, and its number ``_row`` (see ``with_row``)."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return with_row(df.select(whole.alias("_given")), "_row")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``name``: the 0-based place in ``order`` among all rows.

    A distributed sort writes the rows once; a count per sorted partition turns
    places in a partition into global ones. No task sees more than a partition,
    and rows that tie in ``order`` are still dealt to several partitions.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = tied.orderBy(*order, "_tie").withColumn("_at", F.monotonically_increasing_id())
    placed = staged(placed.drop("_tie"), "numbered")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per sorted partition
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    at = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
            .withColumn(name, at).drop("_part", "_at", "_start"))


def fits_broadcast(small: DataFrame) -> bool:
    """Whether a stored table is within both bounds of a broadcast. What is counted is
    BROADCAST_ROWS + 1 rows at most."""
    def size_of(field: T.StructField) -> Column:
        name = f"`{field.name}`"
        if isinstance(field.dataType, T.StringType):
            return F.octet_length(name)
        if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.NumericType):
            return F.size(name) * 8
        return F.octet_length(F.to_json(F.struct(name)))

    wide = [size_of(f) for f in small.schema if isinstance(f.dataType, (T.StringType, T.ArrayType, T.StructType, T.MapType))]
    total = sum((F.coalesce(w.cast("bigint"), F.lit(0)) for w in wide), F.lit(0))
    n, size = small.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(total), F.lit(0))).first()
    return n <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def attach(rows: DataFrame, small: DataFrame, keys: list[str], salt: Column) -> DataFrame:
    """Left join of a per-key table with null-safe keys, one row per key.

    ``small`` must be a stored table. Up to BROADCAST_ROWS rows and BROADCAST_BYTES it is
    broadcast. Beyond, it first meets the distinct (keys, salt) of ``rows``, at most SALTS per
    key, and these meet the rows: no task gets all rows of a hot key.
    """
    right = small.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                         *[c for c in small.columns if c not in keys])
    renamed = [f"_k{i}" for i in range(len(keys))]
    if fits_broadcast(small):
        right = F.broadcast(right)
        return rows.join(right, [rows[k].eqNullSafe(right[r]) for k, r in zip(keys, renamed)], "left").drop(*renamed)
    spread = rows.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int"))
    met = spread.select(*[F.col(k).alias(f"_m{i}") for i, k in enumerate(keys)], F.col("_salt").alias("_s")).distinct()
    met = met.join(right, [met[f"_m{i}"].eqNullSafe(right[r]) for i, r in enumerate(renamed)]).drop(*renamed)
    on = [spread[k].eqNullSafe(met[f"_m{i}"]) for i, k in enumerate(keys)]
    return (spread.join(met, [*on, spread["_salt"] == met["_s"]], "left")
            .drop("_salt", "_s", *[f"_m{i}" for i in range(len(keys))]))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of the links (a, b): root is the least node reachable.

    Large-star and small-star rounds until nothing changes. Each round is written down;
    what comes to the driver is a count and a checksum.
    """
    edges = staged(links.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
                   .distinct(), "links")
    seen = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("lo", "hi"))).first())
        if now == seen:
            break
        seen = now
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(
            edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u").where("m < v")
                 .select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct())
        large = staged(large, "large_star")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo > m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        edges = staged(small.union(least.select(F.col("m").alias("lo"), "hi")).distinct(), "small_star")
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return roots.union(edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")))
