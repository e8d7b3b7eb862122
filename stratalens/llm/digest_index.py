"""Exact dedup against a persistent digest index.

The index is a table of (digest, keep_id, arrival), bucketed and sorted by digest, below a
folder of its own, so that any later session can open it again. An arrival of new rows is
reduced to its distinct digests; a sort-merge anti-join with the index leaves those never
seen, which are appended. The bucketed side of that join is read in place: only the new
digests are shuffled, to as many partitions as there are buckets, and every one of these
writes the file of its bucket.

Texts are equal when identical to the byte. Of equal texts in one arrival the row with the
largest key stays, of rows that tie in the key the first in stored order; what an earlier
arrival brought stays before all that follow. An arrival that is repeated under its name
finds its own entries and admits the same rows again.

Null texts count as empty, and the empty text is a text like others. A null key is less
than any other. Repeated rows are rows of their own, one of which stays. An empty table
admits nothing. ``admit`` passes all columns unchanged, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import md5

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.llm.common import attach, given, text_of, with_row
from stratalens.sources.staging import staged, staged_path

#: Digests that a bucket is to hold: about 64 MB of them.
PER_BUCKET = 1_000_000


def digest_of(text: Column) -> Column:
    """32 bytes of SHA-256 over the UTF-8 text."""
    return F.unhex(F.sha2(text, 256))


@dataclass
class DigestIndex:
    spark: SparkSession
    table: str
    buckets: int

    def entries(self) -> DataFrame:
        """(digest, keep_id, arrival) as stored now."""
        return self.spark.table(self.table)

    def add(self, firsts: DataFrame, arrival: str) -> None:
        """Append those of ``firsts`` (digest, keep_id; one row per digest) never seen."""
        new = firsts.hint("merge").join(self.entries(), "digest", "left_anti")
        (new.select("digest", "keep_id", F.lit(arrival).alias("arrival"))
         .repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table))

    def compact(self, path: str) -> DigestIndex:
        """A copy below ``path`` with one sorted file per bucket, after many arrivals."""
        kind = self.entries().schema["keep_id"].dataType
        other = open_index(self.spark, path, kind, self.buckets)
        (self.entries().repartition(self.buckets, "digest").sortWithinPartitions("digest")
         .write.insertInto(other.table))
        return other


def buckets_for(rows: int) -> int:
    """A power of two, so that buckets hold about PER_BUCKET digests."""
    return 1 << max(4, (max(rows, 1) // PER_BUCKET).bit_length())


def open_index(spark: SparkSession, path: str, key: T.DataType, buckets: int = 16) -> DigestIndex:
    """The index below ``path``. A new one is made with so many ``buckets``; one that is
    there already keeps its own number."""
    about = f"{path}/about"
    try:
        buckets = spark.read.schema("buckets int").json(about).first()["buckets"]
    except AnalysisException:
        spark.range(1).select(F.lit(buckets).alias("buckets")).write.json(about)
    table = f"digest_index_{md5(path.encode()).hexdigest()}"
    if not spark.catalog.tableExists(table):
        spark.sql(f"CREATE TABLE {table} (digest BINARY, keep_id {key.simpleString()}, arrival STRING) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}/entries'")
    return DigestIndex(spark, table, buckets)


def _digested(df: DataFrame, key: str, text: str) -> DataFrame:
    rows = with_row(df.select(F.col(key).alias("key"), F.col(text).alias("text")), "_row")
    return rows.select("_row", "key", digest_of(text_of("text")).alias("digest"))


def _firsts(digested: DataFrame) -> DataFrame:
    """Per digest: the row that stays within an arrival. Aggregated before the shuffle."""
    best = F.max(F.struct("key", (-F.col("_row")).alias("back")))
    return digested.groupBy("digest").agg(best.alias("b")).select(
        "digest", F.col("b.key").alias("keep_id"), (-F.col("b.back")).alias("_first"))


def _admitted(index: DigestIndex, digested: DataFrame, arrival: str) -> DataFrame:
    """Per digest of the arrival: the keep_id and, where the arrival brought it, the row."""
    firsts = staged(_firsts(digested), "firsts")
    index.add(firsts.select("digest", "keep_id"), arrival)
    stored = index.entries().select("digest", F.col("keep_id").alias("_keep"), F.col("arrival").alias("_by"))
    found = firsts.hint("merge").join(stored, "digest")
    own = F.col("_by") == arrival
    return staged(found.select("digest", F.col("_keep").alias("keep_id"), F.when(own, F.col("_first")).alias("_first")),
                  "admitted")


def admit(df: DataFrame, index: DigestIndex, arrival: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text the index did not have, one of equal ones; their digests
    are in the index afterwards. ``df`` must be a stored table."""
    digested = staged(_digested(df, key, text), "digests")
    new = _admitted(index, digested, arrival).where("_first IS NOT NULL").select(F.col("_first").alias("_row"))
    return given(df).join(new, "_row", "left_semi").select("_given.*")


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Per row: key, keep_id (the key of the row that stays), group_size, kept and
    text_sha256, by an index below ``path`` (a new folder if none is given).

    The rows arrive in two halves, the larger keys first, so that an entry of the index
    always names the largest key of its text.
    """
    spark = df.sparkSession
    digested = staged(_digested(df, key, text), "digests")
    sizes = staged(digested.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size")), "sizes")
    index = open_index(spark, path or staged_path(spark, "index"), df.schema[key].dataType,
                       buckets_for(sizes.count()))
    middle = digested.agg(F.percentile_approx("key", 0.5)).first()[0]
    upper = F.coalesce(F.col("key") > F.lit(middle), F.lit(False))
    first = _admitted(index, digested.where(upper), "upper keys")
    second = _admitted(index, digested.where(~upper), "lower keys")
    # a digest of both halves has the row in the first
    kept = first.union(second).groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max("_first").alias("_first"))
    known = staged(sizes.join(kept, "digest"), "known")
    out = attach(digested, known, ["digest"], F.col("_row"))
    return out.select(F.col("key").alias(key), "keep_id", "group_size",
                      F.coalesce(F.col("_row") == F.col("_first"), F.lit(False)).alias("kept"),
                      F.lower(F.hex("digest")).alias("text_sha256"))
