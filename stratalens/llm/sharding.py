"""Sharding by jump consistent hashing.

A stable key decides the shard without a ring table; appending a shard moves only
the rows that the new shard takes (about 1/(n+1) of them).

The key is a 64-bit hash of the key column, so any type works. Null keys share one
shard, as do rows that repeat a key. Null texts have no bytes. An empty table gives
an empty table. Working columns start with ``_``; all other columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.llm.common import numbered, ship, text_of

# Fixed value: the multiplier of the generator that jump hashing draws from.
MULTIPLIER = 2862933555777941757


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key. Rows leave the loop once they jump past the end."""
    state = keys.astype(np.uint64)
    at = np.full(len(state), -1, dtype=np.int64)
    landing = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = landing[live]
        state[live] = state[live] * np.uint64(MULTIPLIER) + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        landing[live] = ((at[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[landing[live] < shards]
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Shard in [0, shards) of a key of any type."""
    if shards < 1:
        raise ValueError("at least one shard")
    ship(SparkSession.active())

    @F.pandas_udf(T.IntegerType())
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for hashed in batches:
            yield pd.Series(jump(hashed.to_numpy(dtype=np.int64).view(np.uint64), shards))

    return place(F.xxhash64(key))


def assign(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, size (bytes and one), checksum, shard, slot within the shard and the shard
    if there were one more. Slots follow the key, nulls first; rows that tie follow
    their checksum."""
    body = text_of(text)
    rows = df.select(key, (F.octet_length(body) + 1).cast("bigint").alias("size"),
                     F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    rows = rows.select("*", shard_of(F.col(key), shards).alias("shard"),
                       shard_of(F.col(key), shards + 1).alias("grown_shard"))
    placed = numbered(rows, ["shard", key, "text_crc32", "size"], "_place")
    first = placed.groupBy("shard").agg(F.min("_place").alias("_first"))  # a row per shard
    return (placed.join(F.broadcast(first), "shard")
            .withColumn("slot", F.col("_place") - F.col("_first")).drop("_place", "_first"))


def write_shards(df: DataFrame, path: str, shards: int, key: str = "doc_id",
                 files_per_shard: int = 1) -> None:
    """Write the rows below ``path`` as ``shard=<n>/``. A shard's rows are spread over
    ``files_per_shard`` tasks, so that shards may be larger than a task's memory."""
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(files_per_shard))
    (df.withColumn("shard", shard_of(F.col(key), shards))
     .repartition(shards * files_per_shard, "shard", part)
     .write.partitionBy("shard").parquet(path))
