"""Mixing sources to target weights by hash-threshold histograms.

Sources, ordered by code point with null last, weigh 5, 2, 1, repeating, and share
the sum of all sizes. No target exceeds ``MOST`` times its source's size; what is
over goes to the others by weight, until no target is above.

A source whose target is k times its size and a rest gives every document k times,
and once more those documents whose hash is below a threshold. The threshold comes
from histograms: sizes summed by source and hash bucket, the bucket in which the
running sum meets the rest, then only that bucket in finer buckets, until it holds
one document. Thresholds nest: a larger budget takes a superset. Nothing is sorted.

Sizes count words; null and empty texts have size 0 and are taken like others.
Rows that repeat both key and text have one hash and are taken or left together.
An empty table gives an empty table. Columns other than the working ones, which
start with ``_``, pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.llm.common import attach, given, numbered, text_of, words
from stratalens.sources.staging import staged

# Weights of the sources in order, and the most that a target may be.
WEIGHTS = (5, 2, 1)
MOST = 3
#: Bits of the hash resolved by each histogram.
BITS = 12


def targets(sources: DataFrame) -> DataFrame:
    """From (source, source_size): the target of each source. The shares are dealt in
    rounds; a round ends with one row on the driver, however many sources there are."""
    order = [F.col("source").isNull().alias("_null"), "source"]
    placed = numbered(sources.select("*", order[0]), ["_null", "source"], "_place").drop("_null")
    weights = F.array(*[F.lit(w).cast("double") for w in WEIGHTS])
    open_ = staged(placed.select(
        "source", "source_size", F.get(weights, F.pmod("_place", F.lit(len(WEIGHTS))).cast("int"))
        .alias("_weight"), (F.col("source_size") * MOST).cast("double").alias("_cap")), "sources")
    capped, total = None, None
    while True:
        free = open_ if capped is None else open_.where(~capped)
        fixed = F.lit(0.0) if capped is None else F.sum(F.when(capped, F.col("_cap")))
        row = open_.agg(F.sum("source_size").alias("all"), fixed.alias("fixed")).first()
        total = float(row["all"] or 0)
        left = total - float(row["fixed"] or 0.0)
        weight = free.agg(F.sum("_weight")).first()[0] or 0.0
        share = F.col("_weight") * F.lit(left / weight if weight else 0.0)
        over = (share > F.col("_cap")) if capped is None else (capped | (share > F.col("_cap")))
        if free.where(share > F.col("_cap")).limit(1).count() == 0:
            break
        # the caps of this round stay: written down, so that the plan does not grow
        open_ = staged(open_.withColumn("_capped", over), "sources")
        capped = F.col("_capped")
    target = share if capped is None else F.when(capped, F.col("_cap")).otherwise(share)
    return open_.select("source", "source_size", target.alias("target"))


def _bucket(hashed: Column, level: int) -> Column:
    """The leading ``BITS * (level + 1)`` bits of a 63-bit hash."""
    return F.shiftright(hashed, 63 - BITS * (level + 1))


def thresholds(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """For (source, rest): the documents with a hash up to ``limit`` have about ``rest``
    words. ``sized`` has source, _size and _hash (63 bits)."""
    found = wanted.select("source", F.col("rest").alias("_left"), F.lit(0).cast("bigint").alias("_from"))
    for level in range(63 // BITS):
        inside = sized
        if level:
            edge = found.withColumnRenamed("_from", "_edge")
            inside = (attach(sized, edge, ["source"], F.col("_hash"))
                      .where(_bucket(F.col("_hash"), level - 1) == F.col("_edge")))
        sums = (inside.groupBy("source", _bucket(F.col("_hash"), level).alias("_bucket"))
                .agg(F.sum("_size").alias("_sum"), F.count(F.lit(1)).alias("_docs")))
        # at most 2**BITS rows for a source
        upto = Window.partitionBy("source").orderBy("_bucket")
        sums = (attach(sums, found.drop("_from"), ["source"], F.col("_bucket"))
                .where(F.col("_left").isNotNull()))
        sums = (sums.withColumn("_through", F.sum("_sum").over(upto))
                .withColumn("_last", F.max("_bucket").over(Window.partitionBy("source"))))
        met = (F.col("_through") >= F.col("_left")) | (F.col("_bucket") == F.col("_last"))
        edges = (sums.where(met).withColumn("_first", F.min("_bucket").over(Window.partitionBy("source")))
                 .where(F.col("_bucket") == F.col("_first")))
        found = staged(edges.select(
            "source", (F.col("_left") - (F.col("_through") - F.col("_sum"))).alias("_left"),
            F.col("_bucket").alias("_from"), "_sum", "_docs"), f"edges{level}")
        done = found.where("_docs > 1").limit(1).count() == 0
        if done or level + 1 == 63 // BITS:
            # the documents of the last bucket go with whichever side is nearer
            width = 63 - BITS * (level + 1)
            above = F.shiftleft(F.col("_from") + 1, width) - 1
            below = F.shiftleft(F.col("_from"), width) - 1
            return found.select("source", F.when(F.col("_left") * 2 >= F.col("_sum"), above)
                                .otherwise(below).alias("limit"))
        found = staged(found.drop("_sum", "_docs"), f"left{level}")
    raise AssertionError("unreachable")


def plan(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
         also: tuple[str, ...] = ()) -> DataFrame:
    """Per row: key, size, source_size, target, times (how often the mix takes it) and
    taken (its words in the mix)."""
    body = text_of(text)
    # 63 bits, so that comparisons are those of unsigned numbers
    hashed = F.shiftrightunsigned(F.xxhash64(F.col(key), body), 1)
    sized = staged(df.select(F.col(key), F.col(source).alias("source"), *also,
                             F.size(words(body)).cast("bigint").alias("_size"),
                             hashed.alias("_hash")), "sized")
    sizes = staged(sized.groupBy("source").agg(F.sum("_size").alias("source_size")), "source_sizes")
    goal = targets(sizes)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
                   ).otherwise(F.lit(0)).cast("bigint")
    goal = staged(goal.withColumn("_whole", whole).withColumn(
        "rest", F.col("target") - F.col("_whole") * F.col("source_size")), "targets")
    limits = thresholds(sized.where("_size > 0"), goal.where("rest > 0"))
    goal = staged(attach(goal, staged(limits, "limits"), ["source"], F.xxhash64("source")), "goal")
    rows = attach(sized, goal, ["source"], F.col("_hash"))
    once = (F.col("limit").isNotNull() & (F.col("_hash") <= F.col("limit"))).cast("bigint")
    times = F.least(F.col("_whole") + once, F.lit(MOST)).cast("bigint")
    return rows.select(key, *([] if key == "source" else ["source"]), *also,
                       F.col("_size").alias("size"), "source_size", "target",
                       times.alias("times"), (F.col("_size") * times).alias("taken"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``df``, each as often as the plan takes it. ``df`` must be a stored
    table, for its rows are numbered in two reads."""
    rows = given(df)
    read = rows.select("_row", *[F.col("_given")[c].alias(n) for c, n in
                                 ((key, "doc_id"), (text, "text"), (source, "source"))])
    taken = plan(read, also=("_row",)).where("times > 0").select("_row", "times")
    return rows.join(taken, "_row").select(
        "_given", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))).select("_given.*")
