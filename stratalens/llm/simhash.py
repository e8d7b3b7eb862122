"""SimHash near-dedup by segment-popcount embedding.

A fingerprint's 16 segments of 4 bits are mapped to their bit counts. The Manhattan
distance of two such vectors is at most the Hamming distance of the fingerprints, so
fingerprints that differ in RADIUS = 2 bits are at most 2 apart on the grid of vectors.
Two points at most 2 apart have a common point at most 1 from either: every distinct
fingerprint visits its own cell and the 32 next to it, and those that meet are compared
exactly. Cells with more than CROWD visitors emit no pairs: there every visitor lists
itself and its 64 one-bit neighbours, and fingerprints that share one (which holds just
for those at most 2 bits apart) are linked to the least of them. So the work is linear
in the number of distinct fingerprints, and no link is lost.

Copies share a fingerprint and never form pairs. Null texts count as empty; texts
without words have fingerprint zero. Repeated rows are rows of their own. An empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.llm.common import attach, components, given, ship
from stratalens.sources.staging import staged

# The seed of the shingle hash, and the bits in which linked fingerprints may differ.
SEED, RADIUS = 42, 2
#: Visitors of a cell up to which all its pairs are compared.
CROWD = 16
#: Hashes whose bits are counted at once.
CHUNK = 1 << 15
#: The lowest bit of every segment of 4 bits.
LOW = 0x1111111111111111
#: Signatures for similar texts: bands of least hashes. Two texts that share 0.8 of their
#: shingles miss each other in all bands with probability 0.0002.
BANDS, ROWS = 16, 4
#: Texts in which shingles are counted to order them, and counted shingles that travel.
COUNTED, COMMON = 4096, 100_000
#: Texts of a shared rare shingle up to which all its pairs are compared at once; a block of larger ones.
BLOCK = 128
#: Rounds in which one text of a crowded shingle is compared with the others, before all pairs are.
LEADS = 2
#: Bits of the map that passes over most entries of unshared shingles before any moves, and of a part of it.
MAP_BITS, PART_BITS = 1 << 26, 1 << 20


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words, A to Z in lower case; of all words where
    there are fewer; none without words."""
    words = text.encode("utf-8").lower().split()  # bytes: only ASCII letters and white space
    if len(words) <= width:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = [b" ".join(run) for run in zip(*[words[i:] for i in range(width)])]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], dtype=np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[start:start + CHUNK], dtype="<u8").view(np.uint8)
        counts += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0]
    return int(bits.astype("<u8").view("<i8"))


def fingerprints(df: DataFrame, text: str, also: list[str], width: int) -> DataFrame:
    """The columns ``also`` and the fingerprint as a signed long."""
    ship(df.sparkSession)
    schema = T.StructType([*[df.schema[c] for c in also], T.StructField("fingerprint", T.LongType())])

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[also].copy()
            out["fingerprint"] = [simhash(shingle_hashes(x or "", width)) for x in batch[text]]
            yield out

    return df.select(*also, text).mapInPandas(made, schema)


def embedded(fingerprint: Column) -> Column:
    """Bit counts of the 16 segments, 4 bits each: the cell of a fingerprint."""
    parts = [F.shiftrightunsigned(fingerprint, i).bitwiseAND(F.lit(LOW)) for i in range(4)]
    return parts[0] + parts[1] + parts[2] + parts[3]


def visits(distinct: DataFrame) -> DataFrame:
    """(cell, fingerprint): the own cell and those one step away in one segment."""
    cells = distinct.select("fingerprint", embedded(F.col("fingerprint")).alias("_own"))
    near = [F.col("_own")]
    for i in range(16):
        count = F.shiftrightunsigned("_own", 4 * i).bitwiseAND(F.lit(15))
        near += [F.when(count < 4, F.col("_own") + (1 << 4 * i)), F.when(count > 0, F.col("_own") - (1 << 4 * i))]
    return (cells.select("fingerprint", F.explode(F.array(*near)).alias("cell"))
            .where(F.col("cell").isNotNull()).select("cell", "fingerprint"))


def _close(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): pairs of fingerprints, each at most RADIUS bits apart, that connect all
    fingerprints which are. ``distinct`` is a stored table of distinct fingerprints."""
    cells = visits(distinct)
    met = staged(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("fingerprint").alias("a"),
                                           F.max("fingerprint").alias("b")).where("n > 1"), "met")
    two = met.where("n = 2").where(_close("a", "b")).select("a", "b")
    more = staged(cells.join(met.where("n > 2").select("cell", "n"), "cell"), "crowded")
    few = more.where(F.col("n") <= CROWD)
    few = (few.select("cell", F.col("fingerprint").alias("a"))
           .join(few.select("cell", F.col("fingerprint").alias("b")), "cell")
           .where("a < b").where(_close("a", "b")).select("a", "b"))
    crowd = more.where(F.col("n") > CROWD).select("fingerprint").distinct()
    flips = [F.col("fingerprint"), *[F.col("fingerprint").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)]]
    listed = staged(crowd.select("fingerprint", F.explode(F.array(*flips)).alias("point")), "listed")
    least = staged(listed.groupBy("point").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("b"))
                   .where("a < b").select("point", "a"), "least")
    star = (attach(listed, least, ["point"], F.col("fingerprint"))
            .where("a < fingerprint").select("a", F.col("fingerprint").alias("b")))
    return two.union(few).union(star).distinct()


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """Per row: key, fingerprint (hexadecimal) and component_id, the least key that links
    of at most RADIUS bits reach."""
    made = staged(fingerprints(df, text, [key], width), "fingerprints")
    least = staged(made.groupBy("fingerprint").agg(F.min(key).alias("_least")), "distinct")
    parts = staged(components(links(least.select("fingerprint"))), "components")
    rooted = least.join(parts, least["fingerprint"] == parts["node"], "left").select(
        "fingerprint", "_least", F.coalesce("root", "fingerprint").alias("_root"))
    ids = staged(rooted.groupBy("_root").agg(F.min("_least").alias("component_id")), "ids")
    named = staged(rooted.join(ids, "_root").select("fingerprint", "component_id"), "named")
    out = attach(made, named, ["fingerprint"], F.xxhash64(key))
    return out.select(key, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


# --- texts that share most of their shingles -----------------------------------------

_odd = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray) -> list[int]:
    """One key per band: a hash of ROWS least values under different permutations."""
    least = []
    for odd in _odd:
        mixed = hashes * odd
        mixed ^= mixed >> np.uint64(29)
        least.append((mixed * np.uint64(0xBF58476D1CE4E5B9)).min() if len(mixed) else np.uint64(0))
    rows = np.array(least, dtype="<u8").reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), i) - (1 << 63) for i, r in enumerate(rows)]


def similarity(a: str, b: str, width: int) -> float:
    """Share of the distinct shingles of two texts that both have; 1 if neither has any."""
    x, y = (np.unique(shingle_hashes(t or "", width)) for t in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def prefix(hashes: np.ndarray, common: np.ndarray, times: np.ndarray, least: float) -> tuple[np.ndarray, int]:
    """The rarest of a text's distinct hashes, in an order that is the same for all texts, and
    how many of them are not ``common`` (sorted, met so many ``times``). Two texts that share
    ``least`` of their hashes have one of these in common."""
    at = np.searchsorted(common, hashes)
    found = at < len(common)
    found[found] = common[at[found]] == hashes[found]
    weight = np.zeros(len(hashes), dtype=np.int64)
    weight[found] = times[at[found]]
    n = len(hashes) - int(np.ceil(least * len(hashes) - 1e-6)) + 1 if len(hashes) else 0
    return hashes[np.lexsort((hashes, weight))[:n]], int(len(hashes) - found.sum())


def _counted(df: DataFrame, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles met in several of a bounded number of texts, and how often. They only order
    the shingles: any order is right, a good one makes few candidates."""
    ship(df.sparkSession)
    every = max(1, df.count() // COUNTED)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x in batch[text]:
                yield pd.DataFrame({"_h": np.unique(shingle_hashes(x or "", width)).view(np.int64)})

    few = df.where(F.pmod(F.xxhash64("_row"), F.lit(every)) == 0).select(text)
    often = few.mapInPandas(made, "_h long").groupBy("_h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = often.orderBy(F.desc("n"), "_h").limit(COMMON).collect()
    common = np.array([r["_h"] for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(common)
    return common[order], np.array([r["n"] for r in rows], dtype=np.int64)[order]


def _signatures(df: DataFrame, text: str, width: int, least: float, printed: int) -> DataFrame:
    """Per row what finds its like: digests of the text, the fingerprint over shingles of
    ``printed`` words, and bands and rarest hashes of those of ``width`` words."""
    ship(df.sparkSession)
    common, times = _counted(df, text, width)
    schema = ("_row long, _same long, _same2 long, fingerprint long, _bands array<long>, "
              "_prefix array<long>, _size int, _rare int")

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row, x in zip(batch["_row"], batch[text]):
                hashes = shingle_hashes(x or "", width)
                raw = (x or "").encode("utf-8")
                distinct = np.unique(hashes)
                first, rare = prefix(distinct, common, times, least)
                rows.append((row, *[xxhash.xxh64_intdigest(raw, s) - (1 << 63) for s in (1, 2)],
                             simhash(hashes if printed == width else shingle_hashes(x or "", printed)), bands(distinct), first.view(np.int64), len(distinct), rare))
            yield pd.DataFrame(rows, columns=["_row", "_same", "_same2", "fingerprint", "_bands",
                                              "_prefix", "_size", "_rare"])

    return df.select("_row", text).mapInPandas(made, schema)


def near_copies(df: DataFrame, text: str = "text", width: int = 5, least: float = 0.8, grid: int | None = None) -> DataFrame:
    """(row, root): the group of every row of ``df``, which has ``_row`` and is stored.

    With ``grid``, groups also join what ``classes`` joins for shingles of that width: there
    fingerprints at most RADIUS bits apart link as they are.

    Groups join equal texts, and texts that share ``least`` of their shingles. One
    64-bit fingerprint does not find these: at 0.8 it differs in 4 to 14 bits. So
    candidates are texts whose fingerprints link on the grid, and texts that meet in a
    band of least hashes; every candidate pair is verified on the whole texts. In a band
    all texts are compared with one of them, another one in each band, never in pairs.
    What these leave apart is joined exactly (``_completed``).
    """
    rows = df.select("_row", text)
    signed = staged(_signatures(rows, text, width, least, grid or width), "signatures")
    same = staged(signed.groupBy("_same", "_same2").agg(F.min("_row").alias("_first")), "same")
    own = staged(signed.join(same, signed["_row"] == same["_first"]).select(
        "_row", "fingerprint", "_bands"), "distinct_texts")
    # rows of equal texts, linked to the first
    equal = (attach(signed.select("_row", "_same", "_same2"), same, ["_same", "_same2"], F.xxhash64("_row"))
             .select(F.col("_first").alias("a"), F.col("_row").alias("b")).where("a < b"))
    # pairs by fingerprint: one text stands for a fingerprint, others are compared with it
    marks = staged(own.groupBy("fingerprint").agg(F.min("_row").alias("_mark")), "marks")
    grid = links(marks.select("fingerprint"))
    mark = lambda side: marks.select(F.col("fingerprint").alias(side), F.col("_mark").alias(f"_{side}"))
    by_grid = grid.join(mark("a"), "a").join(mark("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    by_mark = (attach(own.select("_row", "fingerprint"), marks, ["fingerprint"], F.xxhash64("_row"))
               .select(F.col("_mark").alias("a"), F.col("_row").alias("b")))
    # pairs by band: the member with the least hash, under one of four orders
    members = staged(own.select("_row", F.posexplode("_bands").alias("_n", "_band"))
                     .select("_row", "_band", F.xxhash64("_row", F.pmod("_n", F.lit(4))).alias("_rank")), "bands")
    lead = staged(members.groupBy("_band").agg(F.min("_rank").alias("_lead"), F.count(F.lit(1)).alias("_met"))
                  .where("_met > 1").drop("_met"), "leads")
    led = attach(members, lead, ["_band"], F.xxhash64("_row")).where(F.col("_lead").isNotNull())
    leader = staged(led.where("_rank = _lead").groupBy("_band").agg(F.min("_row").alias("_leader")), "leaders")
    by_band = (attach(led, leader, ["_band"], F.xxhash64("_row"))
               .select(F.col("_leader").alias("a"), F.col("_row").alias("b")))
    by_print = by_grid.union(by_mark)
    ordered = lambda pairs: (pairs.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    pairs = staged(ordered(by_band if grid else by_print.union(by_band)), "pairs")
    verified = staged(_verified(rows, pairs, text, width, least), "verified")
    if grid:
        verified = verified.union(staged(ordered(by_print), "linked"))
    firsts = same.select(F.col("_first").alias("_row"))
    parts = _completed(rows, signed, firsts, verified.union(equal), text, width, least)
    return staged(parts.select(F.col("node").alias("_row"), F.col("root").alias("_root")), "groups")


def _marked(shared: DataFrame) -> np.ndarray:
    """A map of MAP_BITS bits, set for the shingles ``_h`` in ``shared``. Others may hit a set bit,
    the more the more there are, so what passes it is still to be joined."""
    places = shared.select(F.pmod("_h", F.lit(MAP_BITS)).alias("_bit")).distinct()

    def packed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(PART_BITS, dtype=np.uint8)
        bits[part["_bit"].to_numpy() % PART_BITS] = 1
        return pd.DataFrame({"_part": [key[0]], "_bits": [np.packbits(bits, bitorder="little").tobytes()]})

    parts = places.groupBy(F.shiftright("_bit", PART_BITS.bit_length() - 1).alias("_part")).applyInPandas(
        packed, "_part long, _bits binary")
    marked = np.zeros(MAP_BITS // 8, dtype=np.uint8)
    width = PART_BITS // 8
    for row in parts.collect():
        marked[row["_part"] * width:(row["_part"] + 1) * width] = np.frombuffer(row["_bits"], dtype=np.uint8)
    return marked


def _listed(chosen: DataFrame, marked: np.ndarray) -> DataFrame:
    """An entry for every rarest shingle of a text whose bit is set."""
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ats, shingles = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for first in batch["_prefix"]:
                first = np.asarray(first, dtype=np.int64)
                bit = first & (MAP_BITS - 1)
                ats.append(np.flatnonzero(marked[bit >> 3] >> (bit & 7).astype(np.uint8) & 1))
                shingles.append(first[ats[-1]])
            times = [len(x) for x in ats[1:]]
            yield pd.DataFrame({**{c: np.repeat(batch[c].to_numpy(), times) for c in ("_row", "_size", "_rare")},
                                "_at": np.concatenate(ats), "_h": np.concatenate(shingles)})

    return chosen.select("_row", "_size", "_rare", "_prefix").mapInPandas(
        made, "_row long, _size int, _rare int, _at int, _h long")


def _completed(rows: DataFrame, signed: DataFrame, firsts: DataFrame, found: DataFrame, text: str, width: int,
               least: float) -> DataFrame:
    """(node, root): components of the links ``found`` and of all pairs that share ``least``
    of their shingles. ``firsts`` are the rows of different texts.

    Texts of such a pair have one of their rarest shingles in common (``prefix``), and at
    the first such the shingles left in both are enough for the overlap. Only pairs of
    different components are compared, so one aggregation first finds the shingles that
    several components share (the least and the greatest component that has it); entries of
    other shingles hardly move (``_marked``). A pair's texts move if the shared ones among its rarest
    shingles and all that may follow them are enough. Where many texts share a shingle, the one with the
    fewest uncommon shingles, as the original among its copies, is compared with the others
    first, and once more among those left apart if that links any; then all pairs.
    """
    parts = staged(components(found), "components")

    def rooted(entries: DataFrame) -> DataFrame:
        named = entries.join(parts.select(F.col("node").alias("_row"), F.col("root").alias("_part")), "_row", "left")
        return named.withColumn("_part", F.coalesce("_part", "_row"))

    # rows are chosen and meet their component before their entries are taken apart
    chosen = staged(signed.select("_row", "_size", "_rare", "_prefix").join(firsts, "_row", "left_semi"), "chosen")
    sides = (rooted(chosen.select("_row", "_prefix")).select("_part", F.explode("_prefix").alias("_h"))
             .groupBy("_h").agg(F.min("_part").alias("_lo"), F.max("_part").alias("_hi")))
    shared = staged(sides.where("_lo < _hi").select("_h", F.lit(True).alias("_shared")), "shared")
    listed = _listed(chosen, _marked(shared))
    listed = staged(attach(listed, shared, ["_h"], F.col("_row")).where("_shared").drop("_shared"), "postings")

    def apart(entries: DataFrame) -> DataFrame:
        """Entries of shingles that texts of different components share, and their number."""
        named = staged(rooted(entries), "named")
        open_ = staged(named.groupBy("_h").agg(F.min("_part").alias("_lo"), F.max("_part").alias("_hi"), F.count(F.lit(1)).alias("_n"))
                       .where("_lo < _hi").select("_h", "_n"), "open")
        return staged(attach(named, open_, ["_h"], F.col("_row")).where("_n IS NOT NULL"), "apart")

    def fits(a: str, b: str) -> Column:
        size = F.col(f"{a}_size") + F.col(f"{b}_size")
        left = F.least(F.col(f"{a}_size") - F.col(f"{a}_at"), F.col(f"{b}_size") - F.col(f"{b}_at"))
        return (F.col(f"{a}_part") != F.col(f"{b}_part")) & enough(left, size)

    def enough(shared: Column, size: Column) -> Column:
        return shared * (1 + least) >= size * least - 1e-6

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return staged(_verified(rows, staged(pairs, "pairs"), text, width, least), "verified")

    columns = ["_row", "_size", "_rare", "_at", "_h"]
    rest = open_ = apart(listed)
    for _ in range(LEADS):
        crowded = rest.where(F.col("_n") > BLOCK)
        first = crowded.groupBy("_h").agg(F.min(F.struct(
            (F.col("_rare") / F.col("_size")).alias("_share"), F.col("_row"), F.col("_size"), F.col("_at"), F.col("_part"))).alias("_l"))
        first = staged(first.select("_h", *[F.col(f"_l.{c}").alias(f"_l{c}") for c in ("_row", "_size", "_at", "_part")]), "leaders")
        if first.isEmpty():
            break
        led = staged(attach(crowded, first, ["_h"], F.col("_row")), "led")
        new = linked(led.where(fits("", "_l")).select(F.col("_l_row").alias("a"), F.col("_row").alias("b")))
        if new.isEmpty():
            break
        found = found.union(new)
        parts = staged(components(found), "components")
        # those that the leader's component does not hold now
        named = attach(led, parts.select(F.col("node").alias("_row"), F.col("root").alias("_now")), ["_row"], F.col("_at"))
        named = attach(staged(named, "now"), parts.select(F.col("node").alias("_l_row"), F.col("root").alias("_then")), ["_l_row"], F.col("_row"))
        rest = apart(staged(named.where(F.coalesce("_now", "_row") != F.coalesce("_then", "_l_row")).select(*columns), "rest"))
        open_ = None

    # all pairs, a crowded shingle's in blocks: no task gets them all
    open_ = (apart(listed) if open_ is None else open_).withColumn("_blocks", F.ceil(F.col("_n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("_row"), F.col("_blocks")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    side = lambda s: [F.col(c).alias(f"{s}{c}") for c in ("_row", "_size", "_at", "_part")]
    left = open_.select("_h", *side("x"), own.alias("_i"), others.alias("_j"))
    right = open_.select("_h", *side("y"), others.alias("_i"), own.alias("_j"))
    size = F.col("x_size") + F.col("y_size")
    met = left.join(right, ["_h", "_i", "_j"]).where(
        (F.col("x_row") < F.col("y_row")) & (F.col("x_part") != F.col("y_part")) & enough(F.least("x_size", "y_size"), size))
    # a pair meets at every shingle that the rarest of both have in common
    pairs = met.groupBy("x_row", "y_row").agg(
        F.count(F.lit(1)).alias("_both"), *[F.first(f"{s}_size").alias(f"{s}_size") for s in "xy"],
        *[f(f"{s}_at").alias(f"{s}_{n}") for s in "xy" for n, f in (("from", F.min), ("to", F.max))])
    # from the first such on, after the last, and beyond the rarest that end first in the common order
    beyond = lambda s: F.ceil(F.col(f"{s}_size") * least - 1e-6) - 1
    bounds = [F.least(*[F.col(f"{s}_size") - F.col(f"{s}_from") for s in "xy"]),
              F.col("_both") + F.least(*[F.col(f"{s}_size") - F.col(f"{s}_to") - 1 for s in "xy"]),
              F.col("_both") + F.greatest(beyond("x"), beyond("y"))]
    new = linked(pairs.where(enough(F.least(*bounds), size)).select(F.col("x_row").alias("a"), F.col("y_row").alias("b")))
    return parts if new.isEmpty() else components(found.union(new))


def _verified(rows: DataFrame, pairs: DataFrame, text: str, width: int, least: float) -> DataFrame:
    asked = pairs.select(F.col("a").alias("_row")).union(pairs.select(F.col("b").alias("_row"))).distinct()
    texts = staged(rows.join(asked, "_row", "left_semi"), "asked_texts")
    side = lambda s: texts.select(F.col("_row").alias(s), F.col(text).alias(f"_{s}"))

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [similarity(x, y, width) >= least for x, y in zip(batch["_a"], batch["_b"])]
            yield batch.loc[good, ["a", "b"]]

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(compared, "a long, b long")


def dedup(df: DataFrame, text: str = "text", width: int = 5, least: float = 0.8, grid: int | None = None) -> DataFrame:
    """The rows of ``df`` without near copies: of each group (``near_copies``) the first row in
    stored order stays. ``df`` must be a stored table, for its rows are numbered in several reads."""
    rows = given(df)
    read = rows.select("_row", F.col("_given")[text].alias("text"))
    gone = near_copies(read, "text", width, least, grid).where("_row <> _root").select("_row")
    return rows.join(gone, "_row", "left_anti").select("_given.*")
