"""Document fingerprints by a homomorphic multiset hash.

Each paragraph (line with a word) is hashed to a wide vector; a document's fingerprint
is the sum of its paragraphs' vectors, each lane modulo a power of two. So order does
not matter, equal multisets have equal fingerprints, and a paragraph is inserted or
deleted by adding or subtracting its vector (``combine``).

The first EXACT lanes (32 bits) come from hashes of the whole paragraph: they tell
multisets apart. The other LANES lanes (16 bits, signed) sum +1 or -1 per pair of
neighbouring words: the cosine of two such vectors estimates how much the texts share.
Where a sum outgrows its lane, likeness takes the sums themselves (``wide``).

Null texts count as empty: all lanes zero. Two texts without words have likeness 1,
such a text and one with words 0. ``edited`` sorts by key with nulls first; rows with
equal keys follow their stored order, repeated rows are documents of their own. An
empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import numbered, text_of, with_row, words
from stratalens.llm.shingles import bit_counts, bit_sums
from stratalens.sources.staging import staged

EXACT, LANES = 8, 128
EXACT_MASK, LANE_MASK, LANE_SIGN = (1 << 32) - 1, (1 << 16) - 1, 1 << 15


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))


def exact_lanes(parts: Column) -> list[Column]:
    """Sums of the hashes of whole paragraphs, modulo 2**32."""
    def lane(seed: int, high: bool) -> Column:
        def half(x: Column) -> Column:
            hashed = F.xxhash64(x, F.lit(seed))
            return F.shiftrightunsigned(hashed, 32) if high else hashed.bitwiseAND(F.lit(EXACT_MASK))
        return F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, x: s + half(x)) % (EXACT_MASK + 1)

    return [lane(i // 2, bool(i % 2)) for i in range(EXACT)]


def _hex(value: Column, digits: int) -> Column:
    return F.lower(F.lpad(F.hex(value), digits, "0"))


def vectors(rows: DataFrame, by: list[str], body: str) -> DataFrame:
    """Per row of ``by`` (unique, and partitioned by a part of it where possible): the exact
    lanes as bytes, and the likeness lanes as an array of signed numbers, for long texts
    also the sums before they are reduced to lanes."""
    parts = rows.select(*by, paragraphs(F.col(body)).alias("_parts"))
    # the exact lanes ride along as one grouping key: they are known per row
    parts = parts.select(*by, "_parts", F.concat(*[_hex(x, 8) for x in exact_lanes(F.col("_parts"))]).alias("_exact"))
    lines = parts.select(*by, "_exact", F.explode_outer("_parts").alias("_part"))
    units = words(text_of("_part"))
    pairs = lines.select(*by, "_exact", units.alias("_u"))
    pairs = pairs.select(*by, "_exact", F.explode_outer(
        F.arrays_zip(F.col("_u").alias("a"), F.slice("_u", 2, F.greatest(F.size("_u"), F.lit(1))).alias("b"))).alias("_p"))
    there = F.col("_p").isNotNull()
    hashed = pairs.select(*by, "_exact", F.when(there, F.xxhash64("_p")).alias("_h"),
                          F.when(there, F.xxhash64("_p", F.lit(1))).alias("_g"))
    sums = hashed.groupBy(*by, "_exact").agg(F.count("_h").alias("_n"), *bit_sums("_h", "_x"), *bit_sums("_g", "_y"))
    # an array first: the 128 sums are written out once, both forms are short loops over it
    whole = F.array(*[c * 2 - F.col("_n") for c in bit_counts("_x") + bit_counts("_y")])
    summed = sums.select(*by, F.unhex("_exact").alias("exact"), "_n", whole.alias("_whole"))
    lane = lambda s: (s.bitwiseAND(F.lit(LANE_MASK)).bitwiseXOR(F.lit(LANE_SIGN)) - LANE_SIGN).cast("smallint")
    # no sum exceeds the number of pairs
    wide = F.when(F.col("_n") >= LANE_SIGN, F.transform("_whole", lambda s: s.cast("int")))
    return summed.select(*by, "exact", F.transform("_whole", lane).alias("lanes"), wide.alias("wide"))


def compared(lanes: str, wide: str) -> Column:
    """What ``likeness`` takes."""
    return F.coalesce(F.col(wide), F.col(lanes).cast("array<int>"))


def shown(exact: str, lanes: str) -> Column:
    """The fingerprint as a string: all lanes in hexadecimal."""
    each = F.transform(lanes, lambda x: _hex(x.cast("bigint").bitwiseAND(F.lit(LANE_MASK)), 4))
    return F.concat(F.lower(F.hex(exact)), F.array_join(each, ""))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of two vectors of likeness lanes, at least 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    empty = F.when((dot(a, a) == 0) & (dot(b, b) == 0), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(norm == 0, empty).when(a == b, F.lit(1.0)).otherwise(
        F.least(F.greatest(dot(a, b) / norm, F.lit(0.0)), F.lit(1.0)))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of both multisets together (sign 1), or of the first without the
    second (sign -1)."""
    def lane(i: int) -> Column:
        digits, start = (8, 8 * i) if i < EXACT else (4, 8 * EXACT + 4 * (i - EXACT))
        number = lambda x: F.conv(F.substring(x, start + 1, digits), 16, 10).cast("bigint")
        return _hex(F.pmod(number(a) + number(b) * sign, F.lit(1 << 4 * digits)), digits)
    return F.concat(*[lane(i) for i in range(EXACT + LANES)])


def fingerprint(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key and fingerprint. ``df`` must be a stored table."""
    rows = with_row(df.select(key, text), "_row").select("_row", key, text_of(text).alias("_body"))
    return vectors(rows, ["_row", key], "_body").select(key, shown("exact", "lanes").alias("fingerprint"))


def edited(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, in which the last half of the
    code points is replaced by the first as many of the next text (after the last: the
    first). Texts move twice: whole, to their own row, and half, to the row before."""
    rows = with_row(df.select(key, text), "_row").withColumn("_body", text_of(text))
    order = numbered(rows.select("_row", key, F.length("_body").cast("bigint").alias("_chars")), [key, "_row"], "_place")
    order = staged(order, "order")
    n = order.count()
    behind = order.select(F.col("_place").alias("_p"), F.col("_row").alias("_before"), F.col(key).alias("_key"),
                          F.col("_chars").alias("_n"))
    chain = staged(order.join(behind, order["_place"] == F.pmod(F.col("_p") + 1, F.lit(max(n, 1))))
                   .select("_row", "_before", "_key", "_n"), "chain")
    texts = rows.select("_row", "_body")
    heads = texts.join(chain, "_row").select(
        F.col("_before").alias("_row"), F.col("_row").alias("_next"), F.col("_key").alias("_id"), F.col("_n").alias("n_chars"),
        F.substring("_body", F.lit(1), F.expr("cast(_n div 2 as int)")).alias("_head"))
    both = texts.join(heads, "_row")
    kept = F.substring("_body", F.lit(1), F.expr("cast(n_chars - n_chars div 2 as int)"))
    both = both.select("_row", "_next", "_id", "n_chars", "_body", F.concat(kept, "_head").alias("_edit"))
    forms = both.select("_row", "_next", "_id", "n_chars", F.unhex(F.sha2("_edit", 256)).alias("_sha"), F.explode(F.array(
        F.struct(F.lit(0).alias("form"), F.col("_body").alias("body")),
        F.struct(F.lit(1).alias("form"), F.col("_edit").alias("body")))).alias("_f"))
    forms = forms.select("_row", "_next", "_id", "n_chars", "_sha", F.col("_f.form").alias("_form"), F.col("_f.body").alias("_body"))
    by = ["_row", "_next", "_id", "n_chars", "_sha"]
    made = vectors(forms, [*by, "_form"], "_body")
    # both forms of a row are in one task already; lanes stay numbers until the end
    form = lambda n, c: F.first(F.when(F.col("_form") == n, F.col(c)), ignorenulls=True)
    made = staged(made.groupBy(*by).agg(form(0, "exact").alias("_x"), form(0, "lanes").alias("_l"),
                                        form(0, "wide").alias("_w"), form(1, "exact").alias("_ex"),
                                        form(1, "lanes").alias("_el"), form(1, "wide").alias("_ew")), "vectors")
    after = made.select(F.col("_row").alias("_next"), F.col("_l").alias("_a"), F.col("_w").alias("_aw"))
    out = made.join(after, "_next")
    return out.select(F.col("_id").alias(key), "n_chars", F.lower(F.hex("_sha")).alias("edited_sha256"),
                      shown("_x", "_l").alias("fingerprint"), shown("_ex", "_el").alias("edited_fingerprint"),
                      likeness(compared("_l", "_w"), compared("_el", "_ew")).alias("near_edited"),
                      likeness(compared("_l", "_w"), compared("_a", "_aw")).alias("near_next"))
