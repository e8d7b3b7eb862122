"""Quality rules with thresholds that adapt to language and source.

``measures`` takes the figures of a text; a fixed base rule rejects very short and
very repetitive texts. The other rules look at shares (in ten-thousandths): symbols
among word characters, upper-case words, repeated lines, words in repeated
three-word windows, and the mean word length. Quantile sketches of each share per
language and source hold counts in buckets of fixed relative width; adding counts
merges sketches, exactly and in any order.

A sketch's fence is its third quartile plus a multiple (``RULES``) of the spread of its
quartiles. Most texts have no repeated line or upper-case word at all, so for such
shares the quartiles are those of the texts that have any. Only a spread below a small
tolerance is widened to it. Fences are pooled by weight: a language's fence counts as
many texts as its sketch, that of all texts as POOL more; a source's fence is pooled with
its language's in the same way. So a group decides by itself the more the larger it is,
and no size is a limit. Thresholds are joined to the rows and filter them.

Only texts that the base rule keeps enter the sketches. Null texts count as empty
and are rejected by the base rule; null languages and sources are groups of their
own. Repeated rows count as often as they occur. An empty table gives an empty
table. ``filter_rows`` passes all columns unchanged; working columns start with ``_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.llm.common import attach, given, text_of, words
from stratalens.llm.shingles import hashed_windows, repeated_units, shifted_left, shifted_right
from stratalens.sources.staging import staged

# Fixed values of the base rule.
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 50, 50, 3
SYMBOLS = r"[#*$%&|<>]+"

#: Per share: whether texts without any count in the quartiles, the multiple of the spread, and
#: the least spread. Prose has hardly a symbol, so there the texts without any are the measure.
RULES = {"symbol_share": (True, 3, 100), "upper_share": (False, 16, 20), "dup_line_share": (False, 4, 500),
         "repeat_share": (False, 12, 100), "word_length": (True, 5, 500)}
#: Texts that a coarser sketch counts as in a finer one's fence.
POOL = 50
#: Values below 2**DIGITS have buckets of their own, larger ones keep so many leading bits.
DIGITS = 7


def measures(text: Column) -> dict[str, Column]:
    """Figures of a text, in terms of ``_words`` and ``_hashes`` (see ``measured``)."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    n = F.size("_words")
    return {
        "n_words": n.cast("bigint"),
        "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("bigint"),
        "n_lines": F.size(lines).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        "n_repeat_words": repeated_units(F.col("_hashes"), WINDOW).cast("bigint"),
        "n_upper": F.regexp_count(text, F.lit(r"(?<!\p{L})\p{Lu}{2,}(?!\p{L})")).cast("bigint"),
    }


def measured(df: DataFrame, text: str, also: list[str]) -> DataFrame:
    """The columns ``also`` and the figures of each row's text."""
    body = text_of(text)
    rows = df.select(*also, body.alias("_text"), words(body).alias("_words"))
    rows = rows.withColumn("_hashes", hashed_windows(F.col("_words"), WINDOW))
    figures = measures(F.col("_text"))
    return rows.select(*also, *[c.alias(n) for n, c in figures.items()])


def base_failed() -> Column:
    return ((F.col("n_words") < LEAST_WORDS)
            | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT))


def _per_myriad(part: str, whole: str) -> Column:
    share = F.expr(f"({part} * 10000) div greatest({whole}, 1)")
    return share.cast("bigint")


def shares() -> dict[str, Column]:
    return {"symbol_share": _per_myriad("n_symbols", "word_chars"),
            "upper_share": _per_myriad("n_upper", "n_words"),
            "dup_line_share": _per_myriad("n_dup_lines", "n_lines"),
            "repeat_share": _per_myriad("n_repeat_words", "n_words"),
            "word_length": _per_myriad("word_chars", "n_words")}


def bucket(value: Column) -> Column:
    """The least value of its bucket: all but the DIGITS leading bits cleared."""
    drop = F.greatest(F.length(F.bin(value)) - DIGITS, F.lit(0))
    return shifted_left(shifted_right(value, drop), drop)


def sketches(rows: DataFrame, group: list[str]) -> DataFrame:
    """Counts by group, share and bucket."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), bucket(F.col(n)).alias("value"))
                                for n in RULES]))
    return (rows.select(*group, pairs.alias("_p"))
            .groupBy(*group, "_p.rule", "_p.value").agg(F.count(F.lit(1)).alias("n")))


def merged(sketch: DataFrame, group: list[str]) -> DataFrame:
    """Sketches of coarser groups."""
    return sketch.groupBy(*group, "rule", "value").agg(F.sum("n").alias("n"))


def _of_rule(place: int) -> Column:
    """A parameter of the row's rule."""
    return F.create_map(*[F.lit(x) for name, how in RULES.items() for x in (name, how[place])])[F.col("rule")]


def fences(sketch: DataFrame, group: list[str]) -> DataFrame:
    """Per group and rule: how many texts count, the fence (null if none does), and whether
    the spread is the sketch's own."""
    within = Window.partitionBy(*group, "rule")  # a bounded number of buckets
    counted = F.when(_of_rule(0) | (F.col("value") > 0), F.col("n")).otherwise(F.lit(0))
    run = (sketch.withColumn("_n", counted).withColumn("_all", F.sum("_n").over(within))
           .withColumn("_upto", F.sum("_n").over(within.orderBy("value"))))
    quartile = lambda q: F.min(F.when((F.col("_upto") * 4 >= F.col("_all") * q) & (F.col("_upto") > 0), F.col("value")))
    found = run.groupBy(*group, "rule").agg(F.max("_all").alias("texts"), quartile(1).alias("_q1"), quartile(3).alias("_q3"))
    own, least = F.col("_q3") - F.col("_q1"), _of_rule(2).cast("bigint")
    return found.select(*group, "rule", "texts", (F.col("_q3") + F.greatest(own, least) * _of_rule(1)).alias("most"),
                        F.coalesce(own > least, F.lit(False)).alias("decided"))


def pooled(texts: str, most: str, coarser: str) -> Column:
    """The weighted mean of a fence and a coarser one."""
    mean = F.expr(f"({texts} * {most} + {POOL} * {coarser}) div ({texts} + {POOL})")
    return F.coalesce(mean, F.col(coarser), F.col(most)).cast("bigint")


def fence_table(rows: DataFrame, lang: str, source: str) -> DataFrame:
    """Per language, source and rule: the pooled fence as ``most``, the group's own as ``own``,
    and whether its sketch's spread decided that."""
    fine = staged(sketches(rows, [lang, source]), "sketches")
    by_lang = merged(fine, [lang])
    own, lang_, all_ = fences(fine, [lang, source]), fences(by_lang, [lang]), fences(merged(by_lang, []), [])
    lang_ = lang_.select(F.col(lang).alias("_l"), F.col("rule").alias("_r"),
                         F.col("texts").alias("_lt"), F.col("most").alias("_lm"))
    all_ = all_.select(F.col("rule").alias("_ar"), F.col("most").alias("_am"))
    chosen = (own.join(lang_, own[lang].eqNullSafe(F.col("_l")) & (F.col("rule") == F.col("_r")))
              .join(F.broadcast(all_), F.col("rule") == F.col("_ar")))  # one row per rule
    chosen = chosen.withColumn("_pl", pooled("_lt", "_lm", "_am"))
    return chosen.select(lang, source, "rule", "texts", "decided", F.col("most").alias("own"),
                         pooled("texts", "most", "_pl").alias("most"))


def thresholds(rows: DataFrame, lang: str, source: str) -> DataFrame:
    """Per language and source one row: the most that each rule lets pass."""
    return fence_table(rows, lang, source).groupBy(lang, source).agg(*[
        F.max(F.when(F.col("rule") == n, F.col("most"))).alias(f"most_{n}") for n in RULES])


def judged(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
           also: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the columns ``also``, all figures, base_failed and kept."""
    keys = list(dict.fromkeys([*also, lang, source]))
    rows = measured(df, text, keys)
    rows = staged(rows.withColumns({**shares(), "base_failed": base_failed()}), "measured")
    most = staged(thresholds(rows.where(~F.col("base_failed")), lang, source), "thresholds")
    rows = attach(rows, most, [lang, source], F.xxhash64("n_words", "word_chars", *also))
    over = F.lit(False)
    for n in RULES:
        over = over | F.coalesce(F.col(n) > F.col(f"most_{n}"), F.lit(False))
    return rows.withColumn("kept", ~F.col("base_failed") & ~over)


def filter_rows(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``df`` that pass. ``df`` must be a stored table, for its rows are
    numbered in two reads."""
    rows = given(df)
    read = rows.select("_row", *[F.col("_given")[c].alias(n) for c, n in
                                 ((text, "text"), (lang, "lang"), (source, "source"))])
    good = judged(read, also=("_row",)).where("kept").select("_row")
    return rows.join(good, "_row").select("_given.*")
