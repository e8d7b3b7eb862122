"""Line dedup by a log-template tree.

A line is parsed to a leaf of fixed depth: its number of tokens and its first DEPTH
tokens, tokens with a digit standing as one variable. In a leaf with several forms the
most frequent token of every position (that of the least form if some are equally frequent)
makes the leaf's template; forms that agree with
it in SIMILAR of the positions belong to it, so that other variable fields are
generalised too. Among the forms left over, many lead a family at once: a form belongs to
the least leading form that agrees with it in SIMILAR of the positions. Two such forms have
one of a few segments of their tokens in common, so forms meet by segment, each with the
least form of the segment only; a form leads that finds no lesser one to belong to. Forms
whose lesser one belongs elsewhere meet again among themselves, so turns grow with the
logarithm of the forms of a leaf, not with their families. At last all forms that belong to
no other meet by segment in all pairs: one that agrees with a lesser leading form belongs to
it, together with what it leads. Any other form is a template of its own; so is every line of DEPTH tokens or fewer, all of which lead. A template that occurs
in two or more documents is dropped everywhere but in the first document (in stored order)
that has it, however long its lines are. Lines without a token are left alone.

Null texts stay null and have no lines; texts without a recurring template are
unchanged to the byte. A text may become empty; its row stays. Repeated rows are
documents of their own. An empty table gives an empty table. All other columns pass
unchanged; working columns start with ``_``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import GAP, SPACE, attach, given
from stratalens.llm.shingles import bound
from stratalens.sources.staging import staged

DEPTH, SIMILAR = 5, 0.8
#: Leading forms of a segment up to which all its pairs are compared at once; a block of larger ones.
BLOCK = 128
#: A form with more than this share of all lines is hot. So few forms can be that.
HOT = 1 / 1000
VARIABLE = "<*>"
#: A token with a digit, from its start to its end.
DIGIT_TOKEN = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*"


def lines(rows: DataFrame, text: str) -> DataFrame:
    """Per line with a token: row, place, form (tokens with variables masked) and leaf. A line
    whose tokens all lead has no leaf, for there is nothing to generalise."""
    parsed = F.transform(F.split(F.col(text), "\n", -1), _parsed)
    # taken from an array, so that no filter below repeats the parsing
    each = rows.where(F.col(text).isNotNull()).select("_row", F.posexplode(parsed).alias("_line", "_p"))
    formed = each.where(F.col("_p.form") != "").select("_row", "_line", F.col("_p.n").alias("_n"), F.col("_p.form").alias("_form"))
    leaf = F.when(F.col("_n") > DEPTH, F.xxhash64("_n", F.substring_index("_form", " ", DEPTH)))
    return formed.select("_row", "_line", "_form", leaf.alias("_leaf"))


def _parsed(raw: Column) -> Column:
    """Number of tokens and form of a line. Most lines have single blanks and no digit:
    plain searches spare them the patterns."""
    def spaced(bare: Column) -> Column:
        odd = reduce(lambda a, b: a | b, [F.contains(bare, F.lit(c)) for c in ("  ", *SPACE[1:])])
        return F.when(odd, F.regexp_replace(bare, GAP, " ")).otherwise(bare)

    def masked(plain: Column) -> Column:
        n = F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1
        form = F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, DIGIT_TOKEN, VARIABLE)).otherwise(plain)
        return F.struct(n.alias("n"), form.alias("form"))

    return bound(F.btrim(raw, F.lit(SPACE)), lambda bare: bound(spaced(bare), masked))


def hashed(formed: DataFrame) -> DataFrame:
    """Two hashes of the form, which together identify it."""
    return formed.withColumns({"_a": F.xxhash64("_form"), "_b": F.xxhash64("_form", F.lit(1))})


def templates(rows: DataFrame, text: str, forms: DataFrame) -> DataFrame:
    """(_a, _b, _template): the forms that belong to a template with others, given one row
    (_a, _b, _leaf) per form."""
    several = staged(forms.where("_leaf IS NOT NULL").groupBy("_leaf").agg(F.count(F.lit(1)).alias("_n"))
                     .where("_n > 1").select("_leaf", F.lit(True).alias("_several")), "several")
    inside = attach(lines(rows, text).where("_leaf IS NOT NULL"), several, ["_leaf"], F.col("_row")).where("_several")
    # tokens as their hashes: four bytes each, however long (they only tell tokens of one position
    # apart); those that lead to the leaf are alike
    tokens = F.transform(F.slice(F.split("_form", " "), F.lit(DEPTH + 1), F.size(F.split("_form", " "))), lambda x: F.hash(x))
    left = staged(hashed(inside).groupBy("_leaf", "_a", "_b", "_form").agg(F.count(F.lit(1)).alias("_times"))
                  .withColumn("_tokens", tokens).drop("_form"), "forms")
    voted, left = _voted(left)
    every, families = left, []
    while not left.isEmpty():
        near, left = _led(left)
        families.append(near)
    if families:
        voted = voted.union(_joined(every, staged(reduce(DataFrame.union, families), "families")))
    return staged(voted, "templates")


def _similar(a: Column, b: Column) -> Column:
    """Whether two forms of a leaf agree in SIMILAR of their positions, given the tokens
    after the DEPTH leading ones, in which they do agree."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return same + DEPTH >= (F.size(a) + DEPTH) * SIMILAR


def _voted(forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The forms that belong to the template of the most frequent tokens of their leaf, if
    two or more do, and those left of leaves with several."""
    # four bytes of a form's hash are enough to put forms of a leaf in an order
    votes = (forms.select("_leaf", "_times", F.shiftright("_a", 32).cast("int").alias("_by"),
                          F.posexplode("_tokens").alias("_at", "_token"))
             .groupBy("_leaf", "_at", "_token").agg(F.sum("_times").alias("_votes"), F.min("_by").alias("_by")))
    # the token with most votes; that of the least form if they tie, so that families of one
    # size are not mixed
    best = votes.groupBy("_leaf", "_at").agg(F.min(F.struct((-F.col("_votes")).alias("v"), "_by", "_token")).alias("_best"))
    shape = staged(best.groupBy("_leaf").agg(F.array_sort(F.collect_list(F.struct("_at", "_best._token"))).alias("_s"))
                   .select("_leaf", F.col("_s._token").alias("_shape")), "shapes")
    near = _similar(F.col("_tokens"), F.col("_shape"))
    tried = staged(attach(forms, shape, ["_leaf"], F.col("_a")).withColumn("_near", near).drop("_shape"), "tried")
    joined = staged(tried.groupBy("_leaf").agg((F.count_if(F.col("_near")) > 1).alias("_family")), "joined")
    tried = staged(attach(tried, joined, ["_leaf"], F.col("_a")).withColumn("_near", F.col("_near") & F.col("_family")), "voted")
    return tried.where("_near").select("_a", "_b", F.col("_leaf").alias("_template")), _several(tried.where("NOT _near"))


def _segments(tokens: Column) -> Column:
    """Hashes of one segment more than there may be differences, of the tokens after the
    leading ones. Segments without a token are alike."""
    n = F.size(tokens)
    number = (n + DEPTH - F.ceil((n + DEPTH) * SIMILAR) + 1).cast("int")
    start = lambda i: F.floor(i * n / number).cast("int")
    return F.transform(F.sequence(F.lit(0), number - 1),
                       lambda i: F.xxhash64(F.slice(tokens, start(i) + 1, start(i + 1) - start(i))))


def _led(forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The forms of families with their leader's template, and those that neither lead nor
    belong to a leader yet. The least form of a leaf leads, so every turn takes forms out."""
    own, lead, salt = ["_a", "_b"], ["_la", "_lb"], F.col("_a")
    keyed = forms.select("_leaf", *own, F.posexplode(_segments(F.col("_tokens"))).alias("_at", "_segment"))
    keys = ["_leaf", "_at", "_segment"]
    least = staged(keyed.groupBy(*keys).agg(F.min(F.struct(*own)).alias("_l"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
                   .select(*keys, F.col("_l._a").alias("_la"), F.col("_l._b").alias("_lb")), "segments")
    lesser = (F.col("_la") < F.col("_a")) | ((F.col("_la") == F.col("_a")) & (F.col("_lb") < F.col("_b")))
    met = attach(keyed, least, keys, salt).where(lesser).select(*own, F.struct(*lead).alias("_l"))
    # a form's lesser ones are no more than its segments
    pairs = staged(met.groupBy(*own).agg(F.collect_set("_l").alias("_ls")), "pairs")
    tokens = forms.select(*own, "_tokens")
    leads = staged(pairs.select(F.explode("_ls").alias("_l")).select(F.col("_l._la").alias("_a"), F.col("_l._lb").alias("_b"))
                   .distinct().withColumn("_leads", F.lit(True)), "leads")
    leading = staged(attach(tokens, leads, own, salt).where("_leads")
                     .select(F.col("_a").alias("_la"), F.col("_b").alias("_lb"), F.col("_tokens").alias("_other")), "leading")
    met = attach(tokens, pairs, own, salt).where("_ls IS NOT NULL").select(*own, "_tokens", F.explode("_ls").alias("_l"))
    met = attach(met.select(*own, "_tokens", "_l.*"), leading, lead, salt)
    met = staged(met.where(_similar(F.col("_tokens"), F.col("_other"))).select(*own, *lead), "met")
    follows = staged(met.select(F.col("_a").alias("_la"), F.col("_b").alias("_lb")).distinct()
                     .withColumn("_follows", F.lit(True)), "followers")
    joined = staged(attach(met, follows, lead, salt).where("_follows IS NULL").groupBy(*own)
                    .agg(F.min(F.struct(*lead)).alias("_l")).select(*own, "_l._la", "_l._lb"), "members")
    template = F.xxhash64("_la", "_lb").alias("_template")
    near = joined.select(*own, template).union(joined.select(*lead, template).distinct())
    follows = follows.select(F.col("_la").alias("_a"), F.col("_lb").alias("_b"))
    rest = staged(follows.join(joined, own, "left_anti").withColumn("_rest", F.lit(True)), "waiting")
    return near, staged(attach(forms, rest, own, salt).where("_rest").drop("_rest"), "forms")


def _joined(forms: DataFrame, families: DataFrame) -> DataFrame:
    """(_a, _b, _template) of ``families``, found among ``forms``, after the forms that belong to
    no other have met in all pairs of a segment. Crowded segments are compared in blocks, so no
    task gets all pairs of one."""
    own, lead, salt = ["_a", "_b"], ["_la", "_lb"], F.col("_a")
    name = F.xxhash64(*own)
    members = staged(families.where(name != F.col("_template")).select(*own, F.lit(True).alias("_belongs")), "belong")
    nodes = attach(forms, members, own, salt).where("_belongs IS NULL")
    keys = ["_leaf", "_at", "_segment"]
    keyed = nodes.select("_leaf", *own, "_tokens", F.posexplode(_segments(F.col("_tokens"))).alias("_at", "_segment"))
    met = staged(keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "leading_met")
    dealt = attach(keyed, met, keys, salt).where("_n IS NOT NULL").withColumn("_blocks", F.ceil(F.col("_n") / BLOCK).cast("int"))
    block = F.pmod(F.xxhash64("_b"), F.col("_blocks")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    left = dealt.select(*keys, "_a", "_b", "_tokens", block.alias("_i"), others.alias("_j"))
    right = dealt.select(*keys, F.col("_a").alias("_la"), F.col("_b").alias("_lb"), F.col("_tokens").alias("_other"),
                         others.alias("_i"), block.alias("_j"))
    lesser = (F.col("_la") < F.col("_a")) | ((F.col("_la") == F.col("_a")) & (F.col("_lb") < F.col("_b")))
    pairs = left.join(right, [*keys, "_i", "_j"]).where(lesser).where(_similar(F.col("_tokens"), F.col("_other")))
    edges = staged(pairs.select(*own, *lead).distinct(), "agreeing")
    rounds = []
    while not edges.isEmpty():  # the least form of those left leads, so every turn takes some out
        greater = staged(edges.select(F.col("_a").alias("_la"), F.col("_b").alias("_lb")).distinct()
                         .withColumn("_greater", F.lit(True)), "greater")
        led = attach(edges, greater, lead, salt).where("_greater IS NULL")
        now = staged(led.groupBy(*own).agg(F.min(F.struct(*lead)).alias("_l")).select(*own, "_l._la", "_l._lb"), "joined")
        rounds.append(now)
        gone = staged(now.select(*own, F.lit(True).alias("_gone")), "gone")
        edges = attach(edges, gone, own, F.col("_la")).where("_gone IS NULL").drop("_gone")
        edges = attach(edges, gone.select(F.col("_a").alias("_la"), F.col("_b").alias("_lb"), "_gone"), lead, salt)
        edges = staged(edges.where("_gone IS NULL").drop("_gone"), "agreeing")
    if not rounds:
        return families
    joined = staged(reduce(DataFrame.union, rounds), "joining")
    template = F.xxhash64(*lead)
    now = staged(joined.select(name.alias("_template"), template.alias("_now")), "now")
    moved = attach(families, now, ["_template"], salt).select(*own, F.coalesce("_now", "_template").alias("_template"))
    return (moved.union(joined.select(*own, template.alias("_template")))
            .union(joined.select(*lead, template.alias("_template"))).distinct())


def _several(rest: DataFrame) -> DataFrame:
    """The forms of leaves that have several."""
    rest = rest.select("_leaf", "_a", "_b", "_times", "_tokens")
    several = staged(rest.groupBy("_leaf").agg(F.min("_a").alias("_lo"), F.max("_a").alias("_hi"))
                     .where("_lo <> _hi").select("_leaf", F.lit(True).alias("_several")), "several")
    return staged(attach(rest, several, ["_leaf"], F.col("_a")).where("_several").drop("_several"), "forms")


def recurring(rows: DataFrame, text: str) -> DataFrame:
    """(_row, _line) of the lines to drop. What is decided is decided per form; lines meet
    the decision once."""
    keyed = staged(hashed(lines(rows, text)).drop("_form"), "lines")
    forms = staged(keyed.groupBy("_a", "_b").agg(
        F.min("_leaf").alias("_leaf"), F.min("_row").alias("_first"), F.max("_row").alias("_last"),
        F.count(F.lit(1)).alias("_times")), "forms")
    general = templates(rows, text, forms)
    # one row per form on either side
    member = staged(forms.join(general, ["_a", "_b"]).drop("_leaf"), "generalised")
    whole = staged(member.groupBy("_template").agg(F.min("_first").alias("_start"), F.max("_last").alias("_end"))
                   .where("_start < _end").drop("_end"), "whole")
    member = attach(member, whole, ["_template"], F.col("_a")).where("_start IS NOT NULL")
    # a form that recurs by itself and as one of a template is dropped from the earlier first document on
    alone = forms.where("_first < _last").select("_a", "_b", "_first", "_times")
    either = alone.union(member.select("_a", "_b", F.col("_start").alias("_first"), "_times"))
    again = staged(either.groupBy("_a", "_b").agg(F.min("_first").alias("_first"), F.max("_times").alias("_times")), "recurring")
    return _later(keyed.select("_row", "_line", "_a", "_b"), again)


def _later(keyed: DataFrame, again: DataFrame) -> DataFrame:
    """(_row, _line) of the lines whose form's row is after the form's ``_first``. Hot forms,
    of which there are less than 1 / HOT, are broadcast; of any other, one task has less than
    HOT of all lines."""
    least = keyed.count() * HOT
    hot = F.broadcast(again.where(F.col("_times") > least).select("_a", "_b", F.col("_first").alias("_hot")))
    tried = keyed.join(hot, ["_a", "_b"], "left")
    cold = tried.where("_hot IS NULL").join(again.where(F.col("_times") <= least).select("_a", "_b", "_first"), ["_a", "_b"])
    return (tried.where("_row > _hot").select("_row", "_line")
            .union(cold.where("_row > _first").select("_row", "_line")))


def dedup(df: DataFrame, text: str = "text", dropped: str | None = None) -> DataFrame:
    """The rows of ``df`` without their recurring lines; ``dropped`` names a column for the
    numbers of the dropped lines. ``df`` must be a stored table, for its rows are numbered
    in several reads."""
    rows = given(df)
    body = F.col("_given")[text]
    narrow = rows.select("_row", body.alias("_text"))
    # the lines of one document at most
    gone = recurring(narrow, "_text").groupBy("_row").agg(F.collect_list("_line").alias("_gone"))
    joined = rows.join(gone, "_row", "left")

    def kept(v):
        order = F.array_except(F.sequence(F.lit(0), F.size(v["l"]) - 1), v["g"])
        return F.array_join(F.transform(order, lambda i: F.get(v["l"], i)), "\n")

    split = F.struct(F.split(body, "\n", -1).alias("l"), F.col("_gone").alias("g"))
    cleaned = F.when(F.col("_gone").isNull(), body).otherwise(bound(split, kept))
    names = [(F.col("_given")[c] if c != text else cleaned).alias(c) for c in df.columns]
    extra = [F.array_sort(F.coalesce("_gone", F.array().cast("array<int>"))).alias(dropped)] if dropped else []
    return joined.select(*names, *extra)
