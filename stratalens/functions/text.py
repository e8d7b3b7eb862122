"""Source text and names shown to people."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Characters that end a line (besides the pair CR LF), and the
# marker left where lines were cut.
LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029"
CUT_MARKER = "\n// ... ({n} more lines truncated)"


def _with_plain_breaks(code: Column) -> Column:
    """Every line end as LF. Looking for the rare ones is much cheaper than
    mapping each character, so texts without any pass through."""
    rare = LINE_ENDS.replace("\n", "")
    has_rare = reduce(lambda a, b: a | b, [F.contains(code, F.lit(c)) for c in rare])
    paired = F.replace(code, F.lit("\r\n"), F.lit("\n"))
    return F.when(has_rare, F.translate(paired, rare, "\n" * len(rare))).otherwise(code)


def truncate_lines(code: Column, max_lines: int = 300) -> Column:
    """Keep the first ``max_lines`` lines and say how many were left out.
    Plain string functions throughout: the text is never split into an array."""
    text = _with_plain_breaks(code)
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    # A break at the very end closes the last line, it does not open another.
    count = breaks + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)
    before, after = CUT_MARKER.split("{n}")
    return F.when(count <= max_lines, code).otherwise(
        F.concat(
            F.substring_index(text, "\n", max_lines), F.lit(before),
            (count - max_lines).cast("string"), F.lit(after),
        )
    )


def title_name(key: Column) -> Column:
    """Readable form of a key that has no catalogue entry: every run of
    letters begins with a capital."""
    runs = F.regexp_extract_all(F.replace(key, F.lit("_"), F.lit(" ")), F.lit("\\p{L}+|\\P{L}+"), 0)
    return F.array_join(F.transform(runs, F.initcap), "")


def or_else(value: Column, other: Column) -> Column:
    """``value`` unless it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), other)
