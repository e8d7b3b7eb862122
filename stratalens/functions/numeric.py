"""Rounding and means that do not depend on how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_exact(x: Column, digits: int) -> Column:
    """Round a double half-to-even on its exact binary value.

    ``bround`` looks at the shortest decimal text, so it sees 0.15 as a tie
    although the stored double lies below it. Here ``x * 10^digits`` is
    carried as a sum of two doubles (Dekker's exact product), which makes the
    comparison with the midpoint exact. Works for |x| far below 2^53.
    """
    scale = float(10 ** digits)
    product = x * F.lit(scale)
    split = x * F.lit(134217729.0)
    high = split - (split - x)
    low = x - high
    residue = (high * scale - product) + low * scale
    whole = F.floor(product)
    off_middle = (product - whole) - F.lit(0.5)
    up = (off_middle > 0) | (
        (off_middle == 0) & ((residue > 0) | ((residue == 0) & (whole % 2 != 0)))
    )
    return (whole + F.when(up, 1).otherwise(0)).cast("double") / F.lit(scale)


def whole_text(x: Column) -> Column:
    """A number with no decimals, ties to even."""
    return F.rint(x).cast("bigint").cast("string")


# Doubles below 2^7 and 1 are whole multiples of 2^-56 and 2^-60 (down to 0.1
# and 1/256), so scaled by these powers they are whole numbers.
SCORE_BITS, SHARE_BITS = 56, 60


def exact_sum(x: Column, bits: int) -> Column:
    """Sum of doubles as a decimal count of 2^-bits. Whole numbers add up to
    the same total in any order, doubles do not."""
    return F.sum((x * F.lit(2.0 ** bits)).cast("bigint").cast("decimal(28,0)"))


def exact_mean(total: Column, count: Column, bits: int) -> Column:
    """Mean from an exact sum, rounded once for the sum and once for the mean."""
    return total.cast("double") / F.lit(2.0 ** bits) / count.cast("double")


def clip(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
