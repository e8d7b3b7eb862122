"""Score bands and their display."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stratalens.functions.features import violation_score
from stratalens.functions.numeric import clip, round_exact, whole_text

# Lower bound, name and marker of each band.
BANDS = [
    (90, "Excellent", "🟢"),
    (75, "Good", "🟢"),
    (60, "Fair", "🟠"),
    (40, "Poor", "🔴"),
    (0, "Critical", "🔴"),
]


def _band(score: Column, position: int) -> Column:
    chain = None
    for band in BANDS[:-1]:
        hit = score >= F.lit(float(band[0]))
        value = F.lit(band[position])
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain.otherwise(F.lit(BANDS[-1][position]))


def score_label(score: Column) -> Column:
    return _band(score, 1)


def score_emoji(score: Column) -> Column:
    return _band(score, 2)


def score_display(score: Column, shown: Column | None = None) -> Column:
    """``marker band (NN/100)``."""
    return F.concat(
        score_emoji(score), F.lit(" "), score_label(score), F.lit(" ("),
        whole_text(score if shown is None else shown), F.lit("/100)"),
    )


def clip_score(raw: Column) -> Column:
    """Limit to 0..100, one decimal."""
    return round_exact(clip(raw), 1)


def rule_score() -> Column:
    """Score used where no fitted regressor is at hand: 100 less 8 points per
    unit of the composite violation score."""
    return F.lit(100.0) - F.lit(8.0) * violation_score()
