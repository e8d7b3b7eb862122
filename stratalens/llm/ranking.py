"""Quality classifier by Bradley-Terry pairwise ranking.

A document's utility is linear in figures of its text. Weights are learned from
preference pairs (a document of label 1 over one of label 0) by logistic loss on the
differences of their figures. The utility below which the share of label 0 among the
labelled documents lies becomes the cut: the score is logistic in the utility and
meets CUT there.

Fitting takes all labelled rows and all their pairs: a Newton step needs only sums over
bins of the utility per label, and a pair counts with the mean utilities of its bins.
The cut is exact. Scoring reads every whole text once. Null texts count as empty and are
scored like others. Without rows of both labels all weights are 0 and every score is
0.5. Repeated rows are scored alike; repeated labels count as often as they occur.
An empty table gives an empty table. Language, source, labels and keys are no inputs
of a score.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.llm.quality_rules import measured
from stratalens.sources.staging import staged

# A score from CUT on predicts label 1; keys whose checksum leaves 0 are held out.
CUT, FOLDS = 0.3, 5
#: Bins of utilities, steps of a figure between 0 and 1 in sums, values sorted by the driver.
BINS, UNIT, FEW = 1000, 1 << 16, 10_000


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def figures() -> dict[str, Column]:
    """Inputs of the utility. A share enters at two scales, so that a little and a lot can
    weigh differently; each stays between 0 and 1."""
    shares = {"symbols": _share("n_symbols", "word_chars"), "upper": _share("n_upper", "n_words"),
              "dup_lines": _share("n_dup_lines", "n_lines"), "repeats": _share("n_repeat_words", "n_words")}
    found = {}
    for name, share in shares.items():
        for scale, most in (("little", 0.1), ("lot", 0.6)):
            found[f"{name}_{scale}"] = F.least(share / most, F.lit(1.0))
    length = _share("word_chars", "n_words")
    found["long_words"] = F.least(F.greatest(length - 6.0, F.lit(0.0)) / 6.0, F.lit(1.0))
    found["short_words"] = F.least(F.greatest(4.0 - length, F.lit(0.0)) / 4.0, F.lit(1.0))
    found["brief"] = F.least(F.greatest(F.lit(50.0) - F.col("n_words"), F.lit(0.0)) / 50.0, F.lit(1.0))
    found["size"] = F.least(F.log1p("n_words") / 12.0, F.lit(1.0))
    return found


@dataclass
class Ranking:
    weights: list[float]
    cut: float  # the utility at which the score is CUT
    agreement: float = 0.0  # share of all pairs in the right order

    def utility(self, names: list[str]) -> Column:
        return _utility(names, self.weights)

    def score(self, names: list[str]) -> Column:
        shift = math.log(CUT / (1 - CUT)) if any(self.weights) else 0.0
        return 1.0 / (1.0 + F.exp(-(self.utility(names) - self.cut + shift)))


def newton(sums: Callable[[np.ndarray], tuple], width: int, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights of the least penalised logistic loss over all pairs of a good and a bad row, and
    the share of the pairs they order rightly. ``sums`` takes weights and gives, per label
    (good, bad), the count, the sum of the figures and the sum of their products of every bin
    of utilities. A pair counts with the mean utilities of its bins."""
    w = np.zeros(width)
    right = 0.0
    for _ in range(30):
        (n1, s1, q1), (n0, s0, q0) = sums(w)
        gap = (s1 @ w / n1)[:, None] - (s0 @ w / n0)[None, :]
        pairs = n1.sum() * n0.sum()
        right = float((n1[:, None] * n0[None, :] * (gap > 0)).sum() / pairs)
        p = 1.0 / (1.0 + np.exp(np.clip(gap, -30, 30)))  # of the wrong order
        slope = -((p @ n0) @ s1 - (n1 @ p) @ s0) / pairs + penalty * w
        c = p * (1 - p)
        cross = s1.T @ c @ s0
        curve = np.tensordot(c @ n0, q1, 1) + np.tensordot(n1 @ c, q0, 1) - cross - cross.T
        step = np.linalg.solve(curve / pairs + penalty * np.eye(width), slope)
        w = w - step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w, right


def fit(good: np.ndarray, bad: np.ndarray, bad_share: float) -> Ranking:
    """The ranking of rows at hand, each a bin of its own; the cut is the ``bad_share``
    quantile of the utilities of both labels in their true shares."""
    width = good.shape[1] if good.ndim == 2 else bad.shape[1]
    if not len(good) or not len(bad):
        return Ranking([0.0] * width, 0.0)
    each = [(np.ones(len(x)), x, x[:, :, None] * x[:, None, :]) for x in (good, bad)]
    w, right = newton(lambda _: each, width)
    utility = np.concatenate([bad @ w, good @ w])
    mass = np.concatenate([np.full(len(bad), bad_share / len(bad)), np.full(len(good), (1 - bad_share) / len(good))])
    order = np.argsort(utility, kind="stable")
    at = min(int(np.searchsorted(np.cumsum(mass[order]), bad_share, side="right")), len(order) - 1)
    cut = (utility[order[max(at - 1, 0)]] + utility[order[at]]) / 2
    return Ranking([float(v) for v in w], float(cut), right)


def _utility(names: list[str], weights) -> Column:
    total = F.lit(0.0)
    for name, weight in zip(names, weights):
        total = total + F.col(name) * float(weight)
    return total


def binned_sums(known: DataFrame, names: list[str], weights: np.ndarray) -> tuple:
    """Per label (good, bad): counts, sums and sums of products of the figures by bins of the
    utility, over all rows. Figures count in whole multiples of 1 / UNIT, so sums are exact
    whatever their order; what comes to the driver is a row per label and bin."""
    low, high = float(np.minimum(weights, 0).sum()), float(np.maximum(weights, 0).sum())
    bin_ = F.floor((_utility(names, weights) - low) / ((high - low) or 1.0) * BINS)
    whole = [F.round(F.col(n) * UNIT).cast("bigint") for n in names]
    at = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    rows = known.groupBy("_label", bin_.alias("_bin")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(whole)],
        *[F.sum(whole[i] * whole[j]).alias(f"q{i}_{j}") for i, j in at]).collect()
    found = []
    for label in (1, 0):
        table = np.array([tuple(r)[2:] for r in sorted(rows, key=lambda r: r["_bin"]) if r["_label"] == label], dtype=float)
        squares = np.zeros((len(table), len(names), len(names)))
        for k, (i, j) in enumerate(at):
            squares[:, i, j] = squares[:, j, i] = table[:, 1 + len(names) + k] / UNIT**2
        found.append((table[:, 0], table[:, 1:1 + len(names)] / UNIT, squares))
    return tuple(found)


def nth_smallest(values: DataFrame, n: int) -> float:
    """The value of column ``u`` at place n (from 0) among all, found by counting ever
    narrower bins; only counts and at most FEW values come to the driver."""
    low, high, count = values.agg(F.min("u"), F.max("u"), F.count(F.lit(1))).first()
    while low < high:
        inside = values.where((F.col("u") >= low) & (F.col("u") <= high))
        if count <= FEW:
            return sorted(r["u"] for r in inside.collect())[n]
        bin_ = F.least(F.floor((F.col("u") - low) / (high - low) * BINS), F.lit(BINS - 1))
        for r in inside.groupBy(bin_.alias("_bin")).agg(
                F.min("u").alias("low"), F.max("u").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("_bin").collect():
            if n < r["n"]:
                low, high, count = r["low"], r["high"], r["n"]
                break
            n -= r["n"]
    return low


def fit_all(known: DataFrame, names: list[str]) -> Ranking:
    """The ranking of all rows of a stored table with ``_label`` and the figures ``names``."""
    counts = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Ranking([0.0] * len(names), 0.0)
    w, right = newton(lambda weights: binned_sums(known, names, weights), len(names))
    utility = known.select(_utility(names, w).alias("u"))
    # as many lie below the cut as have label 0
    cut = (nth_smallest(utility, counts[0] - 1) + nth_smallest(utility, counts[0])) / 2
    return Ranking([float(v) for v in w], cut, right)


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(FOLDS)) == 0, F.lit(False))


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
             label: str = "quality") -> DataFrame:
    """Per row: key, held_out, score, predicted."""
    names = list(figures())
    inputs = measured(df, text, [key]).select(key, *[c.alias(n) for n, c in figures().items()])
    inputs = staged(inputs, "figures")
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
    known = known.where(~held_out(F.col("_key")) & F.col("_label").isin(0, 1))
    known = staged(inputs.join(known, inputs[key] == known["_key"]).select("_key", "_label", *names), "labelled")
    ranking = fit_all(known, names)
    score = ranking.score(names)
    return inputs.select(key, held_out(F.col(key)).alias("held_out"), score.alias("score"),
                         (score >= CUT).cast("int").alias("predicted"))
