"""Secret scan: fixed patterns, and a character convolution over every candidate.

``scan`` finds the spans of the fixed patterns and all candidates (runs of at least LEAST
token characters, whatever they consist of) with their surrounding context. The network
sees a candidate whole, through windows that overlap by half; the best one counts.

``learned`` fits a small convolutional network in numpy to all labelled findings: what the
patterns found or left in the texts, and rewritten copies of what they found
(``variants``) that bring what the patterns have no label for: other key names and
alphabets as secrets, and paths, addresses, versions, dates and names as innocent ones. What the
patterns left is taken for innocent unless a network of these alone finds it secret. A
third is held out: half of that calibrates the scores (a logistic curve) and sets the
threshold, the highest one that keeps ``RECALL`` of the secrets; the other half measures
recall and precision. Findings are dealt to parts by their hash: in every round each part goes on
from the same network, and what comes back are the mean weights. ``find`` scores every candidate and adds the spans from the threshold
on that touch no pattern span; pattern spans always stay.

Null texts count as empty; an empty text has no spans. Positions are code points,
ends exclusive. Rows are independent: repeated rows give repeated results. Without
positive or negative findings nothing is added. Columns other than key and text
are not read.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.llm.common import ship
from stratalens.llm.ranking import nth_smallest
from stratalens.sources.staging import staged

# The patterns of findings and the least length of what they capture.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run is matched whole, so short ones may be passed over
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex")

#: A candidate: a run of token characters.
LEAST = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)
#: Characters of a window before, inside and after (the part of) the candidate it shows.
BEFORE, WITHIN, AFTER = 16, 40, 8
WINDOW = BEFORE + WITHIN + AFTER
#: Windows of a part that a network is fitted to on its own between two rounds, and parts at most.
PART, PARTS = 100_000, 256
#: Rounds over all windows, at least and at most, and windows that all rounds together see where the most allow it.
ROUNDS, SEEN_BY_FIT = (3, 24), 216_000
#: The most frequent words of the surroundings, of which innocent values are made up.
WORDS = 5000
#: Share of the held-out secrets that must stay above the threshold.
RECALL = 0.98
MODEL_KIND = "model"
#: Labels of windows: part of a candidate that touches no pattern span, touches one, or
#: part of a touched candidate that does not touch itself (neither learned nor added).
INNOCENT, SECRET, APART = 0, 1, 2

SPAN = "struct<kind:string,start:long,end:long>"
SEEN = "struct<start:long,end:long,context:string,label:int>"


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by start, then kind as listed."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text)
             if len(m.group(2)) >= ASSIGN_LEAST]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)
              if m.end() - m.start() >= ACCESS_LEAST]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def windows(text: str, start: int, end: int) -> Iterator[tuple[int, int, str]]:
    """The windows over a candidate: start and end of the part inside, and the context."""
    last = max(start, end - WITHIN)
    for at in [*range(start, last, WITHIN // 2), last]:
        to = min(end, at + WITHIN)
        yield at, to, (text[max(0, at - BEFORE):at].rjust(BEFORE, "\0") + text[at:to].ljust(WITHIN, "\0")
                       + text[to:to + AFTER].ljust(AFTER, "\0"))


def candidates(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, str, int]]:
    """Every candidate's windows, each with the candidate's start and end, and its label."""
    covered: list[list[int]] = []  # union of the pattern spans
    for _, start, end in spans:
        if covered and start <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    starts = [s for s, _ in covered]

    def touched(start: int, end: int) -> bool:
        last = bisect_left(starts, end) - 1
        return last >= 0 and covered[last][1] > start

    found = []
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        other = APART if touched(start, end) else INNOCENT
        found += [(start, end, context, SECRET if touched(at, to) else other)
                  for at, to, context in windows(text, start, end)]
    return found


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, pattern spans, candidates."""
    ship(df.sparkSession)
    schema = T.StructType([df.schema[key], *T.StructType.fromDDL(f"spans array<{SPAN}>, seen array<{SEEN}>")])

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans, seen = [], []
            for x in batch[text]:
                found = pattern_spans(x or "")
                spans.append([dict(zip(("kind", "start", "end"), s)) for s in found])
                seen.append([dict(zip(("start", "end", "context", "label"), c))
                             for c in candidates(x or "", found)])
            yield pd.DataFrame({key: batch[key], "spans": spans, "seen": seen})

    return df.select(key, text).mapInPandas(scanned, schema)


# --- labels the patterns do not have ------------------------------------------------

# Names of keys before rewritten secrets and innocent values, starts of tokens.
SECRET_KEYS = ("pwd", "auth", "bearer", "credential", "private_key", "access_key", "passphrase", "signing_key")
PLAIN_KEYS = ("name", "title", "path", "version", "file", "url", "date", "id", "author", "see")
PREFIXES = ("", "", "sk-", "gh_", "xo-", "key-")
ALPHABETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789")
BETWEEN = (" = ", ": ", "=", "='", '="', '": "', " ")


def secret_value(rng: random.Random) -> str:
    letters = rng.choice(ALPHABETS)
    return rng.choice(PREFIXES) + "".join(rng.choice(letters) for _ in range(rng.randint(16, 44)))


def innocent_value(rng: random.Random, words: list[str]) -> str:
    """A path, address, version, date, number or name, of words of the surroundings."""
    word, number = lambda: rng.choice(words), lambda top: str(rng.randrange(top))
    made = (lambda: "/".join([word(), word(), word(), word() + ".html"]),
            lambda: "www." + word() + ".org/" + word() + "/" + number(3000),
            lambda: ".".join(number(256) for _ in range(4)) + "/" + word(),
            lambda: word() + "-" + ".".join(number(30) for _ in range(3)) + "-beta." + number(9),
            lambda: f"20{number(90).zfill(2)}-0{number(9)}-1{number(9)}T1{number(9)}.2{number(9)}.3{number(9)}",
            lambda: ".".join(number(900).zfill(3) for _ in range(4)),
            lambda: "_".join(word() for _ in range(3)) + "." + rng.choice(("csv", "txt", "py", "json")),
            lambda: "-".join(word() for _ in range(3)),
            lambda: "".join(word().capitalize() for _ in range(3)),
            lambda: rng.choice("-=_.+") * rng.randint(LEAST, 60),
            lambda: word() + word(), lambda: (word() + word()).upper())
    return rng.choice(made)().ljust(LEAST, "s")


def variants(context: str, words: list[str]) -> list[tuple[str, int]]:
    """Windows with a secret and with innocent values, one with a key before it and one
    without, in the surroundings of a window. What they are depends on it alone."""
    rng = random.Random(int(sha256(context.encode()).hexdigest(), 16))
    before, after = context[:BEFORE].replace("\0", " "), " " + context[BEFORE + WITHIN:].replace("\0", " ")
    found = []
    for label, keys, value in ((SECRET, SECRET_KEYS, lambda: secret_value(rng)),
                               (INNOCENT, PLAIN_KEYS, lambda: innocent_value(rng, words)),
                               (INNOCENT, PLAIN_KEYS, lambda: innocent_value(rng, words))):
        for key in (rng.choice(keys) + rng.choice(BETWEEN), ""):
            head, given = before + " " + key, value()
            found += [(c, label) for *_, c in windows(head + given + after, len(head), len(head) + len(given))]
    return found


# --- the network -----------------------------------------------------------------

#: ASCII characters, 127 for all others, once outside and once inside the candidate.
LETTERS = 256
FILTERS, WIDTH = 16, 5


def codes(contexts: list[str]) -> np.ndarray:
    """One class per character of every window."""
    flat = np.frombuffer("".join(contexts).encode("utf-32-le"), dtype="<u4").reshape(-1, WINDOW)
    x = np.minimum(flat, LETTERS // 2 - 1).astype(np.int64)
    inside = x[:, BEFORE:BEFORE + WITHIN]
    inside[inside > 0] += LETTERS // 2
    return x


def shares(x: np.ndarray) -> np.ndarray:
    """Share of every class in every window: averages of convolutions of width 1."""
    at = x + LETTERS * np.arange(len(x))[:, None]
    return np.bincount(at.ravel(), minlength=LETTERS * len(x)).reshape(-1, LETTERS) / WINDOW


def logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Network:
    """Convolutions with maximum and with average over the window, and a logistic layer;
    a logistic curve from its sums to probabilities, and a threshold on these."""

    kernel: np.ndarray   # (WIDTH, LETTERS, FILTERS)
    bias: np.ndarray     # (FILTERS,)
    out: np.ndarray      # (FILTERS + 1,)
    mean: np.ndarray     # (LETTERS,)
    curve: tuple[float, float] = (1.0, 0.0)
    threshold: float = 1.0
    recall: float = 0.0     # both on findings neither fitted nor calibrated to
    precision: float = 0.0

    def weights(self) -> list[np.ndarray]:
        return [self.kernel, self.bias, self.out, self.mean]

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        steps = WINDOW - WIDTH + 1
        z = self.bias + sum(self.kernel[k][x[:, k:k + steps]] for k in range(WIDTH))
        best = z.argmax(axis=1)
        return np.maximum(np.take_along_axis(z, best[:, None], 1)[:, 0], 0.0), best

    def sums(self, x: np.ndarray) -> np.ndarray:
        parts = [np.zeros(0)]
        for at in range(0, len(x), 4096):  # bounded memory
            part = x[at:at + 4096]
            parts.append(self.hidden(part)[0] @ self.out[:-1] + shares(part) @ self.mean + self.out[-1])
        return np.concatenate(parts)

    def score(self, x: np.ndarray) -> np.ndarray:
        return logistic(self.curve[0] * self.sums(x) + self.curve[1])


def start(seed: int = 7) -> Network:
    """A network that has learned nothing."""
    rng = np.random.default_rng(seed)
    return Network(rng.normal(0, 0.1, (WIDTH, LETTERS, FILTERS)), np.zeros(FILTERS),
                   np.append(rng.normal(0, 0.3, FILTERS), 0.0), np.zeros(LETTERS))


def descend(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray, turns: list[int], rounds: int,
            rng: np.random.Generator, rate: float = 0.2) -> None:
    """Some turns of all rounds of stochastic gradient descent with momentum on the weighted logistic loss."""
    speed = [np.zeros_like(part) for part in net.weights()]
    for done in turns:
        pace = rate * (1 - done / rounds)
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            seen = x[rows].astype(np.int64)
            h, best = net.hidden(seen)
            share = shares(seen)
            p = logistic(h @ net.out[:-1] + share @ net.mean + net.out[-1])
            slope = (p - y[rows]) * weight[rows] / len(rows)
            down = slope[:, None] * net.out[:-1] * (h > 0)
            steps = [np.zeros_like(net.kernel), down.sum(0), np.append(h.T @ slope, slope.sum()) + 1e-4 * net.out,
                     20.0 * (share.T @ slope)]  # shares are small numbers
            for k in range(WIDTH):
                letter = np.take_along_axis(seen, best + k, 1)
                np.add.at(steps[0][k], (letter, np.arange(FILTERS)[None, :]), down)
            for part, v, step in zip(net.weights(), speed, steps):
                v *= 0.8
                v -= pace * step
                part += v


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 24, seed: int = 7) -> Network:
    """The network of windows at hand; both labels weigh alike."""
    net = start(seed)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    descend(net, x, y, weight, list(range(rounds)), rounds, np.random.default_rng(seed + 1))
    return net


def calibrated(sums: np.ndarray, y: np.ndarray, times: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset of the logistic curve through held-out sums (Newton's method), each so
    many ``times``, with targets drawn in a little so that separable labels have a curve, too."""
    times = np.ones(len(y)) if times is None else times
    n1, n0 = (y * times).sum(), ((1 - y) * times).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(1e-9, float(np.abs(sums).max()))
    f = np.stack([sums / scale, np.ones(len(sums))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = logistic(f @ w)
        bend = (f * (p * (1 - p) * times)[:, None]).T @ f + 1e-6 * np.eye(2)
        step = np.linalg.solve(bend, f.T @ ((p - target) * times) + 1e-6 * w)
        w = w - step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
    return (float(max(w[0], 1e-9) / scale), float(w[1]))  # a higher sum is never a lower score


def train(findings: list[tuple[str, int]], held: list[tuple[str, int]]) -> Network | None:
    """Fit to labelled windows at hand; calibrate and set the threshold on every other held-out one,
    measure on the rest."""
    labels = {label for _, label in findings}
    tuned, kept = held[::2], held[1::2]
    if labels != {0, 1} or {label for _, label in tuned} != {0, 1}:
        return None
    net = fit(codes([c for c, _ in findings]), np.array([y for _, y in findings]))
    y = np.array([y for _, y in tuned])
    sums = net.sums(codes([c for c, _ in tuned]))
    net.curve = calibrated(sums, y)
    scores = np.sort(logistic(net.curve[0] * sums[y == 1] + net.curve[1]))
    # a further secret is above the k-th least of n with a chance of 1 - k / (n + 1)
    net.threshold = float(scores[max(0, int(np.floor((1.0 - RECALL) * (len(scores) + 1))) - 1)])
    y, over = np.array([y for _, y in kept]), net.score(codes([c for c, _ in kept])) >= net.threshold
    net.recall = float(over[y == 1].mean()) if (y == 1).any() else 0.0
    net.precision = float((y[over] == 1).mean()) if over.any() else 0.0
    return net


LABELLED = "context string, label int, kind int, held int"
#: Kinds of labelled windows: findings, what the patterns left with a digit and without, variants.
FOUND, DIGIT, PLAIN, VARIANT = range(4)
#: Places of a window: learned from, calibrated to, measured on.
LEARNED, TUNED, KEPT = range(3)
#: Bins of held-out sums that the curve is drawn through.
BINS = 1000


def labelled(scanned: DataFrame) -> DataFrame:
    """All distinct windows that are labelled, a third of them held out by their hash."""
    found = scanned.select(F.explode("seen").alias("s")).select("s.context", "s.label").where(
        F.col("s.label") != APART).distinct()
    digit = F.substring("context", BEFORE + 1, WITHIN).rlike("[0-9]")
    kind = F.when(F.col("label") == SECRET, FOUND).when(digit, DIGIT).otherwise(PLAIN)
    half = F.when(F.pmod(F.xxhash64("context", F.lit(1)), F.lit(2)) == 0, TUNED).otherwise(KEPT)
    held = F.when(F.pmod(F.xxhash64("context"), F.lit(3)) == 0, half).otherwise(LEARNED)
    return found.select("context", "label", kind.alias("kind"), held.alias("held"))


def rewritten(found: DataFrame, words: list[str]) -> DataFrame:
    """The variants of all findings, held out as these are."""
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(c, y, VARIANT, held) for context, held in zip(batch["context"], batch["held"])
                    for c, y in (variants(context, words) if words else [])]
            yield pd.DataFrame(rows, columns=["context", "label", "kind", "held"])

    return found.where(F.col("label") == SECRET).mapInPandas(made, LABELLED)


def summed(known: DataFrame, net: Network) -> DataFrame:
    """Add ``u``, the network's sum, to every window."""
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(u=net.sums(codes(list(batch["context"]))) if len(batch) else np.zeros(0))

    return known.mapInPandas(made, f"{LABELLED}, u double")


def fit_all(known: DataFrame) -> Network | None:
    """The network of all windows to learn from, in a stored table. Both labels weigh alike; among the
    innocent ones, each kind the patterns left weighs no more than the findings."""
    learn = known.where(F.col("held") == LEARNED)
    counts = {(r["label"], r["kind"]): r["n"] for r in learn.groupBy("label", "kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    if {label for label, _ in counts} != {INNOCENT, SECRET}:
        return None
    n = sum(counts.values())
    each = {(y, k): min(1.0, counts.get((SECRET, FOUND), 0) / m) if k in (DIGIT, PLAIN) else 1.0 for (y, k), m in counts.items()}
    mass = {label: sum(each[x] * m for x, m in counts.items() if x[0] == label) for label in (INNOCENT, SECRET)}
    weight = {x: 0.5 * n * w / mass[x[0]] for x, w in each.items()}
    parts = min(PARTS, -(-n // PART))
    rounds = int(min(max(-(-SEEN_BY_FIT // n), ROUNDS[0]), ROUNDS[1]))
    dealt = learn.select("context", "label", "kind", F.pmod(F.xxhash64("context", F.lit(2)), F.lit(parts)).alias("part"))
    net = start()
    # a single part needs no mean, so it makes all rounds at once
    for turns in [list(range(rounds))] if parts == 1 else [[i] for i in range(rounds)]:
        def moved(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["context", "label", "kind"])  # as if it had always come in this order
            y = part["label"].to_numpy()
            own = Network(*[w.copy() for w in net.weights()])
            descend(own, codes(list(part["context"])).astype(np.uint8), y,
                    np.array([weight[x] for x in zip(y, part["kind"])]), turns, rounds, np.random.default_rng([key[0], turns[0]]))
            return pd.DataFrame({"part": [key[0]], "n": [len(y)], "weights": [np.concatenate([w.ravel() for w in own.weights()])]})

        rows = dealt.groupBy("part").applyInPandas(moved, "part long, n long, weights array<double>").collect()
        total = np.zeros(sum(w.size for w in net.weights()))
        for row in sorted(rows, key=lambda r: r["part"]):
            total += np.array(row["weights"]) * (row["n"] / n)
        ends = np.cumsum([w.size for w in net.weights()])[:-1]
        net = Network(*[part.reshape(w.shape) for part, w in zip(np.split(total, ends), net.weights())])
    return net


def learned(scanned: DataFrame) -> Network | None:
    """The network of all labelled windows, its curve through all sums to calibrate to (by the
    mean sum of bins) and its threshold at the exact place among them."""
    found = staged(labelled(scanned), "windows")
    plain = F.explode(F.regexp_extract_all(F.lower("context"), F.lit("[a-z]{3,}"), F.lit(0)))
    often = found.where(F.col("label") == INNOCENT).select(plain.alias("word")).groupBy("word").count()
    words = sorted(r["word"] for r in often.orderBy(F.desc("count"), "word").limit(WORDS).collect())
    sure = staged(found.where(F.col("label") == SECRET).union(rewritten(found, words)), "sure")
    left = found.where(F.col("label") == INNOCENT)
    first = fit_all(sure)
    # what the patterns left is not known to be innocent: what a network of the others takes for a secret teaches nothing
    if first is not None:
        left = summed(left, first).where("u < 0").drop("u")
    known = staged(sure.union(left), "known")
    net = fit_all(known)
    if net is None:
        return None
    held = staged(summed(known.where(F.col("held") != LEARNED), net).select("label", "held", "u"), "held")
    tuned = held.where(F.col("held") == TUNED)
    low, high = tuned.agg(F.min("u"), F.max("u")).first()
    bin_ = F.floor((F.col("u") - F.lit(low)) / F.lit((high - low) or 1.0 if low is not None else 1.0) * BINS)
    bins = tuned.groupBy("label", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("u").alias("u")).orderBy("label", "bin").collect()
    y, times = np.array([r["label"] for r in bins]), np.array([float(r["n"]) for r in bins])
    if set(y.tolist()) != {INNOCENT, SECRET}:
        return None
    net.curve = calibrated(np.array([r["u"] for r in bins]), y, times)
    # a further secret is above the k-th least of n with a chance of 1 - k / (n + 1)
    place = max(0, int(np.floor((1.0 - RECALL) * (times[y == SECRET].sum() + 1))) - 1)
    least = nth_smallest(tuned.where(F.col("label") == SECRET).select("u"), place)
    net.threshold = float(logistic(net.curve[0] * np.array([least]) + net.curve[1])[0])
    over = F.col("u") >= least
    hits, secrets, wrong = held.where(F.col("held") == KEPT).agg(
        F.count_if(over & (F.col("label") == SECRET)), F.count_if(F.col("label") == SECRET),
        F.count_if(over & (F.col("label") == INNOCENT))).first()
    net.recall, net.precision = hits / max(1, secrets), hits / max(1, hits + wrong)
    return net


def find(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_assign, n_access, n_hex, base_sha256 (of the pattern spans) and
    spans (all, as kind:start:end joined by commas; those of the model after the others
    at the same start)."""
    scanned = staged(scan(df, key, text), "scanned")
    net = learned(scanned)
    schema = T.StructType([scanned.schema[key], *T.StructType.fromDDL(
        "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long")])

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            owner = [i for i, seen in enumerate(batch["seen"]) for _ in seen]
            seen = [c for found in batch["seen"] for c in found]
            score = net.score(codes([c["context"] for c in seen])) if net and seen else np.zeros(len(seen))
            found: dict[int, set] = {}  # a candidate is added if one of its windows is
            for i, c, p in zip(owner, seen, score):
                if net and p >= net.threshold and c["label"] == INNOCENT:
                    found.setdefault(i, set()).add((MODEL_KIND, c["start"], c["end"]))
            added = {i: sorted(spans) for i, spans in found.items()}
            rows = []
            for i, spans in enumerate(batch["spans"]):
                base = [(s["kind"], s["start"], s["end"]) for s in spans]
                order = {k: n for n, k in enumerate((*KINDS, MODEL_KIND))}
                all_ = sorted(base + added.get(i, []), key=lambda s: (s[1], order[s[0]]))
                shown = [",".join(f"{k}:{a}:{b}" for k, a, b in x) for x in (base, all_)]
                rows.append((*[sum(s[0] == k for s in base) for k in KINDS],
                             sha256(shown[0].encode()).hexdigest(), shown[1], len(added.get(i, []))))
            out = pd.DataFrame(rows, columns=schema.names[1:], index=batch.index)
            out.insert(0, key, batch[key])
            yield out

    return scanned.mapInPandas(scored, schema)
