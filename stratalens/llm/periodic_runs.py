"""Detection of periodic runs of words by suffix trees.

A run is a stretch of words with smallest period q that no neighbouring word extends; here
it counts from max(LEAST, POWER * q) words on. For every document an Ukkonen tree of its
words and one of their reversal are built; an Euler tour turns either into a table whose
minimum over a range, found in constant time, is the longest common extension (LCE) of two
positions. Every run has a Lyndon root, the longest Lyndon word that starts at one of its
positions under the order of the words or its inverse: so each position gives two
candidates, and each is extended in both directions by one LCE query.

Words that cannot lie in a run stand in the trees as separators: in a run of LEAST words and
POWER periods every stretch of GRAM words occurs at least twice, so what no such stretch
covers is cut. This is exact: no run and no extension of one crosses a cut.

Null texts count as empty; texts without words have no run. Null keys are rows like others
and are never damaged. Repeated rows give repeated results. An empty table gives an empty
table. Columns other than key and text are not read. Documents are independent: a hot key
or source makes no difference, and memory is that of one document's words.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.llm.common import ship

# The least length of a run, in words and in periods, and the share of damaged keys.
LEAST, POWER, DAMAGED = 6, 4, 10
#: Every so many neighbouring words of a run occur twice in it: 6 words of period 1 have two
#: such stretches, 8 of period 2 have four, and longer periods at least twice their length.
GRAM = 5


# --- suffix trees -------------------------------------------------------------------

class Tree:
    """Ukkonen's tree of a sequence of numbers whose last one occurs nowhere else."""

    def __init__(self, symbols: list[int]):
        n = self.size = len(symbols)
        span = self.span = max(symbols) + 1
        # by node: where its edge begins and ends in the sequence, and its suffix link
        first, last, link, edges = [0] * (2 * n), [n] * (2 * n), [0] * (2 * n), {}
        find, nodes, last[0] = edges.get, 1, 0
        node = at = length = waiting = 0
        for i, symbol in enumerate(symbols):
            waiting += 1
            inner = 0
            while waiting:
                if not length:
                    at = i
                key = node * span + symbols[at]
                child = find(key)
                if child is None:
                    edges[key], first[nodes] = nodes, i
                    nodes += 1
                    if inner:
                        link[inner] = node
                        inner = 0
                else:
                    begin = first[child]
                    size = last[child] - begin
                    if length >= size:
                        at, length, node = at + size, length - size, child
                        continue
                    middle = begin + length
                    if symbols[middle] == symbol:
                        length += 1
                        if inner:
                            link[inner] = node
                        break
                    edges[key], first[nodes], last[nodes] = nodes, begin, middle
                    below = nodes * span
                    edges[below + symbol], first[nodes + 1] = nodes + 1, i
                    edges[below + symbols[middle]], first[child] = child, middle
                    if inner:
                        link[inner] = nodes
                    inner = nodes
                    nodes += 2
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length, at = length - 1, i - waiting + 1
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        self.child = np.fromiter(edges.values(), np.int64, len(edges))
        self.parent, self.symbol = keys // span, keys % span
        self.width = np.array(last[:nodes]) - np.array(first[:nodes])

    def tour(self) -> tuple[np.ndarray, np.ndarray]:
        """Euler tour with children in the order of their symbols. Suffixes in the order of
        their leaves, and between neighbouring leaves the depth of the node above both,
        which is the least that the tour passes on the way."""
        order = np.lexsort((-self.symbol, self.parent))  # the least child is pushed last
        bounds = np.searchsorted(self.parent[order], np.arange(len(self.width) + 1)).tolist()
        child, width, size = self.child[order].tolist(), self.width.tolist(), self.size
        stack, above = child[:bounds[1]], [0] * bounds[1]
        leaves, between, after_leaf = [], [], False
        while stack:
            node, depth = stack.pop(), above.pop()
            if after_leaf:
                between.append(depth)
                after_leaf = False
            depth += width[node]
            lo, hi = bounds[node], bounds[node + 1]
            if lo == hi:
                leaves.append(size - depth)
                after_leaf = True
            else:
                stack += child[lo:hi]
                above += [depth] * (hi - lo)
        return np.array(leaves), np.array(between, dtype=np.int32)


class Extensions:
    """Longest common extensions of two suffixes, many queries at once, each in constant time."""

    def __init__(self, leaves: np.ndarray, between: np.ndarray):
        self.place = np.empty(len(leaves), dtype=np.int64)
        self.place[leaves] = np.arange(len(leaves))
        self.rows = [between]
        step = 1
        while 2 * step <= len(between):
            below = self.rows[-1]
            self.rows.append(np.minimum(below[:-step], below[step:]))
            step *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of different suffixes."""
        x, y = self.place[a], self.place[b]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), dtype=np.int64)
        for k, row in enumerate(self.rows):
            at = np.nonzero(level == k)[0]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << k)])
        return out


def _next_smaller(place: list[int]) -> np.ndarray:
    """Per position the next one with a lesser place; the own longest Lyndon word ends there."""
    n = len(place)
    found, stack = [n] * n, []
    for i, p in enumerate(place):
        while stack and place[stack[-1]] > p:
            found[stack.pop()] = i
        stack.append(i)
    return np.array(found)


def runs_of(symbols: np.ndarray, separators: int) -> np.ndarray:
    """(start, length, period) of all runs, by start, then period. Symbols below ``separators``
    occur once each and belong to no run; the last symbol is one of them."""
    n = len(symbols)
    forward = Extensions(*Tree(symbols.tolist()).tour())
    # no suffix is the beginning of another, so the inverse order just turns their places around
    starts = np.nonzero(symbols >= separators)[0]
    root = np.concatenate([_next_smaller(forward.place.tolist())[starts],
                           _next_smaller((n - 1 - forward.place).tolist())[starts]])
    start = np.concatenate([starts, starts])
    # a root that ends at a separator is followed by nothing equal
    fits = root < n
    fits[fits] = symbols[root[fits]] >= separators
    start, root = start[fits], root[fits]
    # the reversed sequence needs a last symbol of its own: a separator below all others
    backward = Extensions(*Tree([*(symbols[::-1] + 1).tolist(), 0]).tour())
    right = forward.common(start, root)
    left = np.zeros(len(start), dtype=np.int64)
    inside = start > 0
    left[inside] = backward.common(n - start[inside], n - root[inside])
    period = root - start
    length = left + period + right
    found = np.stack([start - left, period, length], axis=1)
    return np.unique(found[length >= np.maximum(LEAST, POWER * period)], axis=0)[:, [0, 2, 1]]


# --- documents ----------------------------------------------------------------------

#: Multiplier of the hash of stretches.
_ODD = 0x9E3779B97F4A7C15


def candidates(words: np.ndarray) -> np.ndarray:
    """Which words lie in a stretch of GRAM words that occurs twice. Two stretches whose hashes
    are equal by chance leave a word too many, never too few."""
    mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(_ODD)
    mixed ^= mixed >> np.uint64(32)
    hashed = np.zeros(len(words) - GRAM + 1, dtype=np.uint64)
    for k in range(GRAM):
        hashed = hashed * np.uint64(_ODD) + mixed[k:k + len(hashed)]
    order = np.argsort(hashed, kind="stable")
    same = hashed[order[1:]] == hashed[order[:-1]]
    at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    marks[at] += 1
    marks[at + GRAM] -= 1
    return np.cumsum(marks)[:-1] > 0


def _pieces(kept: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of true of LEAST words or more."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], kept, [False]])))
    return [(a, b) for a, b in edges.reshape(-1, 2).tolist() if b - a >= LEAST]


def runs(words: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs in a sequence of word numbers, by start, then period."""
    none = np.zeros((0, 3), dtype=np.int64)
    if len(words) < LEAST:
        return none
    kept = _pieces(candidates(words))
    if not kept:
        return none
    # one sequence for the trees: pieces, each closed by a separator of its own
    separators = len(kept)
    numbers = np.unique(np.concatenate([words[a:b] for a, b in kept]), return_inverse=True)[1].reshape(-1) + separators
    parts, origin, done = [], [], 0
    for i, (a, b) in enumerate(kept):
        parts += [numbers[done:done + b - a], [i]]
        origin += [np.arange(a, b), [-1]]
        done += b - a
    found = runs_of(np.concatenate(parts), separators)
    found[:, 0] = np.concatenate(origin)[found[:, 0]]
    return found


def left_over(n: int, found: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: those that no run contains after its first period."""
    marks = np.zeros(n + 1, dtype=np.int64)
    np.add.at(marks, found[:, 0] + found[:, 2], 1)
    np.add.at(marks, found[:, 0] + found[:, 1], -1)
    return np.cumsum(marks)[:-1] == 0


def damaged(words: list[bytes], hashed: int) -> list[bytes]:
    """The words, periodic from a place on where the hash of the key says so."""
    n = len(words)
    if not n or hashed % DAMAGED:
        return words
    g = hashed // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


RESULT = ("n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def examined(words: list[bytes]) -> tuple:
    """One row of RESULT."""
    found = runs(pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)) if words else np.zeros((0, 3), int)
    best = (None,) * 4
    if len(found):
        start, length, period = found[np.lexsort((found[:, 2], found[:, 0], -found[:, 1]))[0]].tolist()
        best = (start, length, period, 1000 * length // period)
        stay = left_over(len(words), found).tolist()
        words = [w for w, s in zip(words, stay) if s]
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found.tolist())
    return (len(found), *best, sha256(listed.encode()).hexdigest(), sha256(b" ".join(words)).hexdigest())


def detect(df: DataFrame, key: str = "doc_id", text: str = "text", damage: bool = False) -> DataFrame:
    """Per row: the key, the number of runs, the longest (ties: least start, then period),
    digests of the list of runs and of the text without what runs repeat. ``damage`` first
    makes the text of every tenth key, by its checksum, periodic from some word on."""
    ship(df.sparkSession)
    hashed = F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) if damage else F.lit(None).cast("bigint")
    read = df.select(F.col(key), F.col(text).alias("_text"), hashed.alias("_hash"))
    schema = T.StructType([df.schema[key], *T.StructType.fromDDL(RESULT)])
    kinds = pa.schema([("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
                       ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body, h in zip(batch.column(1), batch.column(2)):
                # bytes split at ASCII white space only; U+0020 and U+0009 to U+000D are all of it
                words = (body.as_py() or "").encode("utf-8").split()
                rows.append(examined(words if h.as_py() is None else damaged(words, h.as_py())))
            columns = [pa.array(c, type=k.type) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return read.mapInArrow(found, schema)
