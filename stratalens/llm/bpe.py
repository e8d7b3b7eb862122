"""Byte-level BPE by forced-boundary splitting.

Some pairs of neighbouring bytes occur inside no vocabulary token. Whatever the
merges do, a token never spans such a pair, so it marks a certain cut. A text is
split into pre-tokens by the tokenizer's pattern, each pre-token at its certain
cuts; the fragments are encoded independently and the ids concatenated.

Null texts count as empty; an empty text has no ids. Rows are independent:
repeated rows give repeated results, other columns pass unchanged.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.llm.common import ship

# The pre-token pattern of byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens in each of the two generations kept in a worker, and the longest one kept.
CACHED, CACHED_CHARS = 200_000, 48
#: Rows whose ids are handed over at once: long texts must not pile up.
HANDED = 256
#: Fragments up to this length look for the next merge by a scan.
SCANNED = 48
#: A merge is stored as its rank above the id it makes.
ID_BITS = 24
ID_MASK = (1 << ID_BITS) - 1


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        self.bytes_of = {i: bytes(byte_of[x] for x in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of.update({i: text.encode() for text, i in self.special.items()})
        self.id_of_byte = [vocab[letter] for letter in byte_letters()]
        self.merge = {}
        for rank, rule in enumerate(spec["model"]["merges"]):
            left, right = rule.split(" ") if isinstance(rule, str) else rule
            self.merge[vocab[left], vocab[right]] = rank << ID_BITS | vocab[left + right]
        self.no_merge = len(self.merge) + 1 << ID_BITS
        self.inside = {pair for token in vocab for raw in [self.bytes_of[vocab[token]]]
                       for pair in zip(raw, raw[1:])}
        self.pieces = regex.compile(PATTERN)
        self.splits = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") \
            if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}

    def fragments(self, raw: bytes) -> list[bytes]:
        """Split at every byte pair that occurs inside no token."""
        cuts = [i for i, pair in enumerate(zip(raw, raw[1:]), 1) if pair not in self.inside]
        return [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)])] if cuts else [raw]

    def encode_fragment(self, raw: bytes) -> list[int]:
        """Apply the merges, lowest rank first and leftmost first among equals."""
        ids = [self.id_of_byte[b] for b in raw]
        if len(ids) > SCANNED:
            return self._merged_by_queue(ids)
        rule, none = self.merge.get, self.no_merge
        ranks = [rule(pair, none) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = made = best & ID_MASK
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rule((ids[i - 1], made), none)
            if i < len(ranks):
                ranks[i] = rule((made, ids[i + 1]), none)
        return ids

    def _merged_by_queue(self, ids: list[int]) -> list[int]:
        """The same for long fragments, in n log n steps."""
        end = len(ids)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        queue = [(self.merge[pair], i, *pair) for i, pair in enumerate(zip(ids, ids[1:]))
                 if pair in self.merge]
        heapq.heapify(queue)
        while queue:
            rule, i, left, right = heapq.heappop(queue)
            j = after[i] if ids[i] == left else end
            if j >= end or ids[j] != right:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = rule & ID_MASK, -1
            after[i] = after[j]
            if after[j] < end:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < end and (ids[a], ids[b]) in self.merge:
                    heapq.heappush(queue, (self.merge[ids[a], ids[b]], a, ids[a], ids[b]))
        return [i for i in ids if i >= 0]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of a pre-token, kept for a while: two generations of bounded size."""
        ids = self.before.get(piece)
        if ids is None:
            made = []
            for fragment in self.fragments(piece.encode("utf-8")):
                made += self.encode_fragment(fragment)
            ids = tuple(made)
        if len(piece) <= CACHED_CHARS:
            if len(self.known) >= CACHED:
                self.before, self.known = self.known, {}
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if self.splits is None or not any(s in text for s in self.special):
            return self._encode_plain(text)
        ids = []
        for part in self.splits.split(text):
            ids += [self.special[part]] if part in self.special else self._encode_plain(part)
        return ids

    def _encode_plain(self, text: str) -> list[int]:
        known, ids = self.known, []
        for piece in self.pieces.findall(text):
            ids += known.get(piece) or self.encode_piece(piece)
        return ids

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec per worker and file."""
    return Codec(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids",
           count: str = "n_tokens") -> DataFrame:
    """Replace the text by its token ids (``array<int>``) and their number."""
    ship(df.sparkSession)
    kept = [c for c in df.columns if c not in (text, ids, count)]
    schema = T.StructType([*[df.schema[c] for c in kept],
                           T.StructField(count, T.LongType()),
                           T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for batch in batches:
            for start in range(0, len(batch), HANDED):
                part = batch.iloc[start:start + HANDED]
                out = part[kept].copy()
                found = [np.array(own.encode(x or ""), dtype=np.int32) for x in part[text]]
                out[count] = np.array([len(x) for x in found], dtype=np.int64)
                out[ids] = pd.Series(found, index=out.index, dtype=object)
                yield out

    return df.select(*kept, text).mapInPandas(encoded, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Replace token ids by their text; null ids give the empty text."""
    ship(df.sparkSession)
    kept = [c for c in df.columns if c not in (text, ids)]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(text, T.StringType())])

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for batch in batches:
            out = batch[kept].copy()
            out[text] = [own.decode(x) if x is not None else "" for x in batch[ids]]
            yield out

    return df.select(*kept, ids).mapInPandas(decoded, schema)


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: number of tokens, digest of the ids, digest of the text decoded from them."""
    ship(df.sparkSession)
    schema = T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType())])

    def digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        shown = {i: str(i) for i in own.bytes_of}
        for batch in batches:
            rows = []
            for x in batch[text]:
                ids = own.encode(x or "")
                listed = ",".join(map(shown.__getitem__, ids)).encode()
                rows.append((len(ids), sha256(listed).hexdigest(),
                             sha256(own.decode(ids).encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=schema.names[1:], index=batch.index)
            out.insert(0, key, batch[key])
            yield out

    return df.select(F.col(key), F.col(text)).mapInPandas(digested, schema)
