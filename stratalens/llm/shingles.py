"""Counts over windows of words and over the bits of hashes, as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shifted_left(value: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", value, bits.cast("int"))


def shifted_right(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits.cast("int"))


def windows(units: Column, width: int) -> Column:
    """Every run of ``width`` neighbouring units as a struct; fewer units have none."""
    n = F.size(units) - F.lit(width - 1)
    shifted = [F.slice(units, F.lit(i + 1), F.greatest(n, F.lit(0))) for i in range(width)]
    return F.arrays_zip(*[s.alias(f"u{i}") for i, s in enumerate(shifted)])


def hashed_windows(units: Column, width: int) -> Column:
    """A 64-bit hash of every window, in order."""
    return F.transform(windows(units, width), lambda w: F.xxhash64(w))


def bound(value: Column, body) -> Column:
    """``body`` of the value, which is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_units(hashes: Column, width: int) -> Column:
    """How many units lie in windows whose hash occurs twice or more.

    Hash and position share a long, as many bits for the position as the row needs.
    Sorted, equal windows stand together, so a neighbour tells whether a window may
    repeat; those whose shortened hash does are compared by their whole hash. The
    positions found cover ``width`` units each.
    """
    n = F.size(hashes)
    bits = F.length(F.bin(n.cast("bigint"))).cast("int")
    row = F.struct(hashes.alias("h"), bits.alias("b"))

    def beside(values: Column, j: Column, same) -> Column:
        x = F.get(values, j)
        near = lambda k: F.coalesce(same(x, F.get(values, k)), F.lit(False))
        return near(j - 1) | near(j + 1)

    def packed(v: Column) -> Column:
        return F.sort_array(F.transform(
            v["h"], lambda h, i: shifted_left(h, v["b"]).bitwiseOR(i.cast("bigint"))))

    def likely(v: Column) -> Column:
        same = lambda x, y: shifted_right(x.bitwiseXOR(y), v["b"]) == 0
        low = shifted_left(F.lit(1).cast("bigint"), v["b"]) - 1
        return F.transform(F.filter(v["s"], lambda x, j: beside(v["s"], j, same)), lambda x: x.bitwiseAND(low))

    def settled(v: Column) -> Column:
        whole = F.sort_array(F.transform(v["at"], lambda i: F.struct(F.get(v["h"], i.cast("int")).alias("h"), i.alias("i"))))
        same = lambda x, y: x["h"] == y["h"]
        return F.transform(bound(whole, lambda w: F.filter(w, lambda x, j: beside(w, j, same))), lambda x: x["i"])

    def units(starts: Column) -> Column:
        return F.size(F.array_distinct(F.concat(*[_plus(starts, k) for k in range(width)])))

    def found(v: Column) -> Column:
        at = bound(F.struct(packed(v).alias("s"), v["b"].alias("b")), likely)
        return bound(F.struct(v["h"].alias("h"), at.alias("at")), settled)

    return F.when(F.size(F.array_distinct(hashes)) == n, F.lit(0)).otherwise(bound(bound(row, found), units))


def _plus(values: Column, k: int) -> Column:
    return F.transform(values, lambda x: x + k)


# --- how often each bit is set -----------------------------------------------------

#: Two counters share a long, one in either half, so no count below 2**31 can overflow.
PAIRED = (1 << 32) | 1


def bit_sums(hashed: str, name: str) -> list[Column]:
    """32 sums over rows: sum i counts bit i in its lower half, bit i + 32 in its upper."""
    return [F.sum(F.shiftright(F.col(hashed), i).bitwiseAND(F.lit(PAIRED))).alias(f"{name}{i}")
            for i in range(32)]


def bit_counts(name: str) -> list[Column]:
    """How often each of the 64 bits was set, from ``bit_sums``."""
    low = [F.col(f"{name}{i}").bitwiseAND(F.lit((1 << 32) - 1)) for i in range(32)]
    high = [F.shiftrightunsigned(F.col(f"{name}{i}"), 32) for i in range(32)]
    return [F.coalesce(c, F.lit(0).cast("bigint")) for c in low + high]
