"""Partition numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_PARTITIONS = 30


def folded_part(key: Column, parts: int) -> Column:
    """The partition of an integer key: its 32-bit hash, exclusive-or-folded in steps of floor(log2 parts) bits, modulo parts.

    A long's hash is its upper half exclusive-or its lower half, which is the number itself below 2**31.
    """
    if parts <= 1:
        return F.lit(0)
    wide = key.cast("long")
    word = (wide.bitwiseXOR(F.shiftrightunsigned(wide, 32))).bitwiseAND(0xFFFFFFFF)
    width = parts.bit_length() - 1
    folded = word
    for shift in range(width, 32, width):
        folded = folded.bitwiseXOR(F.shiftrightunsigned(word, shift))
    signed = F.when(folded >= 1 << 31, folded - (1 << 32)).otherwise(folded)
    return F.abs(signed % parts).cast("int")


def hashed_part(parts: int, *keys: Column) -> Column:
    """The partition of keys of any type, by Spark's own hash."""
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def fraction(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys and the seed alone: a rerun draws the same."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / float(1 << 52)


def poisson(mean: float, u: Column) -> Column:
    """A Poisson number from a uniform one, by inversion: how many of the distribution's steps lie at or below it. Steps
    are listed where they are told apart from 0 and 1 in double precision, which grows with the root of the mean."""
    import math

    mass = lambda k: math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) if mean > 0 else float(k == 0)
    spread = 12 * math.sqrt(mean) + 40
    low = max(0, int(mean - spread))
    total, steps = 0.0, []
    for k in range(low, int(mean + spread) + 1):
        total += mass(k)
        steps.append(min(total, 1.0))
    return (steps_below(steps, u) + low).cast("int")


def steps_below(steps: list[float], u: Column, leaves: int = 64) -> Column:
    """How many of some numbers in rising order lie at or below `u` (0 for null), by halving: plain comparisons down to
    `leaves` ranges, so that the expression stays small, and a list's filter within a range."""
    width = -(-len(steps) // leaves)

    def within(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        if 1 < b - a <= width:
            return F.size(F.filter(F.array(*map(F.lit, steps[a:b])), lambda step: step <= u)) + a
        half = (a + b) // 2
        return F.when(u >= steps[half], within(half + 1, b)).otherwise(within(a, half))

    return within(0, len(steps))


def string_hash(text: Column) -> Column:
    """The 32-bit hash of a string that sums its UTF-16 units, each times 31 to the number of units after it; signed."""
    code = lambda c: F.ascii(c).cast("long")
    pair = lambda c: ((code(c) - 0x10000) / 1024).cast("long") + 0xD800
    step = lambda h, x: (h * 31 + x).bitwiseAND(0xFFFFFFFF)
    summed = F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda h, c: F.when(c == "", h).when(code(c) < 0x10000, step(h, code(c))).otherwise(step(step(h, pair(c)), (code(c) - 0x10000) % 1024 + 0xDC00)))
    return F.when(summed >= 1 << 31, summed - (1 << 32)).otherwise(summed)
