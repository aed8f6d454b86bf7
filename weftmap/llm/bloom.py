"""Bloom filters held in a plan: an array of words, probed by native hashes.

A filter answers "surely not" or "maybe". It is never the last word here: a cascade or a
join settles what it lets through.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: The most bytes of a filter that is part of a plan.
MAX_BYTES = 4 << 20


@dataclass(frozen=True)
class Level:
    seed: int
    hashes: int
    words: tuple[int, ...]


def slot(key: Column, seed: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed * 64 + i), key), F.lit(bits))


def in_level(key: Column, level: Level) -> Column:
    """Whether key, worked out once, may be among those a level was built from; null isn't."""
    bits = len(level.words) * 64
    # one literal, whatever its length
    words = F.split(F.lit(",".join(map(str, level.words))), ",").cast("array<bigint>")

    def hits(k: Column, held: Column) -> Column:
        slots = [slot(k, level.seed, i, bits) for i in range(level.hashes)]
        # getbit counts from the lowest bit
        return reduce(lambda a, b: a & b, [F.getbit(F.get(held, F.shiftright(s, 6).cast("int")), (s % 64).cast("int")) == 1 for s in slots])

    return let(key, lambda k: k.isNotNull() & let(words, lambda held: hits(k, held)))


def level_bytes(n: int, bits_per_key: int) -> int:
    return 8 * max(1, -(-n * bits_per_key // 64))


def build_level(keys: DataFrame, n_bytes: int, seed: int, hashes: int) -> Level:
    """The level of a table's column key; the driver holds its words, n_bytes of them."""
    bits = n_bytes * 8
    slots = keys.select(F.explode(F.array(*[slot(F.col("key"), seed, i, bits) for i in range(hashes)])).alias("slot"))
    packed = slots.groupBy((F.shiftright("slot", 6)).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("value"))
    words = [0] * (bits // 64)
    for row in packed.collect():  # at most bits/64 rows
        words[row["word"]] = row["value"]
    return Level(seed, hashes, tuple(words))


def prefilter(keys: DataFrame, max_bytes: int = MAX_BYTES, bits_per_key: int = 12) -> Level:
    """A filter of the column key of at most max_bytes; the more keys beyond it, the more it lets through."""
    n = keys.count()
    size = min(level_bytes(n, bits_per_key), max(8, max_bytes // 8 * 8))
    return build_level(keys, size, 1, max(1, min(6, round(0.69 * 8 * size / max(n, 1)))))
