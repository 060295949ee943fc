"""Keyed random numbers: functions of seed, entity keys and draw, never of partitions."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lehmer generator (multiplier, modulus): the portable form that SQL oracles share.
LEHMER = 48271, 2147483647


def uniform(seed: int, draw: int | Column, *keys) -> Column:
    """In the open interval (0, 1), from a 52-bit hash."""
    d = draw if isinstance(draw, Column) else F.lit(draw)
    h = F.xxhash64(*keys, F.lit(seed), d)
    return (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / float(1 << 52)


def normal(seed: int, draw: int | Column, *keys) -> Column:
    """Standard normal by Box and Muller."""
    d = draw if isinstance(draw, Column) else F.lit(draw)
    u, v = uniform(seed, d * 2, *keys), uniform(seed, d * 2 + 1, *keys)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def lehmer(key: Column, steps: int = 1) -> Column:
    """Portable uniform of an integer key: steps of the generator, scaled."""
    k = key.cast("long") % LEHMER[1] + 1
    for _ in range(steps):
        k = k * LEHMER[0] % LEHMER[1]
    return k / F.lit(float(LEHMER[1]))


def halton(index: Column, base: int, digits: int = 20) -> Column:
    """Radical inverse of index in base."""
    out, k, f = F.lit(0.0), index.cast("long"), 1.0
    for _ in range(digits):
        f /= base
        out = out + (k % base) * F.lit(f)
        k = F.floor(k / base)
    return out
