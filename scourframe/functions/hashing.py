"""Seeded values computed from a row key, so they do not depend on partitioning or on a retried task.

The hash uses only 64-bit integer arithmetic, which any SQL engine can repeat.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = 4294967296  # 2^32
MULTIPLIER = 1540483477
SALT_STEP = 40503
FOLD = 1779033703


def keyed_hash(key: Column, salt: int) -> Column:
    """Uniform integer in [0, 2^32) for a BIGINT key. The products stay below 2^63, as ANSI mode demands.

    The upper half of the key is folded into the lower one, so that keys 2^32 apart differ; keys below 2^32 are unchanged by it.
    """
    mask = F.lit(SPACE - 1)
    k = key.cast("bigint")
    upper = (F.shiftright(k, 32).bitwiseAND(mask) * F.lit(FOLD)).bitwiseAND(mask)
    h = (k.bitwiseAND(mask).bitwiseXOR(upper) * F.lit(MULTIPLIER) + F.lit(salt * SALT_STEP)).bitwiseAND(mask)
    h = h.bitwiseXOR(F.shiftright(h, 15))
    h = (h * F.lit(MULTIPLIER)).bitwiseAND(mask)
    return h.bitwiseXOR(F.shiftright(h, 13))


def hash_int(key: Column, salt: int, low: int, high: int) -> Column:
    """Uniform integer in [low, high)."""
    return F.lit(low).cast("bigint") + F.shiftright(keyed_hash(key, salt) * F.lit(high - low), 32)


def hash_unit(key: Column, salt: int) -> Column:
    """Uniform double in [0, 1)."""
    return keyed_hash(key, salt) / F.lit(float(SPACE))


def hash_uniform(key: Column, salt: int, low: float, high: float, places: int = 2) -> Column:
    scale = float(10 ** places)
    return F.rint((F.lit(low) + F.lit(high - low) * hash_unit(key, salt)) * scale) / scale + F.lit(0.0)


def hash_choice(key: Column, salt: int, values: Sequence) -> Column:
    """One of a fixed list of values."""
    index = hash_int(key, salt, 0, len(values)).cast("int") + 1
    return F.element_at(F.array(*[F.lit(v) for v in values]), index)


def hash_normal(key: Column, salt: int, mean: float, sd: float) -> Column:
    """Normal variate by the Box-Muller formula on two keyed uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - hash_unit(key, salt)))
    return F.lit(mean) + F.lit(sd) * radius * F.cos(F.lit(6.283185307179586) * hash_unit(key, salt + 1))


def in_slice(h: Column, rate: float, start: float = 0.0) -> Column:
    """True where a hash falls in the slice [start, start + rate) of its range."""
    return (h >= F.lit(int(start * SPACE))) & (h < F.lit(int((start + rate) * SPACE)))


def selected(key: Column, salt: int, rate: float, start: float = 0.0) -> Column:
    """True for a share of the keys; touching slices of one salt are disjoint."""
    return in_slice(keyed_hash(key, salt), rate, start)


def random_date(key: Column, salt: int, start: str, end: str) -> Column:
    """Date in [start, end)."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    span = F.datediff(last, first).cast("bigint")
    return F.date_add(first, F.shiftright(keyed_hash(key, salt) * span, 32).cast("int"))
