"""Stateless random draws.

A draw is a pure function of a seed, a label and the row's own keys. Generated tables therefore do
not depend on partitioning, and a task that runs again after a lost executor yields the same rows.
One digest per row supplies eight independent 16-bit draws, and any SQL engine can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


SLOTS = 1 << 16  # values of one draw


def entropy(seed: int, label: str, *keys: Column) -> Column:
    """32 hexadecimal digits that look random for every new combination of arguments."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.lit(label), *[k.cast("string") for k in keys]))


def slot(digits: Column, i: int) -> Column:
    """Draw number i (0..7) of a row: an integer in [0, 65536)."""
    return F.conv(F.substring(digits, 4 * i + 1, 4), 16, 10).cast("int")


def uniform_int(digits: Column, i: int, low: int, high: int) -> Column:
    """Uniform integer in [low, high]."""
    return F.lit(low) + slot(digits, i) % (high - low + 1)


def wide_int(digits: Column, i: int, n: int) -> Column:
    """Uniform integer in [0, n) for large n, from 32 bits: draw i (0..3)."""
    return F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("bigint") % n


def chance(digits: Column, i: int, percent: int) -> Column:
    """True with the given probability in percent."""
    return slot(digits, i) % 100 < percent


def pick(digits: Column, i: int, values: tuple) -> Column:
    """One of a short list of values, all equally likely."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), uniform_int(digits, i, 1, len(values)))


def pick_weighted(digits: Column, i: int, weighted: tuple[tuple[object, int], ...]) -> Column:
    """One of a short list of values with weights in percent."""
    roll = slot(digits, i) % 100
    upper, out = 0, None
    for value, weight in weighted[:-1]:
        upper += weight
        out = F.when(roll < upper, value) if out is None else out.when(roll < upper, value)
    return out.otherwise(weighted[-1][0])


def shifted(start: Column, days: Column, cap: Column) -> Column:
    """`start` plus some days, never after `cap`."""
    return F.least(F.date_add(start, days), cap)
