"""Rounding, numbers as text, and the counter form of a small generator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round3(x: Column) -> Column:
    """Three places, halves up, on the double as it is."""
    return F.floor(x * 1000 + 0.5) / 1000


def plain(x: Column) -> Column:
    """A number as text without a needless ``.0``."""
    return F.regexp_replace(x.cast("double").cast("string"), r"\.0$", "")


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of 32-bit numbers, in 64-bit steps that can't overflow."""
    low, high = b.bitwiseAND(0xFFFF), F.shiftrightunsigned(b, 16)
    return (a * low + F.shiftleft((a * high).bitwiseAND(0xFFFF), 16)).bitwiseAND(0xFFFFFFFF)


def _low32(a: Column) -> Column:
    return a.bitwiseAND(0xFFFFFFFF)


def uniform_draw(seed: int, i: Column) -> Column:
    """Draw ``i`` (from 1) of the mulberry32 generator in [0, 1): its state is linear in ``i``, so any draw stands alone."""
    step = F.lit(0x6D2B79F5).cast("long")  # fixed value: the generator's increment
    s = _low32(F.lit(seed).cast("long") + _times(step, _low32(i.cast("long"))))
    t = _times(s.bitwiseXOR(F.shiftrightunsigned(s, 15)), s.bitwiseOR(F.lit(1).cast("long")))
    t = _low32(t + _times(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61).cast("long")))).bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / F.lit(4294967296.0)
