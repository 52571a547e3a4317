"""Fuzzy memberships and rules as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def is_high(x: Column, a: float, b: float) -> Column:
    """Rises from 0 at a to 1 at b; a step if they are equal."""
    return F.when(x >= b, 1.0).otherwise(0.0) if a == b else clamp((x - a) / F.lit(float(b - a)))


def is_low(x: Column, a: float, b: float) -> Column:
    return F.when(x <= a, 1.0).otherwise(0.0) if a == b else clamp((F.lit(float(b)) - x) / F.lit(float(b - a)))


def is_about(x: Column, centre: float, half: float) -> Column:
    return clamp(1 - F.abs(x - centre) / F.lit(max(float(half), 1e-5)))


def fuzzy_and(*x: Column) -> Column:
    return F.least(*x)


def fuzzy_or(*x: Column) -> Column:
    return F.greatest(*x)


def fuzzy_not(x: Column) -> Column:
    return 1 - x


def fuzzy_mean(*x: Column) -> Column:
    return sum(x) / len(x)
