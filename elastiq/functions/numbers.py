"""Guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nonzero(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


def ratio(a: Column, b: Column, places: int) -> Column:
    """``a / b`` rounded, NULL where ``b`` is 0 or NULL."""
    return F.round(a / nonzero(b), places)


def plain_number(c: Column) -> Column:
    """A double as text without exponent and without trailing zeros."""
    return F.regexp_replace(c.cast("decimal(28,12)").cast("string"), r"\.?0+$", "")

