"""Rounding half up, clamping and min-max scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """Half towards plus infinity; `round` of SQL goes away from zero instead."""
    return F.floor(x * 10.0**digits + 0.5).cast("double") / 10.0**digits


def clamp(x: Column, low: float, high: float) -> Column:
    """NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def min_max(x: Column, low: Column, high: Column) -> Column:
    """0 at the low end, 100 at the high one, 50 when they meet."""
    known = x.isNotNull() & low.isNotNull() & high.isNotNull()  # asked of the columns: `clamp` would write the quotient out twice
    return F.when(~known, None).when(high <= low, 50.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (x - low) / (high - low) * 100)))
