"""Exact decimal results: amounts, averages and percentages at two digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Wide enough that totals over trillions of rows do not overflow.
AMOUNT = T.DecimalType(38, 2)


def amount(value: Column) -> Column:
    """``value`` as a two-digit decimal, rounded half away from zero."""
    return F.round(value, 2).cast(AMOUNT)


def rounded_ratio(numerator: Column, denominator: Column, places: int = 2) -> Column:
    """``numerator / denominator`` rounded half away from zero to ``places`` digits.

    Decimal division rounds once on its own before ``round`` does, and keeps fewer digits the
    larger its operands are. Integer division of the scaled operands rounds exactly once.
    The denominator is a count or another non-negative number; zero gives NULL.
    """
    divisor = F.nullif(denominator, F.lit(0))
    scaled = F.abs(numerator) * F.lit(2 * 10**places) + divisor
    units = F.call_function("div", scaled, divisor * F.lit(2)).cast("decimal(20,0)")
    signed = F.when(numerator < 0, -units).otherwise(units)
    step = F.lit(f"{10**-places:.{places}f}").cast(T.DecimalType(places, places))
    return (signed * step).cast(T.DecimalType(38, places))


def percent(part: Column, whole: Column) -> Column:
    """``part`` as a percentage of ``whole``, two digits; NULL when ``whole`` is zero."""
    return rounded_ratio(_exact(part) * F.lit(100), _exact(whole))


def _exact(value: Column) -> Column:
    # Counts become decimals so that scaling them cannot overflow a 64-bit integer.
    return value.cast(T.DecimalType(30, 2))
