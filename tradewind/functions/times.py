from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000
MICROS_PER_DAY = 24 * 60 * 60 * MICROS_PER_SECOND


def months_before(as_of: dt.date | None, months: int) -> Column:
    """Midnight of the day ``months`` before ``as_of`` (default: today)."""
    day = F.current_date() if as_of is None else F.lit(as_of)
    return F.add_months(day, -months).cast("timestamp_ntz")


def elapsed(start: Column, end: Column) -> tuple[Column, Column]:
    """Time between two clock readings: whole seconds, and the microseconds beyond them.

    Both parts carry the sign and are 64-bit integers whose sums hold for trillions of rows,
    which neither an interval nor microseconds in one integer would.

    Subtraction compares the clock readings as they stand. ``timestamp_diff`` would first place
    them in the session time zone, where a daylight saving change moves some of them.
    """
    interval = end - start
    days, hours, minutes, seconds = (
        F.extract(F.lit(unit), interval) for unit in ("DAY", "HOUR", "MINUTE", "SECOND")
    )
    whole_minutes = (days.cast("bigint") * 24 + hours) * 60 + minutes
    second_micros = (seconds * MICROS_PER_SECOND).cast("bigint")
    whole_seconds = F.call_function("div", second_micros, F.lit(MICROS_PER_SECOND))
    return whole_minutes * 60 + whole_seconds, second_micros % MICROS_PER_SECOND


def as_micros(seconds: Column, micros: Column) -> Column:
    """Both parts, or sums of them, as one exact number of microseconds."""
    return seconds.cast("decimal(20,0)") * F.lit(MICROS_PER_SECOND) + micros


def month_of(moment: Column) -> Column:
    """First day of the month."""
    return F.trunc(moment.cast("date"), "month")
