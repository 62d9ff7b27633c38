from __future__ import annotations

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tradewind.functions import (
    amount,
    as_micros,
    elapsed,
    month_of,
    months_before,
    percent,
    rounded_ratio,
    top_k,
)


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def dec(value, kind="decimal(20,3)"):
    return F.lit(str(value)).cast(kind)


def test_amount_rounds_half_away_from_zero(spark):
    assert one(spark, amount(dec("1.505")), amount(dec("-1.505")), amount(dec("1.504"))) == (
        Decimal("1.51"),
        Decimal("-1.51"),
        Decimal("1.50"),
    )


@settings(max_examples=6, deadline=None)
@given(
    pairs=st.lists(
        st.tuples(st.integers(-(10**22), 10**22), st.integers(1, 10**12)), min_size=50, max_size=200
    )
)
def test_rounded_ratio_is_exact(spark, pairs):
    rows = [(i, str(a), b) for i, (a, b) in enumerate(pairs) if abs(a) // b < 10**16]
    if not rows:
        return
    df = spark.createDataFrame(rows, "i int, a string, b bigint")
    found = df.select(
        "i", rounded_ratio(F.col("a").cast("decimal(28,0)"), F.col("b")).alias("r")
    ).collect()
    for row in found:
        a, b = pairs[row.i]
        hundredths, rest = divmod(abs(a) * 100, b)
        hundredths += 2 * rest >= b
        assert row.r == Decimal(hundredths if a >= 0 else -hundredths).scaleb(-2)


def test_rounded_ratio_near_a_tie(spark):
    # 0.0049999999999999999... must not be rounded up by an intermediate division.
    parts, whole = dec("4999999999999999999", "decimal(20,0)"), dec(10**21, "decimal(22,0)")
    near = rounded_ratio(parts, whole)
    assert one(spark, near) == (Decimal("0.00"),)


def test_ratio_of_nothing_is_null(spark):
    none = F.lit(None).cast("decimal(12,2)")
    assert one(
        spark,
        rounded_ratio(F.lit(0), F.lit(0)),
        percent(none, F.lit(3)),
        percent(F.lit(1), none),
        percent(dec("0.00"), dec("0.00")),
    ) == (None, None, None, None)


def test_percent(spark):
    assert one(spark, percent(F.lit(2), F.lit(3)), percent(F.lit(1), F.lit(8))) == (
        Decimal("66.67"),
        Decimal("12.50"),
    )


@pytest.mark.parametrize(
    ("order", "expected"),
    [
        (F.asc_nulls_last, [1, 2, None]),
        (F.desc_nulls_first, [None, 2, 1]),
        (F.desc_nulls_last, [2, 1, None]),
    ],
)
def test_null_placement(spark, order, expected):
    df = spark.createDataFrame([(1,), (None,), (2,)], "v int")
    assert [row.v for row in df.orderBy(order("v")).collect()] == expected
    assert [row.v for row in top_k(df, 2, order("v")).collect()] == expected[:2]


def test_months_before_clamps_to_month_end(spark):
    assert one(spark, months_before(dt.date(2020, 2, 29), 12)) == (dt.datetime(2019, 2, 28),)
    today, start = one(spark, F.current_date(), months_before(None, 0))
    assert start == dt.datetime.combine(today, dt.time())


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo"])
def test_wall_clock_arithmetic_in_any_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # Clocks in Sao Paulo skipped from 00:00 to 01:00 on 15 October 2017.
        df = spark.sql(
            "SELECT * FROM VALUES "
            "(timestamp_ntz'2017-10-15 00:30:00', timestamp_ntz'2017-10-16 12:30:00.25'),"
            "(timestamp_ntz'2017-10-15 00:00:00.5', timestamp_ntz'2017-10-14 23:00:00'),"
            "(NULL, timestamp_ntz'2017-10-14 23:00:00') AS t(a, b)"
        )
        parts = [tuple(row) for row in df.select(*elapsed(F.col("a"), F.col("b"))).collect()]
        whole = df.select(as_micros(*elapsed(F.col("a"), F.col("b"))))
        micros = [row[0] for row in whole.collect()]
        months = [row[0] for row in df.select(month_of(F.col("a"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert parts == [(129_600, 250_000), (-3_600, -500_000), (None, None)]
    assert micros == [Decimal(129_600_250_000), Decimal(-3_600_500_000), None]
    assert months == [dt.date(2017, 10, 1), dt.date(2017, 10, 1), None]


def test_amount_matches_decimal_rounding(spark):
    values = ["0.005", "-0.005", "2.675", "123456789.994", "-9.995"]
    found = one(spark, *[amount(dec(v)) for v in values])
    assert found == tuple(Decimal(v).quantize(Decimal("0.01"), ROUND_HALF_UP) for v in values)
