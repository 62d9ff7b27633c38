"""Every registered query against DuckDB on the same Parquet tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry
from contract.oracle import oracle_sql
from contract.registry import queries

SF_DIR = Path("/root/testdata/sf0.01")
ORDERED = {
    "gmv_by_state",
    "top_categories",
    "gmv_by_month",
    "gmv_by_month_leap_day",
    "aov_by_customer",
    "payment_mix",
    "delivery_days_by_state",
    "top_sellers",
    "top_sellers_rollup",
    "review_by_category",
    "review_by_category_high_bar",
    "cancel_rate_by_state",
    "price_range_by_category",
    "recent_orders",
    "payment_stats",
    "order_totals",
    "full_refresh_gmv",
    "gmv_by_state_appended",
    "gmv_by_month_stored",
    "gmv_by_month_today",
    "gmv_by_period_stored",
    *(f"preview_{t}" for t in ("customers", "orders", "order_items", "products", "sellers")),
}

# Probed results of FIXTURES.md: (row count, a row that must be present).
ANCHORS = {
    "gmv_by_state": (25, {"state": "NATION_0", "gmv": "115271067.27"}),
    "top_categories": (15, {}),
    "gmv_by_month": (13, {"month": "2001-08-01", "gmv": "495299.01"}),
    "gmv_by_month_empty": (0, None),
    "aov_by_customer": (20, {"customer_id": "1028", "avg_order_value": "341900.24"}),
    "payment_mix": (5, {"payment_type": "click", "total_paid": "101951.00"}),
    "delivery_days_by_state": (25, {"customer_state": "NATION_0", "avg_delivery_days": "745.86"}),
    "repeat_rate": (1, {"repeat_purchase_rate_pct": "99.87", "repeat_customers": "1498"}),
    "top_sellers": (20, {"seller_id": "0", "orders": "644", "revenue": "35574597.21"}),
    "review_by_category_high_bar": (10, {}),
    "cancel_rate_by_state": (25, {"customer_state": "NATION_0", "canceled_rate_pct": "34.68"}),
    "price_range_by_category": (26, {"category": "None", "max_item_price": "104786.32"}),
    "soft_products_translation_missing": (1, {"count": "202"}),
    "soft_customers_geolocation_missing": (1, {"count": "319"}),
    "soft_customers_geolocation_coverage": (1, {"pct": "89.84"}),
    "pk_composite_items": (1, {"total_rows": "60000", "distinct_keys": "45832"}),
    "load_order_items": (36846, {}),
    "ri_items_orders_volume": (1, {"count": "60000"}),
    "gmv_by_month_today": (13, {}),
    "gmv_by_period_stored": (7, {}),
    "append_payments": (3365, {}),
    "src_csv_spanning": (1000, {}),
    "snk_csv_empty": (1, {"value": "month,gmv"}),
    "preview_any_orders": (1, {"n_rows": "10", "n_known": "10"}),
    "src_feed_inventory": (9, {"table_name": "sellers", "present": "False", "records": "None"}),
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _key(row):
    return tuple((value is None, str(value)) for value in row)


def test_every_query_has_an_oracle():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_matches_oracle(spark, duck, name):
    result = queries()[name](spark, str(SF_DIR))
    actual = [tuple(row) for row in result.collect()]
    expected = duck.execute(oracle_sql()[name]).fetchall()
    columns = [column[0] for column in duck.description]
    assert sorted(result.columns) == sorted(columns)
    places = [columns.index(column) for column in result.columns]
    expected = [tuple(row[place] for place in places) for row in expected]
    if name not in ORDERED:
        actual, expected = sorted(actual, key=_key), sorted(expected, key=_key)
    assert actual == expected
    if name in ANCHORS:
        count, cells = ANCHORS[name]
        assert len(actual) == count
        named = [dict(zip(result.columns, map(str, row))) for row in actual]
        assert cells is None or any(cells.items() <= row.items() for row in named)


def test_entry(spark):
    assert entry(spark).columns == ["state", "gmv"]
    assert entry(spark).count() == 25
