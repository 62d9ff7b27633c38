"""Relations between results that hold on any dataset, and the columns of every report."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from contract.bindings import bind, orders_with_delivery
from tradewind import operators as ops
from tradewind.model import FOREIGN_KEYS, SOFT_LINKS
from tradewind.plans import REPORTS

SF_DIR = "/root/testdata/sf0.01"

# The columns of each report, in order.
COLUMNS = {
    "gmv_by_state": "state gmv",
    "top_categories": "category revenue items_sold",
    "gmv_by_month": "month gmv",
    "aov_by_customer": "customer_id customer_city customer_state orders_count avg_order_value",
    "payment_mix": "payment_type payment_records total_paid pct_of_total",
    "delivery_days_by_state": "customer_state avg_delivery_days delivered_orders",
    "repeat_rate": "repeat_purchase_rate_pct repeat_customers total_customers",
    "top_sellers": "seller_id orders revenue",
    "review_by_category": "category avg_review reviews",
    "cancel_rate_by_state": "customer_state canceled total_orders canceled_rate_pct",
    "price_range_by_category": "category min_item_price max_item_price",
    "recent_orders": "order_id customer_id order_status order_purchase_timestamp",
    "payment_stats": "payment_type cnt avg_payment min_payment max_payment",
    "order_totals": "order_id order_total",
}


@pytest.fixture(scope="module")
def tables(spark):
    return bind(spark, SF_DIR) | {"orders": orders_with_delivery(spark, SF_DIR)}


def total(df, expression):
    return df.agg(F.expr(expression)).first()[0]


def test_report_columns(tables):
    assert {name: " ".join(report(tables).columns) for name, report in REPORTS.items()} == COLUMNS


def test_orders_add_up(tables):
    by_state = REPORTS["cancel_rate_by_state"](tables, canceled_status="F")
    n_orders = total(by_state, "sum(total_orders)")
    assert n_orders == tables["orders"].count()
    assert n_orders == ops.link_volume(tables, FOREIGN_KEYS[0]).first()["count"]
    delivered = total(REPORTS["delivery_days_by_state"](tables), "sum(delivered_orders)")
    assert delivered == tables["orders"].where("order_delivered_customer_date IS NOT NULL").count()
    per_order = REPORTS["repeat_rate"](tables, entity_key="order_id").first()
    assert (per_order.repeat_customers, per_order.total_customers) == (0, n_orders)


def test_item_values_add_up(tables):
    value = total(tables["order_items"], "sum(price + freight_value)")
    assert total(REPORTS["gmv_by_state"](tables), "sum(gmv)") == value
    assert total(REPORTS["gmv_by_month"](tables, as_of=dt.date(1996, 1, 1)), "sum(gmv)") == value
    assert total(REPORTS["order_totals"](tables, k=100_000), "sum(order_total)") == value
    revenue = total(tables["order_items"], "sum(price)")
    assert total(REPORTS["top_categories"](tables, k=1_000), "sum(revenue)") == revenue
    assert total(REPORTS["top_sellers"](tables, k=1_000), "sum(revenue)") == revenue


def test_payments_add_up(tables):
    mix = REPORTS["payment_mix"](tables)
    payments = tables["order_payments"]
    assert total(mix, "sum(total_paid)") == total(payments, "sum(payment_value)")
    assert total(mix, "sum(payment_records)") == payments.count()
    shares = [row.pct_of_total for row in mix.collect()]
    assert abs(sum(shares) - 100) <= len(shares) / 200


def test_categories_are_translated_fallback_or_null(tables):
    found = [row.category for row in REPORTS["price_range_by_category"](tables).collect()]
    assert found[-1] is None and None not in found[:-1]
    assert found[:-1] == sorted(found[:-1])
    english = tables["product_category_name_translation"].select("product_category_name_english")
    fallback = set(found[:-1]) - {row[0] for row in english.collect()}
    assert fallback == {"Brand#1", "Brand#2"}


def test_a_child_row_is_either_missing_or_matched(tables):
    for link in FOREIGN_KEYS + SOFT_LINKS:
        counts = ops.link_counts(tables, link).first()
        assert counts.outer_rows == counts.joined + counts.missing
        parents = tables[link.parent].select(F.col(link.parent_key).alias(link.child_key))
        matched = tables[link.child].join(parents.distinct(), link.child_key, "left_semi").count()
        assert matched + counts.missing == tables[link.child].count()


def test_registered_scratch_folder_is_the_shared_one(spark):
    from contract.registry import scratch_dir

    shared = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_dir(spark), scratch_dir(spark)
    assert first.startswith(f"{shared}/") and first != second
