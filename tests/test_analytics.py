"""Cases the test tables lack: NULLs, ties, empty inputs, zero totals, fan-out."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from tests.tables import at, item, rows, table
from tradewind import operators as ops
from tradewind.model import TABLES
from tradewind.plans import REPORTS

D = Decimal


def orders(spark, *pairs, **columns):
    return table(spark, "orders", *[{"order_id": o, "customer_id": c, **columns} for o, c in pairs])


def order_values(spark, *items):
    return ops.items_per_order(table(spark, "order_items", *items))


def customers(spark, *pairs):
    return table(
        spark, "customers", *[{"customer_id": c, "customer_state": s} for c, s in pairs]
    )


def products(spark, *pairs):
    return table(
        spark, "products", *[{"product_id": p, "product_category_name": c} for p, c in pairs]
    )


def translation(spark, *pairs):
    return table(
        spark,
        "product_category_name_translation",
        *[
            {"product_category_name": a, "product_category_name_english": b}
            for a, b in pairs
        ],
    )


def test_gmv_ignores_rows_with_a_null_part_and_keeps_null_state(spark):
    result = ops.gmv_by_state(
        orders(spark, ("1", "a"), ("2", "b"), ("3", "c"), ("4", "gone"), ("5", "a")),
        customers(spark, ("a", "SP"), ("b", None), ("c", "RJ")),
        order_values(
            spark,
            item("1", "1.00", None),
            item("1", "2.00", "0.50", 2),
            item("2", "7.00"),
            item("3", "9.00", None),
            item("4", "99.00"),
            item("9", "99.00"),
        ),
    )
    # RJ has only unknown values: its total is NULL, which sorts first going down.
    assert rows(result) == [("RJ", None), (None, D("7.00")), ("SP", D("2.50"))]


def test_gmv_by_month_window(spark):
    moments = [
        "2018-01-14 23:59:59",
        "2018-01-15 00:00:00",
        "2018-01-31 10:00:00",
        "2019-01-15 01:00:00",
    ]
    placed = table(
        spark,
        "orders",
        *[
            {"order_id": str(i), "order_purchase_timestamp": at(m)}
            for i, m in enumerate(moments)
        ],
    )
    sold = order_values(spark, *[item(str(i), f"{10**i}.00") for i in range(4)])
    result = ops.gmv_by_month(placed, sold, as_of=dt.date(2019, 1, 15))
    assert rows(result) == [
        (dt.date(2018, 1, 1), D("110.00")),
        (dt.date(2019, 1, 1), D("1000.00")),
    ]
    late = ops.gmv_by_month(placed, sold)
    assert rows(late) == [] and late.columns == ["month", "gmv"]


def test_aov_averages_orders_not_items(spark):
    result = ops.aov_by_customer(
        orders(spark, ("1", "a"), ("2", "a"), ("3", "b"), ("4", "c")),
        customers(spark, ("a", "SP"), ("b", "RJ"), ("c", "MG")),
        order_values(
            spark,
            item("1", "1.00"),
            item("1", "1.00", "1.00", 2),
            item("2", "0.01"),
            item("3", "5.00"),
            item("4", None),
        ),
    )
    found = [(row.customer_id, row.orders_count, row.avg_order_value) for row in result.collect()]
    # (3.00 + 0.01) / 2 = 1.505
    assert found == [("c", 1, None), ("b", 1, D("5.00")), ("a", 2, D("1.51"))]


def test_top_k_breaks_ties_by_id(spark):
    sold = table(
        spark, "order_items", *[item("1", "5.00", number=i, seller=f"s{i:02}") for i in range(30)]
    )
    found = ops.top_sellers(sold).collect()
    assert [row.seller_id for row in found] == [f"s{i:02}" for i in range(20)]
    assert {row.orders for row in found} == {1}


def test_categories_translate_fall_back_and_group_null(spark):
    sold = table(
        spark,
        "order_items",
        item("1", "3.00", product="p1"),
        item("1", "5.00", number=2, product="p2"),
        item("1", "1.00", number=3, product="p3"),
        item("1", "2.00", number=4, product="p4"),
        item("1", None, number=5, product="p4"),
        item("1", "100.00", number=6, product="unknown"),
        item("1", "100.00", number=7, product=None),
    )
    catalogue = products(spark, ("p1", "arte"), ("p2", "arte"), ("p3", "solo"), ("p4", None))
    names = translation(spark, ("arte", "art"), ("other", "unused"))
    assert rows(ops.top_categories(sold, catalogue, names)) == [
        ("art", D("8.00"), 2),
        (None, D("2.00"), 2),
        ("solo", D("1.00"), 1),
    ]
    assert rows(ops.price_range_by_category(sold, catalogue, names)) == [
        ("art", D("3.00"), D("5.00")),
        ("solo", D("1.00"), D("1.00")),
        (None, D("2.00"), D("2.00")),
    ]


def test_two_names_with_one_translation_share_a_category(spark):
    sold = table(
        spark, "order_items", item("1", "3.00", product="p1"), item("2", "4.00", product="p2")
    )
    result = ops.top_categories(
        sold, products(spark, ("p1", "a"), ("p2", "b")), translation(spark, ("a", "x"), ("b", "x"))
    )
    assert rows(result) == [("x", D("7.00"), 2)]


def test_a_review_counts_once_per_item(spark):
    reviews = table(
        spark,
        "order_reviews",
        {"review_id": "r1", "order_id": "1", "review_score": 5},
        {"review_id": "r2", "order_id": "1", "review_score": 2},
        {"review_id": "r3", "order_id": "1"},
        {"review_id": "r4", "order_id": "none", "review_score": 1},
    )
    sold = table(
        spark,
        "order_items",
        *[item("1", "1.00", number=i, product="p1" if i < 3 else "p2") for i in range(4)],
    )
    catalogue = products(spark, ("p1", "a"), ("p2", "b"))
    names = translation(spark)
    assert rows(ops.review_by_category(reviews, sold, catalogue, names, min_reviews=1)) == [
        ("a", D("3.50"), 9),
        ("b", D("3.50"), 3),
    ]
    assert rows(ops.review_by_category(reviews, sold, catalogue, names, min_reviews=4)) == [
        ("a", D("3.50"), 9)
    ]


def test_payment_mix(spark):
    def paid(*values):
        return table(
            spark,
            "order_payments",
            *[{"order_id": "1", "payment_type": t, "payment_value": v} for t, v in values],
        )

    assert rows(ops.payment_mix(paid(("card", "2.00"), ("cash", "1.00"), (None, None)))) == [
        (None, 1, None, None),
        ("card", 1, D("2.00"), D("66.67")),
        ("cash", 1, D("1.00"), D("33.33")),
    ]
    assert rows(ops.payment_mix(paid(("card", "0.00"), ("cash", "0.00")))) == [
        ("card", 1, D("0.00"), None),
        ("cash", 1, D("0.00"), None),
    ]
    assert rows(ops.payment_mix(paid())) == []


def test_payment_stats_mean_is_not_rounded_to_cents(spark):
    payments = table(
        spark,
        "order_payments",
        *[{"payment_type": "card", "payment_value": v} for v in ("1.00", "1.00", "0.00", None)],
        {"payment_type": "none"},
    )
    assert rows(ops.payment_stats(payments)) == [
        ("card", 4, D("0.666666666666666667"), D("0.00"), D("1.00")),
        ("none", 1, None, None, None),
    ]


def test_delivery_days(spark):
    def order(number, customer, start, end):
        return {
            "order_id": number,
            "customer_id": customer,
            "order_purchase_timestamp": start and at(start),
            "order_delivered_customer_date": end and at(end),
        }

    placed = table(
        spark,
        "orders",
        order("1", "a", "2020-01-01 00:00:00", "2020-01-02 12:00:00"),
        order("2", "a", "2020-01-01 00:00:00", None),
        order("3", "a", None, "2020-01-02 12:00:00"),
        order("4", "b", "2020-01-03 00:00:00", "2020-01-02 12:00:00"),
        order("5", "gone", "2020-01-01 00:00:00", "2020-01-02 12:00:00"),
    )
    result = ops.delivery_days_by_state(placed, customers(spark, ("a", "SP"), ("b", "RJ")))
    assert rows(result) == [("RJ", D("-0.50"), 1), ("SP", D("1.50"), 2)]


def test_cancel_rate(spark):
    placed = table(
        spark,
        "orders",
        *[
            {"order_id": str(i), "customer_id": c, "order_status": s}
            for i, (c, s) in enumerate(
                [("a", "canceled"), ("a", "shipped"), ("b", None), ("c", "canceled")]
            )
        ],
    )
    people = customers(spark, ("a", "SP"), ("b", "RJ"))
    assert rows(ops.cancel_rate_by_state(placed, people)) == [
        ("SP", 1, 2, D("50.00")),
        ("RJ", 0, 1, D("0.00")),
    ]


def test_repeat_rate(spark):
    placed = orders(spark, ("1", "a"), ("2", "a"), ("3", "b"), ("4", None), ("5", None))
    # Orders without a customer form one group, as in any GROUP BY.
    assert rows(ops.repeat_rate(placed)) == [(D("66.67"), 2, 3)]
    assert rows(ops.repeat_rate(placed, entity_key="order_id")) == [(D("0.00"), 0, 5)]
    assert rows(ops.repeat_rate(orders(spark))) == [(None, 0, 0)]


def test_recent_orders(spark):
    def order(number, status, day=None):
        moment = day and at(day)
        return {"order_id": number, "order_status": status, "order_purchase_timestamp": moment}

    placed = table(
        spark,
        "orders",
        order("1", "shipped"),
        order("2", "delivered", "2020-01-01"),
        order("3", "invoiced", "2021-01-01"),
        order("4", "canceled", "2022-01-01"),
        order("5", None),
    )
    assert [row.order_id for row in ops.recent_orders(placed).collect()] == ["1", "3", "2"]
    assert [row.order_id for row in ops.recent_orders(placed, k=2).collect()] == ["1", "3"]


def test_order_totals_drop_unknown_orders(spark):
    sold = order_values(spark, item("1", "1.00", "0.25"), item("9", "50.00"))
    assert rows(ops.order_totals(orders(spark, ("1", "a")), sold)) == [("1", D("1.25"))]


@pytest.mark.parametrize("name", sorted(set(REPORTS) - {"repeat_rate"}))
def test_grouped_results_of_nothing_keep_their_columns(spark, name):
    empty = {table_name: table(spark, table_name) for table_name in TABLES}
    result = REPORTS[name](empty)
    assert rows(result) == [] and len(result.columns) >= 2
