from __future__ import annotations

from decimal import Decimal

import pytest

from tests.tables import at, item, rows, table
from tradewind import operators as ops
from tradewind.model import FOREIGN_KEYS, SOFT_LINKS, TABLES, Link

CUSTOMER_GEO = SOFT_LINKS[0]
ORDER_CUSTOMER = FOREIGN_KEYS[0]


def located(spark):
    return {
        "customers": table(
            spark,
            "customers",
            {"customer_id": "a", "customer_zip_code_prefix": 1},
            {"customer_id": "b", "customer_zip_code_prefix": 2},
        ),
        "geolocation": table(spark, "geolocation", *[{"geolocation_zip_code_prefix": 1}] * 3),
    }


def test_coverage_is_weighted_by_parent_rows(spark):
    tables = located(spark)
    assert rows(ops.link_coverage(tables, CUSTOMER_GEO)) == [
        ("customers->geolocation coverage_pct", Decimal("75.00"))
    ]
    assert rows(ops.link_missing(tables, CUSTOMER_GEO)) == [
        ("customers->geolocation missing", 1)
    ]
    assert rows(ops.link_counts(tables, CUSTOMER_GEO)) == [(1, 3, 4)]


def test_links_of_empty_tables(spark):
    tables = {"customers": table(spark, "customers"), "geolocation": table(spark, "geolocation")}
    assert rows(ops.link_counts(tables, CUSTOMER_GEO)) == [(0, 0, 0)]
    assert rows(ops.link_coverage(tables, CUSTOMER_GEO))[0][1] is None


def test_null_keys_are_missing_but_not_violations(spark):
    tables = {
        "orders": table(
            spark,
            "orders",
            {"order_id": "1", "customer_id": "a"},
            {"order_id": "2", "customer_id": None},
            {"order_id": "3", "customer_id": None},
            {"order_id": "4", "customer_id": "x"},
        ),
        "customers": table(spark, "customers", {"customer_id": "a"}, {"customer_id": None}),
    }
    assert rows(ops.link_missing(tables, ORDER_CUSTOMER))[0][1] == 3
    assert rows(ops.link_volume(tables, ORDER_CUSTOMER)) == [
        ("orders.customer_id -> customers.customer_id", 1)
    ]
    assert rows(ops.fk_violations(tables, [ORDER_CUSTOMER]))[0][1] == 1
    with pytest.raises(ops.DataQualityError, match="1 unknown"):
        ops.require_foreign_keys(tables, [ORDER_CUSTOMER])


def test_unique_keys(spark):
    sound = table(spark, "orders", {"order_id": "1"}, {"order_id": "2"})
    ops.require_unique_keys({"orders": sound, "geolocation": table(spark, "geolocation")})
    assert rows(ops.duplicate_keys(sound, ["order_id"])) == []
    for bad in ({"order_id": "1"}, {"order_id": None}):
        broken = sound.unionByName(table(spark, "orders", bad))
        with pytest.raises(ops.DataQualityError, match="orders"):
            ops.require_unique_keys({"orders": broken})


def test_composite_key_audit_counts_incomplete_keys(spark):
    items = table(
        spark,
        "order_items",
        item("1", "1.00"),
        item("1", "2.00"),
        item("1", "1.00", number=2),
        item(None, "1.00"),
        item("2", "1.00", number=None),
    )
    audit = ops.key_audit(items, "order_items", TABLES["order_items"].key)
    assert rows(audit) == [("order_items", 5, 2, 2)]
    assert rows(ops.duplicate_keys(items, TABLES["order_items"].key)) == [("1", 1, 2)]


def test_first_per_key_is_the_smallest_row_however_rows_arrive(spark):
    copies = [item("1", f"{n}.00", product=p) for n in (3, 1, 2) for p in ("b", "a", None)]
    items = table(spark, "order_items", *copies, item("2", "9.00"))
    keys = TABLES["order_items"].key
    expected = {("1", None, Decimal("1.00")), ("2", "p", Decimal("9.00"))}
    for arranged in (items, items.repartition(5), items.orderBy("price")):
        kept = ops.first_per_key(arranged, keys)
        assert kept.columns == items.columns
        assert kept.dtypes == items.dtypes
        assert {(r.order_id, r.product_id, r.price) for r in kept.collect()} == expected


def test_first_per_key_of_key_only_rows(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert sorted(rows(ops.first_per_key(df, ["k"]))) == [(1,), (2,)]


def test_load_keeps_a_known_copy_of_a_partly_unknown_item(spark):
    staged = table(
        spark,
        "order_items",
        item("1", "1.00", product="gone"),
        item("1", "2.00", product="p"),
        item("2", "1.00", product=None),
        item("3", "1.00", seller="gone"),
        item("4", "1.00"),
    )
    kept = ops.load_order_items(
        staged,
        table(spark, "products", {"product_id": "p"}),
        table(spark, "sellers", {"seller_id": "s"}),
    )
    assert sorted((r.order_id, r.price) for r in kept.collect()) == [
        ("1", Decimal("2.00")),
        ("4", Decimal("1.00")),
    ]


def test_insert_if_absent(spark):
    def payments(*found):
        return table(
            spark,
            "order_payments",
            *[
                {"order_id": o, "payment_sequential": n, "payment_value": v}
                for o, n, v in found
            ],
        )

    new = ops.insert_if_absent(
        payments(("1", 1, "9.00"), ("1", 2, "5.00"), ("1", 2, "4.00"), ("2", 1, "1.00")),
        payments(("1", 1, "1.00")),
        TABLES["order_payments"].key,
    )
    assert sorted((r.order_id, r.payment_sequential, r.payment_value) for r in new.collect()) == [
        ("1", 2, Decimal("4.00")),
        ("2", 1, Decimal("1.00")),
    ]


def test_schema_overview(spark):
    tables = {
        "sellers": table(
            spark, "sellers", {"seller_id": "s"}, {"seller_id": "t", "seller_city": "x"}
        ),
        "orders": table(spark, "orders", {"order_id": "1", "order_approved_at": at("2020-01-01")}),
    }
    listed = ops.schema_overview(tables)
    found = rows(ops.column_profile(tables))
    assert [r[:4] for r in found] == rows(listed)
    assert "Scan" not in listed._jdf.queryExecution().executedPlan().toString().replace("LocalTableScan", "").replace("Scan ExistingRDD", "")
    assert found[0] == ("orders", 1, "order_id", "string", 1)
    assert found[4] == ("orders", 5, "order_approved_at", "timestamp_ntz", 1)
    assert found[8:] == [
        ("sellers", 1, "seller_id", "string", 2),
        ("sellers", 2, "seller_zip_code_prefix", "int", 0),
        ("sellers", 3, "seller_city", "string", 1),
        ("sellers", 4, "seller_state", "string", 0),
    ]
    assert ops.list_tables(tables) == ["orders", "sellers"]


def test_preview(spark):
    df = spark.range(100)
    assert ops.preview(df).count() == 10
    assert [r.id for r in ops.preview(df, 3, [df.id.desc()]).collect()] == [99, 98, 97]


def test_link_labels():
    link = Link("a", "k", "b", "j")
    assert (link.arrow, link.relation) == ("a->b", "a.k -> b.j")
    assert SOFT_LINKS[2].arrow == "products->translation"
