"""Dense numbers, bitmaps of orders, and the catalog's listing."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.tables import at, item, rows, table
from tradewind import operators as ops
from tradewind.functions import dense_numbers, partition_rows
from tradewind.sources import Commit, catalog_listing, latest_version, register_tables


def kept(spark, df, path):
    df.write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_numbers_have_no_gaps_and_follow_the_order(spark, tmp_path):
    values = spark.range(0, 70_000, 1, 9).select((F.col("id") * 7919 % 70_001).alias("v"))
    found = dense_numbers(kept(spark, partition_rows(values, "v"), tmp_path / "v")).orderBy("number").collect()
    assert [r.number for r in found] == list(range(70_000))
    assert [r.v for r in found] == sorted(r.v for r in found)
    assert dense_numbers(kept(spark, partition_rows(values.limit(0), "v"), tmp_path / "e")).collect() == []


@pytest.fixture
def shop(spark):
    rng = random.Random(2)
    orders = [
        {"order_id": f"o{i}", "order_purchase_timestamp": at(f"2018-{1 + i % 5:02d}-03") if i % 9 else None}
        for i in range(80)
    ]
    items = [
        item(rng.choice([f"o{i}" for i in range(90)] + [None]), f"{rng.randrange(900)}.25", number=n, seller=rng.choice(["a", "b", None]))
        for n in range(600)
    ]
    return table(spark, "orders", *orders), table(spark, "order_items", *items)


def test_bitmaps_add_up_over_any_months(spark, shop, tmp_path):
    orders, items = shop
    numbered = dense_numbers(kept(spark, ops.placed_orders(items, orders), tmp_path / "o"))
    months = kept(spark, ops.seller_months(items, numbered), tmp_path / "m")
    assert rows(ops.top_sellers_from(months)) == rows(ops.top_sellers(items))
    bought = items.join(orders, "order_id")
    for low, high in ((1, 2), (2, 4), (5, 5)):
        own = bought.where(F.month("order_purchase_timestamp").between(low, high))
        some = ops.top_sellers_from(months.where(F.month("month").between(low, high)))
        assert rows(some) == rows(ops.top_sellers(own))


def test_numbers_beyond_one_bitmap(spark, tmp_path):
    numbered = spark.range(100_000).selectExpr("CAST(id AS string) AS order_id", "date'2018-01-01' AS month", "id AS number")
    items = spark.range(300_000).selectExpr(
        "CAST(id % 100000 AS string) AS order_id", "CAST(id % 3 AS string) AS seller_id", "CAST(1 AS decimal(12,2)) AS price"
    )
    months = ops.seller_months(items, numbered)
    assert months.select("bucket").distinct().count() == 4
    assert rows(ops.seller_totals(months).orderBy("seller_id")) == [
        (s, 100_000, Decimal("100000.00")) for s in ("0", "1", "2")
    ]


def test_a_few_orders_take_little_room(spark):
    """A seller's orders of a month take a row for each at most, not a whole bitmap."""
    numbered = spark.range(1000).selectExpr(
        "CAST(id AS string) AS order_id", "date'2018-01-01' AS month", "id * 32768 AS number"
    )
    items = spark.range(5000).selectExpr(
        "if(id < 4000, CAST(id % 1000 AS string), NULL) AS order_id",
        "if(id >= 4990, 'n', CAST(id % 100 AS string)) AS seller_id",
        "CAST(1 AS decimal(12,2)) AS price",
    )
    months = ops.seller_months(items, numbered)
    assert months.schema["orders"].dataType.typeName() == "long"
    assert months.where("orders IS NOT NULL").count() == 1000
    totals = {r.seller_id: (r.orders, r.revenue) for r in ops.seller_totals(months).collect()}
    assert totals["n"] == (0, Decimal("10.00")) and totals["7"] == (10, Decimal("50.00"))
    assert sum(n for n, _ in totals.values()) == 1000


def test_the_catalog_lists_what_a_version_holds(spark, tmp_path):
    directory = str(tmp_path / "d")
    schemas = {}
    commit = Commit(spark, directory)
    for name, df, part in (
        ("t", spark.range(10).selectExpr("id", "id % 3 AS p", "CAST(NULL AS string) AS s"), "p"),
        ("e", spark.range(0), None),
        ("u", spark.range(4), None),
    ):
        commit.write(name, df, partition_by=part)
        schemas[name] = df.schema
    version = commit.publish()
    later = Commit(spark, directory, version)
    later.write("u", spark.range(3))  # never published
    register_tables(latest_version(spark, directory), schemas, "listed")
    spark.range(5).createOrReplaceTempView("u")
    listing = rows(catalog_listing(spark, "listed"))
    # A partition column is listed with the columns that say where a row is stored.
    assert listing == [("e", 1, "id", "bigint", 0), ("t", 1, "id", "bigint", 10), ("t", 2, "s", "string", 10), ("u", 1, "id", "bigint", 4)]
    assert spark.table("listed.u").count() == 4
    assert spark.table("listed.t").where("p = 1").count() == 3
    again = Commit(spark, directory, version)
    again.write("u", spark.range(3))
    register_tables(again.publish(), schemas, "listed")
    assert [r[4] for r in rows(catalog_listing(spark, "listed")) if r[0] == "u"] == [7]


def test_table_overview(spark):
    found = ops.table_overview({"b": spark.range(3), "a": spark.range(0).selectExpr("id", "'x' AS s")})
    assert rows(found) == [("a", 1, "id", "bigint", 0), ("a", 2, "s", "string", 0), ("b", 1, "id", "bigint", 3)]
