"""Stored datasets: versions, appends, derived tables, and what they read."""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.tables import at, item, rows, table
from tradewind import operators as ops
from tradewind.model import KEY_PARTS, TABLES
from tradewind.operators import DataQualityError
from tradewind.plans import DERIVED, REPORTS, append_new, read_derived, store_derived, store_table
from tradewind.plans.refresh import KEY_PART, key_part
from tradewind.sources import Commit, VersionConflict, latest, latest_version, read_table

MONTHS = [at(f"2018-{m:02d}-{d:02d} 10:00:00") for m in range(1, 7) for d in (1, 15)]


def base_tables(spark):
    orders = [
        {"order_id": f"o{i}", "customer_id": f"c{i % 3}", "order_purchase_timestamp": MONTHS[i % 12]}
        for i in range(24)
    ] + [{"order_id": "undated", "customer_id": "c0"}]
    return {
        "customers": table(spark, "customers", *[{"customer_id": f"c{i}", "customer_state": f"S{i % 2}"} for i in range(3)]),
        "products": table(spark, "products", {"product_id": "p"}),
        "sellers": table(spark, "sellers", {"seller_id": "s"}),
        "orders": table(spark, "orders", *orders),
        "order_items": table(spark, "order_items", *[item(o["order_id"], "10.00", "0.50") for o in [*orders[::2], orders[7]]]),
    }


@pytest.fixture
def stored(spark, tmp_path):
    """A published dataset of a few tables with both derived ones."""
    directory = str(tmp_path / "data")
    tables = base_tables(spark)
    commit = Commit(spark, directory)
    for name, df in tables.items():
        store_table(commit, name, df)
    for name in DERIVED:
        store_derived(commit, name, tables)
    commit.publish()
    return directory


def items(directory, spark):
    return sorted(rows(read_table(spark, directory, "order_items").select("order_id", "order_item_id", "price")))


def scans(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"PartitionFilters: \[([^\]]*)\]", text)


def test_a_reader_keeps_its_version(spark, stored):
    before = read_table(spark, stored, "order_items")
    append_new(table(spark, "order_items", item("o1", "7.00", product="p", seller="s")), "order_items", stored)
    assert before.count() == 14 and read_table(spark, stored, "order_items").count() == 15
    assert latest(spark, stored).number == 2
    assert latest(spark, stored + "-none") is None


def test_an_append_that_fails_between_files_changes_nothing(spark, stored):
    before = items(stored, spark)
    good = spark.range(200).selectExpr(
        "concat('o', id % 24) AS order_id", "CAST(100 + id AS int) AS order_item_id", "'p' AS product_id",
        "'s' AS seller_id", "timestamp_ntz'2018-01-01 00:00:00' AS shipping_limit_date",
        "CAST(1 AS decimal(12,2)) AS price", "CAST(1 AS decimal(12,2)) AS freight_value",
    )
    late = F.when(F.col("order_item_id") == 299, F.raise_error(F.lit("disk is gone")).cast("decimal(12,2)"))
    with pytest.raises(Exception, match="disk is gone"):
        append_new(good.withColumn("price", late.otherwise(F.col("price"))), "order_items", stored)
    assert latest(spark, stored).number == 1 and items(stored, spark) == before
    append_new(good, "order_items", stored)
    assert len(items(stored, spark)) == len(before) + 200


def test_an_append_that_breaks_a_key_changes_nothing(spark, stored):
    sound = item("o1", "7.00", product="p", seller="s")
    for bad, message in ((item(None, "1.00"), "complete key"), (item("ghost", "1.00"), "unknown key")):
        with pytest.raises(DataQualityError, match=message):
            append_new(table(spark, "order_items", sound, bad), "order_items", stored)
    assert latest(spark, stored).number == 1 and len(items(stored, spark)) == 14
    totals = rows(read_derived(latest_version(spark, stored), "state_totals"))
    assert sum(t for _, t in totals) == Decimal("147.00")


def test_two_commits_on_one_version_conflict(spark, stored):
    base = latest_version(spark, stored)
    first, second = (Commit(spark, stored, base) for _ in range(2))
    for commit in (first, second):
        store_table(commit, "sellers", table(spark, "sellers", {"seller_id": commit.id}))
    first.publish()
    with pytest.raises(VersionConflict):
        second.publish()
    assert {r[0] for r in rows(read_table(spark, stored, "sellers"))} == {"s", first.id}


def test_appending_nothing_new_publishes_nothing(spark, stored):
    batch = table(spark, "order_items", item("o1", "7.00", product="p", seller="s"))
    assert append_new(batch, "order_items", stored).number == 2
    assert append_new(batch, "order_items", stored).number == 2
    assert append_new(batch.limit(0), "order_items", stored).number == 2


def test_an_append_lists_only_the_parts_of_its_keys(spark, stored, monkeypatch):
    batch = table(spark, "order_items", item("o1", "7.00", product="p", seller="s"), item("o2", "9.00", product="p", seller="s"))
    wanted = {f"{KEY_PART}={r[0]}" for r in batch.select(key_part("order_items")).collect()}
    read = []
    insert = ops.insert_if_absent

    def spy(new, target, keys):
        read.extend(target.inputFiles())
        return insert(new, target, keys)

    monkeypatch.setattr(ops, "insert_if_absent", spy)
    append_new(batch, "order_items", stored)
    assert {re.search(f"{KEY_PART}=\\d+", f)[0] for f in read} <= wanted
    held = {part for name, part, _ in latest(spark, stored).files if name == "order_items"}
    assert len(held) > len(wanted) and len(held) <= KEY_PARTS
    # o2 was stored under its key already, o1 was not.
    prices = {r[0]: r[2] for r in items(stored, spark)}
    assert prices["o1"] == Decimal("7.00") and prices["o2"] == Decimal("10.00")


def test_rows_lie_in_the_part_of_their_key(spark, stored):
    version = latest_version(spark, stored)
    schema = TABLES["order_items"].schema
    for part in {p for n, p, _ in version.files if n == "order_items"}:
        found = version.read("order_items", schema, [part]).select(key_part("order_items")).distinct()
        assert rows(found) == [(int(part.partition("=")[2]),)]
    assert version.read("order_items", schema, []).collect() == []


@pytest.mark.parametrize("name", ["order_items", "order_payments"])
def test_rows_of_an_order_lie_in_one_part(spark, tmp_path, name):
    """A task that folds the stored rows by order then meets most of an order's rows."""
    number = TABLES[name].key[1]
    staged = [{"order_id": f"o{i}", number: n} for i in range(40) for n in range(5)]
    commit = Commit(spark, str(tmp_path / "data"))
    store_table(commit, name, table(spark, name, *staged))
    version = commit.publish()
    parts = {}
    for part in version_parts(version, name):
        for (order,) in rows(version.read(name, TABLES[name].schema, [part]).select("order_id").distinct()):
            parts.setdefault(order, []).append(part)
    assert len(parts) == 40 and all(len(found) == 1 for found in parts.values())
    assert len(version_parts(version, name)) > 10


def version_parts(version, name):
    return {part for table_name, part, _ in version.files if table_name == name}


def test_an_append_finds_rows_in_parts_by_the_whole_key(spark, tmp_path):
    """Parts of datasets stored before the parts of items went by order."""
    directory = str(tmp_path / "data")
    tables = base_tables(spark)
    key = TABLES["order_items"].key
    whole = F.pmod(F.xxhash64(*key), F.lit(KEY_PARTS)).cast("int")
    commit = Commit(spark, directory)
    for name in ("products", "sellers", "orders"):
        store_table(commit, name, tables[name])
    commit.write("order_items", tables["order_items"].withColumn(KEY_PART, whole), key, KEY_PART)
    commit.publish()
    before = items(directory, spark)
    batch = table(spark, "order_items", item("o1", "7.00", product="p", seller="s"), item("o2", "9.00", product="p", seller="s"))
    for _ in range(2):
        append_new(batch, "order_items", directory)
        assert items(directory, spark) == sorted([*before, ("o1", 1, Decimal("7.00"))])


# Values by month


def monthly(spark, stored):
    return read_derived(latest_version(spark, stored), "monthly_values")


def test_a_month_window_opens_only_its_months(spark, stored):
    values = monthly(spark, stored)
    df = ops.gmv_by_month_stored(values, dt.date(2018, 6, 10), months=2)
    assert re.search(r"month#\d+ >= 2018-04-01", scans(df)[0])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "order_items" not in plan
    tables = base_tables(spark)
    expected = ops.gmv_by_month(tables["orders"], ops.items_per_order(tables["order_items"]), dt.date(2018, 6, 10), 2)
    # The window starts on the 10th: orders of 1 April are in its first month but not in it.
    assert rows(df) == rows(expected) and rows(df)[0] == (dt.date(2018, 4, 1), Decimal("10.50"))
    read = df.collect() and df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"isFinalPlan=true", read)


def test_today_is_a_constant_to_the_pruning(spark, stored):
    (filters,) = scans(ops.gmv_by_month_stored(monthly(spark, stored)))
    assert re.search(r"month#\d+ >= \d{4}-\d\d-01", filters)


def test_a_joined_period_opens_only_its_months(spark, stored, tmp_path):
    path = str(tmp_path / "periods")
    spark.sql(
        "SELECT add_months(date'2018-01-01', CAST(id AS int)) AS month, concat('Q', 1 + id div 3) AS period FROM range(12)"
    ).write.parquet(path)
    periods = spark.read.parquet(path).where("period = 'Q2'")
    df = ops.gmv_by_period(monthly(spark, stored), periods)
    assert any("dynamicpruning" in f for f in scans(df))
    assert rows(df) == [("Q2", Decimal("73.50"))]


# Derived tables carried on by appends


def test_derived_tables_follow_appends(spark, stored):
    tables = base_tables(spark)
    batches = [
        [item("o0", "1.00", number=2, product="p", seller="s"), item("o1", "2.25", product="p", seller="s")],
        [item("o1", "99.00", product="p", seller="s"), item("undated", "4.00", number=7, product="p", seller="s")],
    ]
    for batch in batches:
        append_new(table(spark, "order_items", *batch), "order_items", stored)
    version = latest_version(spark, stored)
    everything = tables | {"order_items": read_table(spark, stored, "order_items")}
    assert everything["order_items"].count() == 17
    by_state = ops.gmv_by_state_from(read_derived(version, "state_totals"))
    assert rows(by_state) == rows(REPORTS["gmv_by_state"](everything))
    by_month = ops.gmv_by_month_stored(read_derived(version, "monthly_values"), dt.date(2018, 6, 30))
    assert rows(by_month) == rows(REPORTS["gmv_by_month"](everything, as_of=dt.date(2018, 6, 30)))


def test_hot_partitions_are_written_by_several_tasks(spark, tmp_path):
    """All rows in one month: the partition's rows are spread, its files are many."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16KB")
    try:
        commit = Commit(spark, str(tmp_path / "d"))
        values = spark.range(0, 50_000, 1, 8).selectExpr("uuid() AS order_id", "date'2018-01-01' AS month")
        commit.write("v", values, partition_by="month")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert commit.metrics["v"] == {"rows": 50_000, "null_keys": 0}
    assert len(commit.added) > 3 and {part for _, part, _ in commit.added} == {"month=2018-01-01"}


def test_folded_tables_are_not_read_for_their_keys(spark, monkeypatch):
    counted = []
    keys = ops.keys.distinct_keys
    monkeypatch.setattr(ops.keys, "distinct_keys", lambda t: counted.extend(t) or keys(t))
    tables = base_tables(spark)
    metrics = {n: {"rows": df.count(), "null_keys": 0} for n, df in tables.items()}
    ops.require_written_keys(tables, metrics, ["order_items"])
    assert sorted(counted) == ["customers", "orders", "products", "sellers"]
    metrics["order_items"]["null_keys"] = 1
    with pytest.raises(DataQualityError, match="order_items: 14 rows but 13 distinct keys"):
        ops.require_written_keys(tables, metrics, ["order_items"])
