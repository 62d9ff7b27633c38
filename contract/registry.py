"""The registered queries: every operator over the driver's whole test tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contract import bindings
from contract.bindings import bind, in_declared_schema
from contract.oracle import link_key
from tradewind import operators as ops
from tradewind.functions import dense_numbers, month_of
from tradewind.model import (
    FOREIGN_KEYS,
    KEY_AUDITED,
    KEY_TABLES,
    SOFT_LINKS,
    TABLES,
    Link,
    Tables,
)
from tradewind.plans import (
    REPORTS,
    append_new,
    read_derived,
    refresh_dataset,
    store_derived,
    store_table,
)
from tradewind.scratch import scratch_dir, written
from tradewind.sinks import write_csv
from tradewind.sources import (
    Commit,
    catalog_listing,
    feed_file,
    feed_inventory,
    latest_version,
    read_csv,
    read_spanning_csv,
    read_table,
    register_tables,
    rejected_rows,
)
from tradewind.sources.csv import NULL_MARK

Query = Callable[[SparkSession, str], DataFrame]

TRANSLATION = "product_category_name_translation"


def _report(name: str, *tables: str, **options) -> Query:
    return lambda spark, sf_dir: REPORTS[name](bind(spark, sf_dir, *tables), **options)


def _by_category(name: str, *tables: str, **options) -> Query:
    return _report(name, *tables, "order_items", "products", TRANSLATION, **options)


def _delivery_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.delivery_days_by_state(
        bindings.orders_with_delivery(spark, sf_dir), bindings.customers(spark, sf_dir)
    )


def _preview(table: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = bind(spark, sf_dir, table)[table]
        return ops.preview(df, order_by=df.columns)

    return query


def _link(measure: Callable[..., DataFrame], link: Link) -> Query:
    return lambda spark, sf_dir: measure(bind(spark, sf_dir, link.child, link.parent), link)


def _key_audit(table: str) -> Query:
    return lambda spark, sf_dir: ops.key_audit(
        bind(spark, sf_dir, table)[table], table, TABLES[table].key
    )


def _fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = bind(spark, sf_dir) | {
        "products": bindings.active_products(spark, sf_dir),
        "sellers": bindings.active_sellers(spark, sf_dir),
    }
    return ops.fk_violations(tables)


def _load_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.load_order_items(
        bindings.order_items(spark, sf_dir),
        bindings.active_products(spark, sf_dir),
        bindings.active_sellers(spark, sf_dir),
    )


def _insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = bindings.staged_payments(spark, sf_dir)
    # The stored rows: all, those of another type under keys that the batch doesn't have.
    moved = F.when(F.col("payment_type") == "click", F.col("order_id")).otherwise(-1 - F.col("order_id"))
    target = batch.withColumn("order_id", moved)
    return ops.insert_if_absent(batch, target, TABLES["order_payments"].key)


def _write_feed(spark: SparkSession, sf_dir: str, *names: str) -> str:
    feed = scratch_dir(spark)
    for name, df in bind(spark, sf_dir, *names).items():
        write_csv(in_declared_schema(name, df), f"{feed}/{feed_file(name)}")
    return feed


def _csv_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = _write_feed(spark, sf_dir, "order_items")
    return read_csv(
        spark, f"{feed}/{feed_file('order_items')}", TABLES["order_items"].schema
    )


def _csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = bind(spark, sf_dir, "order_items", "products", TRANSLATION)
    result = REPORTS["price_range_by_category"](tables)
    path = f"{scratch_dir(spark)}/price_range_by_category"
    write_csv(result, path, single_file=True)
    return read_csv(spark, path, result.schema)


def _full_refresh_gmv(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = refresh_dataset(spark, _write_feed(spark, sf_dir), scratch_dir(spark))
    return REPORTS["gmv_by_state"](tables)


def _stored(spark: SparkSession, tables: Tables, *derived: str) -> str:
    """A new dataset of the given tables, published, with derived tables."""
    directory = scratch_dir(spark)
    commit = Commit(spark, directory)
    declared = {name: in_declared_schema(name, df) for name, df in tables.items()}
    for name, df in declared.items():
        store_table(commit, name, df)
    for name in derived:
        store_derived(commit, name, declared)
    commit.publish()
    return directory


def _monthly_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _stored(spark, bind(spark, sf_dir, "orders", "order_items"), "monthly_values")
    return read_derived(latest_version(spark, stored), "monthly_values")


def _gmv_by_month_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.gmv_by_month_stored(_monthly_values(spark, sf_dir), as_of=dt.date(2001, 8, 1))


def _gmv_by_period_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The first quarters, from a calendar of the months in which there are orders.
    placed = month_of(F.col("order_purchase_timestamp")).alias("month")
    months = bindings.orders(spark, sf_dir).select(placed).distinct()
    calendar = months.withColumn("period", F.expr("concat(year(month), 'Q', quarter(month))"))
    return ops.gmv_by_period(
        _monthly_values(spark, sf_dir), calendar.where(F.endswith("period", F.lit("Q1")))
    )


def _append_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = bindings.staged_payments(spark, sf_dir)
    known = ops.load_payments(staged.where("payment_type = 'click'"))
    directory = _stored(spark, bind(spark, sf_dir, "orders") | {"order_payments": known})
    for _ in range(2):
        append_new(in_declared_schema("order_payments", staged), "order_payments", directory)
    stored = read_table(spark, directory, "order_payments")
    return stored.select("order_id", "payment_sequential", "payment_type", "payment_value")


def _gmv_by_state_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = bind(spark, sf_dir, "customers", "products", "sellers", "orders", "order_items")
    declared = {name: in_declared_schema(name, df) for name, df in tables.items()}
    staged = declared["order_items"]
    # A third of the orders first, then another third, then all items: the rest are new.
    first, second = (staged.where(f"CAST(order_id AS bigint) % 3 = {i}") for i in (0, 1))
    loaded = ops.load_order_items(first, declared["products"], declared["sellers"])
    directory = _stored(spark, tables | {"order_items": loaded}, "state_totals")
    for batch in (second, staged):
        append_new(batch, "order_items", directory)
    return ops.gmv_by_state_from(read_derived(latest_version(spark, directory), "state_totals"))


def _csv_spanning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as review messages, with every character that CSV has a use for."""
    schema = "doc_id bigint, text string, lang string"
    docs = spark.read.schema(schema).parquet(f"{sf_dir}/documents.parquet")
    staged = docs.select(
        F.col("doc_id").cast("string").alias("review_id"),
        F.col("lang").alias("review_comment_title"),
        F.concat(F.lit(' \t"'), "text", F.lit('",\r\n""\n ')).alias("review_comment_message"),
    )
    feed = f"{scratch_dir(spark)}/reviews"
    write_csv(in_declared_schema("order_reviews", staged), feed)
    found = read_spanning_csv(spark, feed, TABLES["order_reviews"].schema, NULL_MARK)
    return found.select(
        "review_id",
        "review_comment_title",
        F.length("review_comment_message").cast("bigint").alias("n_chars"),
        F.sha2("review_comment_message", 256).alias("message_sha256"),
    )


def _rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose number is no number, in a feed of all items."""
    items = in_declared_schema("order_items", bindings.order_items(spark, sf_dir))
    number = "if(CAST(product_id AS bigint) % 10 = 7, 'none', CAST(order_item_id AS string))"
    feed = scratch_dir(spark)
    for name, table in TABLES.items():
        rows = spark.createDataFrame([], table.schema)
        if name == "order_items":
            rows = items.withColumn("order_item_id", F.expr(number))
        write_csv(rows, f"{feed}/{feed_file(name)}")
    found = rejected_rows(spark, feed).withColumn("product_id", F.split("record", ",")[2])
    return found.groupBy("table_name", "reason", "product_id").agg(F.count("*").alias("rejected"))


def _today(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders moved by as many days as bring the last of them to today."""
    tables = bind(spark, sf_dir, "orders", "order_items")
    placed = F.col("order_purchase_timestamp")
    last = tables["orders"].agg(F.max(placed)).first()[0]
    days = F.date_diff(F.current_date(), F.lit(last).cast("date"))
    moved = placed + F.make_dt_interval(days)
    tables["orders"] = tables["orders"].withColumn("order_purchase_timestamp", moved)
    return REPORTS["gmv_by_month"](tables)


def _csv_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an export without rows."""
    empty = REPORTS["gmv_by_month"](bind(spark, sf_dir, "orders", "order_items"))
    path = scratch_dir(spark)
    write_csv(empty, path, single_file=True)
    return spark.read.text(path)


def _feed_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed that lacks two files."""
    there = [name for name in TABLES if name not in ("sellers", "geolocation")]
    return feed_inventory(spark, _write_feed(spark, sf_dir, *there))


def _preview_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any ten orders: how many there are, and how many of them are rows of the table."""
    orders = bindings.orders(spark, sf_dir)
    some = ops.preview(orders).withColumn("n_rows", F.lit(1))
    same = " AND ".join(f"s.{c} <=> o.{c}" for c in orders.columns)
    known = orders.withColumn("n_known", F.lit(1)).alias("o")
    return some.alias("s").join(known, F.expr(same), "left").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_known").alias("n_known")
    )


def _top_sellers_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = bind(spark, sf_dir, "orders", "order_items")
    numbered = dense_numbers(written(ops.placed_orders(tables["order_items"], tables["orders"])))
    months = written(ops.seller_months(tables["order_items"], numbered))
    return ops.top_sellers_from(months)


def _catalog_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the catalog lists, beside what a scan of the listed tables counts."""
    tables = bind(spark, sf_dir)
    commit = Commit(spark, scratch_dir(spark))
    for name, df in tables.items():
        commit.write(name, df)
    database = f"catalog_{commit.id}"
    register_tables(commit.publish(), {name: df.schema for name, df in tables.items()}, database)
    stored = {name: spark.table(f"{database}.{name}").select(*df.columns) for name, df in tables.items()}
    counted = ops.column_profile(stored).select("table_name", "column_name", "non_null_count")
    return catalog_listing(spark, database).join(counted, ["table_name", "column_name"])


def _review_high_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Categories with at least a twenty-fifth of all items.
    tables = bind(spark, sf_dir, "order_reviews", "order_items", "products", TRANSLATION)
    bar = tables["order_items"].count() // 25
    return REPORTS["review_by_category"](tables, min_reviews=bar)


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "gmv_by_state": _report("gmv_by_state", "orders", "customers", "order_items"),
        "top_categories": _by_category("top_categories"),
        "gmv_by_month": _report(
            "gmv_by_month", "orders", "order_items", as_of=dt.date(2001, 8, 1)
        ),
        "gmv_by_month_empty": _report("gmv_by_month", "orders", "order_items"),
        "gmv_by_month_leap_day": _report(
            "gmv_by_month", "orders", "order_items", as_of=dt.date(1996, 2, 29)
        ),
        "aov_by_customer": _report("aov_by_customer", "orders", "customers", "order_items"),
        "payment_mix": _report("payment_mix", "order_payments"),
        "delivery_days_by_state": _delivery_days,
        "repeat_rate": _report("repeat_rate", "orders"),
        "top_sellers": _report("top_sellers", "order_items"),
        "review_by_category": _by_category("review_by_category", "order_reviews"),
        "review_by_category_high_bar": _review_high_bar,
        "cancel_rate_by_state": _report(
            "cancel_rate_by_state", "orders", "customers", canceled_status="F"
        ),
        "price_range_by_category": _by_category("price_range_by_category"),
        "recent_orders": _report("recent_orders", "orders", statuses=("F", "O")),
        "payment_stats": _report("payment_stats", "order_payments"),
        "order_totals": _report("order_totals", "orders", "order_items"),
        "pk_composite_items": _key_audit("order_items"),
        "pk_composite_payments": _key_audit("order_payments"),
        "pk_reviews": _key_audit("order_reviews"),
        "pk_translation": _key_audit(TRANSLATION),
        "key_report": lambda spark, sf_dir: ops.key_report(bind(spark, sf_dir)),
        "duplicate_item_keys": lambda spark, sf_dir: ops.duplicate_keys(
            bindings.order_items(spark, sf_dir), TABLES["order_items"].key
        ),
        "fk_violations": _fk_violations,
        "relations_report": lambda spark, sf_dir: ops.relations_report(bind(spark, sf_dir)),
        "load_order_items": _load_order_items,
        "load_payments": lambda spark, sf_dir: ops.load_payments(
            bindings.staged_payments(spark, sf_dir)
        ),
        "load_reviews": lambda spark, sf_dir: ops.load_reviews(
            bindings.staged_reviews(spark, sf_dir)
        ),
        "insert_if_absent": _insert_if_absent,
        "src_csv_load": _csv_load,
        "snk_csv_roundtrip": _csv_roundtrip,
        "full_refresh_gmv": _full_refresh_gmv,
        "src_csv_spanning": _csv_spanning,
        "src_rejected_rows": _rejected,
        "src_feed_inventory": _feed_inventory,
        "snk_csv_empty": _csv_empty,
        "append_payments": _append_payments,
        "gmv_by_state_appended": _gmv_by_state_appended,
        "gmv_by_month_stored": _gmv_by_month_stored,
        "gmv_by_period_stored": _gmv_by_period_stored,
        "gmv_by_month_today": _today,
        "preview_any_orders": _preview_any,
        "repeat_rate_by_person": _report(
            "repeat_rate", "orders", "customers", entity_key="customer_state"
        ),
        "column_profile": lambda spark, sf_dir: ops.column_profile(bind(spark, sf_dir)),
        "schema_overview": lambda spark, sf_dir: ops.table_overview(bind(spark, sf_dir)),
        "catalog_overview": _catalog_overview,
        "top_sellers_rollup": _top_sellers_rollup,
    }
    for table in KEY_TABLES:
        found[f"preview_{table}"] = _preview(table)
    for table in KEY_AUDITED:
        found[f"pk_{table}"] = _key_audit(table)
    for link in FOREIGN_KEYS + SOFT_LINKS:
        found[link_key(link, "missing")] = _link(ops.link_missing, link)
    for link in FOREIGN_KEYS:
        found[link_key(link, "volume")] = _link(ops.link_volume, link)
    for link in SOFT_LINKS:
        found[link_key(link, "coverage")] = _link(ops.link_coverage, link)
    return found
