"""Canonical tables built from the driver's test tables (see FIXTURES.md, section 4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.model import TABLES, Tables


# Declared so that opening a table starts no job to infer its schema.
_SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _amount(column: str) -> str:
    # The test tables hold amounts as doubles of two digits. Going through whole cents is exact
    # for them and much cheaper than Spark's text-based cast from double to decimal.
    cents = f"CAST(CAST(rint({column} * 100) AS BIGINT) AS DECIMAL(12,0))"
    return f"CAST({cents} * 0.01BD AS DECIMAL(12,2))"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _read(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return (
        _read(spark, sf_dir, "customer")
        .join(nation, "c_nationkey")
        .selectExpr(
            "c_custkey AS customer_id",
            "c_name AS customer_unique_id",
            "c_nationkey AS customer_zip_code_prefix",
            "c_mktsegment AS customer_city",
            "n_name AS customer_state",
        )
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS product_id",
        "CASE WHEN p_size = 1 THEN NULL ELSE p_brand END AS product_category_name",
        "length(p_name) AS product_name_lenght",
        "p_size AS product_weight_g",
    )


def sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS seller_id",
        "s_nationkey AS seller_zip_code_prefix",
        "s_name AS seller_city",
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS order_id",
        "o_custkey AS customer_id",
        "o_orderstatus AS order_status",
        "o_orderdate AS order_purchase_timestamp",
    )


def orders_with_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders delivered with their last item; NULL for orders without items."""
    last_shipped = (
        _read(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("order_id"))
        .agg(F.max("l_shipdate").alias("order_delivered_customer_date"))
    )
    return orders(spark, sf_dir).join(last_shipped, "order_id", "left")


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items; the test data repeats some (order, line number) keys."""
    return _read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS order_id",
        "l_linenumber AS order_item_id",
        "l_partkey AS product_id",
        "l_suppkey AS seller_id",
        "l_shipdate AS shipping_limit_date",
        f"{_amount('l_extendedprice')} AS price",
        f"{_amount('l_quantity')} AS freight_value",
    )


def order_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _payments(spark, sf_dir, "event_id")


def staged_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments numbered by hour, which repeats (order, number) keys with different values."""
    return _payments(spark, sf_dir, "hour(ts)")


def _payments(spark: SparkSession, sf_dir: str, number: str) -> DataFrame:
    return _read(spark, sf_dir, "events").selectExpr(
        "user_id AS order_id",
        f"{number} AS payment_sequential",
        "event_type AS payment_type",
        f"{_amount('value')} AS payment_value",
    )


def order_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviews(spark, sf_dir, "o_orderkey")


def staged_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews under their customer's id, which repeats review ids over different orders."""
    return _reviews(spark, sf_dir, "o_custkey")


def _reviews(spark: SparkSession, sf_dir: str, review_key: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").selectExpr(
        f"{review_key} AS review_id",
        "o_orderkey AS order_id",
        "CAST(substring(o_orderpriority, 1, 1) AS INT) AS review_score",
        "o_orderpriority AS review_comment_title",
        "o_orderdate AS review_creation_date",
    )


def translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English names of all brands; two of them under other keys, so that those brands lack one."""
    brands = _read(spark, sf_dir, "part").select("p_brand").distinct()
    return brands.selectExpr(
        "CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN concat('old ', p_brand) ELSE p_brand END "
        "AS product_category_name",
        "lower(replace(p_brand, '#', '_')) AS product_category_name_english",
    )


def geolocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many rows for some prefixes, none for others."""
    return _read(spark, sf_dir, "supplier").selectExpr(
        "CASE WHEN s_acctbal > 5000 THEN s_nationkey ELSE s_nationkey + 1000 END "
        "AS geolocation_zip_code_prefix",
        "s_acctbal AS geolocation_lat",
        "s_name AS geolocation_city",
    )


def active_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue with the bulky parts under other keys, so that some items refer to nothing."""
    moved = "CASE WHEN p_size <= 40 THEN p_partkey ELSE -1 - p_partkey END AS product_id"
    return _read(spark, sf_dir, "part").selectExpr(moved)


def active_sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sellers in debt stand under other keys, so that some items refer to nothing."""
    moved = "CASE WHEN s_acctbal > 0 THEN s_suppkey ELSE -1 - s_suppkey END AS seller_id"
    return _read(spark, sf_dir, "supplier").selectExpr(moved)


BINDINGS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "customers": customers,
    "products": products,
    "sellers": sellers,
    "orders": orders,
    "order_items": order_items,
    "order_payments": order_payments,
    "order_reviews": order_reviews,
    "product_category_name_translation": translation,
    "geolocation": geolocation,
}


def bind(spark: SparkSession, sf_dir: str, *names: str) -> Tables:
    """The named canonical tables (default: all)."""
    return {name: BINDINGS[name](spark, sf_dir) for name in names or BINDINGS}


def in_declared_schema(name: str, df: DataFrame) -> DataFrame:
    """``df`` with all columns and types of the canonical table, absent columns as NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[name].schema.fields
        ]
    )
