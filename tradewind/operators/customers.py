"""Customer questions: delivery time, cancellations, repeat purchases.

Orders are folded to one row per customer before the customer join, so a customer holding a
large share of all orders is combined inside each task instead of meeting in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions import MICROS_PER_DAY, as_micros, elapsed, percent, rounded_ratio
from tradewind.model import CANCELED_STATUS


def _by_state(orders: DataFrame, customers: DataFrame, **measures: Column) -> DataFrame:
    per_customer = orders.groupBy("customer_id").agg(
        *[column.alias(name) for name, column in measures.items()]
    )
    return (
        per_customer.join(customers.select("customer_id", "customer_state"), "customer_id")
        .groupBy("customer_state")
        .agg(*[F.sum(name).alias(name) for name in measures])
    )


def delivery_days_by_state(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Mean days from purchase to delivery per customer state, fastest first."""
    seconds, micros = elapsed(
        F.col("order_purchase_timestamp"), F.col("order_delivered_customer_date")
    )
    totals = _by_state(
        orders.where(F.col("order_delivered_customer_date").isNotNull()),
        customers,
        seconds=F.sum(seconds),
        micros=F.sum(micros),
        timed=F.count("order_purchase_timestamp"),
        delivered_orders=F.count("*"),
    )
    timed_days = F.col("timed").cast("decimal(20,0)") * F.lit(MICROS_PER_DAY)
    micros_in_all = as_micros(F.col("seconds"), F.col("micros"))
    return totals.select(
        "customer_state",
        rounded_ratio(micros_in_all, timed_days).alias("avg_delivery_days"),
        "delivered_orders",
    ).orderBy(F.asc_nulls_last("avg_delivery_days"), F.asc_nulls_last("customer_state"))


def cancel_rate_by_state(
    orders: DataFrame, customers: DataFrame, canceled_status: str = CANCELED_STATUS
) -> DataFrame:
    """Share of canceled orders per customer state, highest first."""
    totals = _by_state(
        orders,
        customers,
        canceled=F.count_if(F.col("order_status") == canceled_status),
        total_orders=F.count("*"),
    )
    return totals.withColumn(
        "canceled_rate_pct", percent(F.col("canceled"), F.col("total_orders"))
    ).orderBy(F.desc_nulls_last("canceled_rate_pct"), F.asc_nulls_last("customer_state"))


def repeat_rate(
    orders: DataFrame, entity_key: str = "customer_id", customers: DataFrame | None = None
) -> DataFrame:
    """Share of customers with two or more orders.

    ``entity_key`` names the column that identifies a buyer. A column that the orders lack, such as
    a person's when ``customer_id`` is issued per order, comes from ``customers``: orders are then
    counted per customer before the join.
    """
    if entity_key in orders.columns:
        per_entity = orders.groupBy(entity_key).agg(F.count("*").alias("orders_count"))
    else:
        per_customer = orders.groupBy("customer_id").agg(F.count("*").alias("n"))
        buyers = customers.select("customer_id", entity_key)
        per_entity = (
            per_customer.join(buyers, "customer_id")
            .groupBy(entity_key)
            .agg(F.sum("n").alias("orders_count"))
        )
    counts = per_entity.agg(
        F.count_if(F.col("orders_count") >= 2).alias("repeat_customers"),
        F.count("*").alias("total_customers"),
    )
    return counts.select(
        percent(F.col("repeat_customers"), F.col("total_customers")).alias(
            "repeat_purchase_rate_pct"
        ),
        "repeat_customers",
        "total_customers",
    )
