"""Order value questions: by state, month, customer, seller and order.

``order_values`` is the result of :func:`items_per_order`, computed on the fly or read back from
where it was written for several questions.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions import amount, month_of, months_before, rounded_ratio, top_k
from tradewind.model import RECENT_STATUSES, TOP_ROWS, WINDOW_MONTHS


def items_per_order(order_items: DataFrame) -> DataFrame:
    """Value (price plus freight) of each order that has items.

    Grouping before the order join lets every task combine its rows first, so an order with a
    huge number of items reaches the shuffle as one row per task.
    """
    value = F.col("price") + F.col("freight_value")
    return order_items.groupBy("order_id").agg(F.sum(value).alias("order_total"))


def totals_by_state(
    orders: DataFrame, customers: DataFrame, order_values: DataFrame
) -> DataFrame:
    """Summed order values per customer state; sums of several such tables can be added up."""
    per_customer = (
        orders.select("order_id", "customer_id")
        .join(order_values, "order_id")
        .groupBy("customer_id")
        .agg(F.sum("order_total").alias("customer_total"))
    )
    return (
        per_customer.join(customers.select("customer_id", "customer_state"), "customer_id")
        .groupBy(F.col("customer_state").alias("state"))
        .agg(F.sum("customer_total").alias("total"))
    )


def _states_ranked(gmv: DataFrame) -> DataFrame:
    return gmv.orderBy(F.desc_nulls_first("gmv"), F.asc_nulls_last("state"))


def gmv_by_state(orders: DataFrame, customers: DataFrame, order_values: DataFrame) -> DataFrame:
    """Gross merchandise value per customer state, largest first."""
    totals = totals_by_state(orders, customers, order_values)
    return _states_ranked(totals.select("state", amount(F.col("total")).alias("gmv")))


def gmv_by_state_from(state_totals: DataFrame) -> DataFrame:
    """As :func:`gmv_by_state`, from partial sums of :func:`totals_by_state`."""
    return _states_ranked(
        state_totals.groupBy("state").agg(amount(F.sum("total")).alias("gmv"))
    )


def values_by_month(orders: DataFrame, order_values: DataFrame) -> DataFrame:
    """Order values with their purchase time and its month, to be stored by month."""
    purchased = orders.select("order_id", "order_purchase_timestamp")
    return purchased.join(order_values, "order_id").withColumn(
        "month", month_of(F.col("order_purchase_timestamp"))
    )


def gmv_by_month_stored(
    monthly_values: DataFrame, as_of: dt.date | None = None, months: int = WINDOW_MONTHS
) -> DataFrame:
    """As :func:`gmv_by_month`, from values stored by month: other months are not opened."""
    start = months_before(as_of, months)
    return (
        monthly_values.where(F.col("month") >= month_of(start))
        .where(F.col("order_purchase_timestamp") >= start)
        .groupBy("month")
        .agg(amount(F.sum("order_total")).alias("gmv"))
        .orderBy(F.asc_nulls_last("month"))
    )


def gmv_by_period(monthly_values: DataFrame, periods: DataFrame) -> DataFrame:
    """Gross merchandise value per period. ``periods`` has a row for each ``month`` of a
    ``period``; of values stored by month, only those of its months are opened."""
    return (
        monthly_values.select("month", "order_total")
        .join(periods.select("month", "period"), "month")
        .groupBy("period")
        .agg(amount(F.sum("order_total")).alias("gmv"))
        .orderBy(F.asc_nulls_last("period"))
    )


def gmv_by_month(
    orders: DataFrame,
    order_values: DataFrame,
    as_of: dt.date | None = None,
    months: int = WINDOW_MONTHS,
) -> DataFrame:
    """Gross merchandise value per purchase month over the last ``months`` months."""
    recent = orders.where(
        F.col("order_purchase_timestamp") >= months_before(as_of, months)
    ).select("order_id", "order_purchase_timestamp")
    return (
        recent.join(order_values, "order_id")
        .groupBy(month_of(F.col("order_purchase_timestamp")).alias("month"))
        .agg(amount(F.sum("order_total")).alias("gmv"))
        .orderBy(F.asc_nulls_last("month"))
    )


def aov_by_customer(
    orders: DataFrame, customers: DataFrame, order_values: DataFrame, k: int = TOP_ROWS
) -> DataFrame:
    """Customers with the highest average order value."""
    per_order = (
        orders.select("order_id", "customer_id")
        .join(order_values, "order_id")
        .groupBy("order_id", "customer_id")
        .agg(F.sum("order_total").alias("order_total"))
    )
    per_customer = per_order.groupBy("customer_id").agg(
        F.count("*").alias("orders_count"),
        F.count("order_total").alias("valued"),
        F.sum("order_total").alias("total"),
    )
    places = ["customer_city", "customer_state"]
    averages = (
        per_customer.join(customers.select("customer_id", *places), "customer_id")
        .groupBy("customer_id", *places)
        .agg(*[F.sum(c).alias(c) for c in ("orders_count", "valued", "total")])
        .select(
            "customer_id",
            *places,
            "orders_count",
            rounded_ratio(F.col("total"), F.col("valued")).alias("avg_order_value"),
        )
    )
    return top_k(
        averages,
        k,
        F.desc_nulls_first("avg_order_value"),
        *[F.asc_nulls_last(c) for c in ("customer_id", *places)],
    )


def top_sellers(order_items: DataFrame, k: int = TOP_ROWS) -> DataFrame:
    """Sellers with the highest item revenue, with their exact number of orders.

    Spark groups by (seller, order) before counting, so one seller's rows spread over tasks.
    """
    per_seller = order_items.groupBy("seller_id").agg(
        F.countDistinct("order_id").alias("orders"),
        amount(F.sum("price")).alias("revenue"),
    )
    return top_k(per_seller, k, F.desc_nulls_first("revenue"), F.asc_nulls_last("seller_id"))


def order_totals(orders: DataFrame, order_values: DataFrame, k: int = TOP_ROWS) -> DataFrame:
    """Orders with the highest total of price and freight."""
    totals = (
        orders.select("order_id")
        .join(order_values, "order_id")
        .groupBy("order_id")
        .agg(amount(F.sum("order_total")).alias("order_total"))
    )
    return top_k(totals, k, F.desc_nulls_first("order_total"), F.asc_nulls_last("order_id"))


def recent_orders(
    orders: DataFrame,
    statuses: tuple[str, ...] = RECENT_STATUSES,
    k: int = TOP_ROWS,
) -> DataFrame:
    """Latest orders in the given statuses."""
    chosen = orders.where(F.col("order_status").isin(*statuses)).select(
        "order_id", "customer_id", "order_status", "order_purchase_timestamp"
    )
    return top_k(
        chosen, k, F.desc_nulls_first("order_purchase_timestamp"), F.asc_nulls_last("order_id")
    )
