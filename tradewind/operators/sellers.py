"""Distinct orders of sellers that add up over months, kept as bitmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions import amount, month_of, partition_rows, top_k
from tradewind.model import TOP_ROWS

#: Numbers in a word of a bitmap.
_WORD_BITS = 64


def placed_orders(order_items: DataFrame, orders: DataFrame) -> DataFrame:
    """The orders that items name, with their ``month``, laid out to be numbered by purchase time
    (see :func:`tradewind.functions.dense_numbers`): a month's orders get neighbouring numbers and
    share bitmaps. Orders that are not known have no month."""
    named = order_items.where(F.col("order_id").isNotNull()).select("order_id").distinct()
    bought = orders.select("order_id", "order_purchase_timestamp")
    placed = named.join(bought, "order_id", "left").select(
        "order_id",
        month_of(F.col("order_purchase_timestamp")).alias("month"),
        F.col("order_purchase_timestamp").alias("bought"),
    )
    return partition_rows(placed, "bought", "order_id").drop("bought")


def seller_months(order_items: DataFrame, numbered_orders: DataFrame) -> DataFrame:
    """Each seller's orders and revenue by month: the orders as bitmaps of their numbers, one for
    each ``bucket`` of 32,768 numbers that any of them falls into, held in words of 64 numbers.

    Only the words that hold an order are rows, so that a seller of few orders a month takes a
    row for each and one of many a row for up to 64. Words of several rows are united by
    ``bit_or``, so an order counts once however many of its items, or rows of this table, name
    it. Tasks unite their own before the shuffle.
    """
    per_order = order_items.groupBy("seller_id", "order_id").agg(F.sum("price").alias("price"))
    numbered = per_order.join(numbered_orders.select("order_id", "month", "number"), "order_id", "left")
    number = F.col("number")
    return numbered.groupBy(
        "seller_id",
        "month",
        F.bitmap_bucket_number(number + 1).alias("bucket"),  # buckets of bitmaps begin at 1
        (F.bitmap_bit_position(number + 1) / _WORD_BITS).cast("int").alias("word"),
    ).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (number % _WORD_BITS).cast("int"))).alias("orders"),
        F.sum("price").alias("revenue"),
    )


def seller_totals(months: DataFrame) -> DataFrame:
    """Distinct orders and revenue per seller over all rows of :func:`seller_months` given, be
    they of one month, of some or of all."""
    per_word = months.groupBy("seller_id", "bucket", "word").agg(
        F.bit_count(F.bit_or("orders")).alias("orders"), F.sum("revenue").alias("revenue")
    )
    return per_word.groupBy("seller_id").agg(
        F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"), amount(F.sum("revenue")).alias("revenue")
    )


def top_sellers_from(months: DataFrame, k: int = TOP_ROWS) -> DataFrame:
    """As :func:`tradewind.operators.top_sellers`, from rows of :func:`seller_months`."""
    return top_k(
        seller_totals(months), k, F.desc_nulls_first("revenue"), F.asc_nulls_last("seller_id")
    )
