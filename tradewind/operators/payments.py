"""Payment questions: mix and value statistics per payment type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions import amount, percent


def payment_mix(order_payments: DataFrame) -> DataFrame:
    """Records, total and share of the overall total per payment type.

    The overall total is a scalar subquery over the grouped rows. Filtering on the count, which
    is never zero, keeps both uses of the grouped rows identical, so Spark reuses one scan and
    one shuffle for them and no task has to hold all groups.
    """
    grouped = (
        order_payments.groupBy("payment_type")
        .agg(F.count("*").alias("payment_records"), F.sum("payment_value").alias("paid"))
        .where(F.col("payment_records") > 0)
    )
    overall = grouped.agg(F.sum("paid")).scalar()
    return grouped.select(
        "payment_type",
        "payment_records",
        amount(F.col("paid")).alias("total_paid"),
        percent(F.col("paid"), overall).alias("pct_of_total"),
    ).orderBy(F.desc_nulls_first("total_paid"), F.asc_nulls_last("payment_type"))


def payment_stats(order_payments: DataFrame) -> DataFrame:
    """Count, unrounded mean (18 digits), minimum and maximum value per payment type."""
    value = F.col("payment_value")
    grouped = order_payments.groupBy("payment_type").agg(
        F.count("*").alias("cnt"),
        F.sum(value).alias("paid"),
        F.count(value).alias("valued"),
        F.min(value).alias("min_payment"),
        F.max(value).alias("max_payment"),
    )
    mean = (F.col("paid") / F.nullif(F.col("valued"), F.lit(0))).cast("decimal(38,18)")
    return grouped.select(
        "payment_type", "cnt", mean.alias("avg_payment"), "min_payment", "max_payment"
    ).orderBy(F.desc_nulls_first("cnt"), F.asc_nulls_last("payment_type"))
