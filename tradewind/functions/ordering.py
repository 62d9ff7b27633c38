from __future__ import annotations

from pyspark.sql import Column, DataFrame


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows in the given order.

    Runs as one bounded heap per task, so nothing but ``k`` rows per task is moved. Callers
    end the order with a unique column to make ties deterministic.
    """
    return df.orderBy(*order).limit(k)
