from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of ``monotonically_increasing_id`` that number the rows within a partition.
_ROW_BITS = (1 << 33) - 1


def partition_rows(df: DataFrame, *order: str) -> DataFrame:
    """``df`` in ranges of ``order``, with ``part``, the number of the range, and ``place``, the
    row's number in it from 0. Write the result before it is used: another run may place rows
    otherwise."""
    by = [F.asc_nulls_first(c) for c in order]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return dealt.select(
        *df.columns,
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)).alias("place"),
    )


def dense_numbers(placed: DataFrame) -> DataFrame:
    """The written result of :func:`partition_rows` with ``number`` from 0 without gaps.

    Only a row for each range meets in one task: how many rows the ranges before it hold.
    """
    counts = placed.groupBy("part").agg(F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    numbered = placed.join(offsets, "part")
    return numbered.withColumn("number", F.col("offset") + F.col("place")).drop("part", "place", "offset")
