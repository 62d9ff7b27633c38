"""Conforming staged rows: duplicates, unknown references, insert-if-absent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.model import TABLES


def first_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: the smallest by the remaining columns, left to right, NULLs first.

    The choice does not depend on row order, so reruns and retried tasks agree. As a minimum it
    combines inside each task before the shuffle: a key with many copies leaves every task as
    one row.
    """
    rest = [name for name in df.columns if name not in keys]
    if not rest:
        return df.dropDuplicates()
    smallest = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("row"))
    return smallest.select(*[name if name in keys else f"row.{name}" for name in df.columns])


def keep_known(df: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` exists in ``parent``; NULL keys are dropped.

    Only the key column of the parent is read. Spark broadcasts it when its size is below the
    session's threshold; otherwise both sides come straight from their shuffle, so adaptive
    execution can split a frequent key.
    """
    return df.join(parent.select(key), key, "left_semi").select(*df.columns)


def load_order_items(staged: DataFrame, products: DataFrame, sellers: DataFrame) -> DataFrame:
    """Staged items with a known product and seller, one row per order and item number."""
    known = keep_known(keep_known(staged, products, "product_id"), sellers, "seller_id")
    return first_per_key(known, TABLES["order_items"].key)


def load_payments(staged: DataFrame) -> DataFrame:
    """Staged payments, one row per order and payment number."""
    return first_per_key(staged, TABLES["order_payments"].key)


def load_reviews(staged: DataFrame) -> DataFrame:
    """Staged reviews, one row per review id."""
    return first_per_key(staged, TABLES["order_reviews"].key)


def insert_if_absent(batch: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``batch`` to append to ``target``: one per key that ``target`` does not hold.

    Duplicates go first: they combine before the shuffle, and the anti-join then reuses the
    resulting partitioning of the batch.
    """
    return first_per_key(batch, keys).join(target.select(*keys), list(keys), "left_anti").select(
        *batch.columns
    )
