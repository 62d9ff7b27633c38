"""Tables that follow from others, stored with a dataset and kept up to date by its appends.

Each is a sum over order items, so what an append of items adds to it can be worked out from these
items alone and stored beside what is there: readers add up. Orders and customers are stored before
items that refer to them, so that later orders and customers change no such sum.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tradewind import operators as ops
from tradewind.model import Tables


@dataclass(frozen=True)
class Derived:
    """``build`` gives the rows that follow from the ``order_items`` among its tables."""

    build: Callable[[Tables], DataFrame]
    schema: T.StructType
    partition_by: str | None = None
    sort_by: tuple[str, ...] = ()


def _monthly_values(tables: Tables) -> DataFrame:
    values = ops.items_per_order(tables["order_items"])
    return ops.values_by_month(tables["orders"], values)


def _state_totals(tables: Tables) -> DataFrame:
    values = ops.items_per_order(tables["order_items"])
    return ops.totals_by_state(tables["orders"], tables["customers"], values)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


DERIVED: dict[str, Derived] = {
    # The value of each order, a partition for each month of purchase.
    "monthly_values": Derived(
        _monthly_values,
        _schema(
            order_id=T.StringType(),
            order_purchase_timestamp=T.TimestampNTZType(),
            order_total=T.DecimalType(38, 2),
            month=T.DateType(),
        ),
        partition_by="month",
        sort_by=("order_purchase_timestamp",),
    ),
    # Partial sums of gross merchandise value per state, a row for each commit and state.
    "state_totals": Derived(
        _state_totals, _schema(state=T.StringType(), total=T.DecimalType(38, 2))
    ),
}


def shaped(name: str, tables: Tables) -> DataFrame:
    """The rows of a derived table that follow from ``tables``, in its declared schema."""
    schema = DERIVED[name].schema
    return DERIVED[name].build(tables).selectExpr(
        *[f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in schema.fields]
    )
