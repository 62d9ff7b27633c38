"""The standing reports by name, and their export."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tradewind import operators as ops
from tradewind.model import Tables
from tradewind.sinks import write_csv, write_table

_TRANSLATION = "product_category_name_translation"


@dataclass(frozen=True)
class Report:
    build: Callable[..., DataFrame]
    inputs: tuple[str, ...]
    optional: tuple[str, ...] = ()  # passed by name where they are at hand

    def __call__(self, tables: Tables, **options) -> DataFrame:
        """The report over ``tables``, which may hold ``order_values`` ready-made."""
        if "order_values" in self.inputs and "order_values" not in tables:
            tables = tables | {"order_values": ops.items_per_order(tables["order_items"])}
        extra = {name: tables[name] for name in self.optional if name in tables}
        return self.build(*[tables[name] for name in self.inputs], **extra, **options)


def _over(build: Callable[..., DataFrame], *inputs: str) -> Report:
    return Report(build, inputs)


REPORTS: dict[str, Report] = {
    "gmv_by_state": _over(ops.gmv_by_state, "orders", "customers", "order_values"),
    "top_categories": _over(ops.top_categories, "order_items", "products", _TRANSLATION),
    "gmv_by_month": _over(ops.gmv_by_month, "orders", "order_values"),
    "aov_by_customer": _over(ops.aov_by_customer, "orders", "customers", "order_values"),
    "payment_mix": _over(ops.payment_mix, "order_payments"),
    "delivery_days_by_state": _over(ops.delivery_days_by_state, "orders", "customers"),
    "repeat_rate": Report(ops.repeat_rate, ("orders",), optional=("customers",)),
    "top_sellers": _over(ops.top_sellers, "order_items"),
    "review_by_category": _over(
        ops.review_by_category, "order_reviews", "order_items", "products", _TRANSLATION
    ),
    "cancel_rate_by_state": _over(ops.cancel_rate_by_state, "orders", "customers"),
    "price_range_by_category": _over(
        ops.price_range_by_category, "order_items", "products", _TRANSLATION
    ),
    "recent_orders": _over(ops.recent_orders, "orders"),
    "payment_stats": _over(ops.payment_stats, "order_payments"),
    "order_totals": _over(ops.order_totals, "orders", "order_values"),
}


def export_reports(
    tables: Tables,
    directory: str,
    names: Iterable[str] | None = None,
    as_of: dt.date | None = None,
) -> list[str]:
    """Write each report to ``<directory>/<name>/`` as CSV and return the paths.

    Several reports start from the value of each order: when more than one of them is asked for,
    it is written once, as Parquet in ``<directory>/order_values/``, and read back by all. A
    failing step does not keep the other reports from being written; all failures are raised
    together at the end.
    """
    chosen = list(REPORTS if names is None else names)
    written, failures = [], []

    def attempt(name: str, step: Callable[[str], None]) -> bool:
        path = f"{directory}/{name}"
        try:
            step(path)
        except Exception as error:
            error.add_note(f"while writing {path}")
            failures.append(error)
            return False
        written.append(path)
        return True

    def store_values(path: str) -> None:
        write_table(ops.items_per_order(tables["order_items"]), path, mode="overwrite")

    shared = sum("order_values" in REPORTS[name].inputs for name in chosen) > 1
    if shared and attempt("order_values", store_values):
        spark = tables["order_items"].sparkSession
        tables = tables | {"order_values": spark.read.parquet(written[-1])}
    for name in chosen:
        options = {"as_of": as_of} if name == "gmv_by_month" else {}
        report = REPORTS[name]
        attempt(name, lambda path: write_csv(report(tables, **options), path, single_file=True))
    if failures:
        raise ExceptionGroup("some reports failed", failures)
    return written
