"""Jobs that string the operators together."""

from tradewind.plans.derived import DERIVED
from tradewind.plans.refresh import (
    append_new,
    audit,
    conform,
    read_derived,
    refresh_dataset,
    store_derived,
    store_table,
)
from tradewind.plans.reports import REPORTS, export_reports

__all__ = [
    "DERIVED",
    "REPORTS",
    "append_new",
    "audit",
    "conform",
    "export_reports",
    "read_derived",
    "refresh_dataset",
    "store_derived",
    "store_table",
]
