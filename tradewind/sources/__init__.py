"""Where tables come from."""

from tradewind.sources.catalog import catalog_listing, register_tables
from tradewind.sources.csv import (
    feed_file,
    feed_inventory,
    has_spanning_records,
    inspect_csv,
    read_csv,
    read_feed,
    rejected_rows,
)
from tradewind.sources.parquet import latest_version, read_dataset, read_table, register_views
from tradewind.sources.spanning import read_spanning_csv
from tradewind.sources.versions import Commit, Version, VersionConflict, latest

__all__ = [
    "Commit",
    "Version",
    "VersionConflict",
    "catalog_listing",
    "feed_file",
    "feed_inventory",
    "has_spanning_records",
    "inspect_csv",
    "latest",
    "latest_version",
    "read_csv",
    "read_dataset",
    "read_feed",
    "read_spanning_csv",
    "read_table",
    "register_tables",
    "register_views",
    "rejected_rows",
]
