"""Where results and tables go."""

from tradewind.sinks.csv import write_csv
from tradewind.sinks.parquet import write_table

__all__ = ["write_csv", "write_table"]
