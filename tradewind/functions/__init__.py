"""Column helpers shared by the operators."""

from tradewind.functions.numbering import dense_numbers, partition_rows
from tradewind.functions.numbers import AMOUNT, amount, percent, rounded_ratio
from tradewind.functions.ordering import top_k
from tradewind.functions.times import MICROS_PER_DAY, as_micros, elapsed, month_of, months_before

__all__ = [
    "AMOUNT",
    "MICROS_PER_DAY",
    "amount",
    "as_micros",
    "dense_numbers",
    "elapsed",
    "month_of",
    "months_before",
    "partition_rows",
    "percent",
    "rounded_ratio",
    "top_k",
]
