"""Tables at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(
    df: DataFrame, path: str, mode: str = "errorifexists", sort_by: tuple[str, ...] = ()
) -> None:
    """Write ``df`` as Parquet.

    ``sort_by`` orders the rows of each file, without a shuffle: filters on these columns then
    skip row groups and pages by their statistics.
    """
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    df.write.mode(mode).parquet(path)
