"""Looking at the tables: row previews and column listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions import top_k
from tradewind.model import PREVIEW_ROWS, Tables


def preview(
    df: DataFrame, n: int = PREVIEW_ROWS, order_by: Sequence[str | Column] = ()
) -> DataFrame:
    """``n`` rows with all columns: any ``n``, or the first in the given order.

    Without an order Spark stops after the first partitions; an order reads the whole table.
    """
    return top_k(df, n, *order_by) if order_by else df.limit(n)


def schema_overview(tables: Tables) -> DataFrame:
    """Columns of every table in declared order, with their types. No data is read."""
    spark = next(iter(tables.values())).sparkSession
    listed = [
        (table, position, field.name, field.dataType.simpleString())
        for table, df in sorted(tables.items())
        for position, field in enumerate(df.schema.fields, start=1)
    ]
    return spark.createDataFrame(
        listed, "table_name string, ordinal_position int, column_name string, data_type string"
    )


def column_profile(tables: Tables) -> DataFrame:
    """The listing of :func:`schema_overview` with the number of non-NULL values of each column.

    Each table is scanned once: a single aggregation counts all of its columns, and its one
    result row is then turned into a row per column.
    """
    overview = None
    for table, df in sorted(tables.items()):
        fields = df.schema.fields
        counted = df.agg(*[F.count(field.name).alias(field.name) for field in fields])
        columns = ", ".join(
            f"struct({position} AS ordinal_position, '{field.name}' AS column_name, "
            f"'{field.dataType.simpleString()}' AS data_type, `{field.name}` AS non_null_count)"
            for position, field in enumerate(fields, start=1)
        )
        listing = counted.selectExpr(f"'{table}' AS table_name", f"inline(array({columns}))")
        overview = listing if overview is None else overview.unionByName(listing)
    return overview.orderBy("table_name", "ordinal_position")


def table_overview(tables: Tables) -> DataFrame:
    """The listing of :func:`schema_overview` with the number of rows of each table, which Spark
    takes from the files' footers where they hold it."""
    overview = None
    for table, df in sorted(tables.items()):
        columns = ", ".join(
            f"struct({position} AS ordinal_position, '{field.name}' AS column_name, "
            f"'{field.dataType.simpleString()}' AS data_type)"
            for position, field in enumerate(df.schema.fields, start=1)
        )
        counted = df.agg(F.count("*").alias("row_count"))
        listing = counted.selectExpr(f"'{table}' AS table_name", f"inline(array({columns}))", "row_count")
        overview = listing if overview is None else overview.unionByName(listing)
    return overview.orderBy("table_name", "ordinal_position")


def list_tables(tables: Tables) -> list[str]:
    """Table names in alphabetical order."""
    return sorted(tables)
