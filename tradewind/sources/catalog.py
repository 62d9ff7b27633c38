"""A version of a dataset in Spark's catalog, with statistics."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tradewind.sources.versions import Version

#: Partition columns that say where a row is stored, not what it holds.
_COMMIT = "commit"


def _partition(file: str) -> dict[str, str]:
    """Partition columns and values of a data file."""
    return dict(p.split("=", 1) for p in file.split("/")[1:-1])


def register_tables(version: Version, schemas: dict[str, T.StructType], database: str) -> None:
    """Make tables of a version known to Spark's catalog in ``database``, and count their rows.

    Each becomes an external table over the files where they lie. Its partitions are the commits
    of the version, so rows of later or abandoned commits stay unseen. Tables of these names are
    replaced; their files are not touched.
    """
    spark = version.spark
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{version.directory}/{database}.db'")
    for name, schema in schemas.items():
        table = f"`{database}`.`{name}`"
        found = [_partition(file) for table_name, _, file in version.files if table_name == name and file]
        parts = {tuple(p.items()) for p in found}
        keys = [_COMMIT, *sorted({k for p in found for k in p} - {_COMMIT})]
        stored = {f.name: f.dataType.simpleString() for f in schema.fields}
        columns = stored | {k: stored.get(k, "string") for k in keys}
        ddl = ", ".join(f"`{c}` {kind}" for c, kind in columns.items())
        by = ", ".join(f"`{k}`" for k in keys)
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        spark.sql(
            f"CREATE TABLE {table} ({ddl}) USING parquet PARTITIONED BY ({by}) "
            f"LOCATION '{version.directory}/{name}'"
        )
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {' '.join(map(_clause, sorted(parts)))}" if parts else "SELECT 1")
        spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS")


def _clause(part: tuple[tuple[str, str], ...]) -> str:
    return "PARTITION (" + ", ".join(f"`{k}` = '{v}'" for k, v in part) + ")"


def catalog_listing(spark: SparkSession, database: str) -> DataFrame:
    """Tables of ``database`` in alphabetical order and their columns in declared order, with
    their types and the rows that the catalog's statistics know of. No table is read."""
    listed = []
    stored = [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]  # no views
    for table in sorted(stored):
        described = spark.sql(f"DESCRIBE TABLE EXTENDED `{database}`.`{table}` AS JSON").first()[0]
        about = json.loads(described)
        rows = about.get("statistics", {}).get("num_rows")
        partitions = set(about.get("partition_columns", []))
        for column in spark.catalog.listColumns(f"`{database}`.`{table}`"):
            if column.name not in partitions:
                listed.append((table, column.name, column.dataType, rows))
    numbered = []
    for table, name, kind, rows in listed:
        position = 1 + sum(t == table for t, *_ in numbered)
        numbered.append((table, position, name, kind, rows))
    return spark.createDataFrame(
        numbered,
        "table_name string, ordinal_position int, column_name string, data_type string, row_count bigint",
    )
