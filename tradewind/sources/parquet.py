"""Tables at rest: versioned Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradewind.model import TABLES, Tables
from tradewind.sources.versions import Version, latest


def latest_version(spark: SparkSession, directory: str) -> Version:
    """The latest version of a dataset; an error if none was published."""
    version = latest(spark, directory)
    if version is None:
        raise FileNotFoundError(f"{directory} holds no audited dataset")
    return version


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a dataset. Its schema is declared, not inferred from the files."""
    return latest_version(spark, directory).read(name, TABLES[name].schema)


def read_dataset(spark: SparkSession, directory: str) -> Tables:
    """All tables of a dataset, as its latest version has them; later appends don't change what
    was returned. An error if no refresh has ended with its audits."""
    version = latest_version(spark, directory)
    if missing := set(TABLES) - version.tables:
        raise FileNotFoundError(f"{directory} lacks {', '.join(sorted(missing))}")
    return {name: version.read(name, table.schema) for name, table in TABLES.items()}


def register_views(tables: Tables) -> None:
    """Make the tables available to SQL under their own names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
