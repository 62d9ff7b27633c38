"""Typed CSV feeds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.model import TABLES, Tables
from tradewind.sources.spanning import numbered_records, read_spanning_csv, rejected_records


def feed_file(table: str, prefix: str = "", suffix: str = "") -> str:
    """File name of a table in a feed: ``<prefix><table><suffix>.csv``.

    The category translation is a lookup shipped beside the feed and carries neither.
    """
    if not TABLES[table].from_feed:
        prefix = suffix = ""
    return f"{prefix}{table}{suffix}.csv"


#: Stands for NULL while a feed is read, so that only an unquoted empty field becomes NULL.
NULL_MARK = "\u0001"


def inspect_csv(
    spark: SparkSession, path: str, null_mark: str = NULL_MARK
) -> tuple[bool, bool, bool]:
    """Whether any record continues over a line break inside quotes, whether ``null_mark`` occurs,
    and whether any file is read in several splits. Exactly if records span lines, some line holds
    an odd number of quotes."""
    unquoted = F.replace("value", F.lit('"'), F.lit(""))
    quotes = F.octet_length("value") - F.octet_length(unquoted)
    found = spark.read.text(path).agg(
        F.coalesce(F.bool_or(quotes % 2 == 1), F.lit(False)),
        F.coalesce(F.bool_or(F.contains("value", F.lit(null_mark))), F.lit(False)),
        F.coalesce(F.max("_metadata.file_block_start") > 0, F.lit(False)),
    )
    return tuple(found.first())


def has_spanning_records(spark: SparkSession, path: str) -> bool:
    """Whether any record continues over a line break inside quotes."""
    return inspect_csv(spark, path)[0]


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    multi_line: bool | None = None,
    null_mark: str = NULL_MARK,
) -> DataFrame:
    """A CSV file or directory with a header, read by position into ``schema``.

    Quotes are doubled for escaping, an unquoted empty field is NULL and a quoted one the empty
    string. A row or value that does not fit the schema fails the query that reads it (writing the
    table reads all of it); a missing path raises here.

    The file is first scanned as text. With ``multi_line=False`` a file in which records span
    lines is refused, never misread. With None, files that are large enough for several splits are
    then read in splits, their lines put together to records (:mod:`tradewind.sources.spanning`);
    others, and with True all, by Spark's own reader with one task for a file. A file that holds
    ``null_mark`` is refused: choose another that it doesn't hold.
    """
    spans, marked, split = inspect_csv(spark, path, null_mark)
    if marked:
        raise ValueError(f"{path} holds {null_mark!r}, which stands for NULL; pass another null_mark")
    if spans and multi_line is False:
        raise ValueError(f"{path} has a line with an odd number of quotes; its records span lines")
    if spans and split and multi_line is None:
        return read_spanning_csv(spark, path, schema, null_mark)
    multi_line = spans if multi_line is None else multi_line
    return spark.read.schema(schema).csv(
        path,
        header=True,
        multiLine=multi_line,
        quote='"',
        escape='"',
        mode="FAILFAST",
        nullValue=null_mark,
    )


def read_feed(
    spark: SparkSession,
    directory: str,
    prefix: str = "",
    suffix: str = "",
    multi_line: Mapping[str, bool | None] | None = None,
) -> Tables:
    """All tables of a feed directory, as found in the files.

    Only tables of free text are taken to have records that span lines, as the model says, and
    are put together from lines; ``multi_line`` overrides that by table.
    """
    chosen = dict(multi_line or {})

    def read(name: str, path: str) -> DataFrame:
        if TABLES[name].spans_lines and name not in chosen:
            return read_spanning_csv(spark, path, TABLES[name].schema, NULL_MARK)
        return read_csv(spark, path, TABLES[name].schema, chosen.get(name, False))

    return {
        name: read(name, f"{directory}/{feed_file(name, prefix, suffix)}") for name in TABLES
    }


def feed_inventory(
    spark: SparkSession, directory: str, prefix: str = "", suffix: str = ""
) -> DataFrame:
    """The files that a feed should have: ``table_name``, ``present``, and the number of its
    ``records``, NULL for a file that is missing."""
    found = None
    for name in TABLES:
        path = f"{directory}/{feed_file(name, prefix, suffix)}"
        try:
            rows = numbered_records(spark, path)[0].agg(F.count("*").alias("records"))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = spark.range(1).select(F.lit(None).cast("bigint").alias("records"))
        present = F.col("records").isNotNull().alias("present")
        rows = rows.select(F.lit(name).alias("table_name"), present, "records")
        found = rows if found is None else found.unionByName(rows)
    return found


def rejected_rows(
    spark: SparkSession, directory: str, prefix: str = "", suffix: str = ""
) -> DataFrame:
    """All records of a feed that don't fit their table: ``table_name``, ``file``, ``line`` on
    which the record begins, ``record`` and ``reason``."""
    found = None
    for name, table in TABLES.items():
        path = f"{directory}/{feed_file(name, prefix, suffix)}"
        rows = rejected_records(spark, path, table.schema, NULL_MARK)
        rows = rows.select(F.lit(name).alias("table_name"), "file", "line", "record", "reason")
        found = rows if found is None else found.unionByName(rows)
    return found
