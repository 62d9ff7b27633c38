"""CSV files whose records span lines, read in splits.

A line break belongs to a value exactly if an odd number of quotes stands before it in its file.
Every block of a file counts its lines and quotes on its own; from what the blocks come to, each
block learns whether it begins inside quotes and, if so, where the record at hand began. Lines with
an odd number of quotes then tell which lines a block shares with its neighbours: only these are
shuffled. All others are put together to records where they are read, in order, a batch at a time.
Spark's CSV parser reads the records one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for a quoted value while a record is looked at.
_QUOTED = "\u0002"


def _lines(text: DataFrame) -> DataFrame:
    """Lines with their file and block; ``at`` rises by one from each line of a block to the next,
    and ``odd`` tells whether the line holds an odd number of quotes."""
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        (quotes % 2 == 1).alias("odd"),
        "value",
    )


def _blocks(lines: DataFrame) -> DataFrame:
    """For each block of a file: how many lines stand before it, where its first line and its
    first and last ``odd`` ones are, whether it begins (``inside``) and ends (``open``) inside
    quotes, and the lines of the file on which a record began that it goes on with (``from_line``)
    or leaves open (``to_line``); the number of the file, and whether the file's lines end in a
    carriage return too, as its first line tells (``crlf``).

    One row for each split, as the list of files that Spark plans a scan with.
    """
    odd = F.when(F.col("odd"), F.col("at"))
    blocks = lines.groupBy("file", "block").agg(
        F.count("*").alias("lines"),
        F.count_if("odd").alias("odd_lines"),
        F.min("at").alias("first"),
        F.min(odd).alias("first_odd"),
        F.max(odd).alias("last_odd"),
        F.min_by(F.endswith("value", F.lit("\r")), "at").alias("returns"),
    )
    whole = Window.partitionBy("file")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    unclosed = F.concat("file", F.lit(" ends inside quotes: its last record is not closed"))
    return (
        blocks.withColumn("lines_before", F.coalesce(F.sum("lines").over(before), F.lit(0)))
        .withColumn("inside", F.coalesce(F.sum("odd_lines").over(before), F.lit(0)) % 2 == 1)
        .withColumn("open", F.col("inside") != (F.col("odd_lines") % 2 == 1))
        .withColumn("to_line", F.expr("if(open, lines_before + last_odd - first + 1, NULL)"))
        .withColumn("from_line", F.last("to_line", ignorenulls=True).over(before))
        .withColumn("closed", F.sum("odd_lines").over(whole) % 2 == 0)
        .withColumn("inside", F.when(F.col("closed"), F.col("inside")).otherwise(F.raise_error(unclosed).cast("boolean")))
        .withColumn("crlf", F.bool_or(F.col("returns") & (F.col("block") == 0)).over(whole))
        .withColumn("file_number", F.dense_rank().over(Window.orderBy("file")))
        .drop("lines", "returns", "closed")
    )


def _stitcher() -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Puts lines (``file_number``, ``line``, ``odd``, ``value``) that come in order, and whose
    quotes are closed at the end of each block, together to records.

    A function of its own in each task: it reaches machines that don't have this package."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = []  # batches of lines of a record that isn't closed yet
        for batch in batches:
            begun.append(batch)
            if len(begun) > 1 and not pc.any(batch.column("odd")).as_py():
                continue
            lines = pa.Table.from_batches(begun).combine_chunks()
            odd = lines["odd"].to_numpy().astype(np.int64)
            starts = np.flatnonzero((np.cumsum(odd) - odd) % 2 == 0)
            end = len(odd)
            begun = []
            if odd.sum() % 2:
                end, starts = int(starts[-1]), starts[:-1]
                begun = lines.slice(end).to_batches()
            if not len(starts):
                continue
            values = pa.concat_arrays(lines["value"].chunks)
            ends = pa.array(np.append(starts, end), pa.int32())
            records = pc.binary_join(pa.ListArray.from_arrays(ends, values), "\n")
            first = lines.select(["file_number", "line"]).take(pa.array(starts)).combine_chunks()
            columns = [pa.concat_arrays(c.chunks) for c in first.columns]
            yield pa.RecordBatch.from_arrays([*columns, records], names=["file_number", "line", "record"])

    return run


def numbered_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The records of the files at ``path`` (``file_number``, the ``line`` on which each begins,
    from 1, and ``record``), and the files (``file_number``, ``file``). Headers and empty lines
    are left out.

    Four scans, one of line ends and quotes alone; lines that a block shares with others are
    shuffled, and no task holds more than a batch of lines or a record. A file that ends inside
    quotes fails the query. Blank characters and line breaks within quotes stay as they are, but
    where lines end in CR LF, such pairs within quotes become LF, as Spark's own reader has it.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    blocks = _blocks(_lines(text))
    head = F.col("inside") & (F.col("at") <= F.coalesce("first_odd", "at"))
    tail = F.col("open") & F.coalesce(F.col("at") >= F.col("last_odd"), F.lit(False))
    lines = (
        _lines(text)
        .join(F.broadcast(blocks), ["file", "block"])
        .withColumn("line", F.expr("lines_before + at - first + 1"))
        .withColumn("start", F.when(head, F.col("from_line")).when(tail, F.col("to_line")))
        .withColumn("value", F.when(F.col("crlf"), F.regexp_replace("value", r"\r\z", "")).otherwise(F.col("value")))
    )
    own = lines.where("start IS NULL")
    # Without a line of odd quotes, every line of a block is a record.
    single = own.where("odd_lines = 0").select("file_number", "line", F.col("value").alias("record"))
    stitched = (
        own.where("odd_lines > 0")
        .select("file_number", "line", "odd", "value")
        .mapInArrow(_stitcher(), "file_number int, line bigint, record string")
    )
    shared = (
        lines.where("start IS NOT NULL")
        .groupBy("file_number", "start")
        .agg(F.sort_array(F.collect_list(F.struct("line", "value"))).alias("lines"))
        .select("file_number", F.col("start").alias("line"), F.array_join("lines.value", "\n").alias("record"))
    )
    found = single.unionByName(stitched).unionByName(shared).where("line > 1 AND record <> ''")
    return found, blocks.select("file_number", "file").distinct()


def _problem(record: Column, null_mark: str) -> Column:
    """Why ``record`` can't be read, if so. Where quotes stand elsewhere than around values,
    counting them doesn't tell the records."""
    quoted = F.regexp_replace(record, '"[^"]*"', _QUOTED)
    stray = quoted.rlike(f'[^,{_QUOTED}]{_QUOTED}|{_QUOTED}[^,{_QUOTED}]|"')
    return F.when(
        F.contains(record, F.lit(null_mark)), F.lit(f"holds {null_mark!r}, which stands for NULL")
    ).when(F.contains(record, F.lit('"')) & stray, F.lit("quote inside an unquoted value"))


def _row(record: Column, schema: T.StructType, null_mark: str, **options: str) -> Column:
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    fixed = {"quote": '"', "escape": '"', "nullValue": null_mark, "multiLine": "true"}
    return F.from_csv(record, ddl, fixed | options)


def read_spanning_csv(
    spark: SparkSession, path: str, schema: T.StructType, null_mark: str
) -> DataFrame:
    """CSV files with a header whose records may span lines, read in as many tasks as splits.

    Like :func:`tradewind.sources.csv.read_csv` in all else: a record that does not fit the
    schema fails the query that reads it, and so does one that holds ``null_mark``. A value that
    holds a quote must be quoted.
    """
    record = F.col("record")
    problem = _problem(record, null_mark)
    refused = F.raise_error(F.concat(problem, F.lit(": "), record)).cast("string")
    sound = F.when(problem.isNotNull(), refused).otherwise(record)
    found, _ = numbered_records(spark, path)
    found = found.select(_row(sound, schema, null_mark, mode="FAILFAST").alias("row"))
    return found.select("row.*")


def rejected_records(
    spark: SparkSession, path: str, schema: T.StructType, null_mark: str
) -> DataFrame:
    """Records that :func:`read_spanning_csv` would refuse: ``file``, ``line``, ``record`` and
    ``reason``. A file that ends inside quotes fails the query."""
    bad = "_rejected"
    wider = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    row = _row(F.col("record"), wider, null_mark, mode="PERMISSIVE", columnNameOfCorruptRecord=bad)
    misfit = F.when(row[bad].isNotNull(), F.lit("does not fit the schema"))
    found, files = numbered_records(spark, path)
    refused = found.withColumn("reason", F.coalesce(_problem(F.col("record"), null_mark), misfit))
    refused = refused.where(F.col("reason").isNotNull())
    return refused.join(F.broadcast(files), "file_number").select("file", "line", "record", "reason")
