"""CSV records that span lines, read in splits, against Spark's own one-task reader."""

from __future__ import annotations

import contextlib
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.model import TABLES
from tradewind.operators import DataQualityError
from tradewind.plans import refresh_dataset
from tradewind.sources import feed_inventory, read_csv, read_dataset, read_spanning_csv, rejected_rows
from tradewind.sources.csv import NULL_MARK



@contextlib.contextmanager
def split_size(spark, size):
    """Blocks of ``size`` bytes, one to a task."""
    values = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": str(size)}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in values:
            spark.conf.unset(key)


def schema():
    names = {"k": T.IntegerType(), "a": T.StringType(), "b": T.StringType(), "c": T.IntegerType()}
    return T.StructType([T.StructField(n, t) for n, t in names.items()])


def quoted(text):
    return '"' + text.replace('"', '""') + '"'


def hostile(directory, seed):
    """Three files with either line end, a byte order mark, a header that spans lines, blank
    lines, quotes, and values that begin, end or consist of line breaks."""
    rng = random.Random(seed)
    directory.mkdir()
    pieces = ["x", "yé", ",", '"', "\n", "\r\n", "\r", " ", " zz ", "\t", "中"]
    for number in range(3):
        end = rng.choice(["\n", "\r\n"])
        header = f'"k{end}x",a,b,c' if number == 2 else "k,a,b,c"
        text = ("﻿" if number == 1 else "") + header + end
        for i in range(250):
            values = ["".join(rng.choices(pieces, k=rng.choice([0, 1, 3, 9, 40]))) for _ in "ab"]
            plain = ["".join(c for c in v if c not in ',"\r\n') for v in values]
            values = [quoted(v) if rng.random() < 0.5 else p for v, p in zip(values, plain, strict=True)]
            text += f"{number * 1000 + i},{values[0]},{values[1]},{rng.choice(['', i])}{end}"
            text += end * (rng.random() < 0.05)
        (directory / f"{number}.csv").write_text(text, encoding="utf-8", newline="")
    return str(directory)


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("size", [64, 257, 2_000, 1 << 27])
@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_gives_the_records_of_the_whole_file(spark, tmp_path, seed, size):
    path = hostile(tmp_path / "feed", seed)
    expected = in_order(read_csv(spark, path, schema(), multi_line=True).collect())
    with split_size(spark, size):
        found = read_spanning_csv(spark, path, schema(), NULL_MARK)
        assert in_order(found.collect()) == expected
        assert in_order(read_csv(spark, path, schema()).collect()) == expected
    assert len(expected) == 750


def test_many_tasks_read_one_file(spark, tmp_path):
    path = tmp_path / "r.csv"
    names = ",".join(TABLES["order_reviews"].schema.names)
    row = '{},o{},5,,"line one\n{}\nline three",2018-05-04 00:00:00,\n'
    path.write_text(names + "\n" + "".join(row.format(i, i, "x" * (i % 200)) for i in range(4000)))
    reviews = TABLES["order_reviews"].schema
    with split_size(spark, 1 << 16):
        lines = spark.read.text(str(path))
        assert lines.rdd.getNumPartitions() > 5
        found = read_spanning_csv(spark, str(path), reviews, NULL_MARK)
        plan = found._jdf.queryExecution().executedPlan().toString()
        found = in_order(found.collect())
    assert "multiLine" not in plan.split("FileScan")[1] and "FileScan text" in plan
    assert found == in_order(read_csv(spark, str(path), reviews, multi_line=True).collect())


@pytest.mark.parametrize("size", [400, 1 << 27])
@pytest.mark.parametrize("rows", [1, 3, 64])
def test_records_go_on_from_batch_to_batch(spark, tmp_path, rows, size):
    path = hostile(tmp_path / "feed", 3)
    expected = in_order(read_csv(spark, path, schema(), multi_line=True).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        with split_size(spark, size):
            assert in_order(read_spanning_csv(spark, path, schema(), NULL_MARK).collect()) == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_task_orders_the_lines_of_a_block(spark, tmp_path):
    path = hostile(tmp_path / "feed", 1)
    found = read_spanning_csv(spark, path, schema(), NULL_MARK)
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows = [line for line in plan if "Window [" in line]
    assert windows and not any(re.search(r"\b(at|line|value)#", line) for line in windows)


def test_a_record_longer_than_blocks(spark, tmp_path):
    path = tmp_path / "l.csv"
    long = "\n".join("y" * 50 for _ in range(200))
    path.write_text(f'k,a,b,c\n1,{quoted(long)},,2\n2,,{quoted(long)},3')
    with split_size(spark, 100):
        found = read_csv(spark, str(path), schema()).orderBy("k").collect()
    assert [tuple(r) for r in found] == [(1, long, None, 2), (2, None, long, 3)]


def test_files_without_records(spark, tmp_path):
    for name, text in (("a", ""), ("b", "k,a,b,c"), ("c", "k,a,b,c\n\n\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    assert read_spanning_csv(spark, str(tmp_path), schema(), NULL_MARK).collect() == []


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ('1,"a\n,b,2\n', "ends inside quotes"),
        ('1,a"x\ny"b,b,2\n', "quote inside an unquoted value"),
        ('1,"a"x"\n"b,b,2\n', "quote inside an unquoted value"),
        ('1,"a\nb",\u0001,2\n', "stands for NULL"),
        ('1,"a\nb",c\n', "MALFORMED_RECORD"),
        ('x,"a\nb",c,1\n', "MALFORMED_RECORD"),
        ('1,"a\nb",c,1,1\n', "MALFORMED_RECORD"),
    ],
)
def test_what_does_not_fit_is_refused(spark, tmp_path, text, message):
    path = tmp_path / "x.csv"
    path.write_text('k,a,b,c\n0,"a\nb",c,1\n' + text)
    with pytest.raises(Exception, match=message):
        read_spanning_csv(spark, str(path), schema(), NULL_MARK).collect()


# Rejected records


def feed(directory, **rows):
    directory.mkdir()
    for name, table in TABLES.items():
        text = ",".join(table.schema.names) + "\n" + rows.get(name, "")
        (directory / f"{name}.csv").write_text(text)
    return str(directory)


BAD = {
    "customers": "c1,u1,1037,sao paulo,SP\nc2,u2,zip,rio,RJ\nc3,u3,1\n",
    "order_reviews": 'r1,o1,5,,"good\nvery good",2018-05-04 00:00:00,\n'
    'r2,o1,five,,"a\nb",2018-05-04 00:00:00,\n',
}


def test_rejected_rows_are_named_with_file_and_line(spark, tmp_path):
    directory = feed(tmp_path / "feed", **BAD)
    with split_size(spark, 70):
        found = rejected_rows(spark, directory).orderBy("table_name", "line").collect()
    assert [(r.table_name, r.file.rpartition("/")[2], r.line, r.record) for r in found] == [
        ("customers", "customers.csv", 3, "c2,u2,zip,rio,RJ"),
        ("customers", "customers.csv", 4, "c3,u3,1"),
        ("order_reviews", "order_reviews.csv", 4, 'r2,o1,five,,"a\nb",2018-05-04 00:00:00,'),
    ]
    assert {r.reason for r in found} == {"does not fit the schema"}


def test_a_refresh_names_all_rejected_rows(spark, tmp_path):
    out = str(tmp_path / "v1")
    with pytest.raises(DataQualityError, match="3 rejected records.*customers, line 3.*line 4.*reviews, line 4"):
        refresh_dataset(spark, feed(tmp_path / "feed", **BAD), out)
    assert spark.read.parquet(f"{out}/rejected").count() == 3
    with pytest.raises(FileNotFoundError):
        read_dataset(spark, out)


def test_a_sound_feed_has_no_rejected_rows(spark, tmp_path):
    rows = {"customers": 'c1,u1,01037,"são\npaulo",SP\n\n', "sellers": "s1,,,\n"}
    directory = feed(tmp_path / "feed", **rows)
    assert rejected_rows(spark, directory).where(F.col("reason") != "").collect() == []


def test_the_inventory_counts_records_without_dealing_out_lines(spark, tmp_path):
    rows = BAD | {"sellers": "\n\ns1,,,\n"}
    directory = feed(tmp_path / "feed", **rows)
    with split_size(spark, 70):
        found = feed_inventory(spark, directory)
        counts = {r.table_name: r.records for r in found.collect()}
        plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert counts["customers"] == 3 and counts["order_reviews"] == 2 and counts["sellers"] == 1
    assert counts["orders"] == 0
    assert not re.search(r"windowspecdefinition\([^)]*\b(at|line)#", plan)


def test_rejected_rows_are_found_where_they_are_read(spark, tmp_path):
    directory = feed(tmp_path / "feed", **BAD)
    found = rejected_rows(spark, directory)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"windowspecdefinition\([^)]*\b(at|line)#", plan)
    assert found.count() == 3
