"""CSV feeds, CSV results, and the full refresh."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.tables import at, item, rows, table
from tradewind.model import TABLES
from tradewind.operators import DataQualityError
from tradewind.plans import REPORTS, append_new, export_reports, refresh_dataset
from tradewind.sinks import write_csv, write_table
from tradewind.sources import (
    feed_file,
    has_spanning_records,
    read_csv,
    read_dataset,
    register_views,
)

REVIEWS = TABLES["order_reviews"].schema


def write(path: Path, text: str) -> str:
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


def test_feed_file_names():
    assert feed_file("orders", "shop_", "_dataset") == "shop_orders_dataset.csv"
    assert (
        feed_file("product_category_name_translation", "shop_", "_dataset")
        == "product_category_name_translation.csv"
    )


def test_quotes_newlines_empties_and_types(spark, tmp_path):
    path = write(
        tmp_path / "reviews.csv",
        "id,other names,are,ignored,here,x,y\r\n"
        'r1,o1,5,"say ""hi""","two\nlines, one field",2018-01-18 00:00:00,2018-01-18 21:46:59\r\n'
        'r2,o2,,"",,,\r\n',
    )
    assert has_spanning_records(spark, path)
    assert rows(read_csv(spark, path, REVIEWS)) == [
        (
            "r1",
            "o1",
            5,
            'say "hi"',
            "two\nlines, one field",
            at("2018-01-18 00:00:00"),
            at("2018-01-18 21:46:59"),
        ),
        ("r2", "o2", None, "", None, None, None),
    ]


def test_zip_codes_amounts_and_byte_order_mark(spark, tmp_path):
    path = write(tmp_path / "c.csv", "﻿a,b,c,d,e\nc1,u1,01037,são paulo,SP\n")
    assert not has_spanning_records(spark, path)
    customers = read_csv(spark, path, TABLES["customers"].schema)
    assert rows(customers) == [("c1", "u1", 1037, "são paulo", "SP")]
    path = write(tmp_path / "i.csv", "a,b,c,d,e,f,g\no1,1,p,s,2017-09-19 09:45:35,1.235,13.29\n")
    (found,) = read_csv(spark, path, TABLES["order_items"].schema).collect()
    assert (found.price, found.freight_value) == (Decimal("1.24"), Decimal("13.29"))


@pytest.mark.parametrize(
    "line",
    [
        "c1,u1,abc,city,SP",
        "c1,u1,1",
        "c1,u1,1,city,SP,extra",
        "c1,u1,99999999999,city,SP",
    ],
)
@pytest.mark.parametrize("multi_line", [True, False])
def test_malformed_rows_fail(spark, tmp_path, line, multi_line):
    path = write(tmp_path / "c.csv", f"a,b,c,d,e\nc0,u0,1,city,SP\n{line}\n")
    customers = read_csv(spark, path, TABLES["customers"].schema, multi_line)
    with pytest.raises(Exception, match="MALFORMED_RECORD_IN_PARSING"):
        customers.write.format("noop").mode("overwrite").save()


@pytest.mark.parametrize("multi_line", [True, None])
def test_missing_file(spark, tmp_path, multi_line):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_csv(spark, str(tmp_path / "none.csv"), REVIEWS, multi_line)


def test_large_files_without_spanning_records_are_split(spark, tmp_path):
    lines = "".join(f"c{i},u,1,{'x' * 80},SP\n" for i in range(100_000))
    path = write(tmp_path / "c.csv", "a,b,c,d,e\n" + lines)
    schema = TABLES["customers"].schema
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 20)
    try:
        split = read_csv(spark, path, schema)
        assert split.rdd.getNumPartitions() > 5
        assert split.agg(F.countDistinct("customer_id")).first()[0] == 100_000
        assert read_csv(spark, path, schema, multi_line=True).rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def raw(path):
    (part,) = Path(path).glob("*.csv")
    return part.read_bytes().decode()


def test_csv_results(spark, tmp_path):
    df = spark.sql(
        "SELECT * FROM VALUES (1, CAST(0 AS DECIMAL(38,2)), CAST(0 AS DECIMAL(38,18)),"
        " timestamp_ntz'2018-10-17 17:30:18', date'2018-10-01', 'a \"b\", c'),"
        " (2, NULL, NULL, NULL, NULL, ''), (3, NULL, NULL, NULL, NULL, NULL) AS t(a,b,c,d,e,f)"
    )
    path = str(tmp_path / "out")
    write_csv(df, path, single_file=True)
    write_csv(df, path, single_file=True)
    assert raw(path) == (
        "a,b,c,d,e,f\n"
        '1,0.00,0.000000000000000000,2018-10-17 17:30:18,2018-10-01,"a ""b"", c"\n'
        "2,,,,,\n"
        "3,,,,,\n"
    )


def test_csv_of_an_empty_result_has_a_header(spark, tmp_path):
    write_csv(spark.createDataFrame([], "month date, gmv decimal(38,2)"), str(tmp_path / "o"), True)
    assert raw(tmp_path / "o") == "month,gmv\n"


# One order placed twice in the items file, one payment sent twice, one review id used twice,
# an item of an unknown product.
FEED = {
    "customers": "c1,u1,01037,sao paulo,SP\nc2,u2,20000,rio,RJ\n",
    "products": "p1,arte,1,1,1,1,1,1,1\np2,,,,,,,,\n",
    "sellers": "s1,1037,sao paulo,SP\n",
    "orders": "o1,c1,delivered,2018-05-01 10:00:00,,,2018-05-03 10:00:00,2018-05-20 00:00:00\n"
    "o2,c2,canceled,2018-06-01 10:00:00,,,,\n",
    "order_items": "o1,1,p1,s1,2018-05-02 00:00:00,10.00,1.50\n"
    "o1,1,p1,s1,2018-05-02 00:00:00,10.00,1.50\n"
    "o1,2,gone,s1,2018-05-02 00:00:00,99.00,1.00\n"
    "o2,1,p2,s1,2018-06-02 00:00:00,5.00,0.25\n",
    "order_payments": "o1,1,card,1,11.50\no1,1,card,1,11.50\no2,1,boleto,1,5.25\n",
    "order_reviews": 'r1,o1,5,,"good\nvery good",2018-05-04 00:00:00,2018-05-05 00:00:00\n'
    "r1,o2,5,,,2018-06-04 00:00:00,2018-06-05 00:00:00\n",
    "product_category_name_translation": "arte,art\n",
    "geolocation": "1037,-23.5,-46.6,sao paulo,SP\n1037,-23.5,-46.6,sao paulo,SP\n",
}


@pytest.fixture
def feed(tmp_path):
    def build(**changed):
        directory = tmp_path / "feed"
        directory.mkdir(exist_ok=True)
        for name, text in (FEED | changed).items():
            header = ",".join(TABLES[name].schema.names)
            write(directory / feed_file(name, "shop_", "_x"), f"{header}\n{text}")
        return str(directory)

    return build


def test_full_refresh(spark, tmp_path, feed):
    tables = refresh_dataset(spark, feed(), str(tmp_path / "v1"), "shop_", "_x")
    assert {name: df.count() for name, df in tables.items()} == {
        "customers": 2,
        "products": 2,
        "sellers": 1,
        "orders": 2,
        "order_items": 2,
        "order_payments": 2,
        "order_reviews": 1,
        "product_category_name_translation": 1,
        "geolocation": 2,
    }
    assert tables["orders"].schema == TABLES["orders"].schema
    by_state = REPORTS["gmv_by_state"](tables)
    assert rows(by_state) == [("SP", Decimal("11.50")), ("RJ", Decimal("5.25"))]
    register_views(read_dataset(spark, str(tmp_path / "v1")))
    assert spark.sql("SELECT sum(price) FROM order_items").first()[0] == Decimal("15.00")
    with pytest.raises(AnalysisException):
        refresh_dataset(spark, feed(), str(tmp_path / "v1"), "shop_", "_x")

    written = export_reports(tables, str(tmp_path / "out"), as_of=dt.date(2018, 6, 30))
    assert len(written) == 15 and written[0].endswith("/order_values")
    assert spark.read.parquet(written[0]).count() == 2
    assert raw(tmp_path / "out" / "gmv_by_month").startswith("month,gmv\n2018-05-01,11.50\n")
    assert raw(tmp_path / "out" / "price_range_by_category") == (
        "category,min_item_price,max_item_price\nart,10.00,10.00\n,5.00,5.00\n"
    )


@pytest.mark.parametrize(
    ("changed", "message"),
    [
        ({"customers": FEED["customers"] * 2}, "customers: 4 rows but 2 distinct"),
        ({"sellers": FEED["sellers"] + ",1,x,SP\n"}, "1 rows with an incomplete key"),
        ({"orders": FEED["orders"].replace("c2", "nobody")}, "orders.customer_id -> customers"),
    ],
)
def test_refresh_stops_on_bad_data(spark, tmp_path, feed, changed, message):
    with pytest.raises(DataQualityError, match=message):
        refresh_dataset(spark, feed(**changed), str(tmp_path / "v1"), "shop_", "_x")


def test_append_new(spark, tmp_path, feed):
    target = str(tmp_path / "v1")
    refresh_dataset(spark, feed(), target, "shop_", "_x")
    batch = table(
        spark,
        "order_items",
        item("o1", "999.00", product="p1", seller="s1"),
        item("o2", "7.00", number=2, product="p1", seller="s1"),
    )
    append_new(batch, "order_items", target)
    append_new(batch, "order_items", target)
    items = read_dataset(spark, target)["order_items"]
    assert sorted(row.price for row in items.collect()) == [
        Decimal("5.00"),
        Decimal("7.00"),
        Decimal("10.00"),
    ]


def test_a_failing_report_does_not_stop_the_others(spark, tmp_path, feed):
    tables = refresh_dataset(spark, feed(), str(tmp_path / "v1"), "shop_", "_x")
    tables["orders"] = tables["orders"].drop("customer_id")
    with pytest.raises(ExceptionGroup) as caught:
        export_reports(tables, str(tmp_path / "out"), ["repeat_rate", "payment_mix"])
    assert len(caught.value.exceptions) == 1
    assert raw(tmp_path / "out" / "payment_mix").count("\n") == 3
    tables["order_items"] = tables["order_items"].drop("price")
    with pytest.raises(ExceptionGroup) as caught:
        names = ["order_totals", "gmv_by_month", "payment_mix"]
        export_reports(tables, str(tmp_path / "out"), names)
    assert len(caught.value.exceptions) == 3


def test_sorted_files_skip_by_statistics(spark, tmp_path):
    moments = spark.range(0, 5_000, 1, 2).selectExpr("id * 7919 % 5000 AS day", "id")
    write_table(moments, str(tmp_path / "t"), sort_by=("day",))
    for part in (tmp_path / "t").glob("*.parquet"):
        days = pq.read_table(part)["day"].to_pylist()
        assert days == sorted(days) and len(days) == 2_500


def test_text_keeps_every_character(spark, tmp_path):
    texts = [" lead", "trail ", "\ttab\t", "a\nb", "a\r\nb", 'q"u"o', "a,b", "\u00e9 ", "plain"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, v string")
    path = str(tmp_path / "out")
    write_csv(df, path, single_file=True)
    assert b'"a\r\nb"' in raw(tmp_path / "out").encode() and "1,trail \n" in raw(tmp_path / "out")
    found = read_csv(spark, path, df.schema, multi_line=True)
    assert [r.v for r in found.orderBy("k").collect()] == texts


def test_misjudged_files_are_refused(spark, tmp_path):
    spanning = tmp_path / "a.csv"
    spanning.write_text('a,b\nk1,"b,c\nd,e"\n')
    schema = T.StructType.fromDDL("a string, b string")
    with pytest.raises(ValueError, match="span lines"):
        read_csv(spark, str(spanning), schema, multi_line=False)
    marked = tmp_path / "b.csv"
    marked.write_text("a,b\nk1,\u0001\n")
    with pytest.raises(ValueError, match="null_mark"):
        read_csv(spark, str(marked), schema)
    found = read_csv(spark, str(marked), schema, null_mark="\u0002")
    assert found.first().b == "\u0001"


@pytest.mark.parametrize(
    ("bad", "message"),
    [
        (item(None, "1.00", product="p1", seller="s1"), "no complete key"),
        (item("ghost", "1.00", product="p1", seller="s1"), "unknown key"),
    ],
)
def test_append_obeys_the_keys(spark, tmp_path, feed, bad, message):
    target = str(tmp_path / "v1")
    refresh_dataset(spark, feed(), target, "shop_", "_x")
    before = read_dataset(spark, target)["order_items"].count()
    with pytest.raises(DataQualityError, match=message):
        append_new(table(spark, "order_items", bad), "order_items", target)
    assert read_dataset(spark, target)["order_items"].count() == before


def test_an_unaudited_dataset_is_refused(spark, tmp_path, feed):
    target = str(tmp_path / "v1")
    with pytest.raises(DataQualityError):
        refresh_dataset(spark, feed(customers=FEED["customers"] * 2), target, "shop_", "_x")
    with pytest.raises(FileNotFoundError, match="no audited dataset"):
        read_dataset(spark, target)
