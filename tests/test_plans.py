"""The physical plans: pushdown, shuffles, reuse, and behaviour under hot keys at scale."""

from __future__ import annotations

import contextlib
import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from contract.registry import queries
from tradewind import operators as ops
from tradewind.functions import percent
from tradewind.plans import REPORTS

SF_DIR = "/root/testdata/sf0.001"

# What a cluster sees when no table is small enough to broadcast.
LARGE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}
# Adaptive execution acting on kilobytes as it would on gigabytes.
SKEW = LARGE | {
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@contextlib.contextmanager
def settings(spark, values):
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    text = plan(df)
    assert "isFinalPlan=true" in text
    return text.split("== Initial Plan ==")[0]


def partitioned_on(text: str) -> list[str]:
    """Key columns of each hash shuffle, without Spark's column numbers."""
    return [
        re.sub(r"#\d+L?", "", keys).rsplit(",", 1)[0]
        for keys in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    ]


#: Queries that write files before they return, or put records together from lines.
SCRATCH = {
    "src_csv_load", "snk_csv_roundtrip", "full_refresh_gmv", "src_csv_spanning", "src_rejected_rows",
    "src_feed_inventory", "snk_csv_empty", "append_payments", "gmv_by_state_appended",
    "gmv_by_month_stored", "gmv_by_period_stored", "catalog_overview", "top_sellers_rollup",
}
NO_SCRATCH = sorted(set(queries()) - SCRATCH)


@pytest.mark.parametrize("name", NO_SCRATCH)
def test_no_nested_loops_and_no_python(spark, name):
    with settings(spark, LARGE):
        text = plan(queries()[name](spark, SF_DIR))
    for operator in ("NestedLoop", "CartesianProduct", "Python", "Arrow", "Window"):
        assert operator not in text, operator


@pytest.mark.parametrize(
    "name", ["aov_by_customer", "top_sellers", "order_totals", "recent_orders"]
)
def test_top_k_never_sorts_the_whole_input(spark, name):
    text = plan(queries()[name](spark, SF_DIR))
    assert "TakeOrderedAndProject" in text
    assert "rangepartitioning" not in text


def test_scans_read_only_used_columns_and_push_filters(spark):
    text = plan(queries()["gmv_by_month"](spark, SF_DIR))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert sorted(schemas) == [
        "l_orderkey:bigint,l_quantity:double,l_extendedprice:double",
        "o_orderkey:bigint,o_orderdate:timestamp_ntz",
    ]
    assert "GreaterThanOrEqual(o_orderdate,2000-08-01T00:00)" in text
    text = plan(queries()["recent_orders"](spark, SF_DIR))
    assert "PushedFilters: [In(o_orderstatus, [F,O])]" in text


def test_order_join_needs_one_shuffle_per_side(spark):
    with settings(spark, LARGE):
        text = plan(queries()["gmv_by_month"](spark, SF_DIR))
    assert partitioned_on(text) == ["_groupingexpression", "order_id", "order_id"]


def test_items_are_combined_before_they_are_shuffled(spark):
    with settings(spark, LARGE):
        text = plan(queries()["gmv_by_state"](spark, SF_DIR))
    assert re.search(
        r"Exchange hashpartitioning\(order_id[^\n]*\n[^\n]*HashAggregate\(keys=\[order_id#\d+L\], "
        r"functions=\[partial_sum",
        text,
    )


def test_average_per_customer_regroups_without_shuffling_again(spark):
    with settings(spark, LARGE):
        text = plan(queries()["aov_by_customer"](spark, SF_DIR))
    shuffles = partitioned_on(text)
    assert shuffles.count("order_id") == 2 and "order_id, customer_id" not in shuffles


def test_payment_mix_scans_once(spark):
    text = final_plan(queries()["payment_mix"](spark, SF_DIR))
    # The subquery for the overall total reads the shuffle that the groups come from.
    assert re.search(r"ReusedExchange [^\n]*Exchange hashpartitioning\(payment_type", text)


def test_distinct_orders_of_one_seller_spread_over_tasks(spark):
    text = plan(queries()["top_sellers"](spark, SF_DIR))
    assert partitioned_on(text) == ["seller_id", "seller_id, order_id"]


def test_insert_if_absent_shuffles_each_side_once(spark):
    with settings(spark, LARGE):
        text = plan(queries()["insert_if_absent"](spark, SF_DIR))
    assert partitioned_on(text) == ["order_id, payment_sequential"] * 2


def test_month_filter_reaches_the_items_as_a_bloom_filter(spark):
    eager = LARGE | {
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
        "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1GB",
    }
    with settings(spark, eager):
        df = queries()["gmv_by_month"](spark, SF_DIR)
        text = plan(df)
        assert "might_contain" in text
        # It is applied on the scanned items, below their shuffle.
        items = text[text.index("partial_sum((price") :]
        assert "might_contain" in items
        with_filter = df.collect()
    assert with_filter == queries()["gmv_by_month"](spark, SF_DIR).collect()


HOT_ROWS = 60_000


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """Items, a third of them in one order, with one product and from one seller."""
    directory = tmp_path_factory.mktemp("hot")

    def key(column, size, stride):
        spread = F.xxhash64("id", F.lit(column)) % size
        hot = F.floor(F.col("id") / stride) % 3 == 0
        return F.when(hot, 0).otherwise(F.abs(spread)).cast("string").alias(column)

    def write(name, df):
        df.write.parquet(f"{directory}/{name}")
        return spark.read.parquet(f"{directory}/{name}")

    price = (F.abs(F.xxhash64("id")) % 10_000 / 100).cast("decimal(12,2)")
    items = spark.range(0, HOT_ROWS, 1, 16).select(
        key("order_id", 20_000, 1),
        (F.col("id") % 50_000).cast("int").alias("order_item_id"),
        key("product_id", 5_000, 3),
        key("seller_id", 2_000, 9),
        F.lit(dt.datetime(2020, 1, 1)).cast("timestamp_ntz").alias("shipping_limit_date"),
        price.alias("price"),
        price.alias("freight_value"),
    )
    ids = lambda name, size: spark.range(size).select(F.col("id").cast("string").alias(name))
    return {
        "order_items": write("items", items),
        "orders": write(
            "orders",
            ids("order_id", 20_000).withColumn(
                "customer_id",
                F.when(F.rand(3) < 0.34, "0").otherwise((F.col("order_id") % 900).cast("string")),
            ),
        ),
        "customers": write(
            "customers",
            ids("customer_id", 900).withColumn("customer_state", F.col("customer_id") % 27),
        ),
        "products": write(
            "products",
            ids("product_id", 4_900).withColumn("product_category_name", F.lit("c")),
        ),
        "sellers": write("sellers", ids("seller_id", 1_900)),
        # A third of all reviews belong to the order that holds a third of all items.
        "order_reviews": write(
            "reviews",
            spark.range(30_000).select(
                F.when(F.col("id") % 3 == 0, 0)
                .otherwise(F.col("id") % 20_000)
                .cast("string")
                .alias("order_id"),
                (F.col("id") % 5 + 1).cast("int").alias("review_score"),
            ),
        ),
        "product_category_name_translation": spark.createDataFrame(
            [("c", "x")], "product_category_name string, product_category_name_english string"
        ),
    }


@pytest.fixture(params=["SortMergeJoin", "ShuffledHashJoin"])
def join(request):
    limit = {"SortMergeJoin": "0", "ShuffledHashJoin": "64MB"}[request.param]
    return request.param, SKEW | {
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": limit
    }


def test_hot_order_is_folded_before_the_review_join(spark, hot, join):
    _, configured = join
    with settings(spark, configured):
        df = REPORTS["review_by_category"](hot)
        text = final_plan(df)
        (row,) = df.collect()
    partial = r"HashAggregate\(keys=\[order_id#\d+L?, product_id#\d+L?\], functions=\[partial_count\(1\)"
    assert re.search(partial, text), "items leave each task as one row per order and product"
    # Score sums per order against item counts per order: the same join, folded on both sides.
    per_order = hot["order_reviews"].groupBy("order_id").agg(
        F.count("*").alias("r"), F.sum("review_score").alias("s")
    )
    known = hot["order_items"].join(hot["products"], "product_id", "left_semi")
    folded = known.groupBy("order_id").agg(F.count("*").alias("i")).join(per_order, "order_id")
    reviews, score = folded.agg(F.expr("sum(i * r)"), F.expr("sum(i * s)")).first()
    assert row.reviews == reviews and reviews > HOT_ROWS * 3_000
    assert abs(float(row.avg_review) - score / reviews) <= 0.005


def test_hot_product_and_seller_are_split_while_loading(spark, hot, join):
    kind, configured = join
    with settings(spark, configured):
        df = ops.load_order_items(hot["order_items"], hot["products"], hot["sellers"])
        text = final_plan(df)
        loaded = df.count()
    assert f"{kind}(skew=true) [product_id" in text
    assert f"{kind}(skew=true) [seller_id" in text
    expected = (
        hot["order_items"]
        .where("cast(product_id as int) < 4900 and cast(seller_id as int) < 1900")
        .select("order_id", "order_item_id")
        .distinct()
        .count()
    )
    assert loaded == expected


@pytest.mark.parametrize(
    "name", ["gmv_by_state", "top_categories", "aov_by_customer", "order_totals"]
)
def test_hot_keys_leave_each_task_as_one_row(spark, hot, name):
    """No shuffle of these reports moves a hot key's rows uncombined, so none is skewed."""
    tables = dict(hot)
    tables["customers"] = tables["customers"].withColumn("customer_city", F.lit("x"))
    with settings(spark, SKEW):
        text = final_plan(REPORTS[name](tables))
    assert "skew=true" not in text
    for exchange in re.finditer(r"Exchange hashpartitioning[^\n]*\n([^\n]*)\n", text):
        below = exchange.group(1)
        if "FileScan" not in below and "Project" not in below and "Filter" not in below:
            assert "HashAggregate" in below, below


def test_percent_of_a_large_total_does_not_overflow(spark):
    part = F.lit("99999999999999999999999.99").cast("decimal(33,2)")
    assert float(spark.range(1).select(percent(part, part)).first()[0]) == 100.0
