"""Item and review measures per product category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions import amount, rounded_ratio, top_k
from tradewind.model import MIN_REVIEWS, TOP_CATEGORIES, TOP_ROWS


def _roll_up(
    per_product: DataFrame,
    products: DataFrame,
    translation: DataFrame,
    measures: Sequence[Column],
) -> DataFrame:
    """Roll measures kept per product up to the displayed category.

    The display name is the English one, else the original; products without a category form a
    NULL group. Rows are folded to the raw category name before the translation joins, so that
    join sees one row per category and no popular product or category reaches a single task
    unaggregated. ``measures`` must be re-aggregable (sum, min, max) under their own names.
    """
    per_name = (
        per_product.join(products.select("product_id", "product_category_name"), "product_id")
        .groupBy("product_category_name")
        .agg(*measures)
    )
    names = translation.select("product_category_name", "product_category_name_english")
    display = F.coalesce("product_category_name_english", "product_category_name")
    return (
        per_name.join(names, "product_category_name", "left")
        .groupBy(display.alias("category"))
        .agg(*measures)
    )


def top_categories(
    order_items: DataFrame, products: DataFrame, translation: DataFrame, k: int = TOP_CATEGORIES
) -> DataFrame:
    """Categories with the highest item revenue."""
    per_product = order_items.groupBy("product_id").agg(
        F.sum("price").alias("revenue"), F.count("*").alias("items_sold")
    )
    measures = [F.sum("revenue").alias("revenue"), F.sum("items_sold").alias("items_sold")]
    totals = _roll_up(per_product, products, translation, measures).select(
        "category", amount(F.col("revenue")).alias("revenue"), "items_sold"
    )
    return top_k(totals, k, F.desc_nulls_first("revenue"), F.asc_nulls_last("category"))


def price_range_by_category(
    order_items: DataFrame, products: DataFrame, translation: DataFrame
) -> DataFrame:
    """Cheapest and dearest item price of every category, the NULL category last."""
    low, high = F.min("min_item_price"), F.max("max_item_price")
    per_product = order_items.groupBy("product_id").agg(
        F.min("price").alias("min_item_price"), F.max("price").alias("max_item_price")
    )
    measures = [low.alias("min_item_price"), high.alias("max_item_price")]
    return _roll_up(per_product, products, translation, measures).orderBy(
        F.asc_nulls_last("category")
    )


def review_by_category(
    order_reviews: DataFrame,
    order_items: DataFrame,
    products: DataFrame,
    translation: DataFrame,
    min_reviews: int = MIN_REVIEWS,
    k: int = TOP_ROWS,
) -> DataFrame:
    """Best rated categories among those with at least ``min_reviews`` reviews.

    A review counts once per item of its order. All measures are linear, so both sides are folded
    before they meet: reviews to one row per order, items to one per order and product. An order
    that holds a large share of the items leaves each task as its different products.
    """
    per_order = order_reviews.groupBy("order_id").agg(
        F.count("*").alias("reviews"),
        F.count("review_score").alias("scored"),
        F.sum(F.col("review_score").cast("decimal(10,0)")).alias("score_total"),
    )
    sold = order_items.groupBy("order_id", "product_id").agg(F.count("*").alias("n"))
    per_product = (
        sold.join(per_order, "order_id")
        .groupBy("product_id")
        .agg(*[F.sum(F.col(c) * F.col("n")).alias(c) for c in ("reviews", "scored", "score_total")])
    )
    measures = [F.sum(c).alias(c) for c in ("reviews", "scored", "score_total")]
    rated = (
        _roll_up(per_product, products, translation, measures)
        .where(F.col("reviews") >= min_reviews)
        .select(
            "category",
            rounded_ratio(F.col("score_total"), F.col("scored")).alias("avg_review"),
            "reviews",
        )
    )
    return top_k(rated, k, F.desc_nulls_first("avg_review"), F.asc_nulls_last("category"))
