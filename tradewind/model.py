"""The relational model: table schemas, primary keys and the links between tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

Tables = dict[str, DataFrame]

_AMOUNT = T.DecimalType(12, 2)
_TS = T.TimestampNTZType()


def _schema(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


@dataclass(frozen=True)
class Table:
    schema: T.StructType
    key: tuple[str, ...] = ()
    from_feed: bool = True  # the file name carries the feed's prefix and suffix
    sort_by: tuple[str, ...] = ()  # order of the rows within each stored file
    spans_lines: bool = False  # holds free text, so that records of a file may span lines
    key_parts: int = 0  # partitions of the stored rows by a hash of the key, for appends
    part_by: tuple[str, ...] = ()  # the columns of the key that are hashed, if not all


@dataclass(frozen=True)
class Link:
    """A reference from a child column to a parent column."""

    child: str
    child_key: str
    parent: str
    parent_key: str
    parent_label: str = ""

    @property
    def arrow(self) -> str:
        return f"{self.child}->{self.parent_label or self.parent}"

    @property
    def relation(self) -> str:
        return f"{self.child}.{self.child_key} -> {self.parent}.{self.parent_key}"


# Of tables that grow by appends; an append of few keys reads few of them.
KEY_PARTS = 32

# Names, types and column order of the source files, read by position. Listed in
# load order: a table follows the tables it refers to. Two columns are spelled "lenght" at source.
TABLES: dict[str, Table] = {
    "customers": Table(
        _schema(
            ("customer_id", T.StringType()),
            ("customer_unique_id", T.StringType()),
            ("customer_zip_code_prefix", T.IntegerType()),
            ("customer_city", T.StringType()),
            ("customer_state", T.StringType()),
        ),
        ("customer_id",),
    ),
    "products": Table(
        _schema(
            ("product_id", T.StringType()),
            ("product_category_name", T.StringType()),
            ("product_name_lenght", T.IntegerType()),
            ("product_description_lenght", T.IntegerType()),
            ("product_photos_qty", T.IntegerType()),
            ("product_weight_g", T.IntegerType()),
            ("product_length_cm", T.IntegerType()),
            ("product_height_cm", T.IntegerType()),
            ("product_width_cm", T.IntegerType()),
        ),
        ("product_id",),
    ),
    "sellers": Table(
        _schema(
            ("seller_id", T.StringType()),
            ("seller_zip_code_prefix", T.IntegerType()),
            ("seller_city", T.StringType()),
            ("seller_state", T.StringType()),
        ),
        ("seller_id",),
    ),
    "orders": Table(
        _schema(
            ("order_id", T.StringType()),
            ("customer_id", T.StringType()),
            ("order_status", T.StringType()),
            ("order_purchase_timestamp", _TS),
            ("order_approved_at", _TS),
            ("order_delivered_carrier_date", _TS),
            ("order_delivered_customer_date", _TS),
            ("order_estimated_delivery_date", _TS),
        ),
        ("order_id",),
        sort_by=("order_purchase_timestamp",),
    ),
    "order_items": Table(
        _schema(
            ("order_id", T.StringType()),
            ("order_item_id", T.IntegerType()),
            ("product_id", T.StringType()),
            ("seller_id", T.StringType()),
            ("shipping_limit_date", _TS),
            ("price", _AMOUNT),
            ("freight_value", _AMOUNT),
        ),
        ("order_id", "order_item_id"),
        key_parts=KEY_PARTS,
        part_by=("order_id",),
    ),
    "order_payments": Table(
        _schema(
            ("order_id", T.StringType()),
            ("payment_sequential", T.IntegerType()),
            ("payment_type", T.StringType()),
            ("payment_installments", T.IntegerType()),
            ("payment_value", _AMOUNT),
        ),
        ("order_id", "payment_sequential"),
        key_parts=KEY_PARTS,
        part_by=("order_id",),
    ),
    "order_reviews": Table(
        _schema(
            ("review_id", T.StringType()),
            ("order_id", T.StringType()),
            ("review_score", T.IntegerType()),
            ("review_comment_title", T.StringType()),
            ("review_comment_message", T.StringType()),
            ("review_creation_date", _TS),
            ("review_answer_timestamp", _TS),
        ),
        ("review_id",),
        spans_lines=True,
        key_parts=KEY_PARTS,
    ),
    "product_category_name_translation": Table(
        _schema(
            ("product_category_name", T.StringType()),
            ("product_category_name_english", T.StringType()),
        ),
        ("product_category_name",),
        from_feed=False,
    ),
    "geolocation": Table(
        _schema(
            ("geolocation_zip_code_prefix", T.IntegerType()),
            ("geolocation_lat", T.DoubleType()),
            ("geolocation_lng", T.DoubleType()),
            ("geolocation_city", T.StringType()),
            ("geolocation_state", T.StringType()),
        ),
    ),
}

# Enforced links: a non-NULL child key must exist in the parent.
FOREIGN_KEYS: tuple[Link, ...] = (
    Link("orders", "customer_id", "customers", "customer_id"),
    Link("order_items", "order_id", "orders", "order_id"),
    Link("order_items", "product_id", "products", "product_id"),
    Link("order_items", "seller_id", "sellers", "seller_id"),
    Link("order_payments", "order_id", "orders", "order_id"),
    Link("order_reviews", "order_id", "orders", "order_id"),
)

# Logical links, measured but never enforced. Geolocation holds many rows per prefix.
SOFT_LINKS: tuple[Link, ...] = (
    Link("customers", "customer_zip_code_prefix", "geolocation", "geolocation_zip_code_prefix"),
    Link("sellers", "seller_zip_code_prefix", "geolocation", "geolocation_zip_code_prefix"),
    Link(
        "products",
        "product_category_name",
        "product_category_name_translation",
        "product_category_name",
        parent_label="translation",
    ),
)

# Tables whose single-column key is compared by count against distinct count after a load.
KEY_AUDITED: tuple[str, ...] = ("customers", "orders", "products", "sellers")

# Tables shown by the preview and column listings.
KEY_TABLES: tuple[str, ...] = (
    "customers",
    "orders",
    "order_items",
    "order_payments",
    "order_reviews",
    "products",
    "sellers",
)

# Fixed values of the standing reports.
RECENT_STATUSES = ("delivered", "shipped", "invoiced")
CANCELED_STATUS = "canceled"
WINDOW_MONTHS = 12
MIN_REVIEWS = 50
TOP_CATEGORIES = 15
TOP_ROWS = 20
PREVIEW_ROWS = 10
