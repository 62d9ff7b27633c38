"""The operators, each a function from DataFrames to a lazy DataFrame."""

from tradewind.operators.categories import (
    price_range_by_category,
    review_by_category,
    top_categories,
)
from tradewind.operators.customers import (
    cancel_rate_by_state,
    delivery_days_by_state,
    repeat_rate,
)
from tradewind.operators.keys import (
    DataQualityError,
    duplicate_keys,
    fk_violations,
    key_audit,
    key_report,
    require_appendable,
    require_foreign_keys,
    require_unique_keys,
    require_written_keys,
)
from tradewind.operators.links import (
    link_counts,
    link_coverage,
    link_missing,
    link_volume,
    relations_report,
)
from tradewind.operators.loading import (
    first_per_key,
    insert_if_absent,
    keep_known,
    load_order_items,
    load_payments,
    load_reviews,
)
from tradewind.operators.overview import (
    column_profile,
    list_tables,
    preview,
    schema_overview,
    table_overview,
)
from tradewind.operators.payments import payment_mix, payment_stats
from tradewind.operators.sales import (
    aov_by_customer,
    gmv_by_month,
    gmv_by_month_stored,
    gmv_by_period,
    gmv_by_state,
    gmv_by_state_from,
    items_per_order,
    order_totals,
    recent_orders,
    top_sellers,
    totals_by_state,
    values_by_month,
)
from tradewind.operators.sellers import (
    placed_orders,
    seller_months,
    seller_totals,
    top_sellers_from,
)

__all__ = [
    "DataQualityError",
    "aov_by_customer",
    "cancel_rate_by_state",
    "delivery_days_by_state",
    "duplicate_keys",
    "first_per_key",
    "fk_violations",
    "gmv_by_month",
    "gmv_by_month_stored",
    "gmv_by_period",
    "gmv_by_state",
    "gmv_by_state_from",
    "insert_if_absent",
    "items_per_order",
    "keep_known",
    "key_audit",
    "key_report",
    "link_counts",
    "link_coverage",
    "link_missing",
    "link_volume",
    "list_tables",
    "load_order_items",
    "load_payments",
    "load_reviews",
    "order_totals",
    "payment_mix",
    "payment_stats",
    "placed_orders",
    "preview",
    "price_range_by_category",
    "recent_orders",
    "relations_report",
    "repeat_rate",
    "require_appendable",
    "require_foreign_keys",
    "require_unique_keys",
    "require_written_keys",
    "review_by_category",
    "column_profile",
    "schema_overview",
    "seller_months",
    "seller_totals",
    "table_overview",
    "top_categories",
    "top_sellers",
    "top_sellers_from",
    "totals_by_state",
    "values_by_month",
]
