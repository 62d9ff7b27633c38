"""DuckDB SQL giving the expected result of each registered query on the test tables.

Written from the question each query answers: plain joins over whole tables, no folding.
"""

from __future__ import annotations

from tradewind.model import FOREIGN_KEYS, KEY_AUDITED, KEY_TABLES, SOFT_LINKS, TABLES, Link

# The bindings of contract/bindings.py, in SQL.
_SOURCES = {
    "customers": """
        SELECT c_custkey AS customer_id, c_name AS customer_unique_id,
               c_nationkey AS customer_zip_code_prefix, c_mktsegment AS customer_city,
               n_name AS customer_state
        FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "products": """
        SELECT p_partkey AS product_id,
               CASE WHEN p_size = 1 THEN NULL ELSE p_brand END AS product_category_name,
               CAST(length(p_name) AS INTEGER) AS product_name_lenght,
               p_size AS product_weight_g
        FROM part""",
    "sellers": """
        SELECT s_suppkey AS seller_id, s_nationkey AS seller_zip_code_prefix,
               s_name AS seller_city
        FROM supplier""",
    "shop_orders": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status,
               o_orderdate AS order_purchase_timestamp
        FROM orders""",
    "delivered": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS purchased,
               max(l_shipdate) AS received
        FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
        GROUP BY ALL""",
    "order_items": """
        SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
               l_suppkey AS seller_id, l_shipdate AS shipping_limit_date,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
               CAST(l_quantity AS DECIMAL(12,2)) AS freight_value
        FROM lineitem""",
    "order_payments": """
        SELECT user_id AS order_id, event_id AS payment_sequential, event_type AS payment_type,
               CAST(value AS DECIMAL(12,2)) AS payment_value
        FROM events""",
    "staged_payments": """
        SELECT user_id AS order_id, CAST(extract(hour FROM ts) AS INTEGER) AS payment_sequential,
               event_type AS payment_type, CAST(value AS DECIMAL(12,2)) AS payment_value
        FROM events""",
    "order_reviews": """
        SELECT o_orderkey AS review_id, o_orderkey AS order_id,
               CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS review_score,
               o_orderpriority AS review_comment_title, o_orderdate AS review_creation_date
        FROM orders""",
    "staged_reviews": """
        SELECT o_custkey AS review_id, o_orderkey AS order_id,
               CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS review_score,
               o_orderpriority AS review_comment_title, o_orderdate AS review_creation_date
        FROM orders""",
    "product_category_name_translation": """
        SELECT DISTINCT CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN concat('old ', p_brand)
                             ELSE p_brand END AS product_category_name,
               lower(replace(p_brand, '#', '_')) AS product_category_name_english
        FROM part""",
    "geolocation": """
        SELECT CAST(CASE WHEN s_acctbal > 5000 THEN s_nationkey ELSE s_nationkey + 1000 END
                    AS INTEGER) AS geolocation_zip_code_prefix, s_acctbal AS geolocation_lat,
               s_name AS geolocation_city
        FROM supplier""",
    "active_products": "SELECT CASE WHEN p_size <= 40 THEN p_partkey ELSE -1 - p_partkey END AS product_id "
    "FROM part",
    "active_sellers": "SELECT CASE WHEN s_acctbal > 0 THEN s_suppkey ELSE -1 - s_suppkey END AS seller_id "
    "FROM supplier",
}

# `orders` is a test table of its own, so its binding goes by another name in SQL.
_NAMES = {"orders": "shop_orders"}


def _source(table: str) -> str:
    return _NAMES.get(table, table)


def _over(sources: str, body: str) -> str:
    parts = [f"{name} AS ({_SOURCES[name]})" for name in sources.split()]
    return "WITH " + ",\n".join(parts) + "\n" + body


def _whole(value: str, of: str) -> str:
    """value / of to the nearest integer, halves away from zero, in integer arithmetic."""
    a, b = f"CAST({value} AS HUGEINT)", f"NULLIF(CAST({of} AS HUGEINT), 0)"
    return f"sign({a}) * ((2 * abs({a}) + {b}) // (2 * {b}))"


def _two_digits(hundredths: str) -> str:
    return f"CAST(CAST({hundredths} AS DECIMAL(30,0)) * 0.01 AS DECIMAL(38,2))"


def _percent(part: str, whole: str) -> str:
    return _two_digits(_whole(f"10000 * ({part})", whole))


def _mean(total: str, count: str) -> str:
    """Mean of two-digit amounts given their total."""
    return _two_digits(_whole(f"100 * ({total})", count))


_CATEGORY = "COALESCE(product_category_name_english, product_category_name)"
_CATEGORIZED = """
    JOIN products USING (product_id)
    LEFT JOIN product_category_name_translation USING (product_category_name)"""
_CATEGORY_SOURCES = "order_items products product_category_name_translation"


def _reports() -> dict[str, str]:
    def review(min_reviews: int | str) -> str:
        return _over(
            f"order_reviews {_CATEGORY_SOURCES}",
            f"""SELECT {_CATEGORY} AS category,
                {_two_digits(_whole("100 * sum(review_score)", "count(review_score)"))}
                    AS avg_review,
                count(*) AS reviews
            FROM order_reviews JOIN order_items USING (order_id) {_CATEGORIZED}
            GROUP BY 1 HAVING count(*) >= {min_reviews}
            ORDER BY avg_review DESC NULLS FIRST, category NULLS LAST LIMIT 20""",
        )

    def by_month(as_of: str, placed: str = "order_purchase_timestamp") -> str:
        return _over(
            "shop_orders order_items",
            f"""SELECT CAST(date_trunc('month', {placed}) AS DATE) AS month,
                CAST(sum(price + freight_value) AS DECIMAL(38,2)) AS gmv
            FROM shop_orders JOIN order_items USING (order_id)
            WHERE {placed} >= {as_of} - INTERVAL 12 MONTH
            GROUP BY 1 ORDER BY 1""",
        )

    empty = by_month("current_date")
    moved = """order_purchase_timestamp + to_days(CAST(current_date
        - (SELECT CAST(max(order_purchase_timestamp) AS DATE) FROM shop_orders) AS INTEGER))"""

    return {
        "gmv_by_state": _over(
            "customers shop_orders order_items",
            """SELECT customer_state AS state,
                CAST(sum(price + freight_value) AS DECIMAL(38,2)) AS gmv
            FROM order_items JOIN shop_orders USING (order_id) JOIN customers USING (customer_id)
            GROUP BY 1 ORDER BY gmv DESC NULLS FIRST, state NULLS LAST""",
        ),
        "top_categories": _over(
            _CATEGORY_SOURCES,
            f"""SELECT {_CATEGORY} AS category, CAST(sum(price) AS DECIMAL(38,2)) AS revenue,
                count(*) AS items_sold
            FROM order_items {_CATEGORIZED}
            GROUP BY 1 ORDER BY revenue DESC NULLS FIRST, category NULLS LAST LIMIT 15""",
        ),
        "gmv_by_month": by_month("DATE '2001-08-01'"),
        "gmv_by_month_empty": empty,
        "gmv_by_month_stored": by_month("DATE '2001-08-01'"),
        "gmv_by_month_today": by_month("current_date", moved),
        "gmv_by_period_stored": _over(
            "shop_orders order_items",
            """SELECT concat(year(order_purchase_timestamp), 'Q1') AS period,
                CAST(sum(price + freight_value) AS DECIMAL(38,2)) AS gmv
            FROM shop_orders JOIN order_items USING (order_id)
            WHERE month(order_purchase_timestamp) <= 3 GROUP BY 1 ORDER BY 1""",
        ),
        "snk_csv_empty": f"""SELECT 'month,gmv' AS value
            UNION ALL SELECT concat_ws(',', month, gmv) FROM ({empty})""",
        "preview_any_orders": """SELECT least(10, count(*)) AS n_rows, least(10, count(*)) AS n_known
            FROM orders""",
        "gmv_by_month_leap_day": by_month("DATE '1996-02-29'"),
        "aov_by_customer": _over(
            "customers shop_orders order_items",
            f"""SELECT customer_id, customer_city, customer_state, count(*) AS orders_count,
                {_mean("sum(spent)", "count(spent)")} AS avg_order_value
            FROM (SELECT order_id, customer_id, sum(price + freight_value) AS spent
                  FROM shop_orders JOIN order_items USING (order_id) GROUP BY ALL)
            JOIN customers USING (customer_id)
            GROUP BY ALL ORDER BY avg_order_value DESC NULLS FIRST, customer_id LIMIT 20""",
        ),
        "payment_mix": _over(
            "order_payments",
            f"""SELECT payment_type, count(*) AS payment_records,
                CAST(sum(payment_value) AS DECIMAL(38,2)) AS total_paid,
                {_percent("100 * sum(payment_value)",
                          "100 * (SELECT sum(payment_value) FROM order_payments)")}
                    AS pct_of_total
            FROM order_payments GROUP BY 1
            ORDER BY total_paid DESC NULLS FIRST, payment_type NULLS LAST""",
        ),
        "delivery_days_by_state": _over(
            "customers delivered",
            f"""SELECT customer_state,
                {_two_digits(_whole("100 * sum(epoch_us(received) - epoch_us(purchased))",
                                    "count(purchased) * CAST(86400000000 AS HUGEINT)"))}
                    AS avg_delivery_days,
                count(*) AS delivered_orders
            FROM delivered JOIN customers USING (customer_id)
            WHERE received IS NOT NULL GROUP BY 1 ORDER BY 2, 1""",
        ),
        "repeat_rate_by_person": _over(
            "shop_orders customers",
            f"""SELECT {_percent("count(*) FILTER (WHERE n >= 2)", "count(*)")} AS repeat_purchase_rate_pct,
                count(*) FILTER (WHERE n >= 2) AS repeat_customers, count(*) AS total_customers
            FROM (SELECT customer_state, count(*) AS n
                  FROM shop_orders JOIN customers USING (customer_id) GROUP BY 1)""",
        ),
        "repeat_rate": _over(
            "shop_orders",
            f"""SELECT {_percent("count(*) FILTER (WHERE n >= 2)", "count(*)")}
                    AS repeat_purchase_rate_pct,
                count(*) FILTER (WHERE n >= 2) AS repeat_customers,
                count(*) AS total_customers
            FROM (SELECT customer_id, count(*) AS n FROM shop_orders GROUP BY 1)""",
        ),
        "top_sellers": _over(
            "order_items",
            """SELECT seller_id, count(DISTINCT order_id) AS orders,
                CAST(sum(price) AS DECIMAL(38,2)) AS revenue
            FROM order_items GROUP BY 1
            ORDER BY revenue DESC NULLS FIRST, seller_id NULLS LAST LIMIT 20""",
        ),
        "review_by_category": review(50),
        "review_by_category_high_bar": review("(SELECT count(*) // 25 FROM order_items)"),
        "cancel_rate_by_state": _over(
            "customers shop_orders",
            f"""SELECT customer_state,
                count(*) FILTER (WHERE order_status = 'F') AS canceled,
                count(*) AS total_orders,
                {_percent("count(*) FILTER (WHERE order_status = 'F')", "count(*)")}
                    AS canceled_rate_pct
            FROM shop_orders JOIN customers USING (customer_id)
            GROUP BY 1 ORDER BY 4 DESC NULLS LAST, 1""",
        ),
        "price_range_by_category": _price_range(),
        "recent_orders": _over(
            "shop_orders",
            """SELECT * FROM shop_orders WHERE order_status IN ('F', 'O')
            ORDER BY order_purchase_timestamp DESC NULLS FIRST, order_id LIMIT 20""",
        ),
        "payment_stats": _over(
            "order_payments",
            """SELECT payment_type, cnt,
                CAST(concat(mean // CAST(1e18 AS HUGEINT), '.',
                            lpad(CAST(mean % CAST(1e18 AS HUGEINT) AS VARCHAR), 18, '0'))
                     AS DECIMAL(38,18)) AS avg_payment,
                min_payment, max_payment
            FROM (SELECT payment_type, count(*) AS cnt, min(payment_value) AS min_payment,
                         max(payment_value) AS max_payment,
                         (2 * CAST(sum(payment_value) * 100 AS HUGEINT) * CAST(1e16 AS HUGEINT)
                          + count(payment_value)) // (2 * count(payment_value)) AS mean
                  FROM order_payments GROUP BY 1)
            ORDER BY cnt DESC, payment_type""",
        ),
        "order_totals": _over(
            "shop_orders order_items",
            """SELECT order_id, CAST(sum(price + freight_value) AS DECIMAL(38,2)) AS order_total
            FROM shop_orders JOIN order_items USING (order_id)
            GROUP BY 1 ORDER BY 2 DESC NULLS FIRST, 1 LIMIT 20""",
        ),
    }


def _price_range() -> str:
    return _over(
        _CATEGORY_SOURCES,
        f"""SELECT {_CATEGORY} AS category, min(price) AS min_item_price,
            max(price) AS max_item_price
        FROM order_items {_CATEGORIZED} GROUP BY 1 ORDER BY 1 NULLS LAST""",
    )


def _previews() -> dict[str, str]:
    return {
        f"preview_{table}": _over(
            _source(table),
            f"SELECT * FROM {_source(table)} ORDER BY ALL NULLS FIRST LIMIT 10",
        )
        for table in KEY_TABLES
    }


def _link_parts(link: Link) -> tuple[str, str, str]:
    child, parent = _source(link.child), _source(link.parent)
    on = f"p.{link.parent_key} = c.{link.child_key}"
    return f"{child} {parent}", f"{child} c LEFT JOIN {parent} p ON {on}", f"p.{link.parent_key}"


def link_key(link: Link, metric: str) -> str:
    """Registry key of a relation check."""
    short = {"order_items": "items", "order_payments": "payments", "order_reviews": "reviews"}
    kind = "soft" if link in SOFT_LINKS else "ri"
    parent = link.parent_label or link.parent
    return f"{kind}_{short.get(link.child, link.child)}_{parent}_{metric}"


def _relations() -> dict[str, str]:
    found = {}
    for link in FOREIGN_KEYS + SOFT_LINKS:
        sources, joined, parent_key = _link_parts(link)
        found[link_key(link, "missing")] = _over(
            sources,
            f"""SELECT '{link.arrow} missing' AS "check", count(*) AS "count"
            FROM {joined} WHERE {parent_key} IS NULL""",
        )
        if link in FOREIGN_KEYS:
            found[link_key(link, "volume")] = _over(
                sources,
                f"""SELECT '{link.relation}' AS relation, count({parent_key}) AS "count"
                FROM {joined}""",
            )
        else:
            found[link_key(link, "coverage")] = _over(
                sources,
                f"""SELECT '{link.arrow} coverage_pct' AS metric,
                    {_percent(f"count({parent_key})", "count(*)")} AS pct
                FROM {joined}""",
            )
    rows = [
        f"""SELECT '{link.arrow}' AS link,
            count(*) FILTER (WHERE {_link_parts(link)[2]} IS NULL) AS missing,
            count({_link_parts(link)[2]}) AS joined,
            {_percent(f"count({_link_parts(link)[2]})", "count(*)")} AS coverage_pct
        FROM {_link_parts(link)[1]}"""
        for link in FOREIGN_KEYS + SOFT_LINKS
    ]
    found["relations_report"] = _over(
        " ".join(_source(table) for table in TABLES), " UNION ALL ".join(rows)
    )
    return found


def _keys() -> dict[str, str]:
    def audit(table: str) -> str:
        keys = TABLES[table].key
        complete = " AND ".join(f"{key} IS NOT NULL" for key in keys)
        return f"""SELECT '{table}' AS table_name, count(*) AS total_rows,
                count(DISTINCT ({", ".join(keys)})) FILTER (WHERE {complete}) AS distinct_keys,
                count(*) FILTER (WHERE NOT ({complete})) AS null_keys
            FROM {_source(table)}"""

    named = {f"pk_{table}": table for table in KEY_AUDITED} | {
        "pk_composite_items": "order_items",
        "pk_composite_payments": "order_payments",
        "pk_reviews": "order_reviews",
        "pk_translation": "product_category_name_translation",
    }
    found = {key: _over(_source(table), audit(table)) for key, table in named.items()}
    found["key_report"] = _over(
        " ".join(_source(table) for table in named.values()),
        " UNION ALL ".join(audit(table) for table in named.values()),
    )
    found["duplicate_item_keys"] = _over(
        "order_items",
        """SELECT order_id, order_item_id, count(*) AS copies FROM order_items
        GROUP BY ALL HAVING count(*) > 1""",
    )
    rows = []
    for link in FOREIGN_KEYS:
        parent = {"products": "active_products", "sellers": "active_sellers"}.get(
            link.parent, _source(link.parent)
        )
        rows.append(
            f"""SELECT '{link.relation}' AS relation, count(*) AS violations
            FROM {_source(link.child)} c
            WHERE {link.child_key} IS NOT NULL AND NOT EXISTS (
                SELECT 1 FROM {parent} p WHERE p.{link.parent_key} = c.{link.child_key})"""
        )
    found["fk_violations"] = _over(
        "customers shop_orders order_items order_payments order_reviews"
        " active_products active_sellers",
        " UNION ALL ".join(rows),
    )
    return found


def _first_per_key(source: str, keys: str, rest: str) -> str:
    order = ", ".join(f"{name.strip()} ASC NULLS FIRST" for name in rest.split(","))
    return f"""SELECT {keys}, {rest} FROM {source}
        QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1"""


_ITEM_KEY, _ITEM_REST = (
    "order_id, order_item_id",
    "product_id, seller_id, shipping_limit_date, price, freight_value",
)
_PAYMENT_KEY, _PAYMENT_REST = "order_id, payment_sequential", "payment_type, payment_value"
_REVIEW_REST = "order_id, review_score, review_comment_title, review_creation_date"
_KNOWN_ITEMS = """(SELECT * FROM order_items
    WHERE product_id IN (SELECT product_id FROM active_products)
      AND seller_id IN (SELECT seller_id FROM active_sellers))"""


_CLICKS = "(SELECT * FROM staged_payments WHERE payment_type = 'click')"
_NOT_CLICKED = f"""(SELECT * FROM staged_payments b WHERE NOT EXISTS (
    SELECT 1 FROM {_CLICKS} t
    WHERE t.order_id = b.order_id AND t.payment_sequential = b.payment_sequential))"""


def _loading() -> dict[str, str]:
    return {
        "load_order_items": _over(
            "order_items active_products active_sellers",
            _first_per_key(_KNOWN_ITEMS, _ITEM_KEY, _ITEM_REST),
        ),
        "load_payments": _over(
            "staged_payments", _first_per_key("staged_payments", _PAYMENT_KEY, _PAYMENT_REST)
        ),
        "load_reviews": _over(
            "staged_reviews", _first_per_key("staged_reviews", "review_id", _REVIEW_REST)
        ),
        "insert_if_absent": _over(
            "staged_payments",
            _first_per_key(
                """(SELECT * FROM staged_payments b WHERE NOT EXISTS (
                    SELECT 1 FROM staged_payments t
                    WHERE CASE WHEN t.payment_type = 'click' THEN t.order_id
                               ELSE -1 - t.order_id END = b.order_id AND t.payment_sequential = b.payment_sequential))""",
                _PAYMENT_KEY,
                _PAYMENT_REST,
            ),
        ),
        "src_csv_load": _over(
            "order_items",
            """SELECT CAST(order_id AS VARCHAR) AS order_id, order_item_id,
                CAST(product_id AS VARCHAR) AS product_id, CAST(seller_id AS VARCHAR) AS seller_id,
                shipping_limit_date, price, freight_value
            FROM order_items""",
        ),
        "snk_csv_roundtrip": _price_range(),
        "src_csv_spanning": """SELECT CAST(doc_id AS VARCHAR) AS review_id,
                lang AS review_comment_title, length(message) AS n_chars,
                sha256(message) AS message_sha256
            FROM (SELECT *, ' ' || chr(9) || '"' || text || '",' || chr(13) || chr(10) || '""'
                            || chr(10) || ' ' AS message FROM documents)""",
        "src_rejected_rows": _over(
            "order_items",
            """SELECT 'order_items' AS table_name, 'does not fit the schema' AS reason,
                CAST(product_id AS VARCHAR) AS product_id, count(*) AS rejected
            FROM order_items WHERE product_id % 10 = 7 GROUP BY ALL""",
        ),
        "src_feed_inventory": _over(
            " ".join(_source(table) for table in TABLES),
            " UNION ALL ".join(
                f"SELECT '{table}' AS table_name, false AS present, NULL::BIGINT AS records"
                if table in ("sellers", "geolocation")
                else f"SELECT '{table}', true, count(*) FROM {_source(table)}"
                for table in sorted(TABLES, key=lambda t: t not in ("sellers", "geolocation"))
            ),
        ),
        "append_payments": _over(
            "staged_payments",
            " UNION ALL ".join(
                f"""SELECT * REPLACE (CAST(order_id AS VARCHAR) AS order_id)
                FROM ({_first_per_key(source, _PAYMENT_KEY, _PAYMENT_REST)})"""
                for source in (_CLICKS, _NOT_CLICKED)
            ),
        ),
        "gmv_by_state_appended": _refreshed_gmv(),
        "full_refresh_gmv": _refreshed_gmv(),
    }


def _refreshed_gmv() -> str:
    return _over(
            "customers shop_orders order_items products sellers",
            f"""SELECT customer_state AS state,
                CAST(sum(price + freight_value) AS DECIMAL(38,2)) AS gmv
            FROM ({_first_per_key(
                '''(SELECT * REPLACE (CAST(product_id AS VARCHAR) AS product_id,
                                      CAST(seller_id AS VARCHAR) AS seller_id)
                    FROM order_items)''', _ITEM_KEY, _ITEM_REST)})
            JOIN shop_orders USING (order_id) JOIN customers USING (customer_id)
            GROUP BY 1 ORDER BY gmv DESC, state""",
    )


_ROWS, _NON_NULL = "count(*) AS row_count", "count({}) AS non_null_count"


def _listing(*counts: str) -> str:
    # The columns and types that the bindings produce, in order.
    listing = {
        "customers": "customer_id bigint, customer_unique_id string, "
        "customer_zip_code_prefix int, customer_city string, customer_state string",
        "products": "product_id bigint, product_category_name string, "
        "product_name_lenght int, product_weight_g int",
        "sellers": "seller_id bigint, seller_zip_code_prefix int, seller_city string",
        "orders": "order_id bigint, customer_id bigint, order_status string, "
        "order_purchase_timestamp timestamp_ntz",
        "order_items": "order_id bigint, order_item_id int, product_id bigint, "
        "seller_id bigint, shipping_limit_date timestamp_ntz, price decimal(12;2), "
        "freight_value decimal(12;2)",
        "order_payments": "order_id bigint, payment_sequential bigint, payment_type string, "
        "payment_value decimal(12;2)",
        "order_reviews": "review_id bigint, order_id bigint, review_score int, "
        "review_comment_title string, review_creation_date timestamp_ntz",
        "product_category_name_translation": "product_category_name string, "
        "product_category_name_english string",
        "geolocation": "geolocation_zip_code_prefix int, geolocation_lat double, "
        "geolocation_city string",
    }
    rows = [
        f"""SELECT '{table}' AS table_name, {position} AS ordinal_position,
            '{column.split()[0]}' AS column_name,
            '{column.split()[1].replace(";", ",")}' AS data_type"""
        + "".join(f", {count.format(column.split()[0])}" for count in counts)
        + f" FROM {_source(table)}"
        for table, columns in listing.items()
        for position, column in enumerate(columns.split(", "), start=1)
    ]
    return _over(" ".join(_source(t) for t in listing), "\nUNION ALL ".join(rows))


def oracle_sql() -> dict[str, str]:
    return {
        **_reports(),
        **_previews(),
        **_relations(),
        **_keys(),
        **_loading(),
        "schema_overview": _listing(_ROWS),
        "column_profile": _listing(_NON_NULL),
        "catalog_overview": _listing(_ROWS, _NON_NULL),
        "top_sellers_rollup": _reports()["top_sellers"],
    }
