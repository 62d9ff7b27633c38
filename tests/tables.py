"""Small literal tables in the canonical schema."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from tradewind.model import TABLES


def table(spark, name, *rows):
    """Rows given as dicts; absent columns are NULL, numbers given as text become decimals."""
    schema = TABLES[name].schema
    values = []
    for row in rows:
        unknown = set(row) - set(schema.names)
        assert not unknown, unknown
        values.append(
            tuple(
                Decimal(row[f.name])
                if f.dataType.typeName() == "decimal" and row.get(f.name) is not None
                else row.get(f.name)
                for f in schema.fields
            )
        )
    return spark.createDataFrame(values, schema)


def item(order, price, freight="0.00", number=1, product="p", seller="s"):
    return {
        "order_id": order,
        "order_item_id": number,
        "product_id": product,
        "seller_id": seller,
        "price": price,
        "freight_value": freight,
    }


def at(text):
    return dt.datetime.fromisoformat(text)


def rows(df):
    return [tuple(row) for row in df.collect()]
