"""Every query against its oracle on tables with NULLs, orphans, copies and hot keys."""

from __future__ import annotations

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from contract.oracle import oracle_sql
from contract.registry import queries
from tests.tables import at

# Their audits are meant to reject this data.
REJECTING = {"full_refresh_gmv", "append_payments", "gmv_by_state_appended"}


def _maybe(rng, value, share=0.08):
    return None if rng.random() < share else value


def _hot(rng, size):
    """A key that is 0 for a third of the rows; a few lie outside 0..size-1."""
    return 0 if rng.random() < 0.34 else rng.randrange(size + size // 10)


def _tables(seed):
    rng = random.Random(seed)

    def cents(limit):
        return _maybe(rng, rng.randrange(limit) / 100)

    def moment(year):
        return _maybe(
            rng,
            at(f"{year + rng.randrange(3)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}")
            .replace(hour=rng.randrange(24), second=rng.randrange(60)),
        )

    n_customers, n_parts, n_suppliers, n_orders = 40, 60, 25, 150
    items = [
        (
            _maybe(rng, _hot(rng, n_orders)),
            _maybe(rng, _hot(rng, n_parts)),
            _maybe(rng, _hot(rng, n_suppliers)),
            _maybe(rng, rng.randint(1, 3)),
            cents(5000),
            cents(1_000_000),
            moment(1999),
        )
        for _ in range(600)
    ]
    items += rng.sample(items, 150)
    return {
        "nation": pa.table(
            {"n_nationkey": range(6), "n_name": [f"N{i}" for i in range(5)] + [None]},
            pa.schema([("n_nationkey", pa.int32()), ("n_name", pa.string())]),
        ),
        "customer": _arrow(
            "c_custkey long c_name string c_nationkey int c_mktsegment string",
            [
                (i, f"C{i}", _maybe(rng, rng.randrange(7)), _maybe(rng, f"M{i % 3}"))
                for i in range(n_customers)
            ],
        ),
        "supplier": _arrow(
            "s_suppkey long s_name string s_nationkey int s_acctbal double",
            [
                (i, f"S{i}", _maybe(rng, rng.randrange(8)), _maybe(rng, rng.uniform(-900, 9900)))
                for i in range(n_suppliers)
            ],
        ),
        "part": _arrow(
            "p_partkey long p_name string p_brand string p_size int",
            [
                (
                    i,
                    _maybe(rng, f"part {i}"),
                    _maybe(rng, f"Brand#{rng.randint(1, 6)}"),
                    _maybe(rng, rng.randint(1, 50)),
                )
                for i in range(n_parts)
            ],
        ),
        "orders": _arrow(
            "o_orderkey long o_custkey long o_orderstatus string o_orderdate ts "
            "o_orderpriority string",
            [
                (
                    i,
                    _maybe(rng, _hot(rng, n_customers)),
                    _maybe(rng, rng.choice("FOP")),
                    moment(1999),
                    _maybe(rng, f"{rng.randint(1, 5)}-X"),
                )
                for i in range(n_orders)
            ],
        ),
        "lineitem": _arrow(
            "l_orderkey long l_partkey long l_suppkey long l_linenumber int l_quantity double "
            "l_extendedprice double l_shipdate ts",
            items,
        ),
        "events": _arrow(
            "event_id long ts ts user_id long event_type string value double",
            [
                (
                    i,
                    moment(2024),
                    _maybe(rng, _hot(rng, 30)),
                    _maybe(rng, rng.choice(["click", "view", "error"])),
                    cents(10_000),
                )
                for i in range(400)
            ],
        ),
        "documents": _arrow(
            "doc_id long text string lang string",
            [
                (i, _maybe(rng, "".join(rng.choices('ab é,"\n\r\t', k=rng.randrange(30)))), _maybe(rng, "en"))
                for i in range(200)
            ],
        ),
    }


_KINDS = {
    "long": pa.int64(),
    "int": pa.int32(),
    "string": pa.string(),
    "double": pa.float64(),
    "ts": pa.timestamp("us"),
}


def _arrow(columns, rows):
    words = columns.split()
    schema = pa.schema([(n, _KINDS[k]) for n, k in zip(words[::2], words[1::2])])
    return pa.table(dict(zip(schema.names, map(list, zip(*rows)))), schema)


@pytest.fixture(scope="module")
def messy(tmp_path_factory):
    directory = tmp_path_factory.mktemp("messy")
    connection = duckdb.connect()
    for name, table in _tables(seed=7).items():
        pq.write_table(table, directory / f"{name}.parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return str(directory), connection


def _key(row):
    return tuple((value is None, str(value)) for value in row)


@pytest.mark.parametrize("name", sorted(set(queries()) - REJECTING))
def test_matches_oracle(spark, messy, name):
    directory, connection = messy
    result = queries()[name](spark, directory)
    expected = connection.execute(oracle_sql()[name]).fetchall()
    columns = [column[0] for column in connection.description]
    places = [columns.index(column) for column in result.columns]
    expected = [tuple(row[place] for place in places) for row in expected]
    assert sorted(map(tuple, result.collect()), key=_key) == sorted(expected, key=_key)
