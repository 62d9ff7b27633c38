"""Running counts and sums along a key's rows, whatever share of all rows a key has.

A window would put a key's rows in one task. Here rows are dealt out by ranges of key and order,
each part is scanned on its own, and what the parts before it add to the key that a part begins
with is put in afterwards: a prefix scan over parts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.scratch import written


def _changes(keys: list[pa.Array], last: tuple | None) -> tuple[np.ndarray, tuple]:
    """Where rows begin a new key, and the last row's key. Keys aren't null."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    for key in keys:
        if n > 1:
            new[1:] |= pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    new[0] = last is None or last != tuple(k[0].as_py() for k in keys)
    return new, tuple(k[-1].as_py() for k in keys)


def _within(values: np.ndarray, new: np.ndarray, carried: np.uint64) -> np.ndarray:
    """Sums of ``values`` (modulo 2**64) from each key's first row on; ``carried`` comes before."""
    total = np.cumsum(values, dtype=np.uint64)
    starts = np.flatnonzero(new)
    before = np.concatenate([[np.uint64(0) - carried], total[starts] - values[starts]])
    return total - before[np.cumsum(new)]


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Sequence[str] = ()
) -> DataFrame:
    """``df``, written, with ``idx``, each row's number from 0 within its key, and with the sums
    of the 64-bit columns ``sums`` up to and with the row (modulo 2**64) in their place.

    Rows of a key are numbered in ascending ``order``, nulls first; rows that tie there are
    numbered in any order. ``keys`` and ``sums`` aren't null. ``df`` must not have the columns
    ``idx``, ``part``, ``only_run`` and ``is_last``.
    """
    spark = df.sparkSession
    summed = ["idx", *sums]
    schema = T.StructType(list(df.schema.fields))
    schema = schema.add("idx", "long").add("part", "integer").add("only_run", "boolean")
    schema = schema.add("is_last", "boolean")

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, runs, held = None, 0, None
        carry = dict.fromkeys(summed, np.uint64(0))
        for batch in batches:
            if not (n := batch.num_rows):
                continue
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            new, last = _changes([columns[k] for k in keys], last)
            runs += int(new.sum())
            columns["idx"] = pa.array(np.ones(n, np.int64))
            for name in summed:
                total = _within(columns[name].to_numpy().view(np.uint64), new, carry[name])
                carry[name] = total[-1]
                columns[name] = pa.array((total - np.uint64(name == "idx")).view(np.int64))
            columns["part"] = pa.array(np.full(n, part, np.int32))
            columns["only_run"] = pa.array(np.full(n, runs == 1))
            columns["is_last"] = pa.array(np.zeros(n, bool))
            if held is not None:
                yield held
            held = pa.RecordBatch.from_pydict(columns)
        if held is not None:
            end = np.arange(held.num_rows) == held.num_rows - 1
            place = held.schema.names.index("is_last")
            yield held.set_column(place, "is_last", pa.array(end))

    by = [F.asc_nulls_first(c) for c in (*keys, *order)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    done = written(dealt.mapInArrow(scan, schema))

    # One row a part reaches the driver, whatever the size of the table.
    ends = done.where("is_last").select("part", *keys, "only_run", *summed).collect()
    carried: dict[int, tuple[tuple, list[int]]] = {}
    before: tuple[tuple, list[int]] | None = None
    for end in sorted(ends, key=lambda r: r.part):
        key, total = tuple(end[k] for k in keys), [end[n] + (n == "idx") for n in summed]
        if before:
            carried[end.part] = before
            if end.only_run and before[0] == key:
                total = [a + b for a, b in zip(before[1], total, strict=True)]
        before = (key, [n % 2**64 for n in total])
    return _with_carried(done, keys, summed, carried).drop("part", "only_run", "is_last")


def _with_carried(
    done: DataFrame, keys: Sequence[str], summed: Sequence[str], carried: dict[int, tuple]
) -> DataFrame:
    """Adds to each part's rows of the key that the part before it ended with what that key had
    come to by then."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            of = columns["part"].to_numpy()
            for part in np.unique(of):
                if int(part) not in carried:
                    continue
                key, total = carried[int(part)]
                rows = of == part
                for name, value in zip(keys, key, strict=True):
                    rows = rows & pc.equal(columns[name], value).to_numpy(zero_copy_only=False)
                if not rows.any():
                    continue
                for name, value in zip(summed, total, strict=True):
                    sums = columns[name].to_numpy().view(np.uint64)
                    sums = np.where(rows, sums + np.uint64(value), sums)
                    columns[name] = pa.array(sums.view(np.int64))
            yield pa.RecordBatch.from_pydict(columns)

    return done.mapInArrow(add, done.schema)
