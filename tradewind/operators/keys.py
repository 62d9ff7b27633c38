"""Primary and foreign key audits, and the checks that stop a load."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.model import FOREIGN_KEYS, TABLES, Link, Tables


class DataQualityError(RuntimeError):
    """Loaded data breaks a key or a reference."""


def key_audit(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct complete keys and rows with an incomplete key.

    A sound primary key has as many distinct keys as rows and no incomplete one.
    """
    incomplete = F.lit(False)
    for key in keys:
        incomplete = incomplete | F.col(key).isNull()
    return df.agg(
        F.count("*").alias("total_rows"),
        F.countDistinct(*keys).alias("distinct_keys"),
        F.count_if(incomplete).alias("null_keys"),
    ).select(F.lit(table).alias("table_name"), "total_rows", "distinct_keys", "null_keys")


def require_appendable(
    new: DataFrame, table: str, parents: Tables, null_keys: int | None = None
) -> None:
    """Raise if a row of ``new`` has an incomplete key or refers to no row of its parents.

    ``null_keys`` is the number of rows with an incomplete key, where it is known already.
    """
    keys = TABLES[table].key
    incomplete = F.lit(False)
    for key in keys:
        incomplete = incomplete | F.col(key).isNull()
    found = not new.where(incomplete).isEmpty() if null_keys is None else null_keys > 0
    if found:
        raise DataQualityError(f"{table}: a new row has no complete key {keys}")
    for link in FOREIGN_KEYS:
        if link.child == table:
            known = parents[link.parent].select(F.col(link.parent_key).alias(link.child_key))
            if not new.join(known, link.child_key, "left_anti").isEmpty():
                raise DataQualityError(f"{link.arrow}: a new row refers to an unknown key")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys carried by more than one row, with their row count."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def key_report(tables: Tables) -> DataFrame:
    """The key audit of every table that has a primary key."""
    report = None
    for name, df in tables.items():
        if TABLES[name].key:
            row = key_audit(df, name, TABLES[name].key)
            report = row if report is None else report.unionByName(row)
    return report


def _refuse_keys(broken: Iterable[tuple[str, int, int, int]]) -> None:
    if broken:
        raise DataQualityError(
            "; ".join(
                f"{table}: {rows} rows but {keys} distinct keys "
                f"({incomplete} rows with an incomplete key)"
                for table, rows, keys, incomplete in broken
            )
        )


def require_unique_keys(tables: Tables) -> None:
    """Raise unless the primary key of every table is unique and complete."""
    broken = key_report(tables).where(F.col("distinct_keys") != F.col("total_rows")).collect()
    _refuse_keys([tuple(row) for row in broken])


def distinct_keys(tables: Tables) -> dict[str, int]:
    """Distinct complete keys of each table; reads the key columns only."""
    counts = None
    for name, df in tables.items():
        row = df.agg(F.countDistinct(*TABLES[name].key).alias("n")).select(F.lit(name).alias("table_name"), "n")
        counts = row if counts is None else counts.unionByName(row)
    return dict(map(tuple, counts.collect())) if counts is not None else {}


def require_written_keys(
    tables: Tables, metrics: Mapping[str, Mapping[str, int]], folded: Iterable[str] = ()
) -> None:
    """Raise unless the primary key of every written table is unique and complete.

    ``metrics`` holds what each write observed: ``rows`` and ``null_keys``. Tables in ``folded``
    were written with one row per key and are not read again; of others the keys are counted.
    """
    keyed = {name: df for name, df in tables.items() if TABLES[name].key}
    counted = distinct_keys({name: df for name, df in keyed.items() if name not in set(folded)})
    found = []
    for name in keyed:
        rows, incomplete = metrics[name]["rows"], metrics[name]["null_keys"]
        found.append((name, rows, counted.get(name, rows - incomplete), incomplete))
    _refuse_keys([row for row in found if row[1] != row[2]])


def fk_violations(tables: Tables, links: Iterable[Link] = FOREIGN_KEYS) -> DataFrame:
    """Rows per foreign key whose non-NULL key is unknown to the parent.

    Unlike the missing-row counts of the relation checks, a NULL key is accepted here. Child keys
    are counted before the join, so a frequent key is one row by then.
    """
    report = None
    for link in links:
        children = (
            tables[link.child]
            .where(F.col(link.child_key).isNotNull())
            .groupBy(F.col(link.child_key).alias("key"))
            .agg(F.count("*").alias("n"))
        )
        parents = tables[link.parent].select(F.col(link.parent_key).alias("key"))
        row = (
            children.join(parents, "key", "left_anti")
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
            .select(F.lit(link.relation).alias("relation"), "violations")
        )
        report = row if report is None else report.unionByName(row)
    return report


def require_foreign_keys(tables: Tables, links: Iterable[Link] = FOREIGN_KEYS) -> None:
    """Raise if any foreign key has violations."""
    broken = fk_violations(tables, links).where(F.col("violations") > 0).collect()
    if broken:
        raise DataQualityError(
            "; ".join(f"{row.relation}: {row.violations} unknown keys" for row in broken)
        )
