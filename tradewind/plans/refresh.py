"""Full refresh: CSV feed to audited Parquet tables; appends to them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind import operators as ops
from tradewind.model import FOREIGN_KEYS, TABLES, Tables
from tradewind.plans.derived import DERIVED, shaped
from tradewind.sources import (
    Commit,
    Version,
    latest,
    latest_version,
    read_feed,
    rejected_rows,
)

#: Name of the column that deals stored rows out by their key.
KEY_PART = "key_part"
#: Tables that :func:`conform` leaves with one row per key.
FOLDED = ("order_items", "order_payments", "order_reviews")


def conform(name: str, staged: DataFrame, loaded: Tables) -> DataFrame:
    """A staged table with duplicates, and items of unknown products or sellers, removed.

    ``loaded`` holds the tables that come before it in load order.
    """
    if name == "order_items":
        return ops.load_order_items(staged, loaded["products"], loaded["sellers"])
    if name == "order_payments":
        return ops.load_payments(staged)
    if name == "order_reviews":
        return ops.load_reviews(staged)
    return staged


def audit(tables: Tables) -> None:
    """Raise if a primary key repeats or is incomplete, or a foreign key is unknown."""
    ops.require_unique_keys(tables)
    ops.require_foreign_keys(tables)


def key_part(name: str) -> Column:
    """The partition that a row of table ``name`` is stored in: a hash of its key, or of the part
    of it that the model names. The latter are numbered from ``key_parts`` on: lower numbers are
    parts by the whole key, as such tables were stored in before."""
    table = TABLES[name]
    number = F.pmod(F.xxhash64(*(table.part_by or table.key)), F.lit(table.key_parts))
    if table.part_by:
        number += table.key_parts
    return number.cast("int").alias(KEY_PART)


def store_table(commit: Commit, name: str, df: DataFrame) -> DataFrame:
    """Write rows of a table of the model in the layout that the model gives it."""
    table = TABLES[name]
    if not table.key_parts:
        return commit.write(name, df, table.key, sort_by=table.sort_by)
    dealt = df.select(*df.columns, key_part(name))
    return commit.write(name, dealt, table.key, KEY_PART, table.sort_by).drop(KEY_PART)


def store_derived(commit: Commit, name: str, tables: Tables) -> DataFrame:
    """Write the rows of a derived table that follow from ``tables``."""
    derived = DERIVED[name]
    return commit.write(
        name, shaped(name, tables), (), derived.partition_by, derived.sort_by
    )


def read_derived(version: Version, name: str) -> DataFrame:
    """A derived table of a version, to be added up by its reader."""
    return version.read(name, DERIVED[name].schema)


def refresh_dataset(
    spark: SparkSession,
    feed_dir: str,
    out_dir: str,
    prefix: str = "",
    suffix: str = "",
    multi_line: Mapping[str, bool | None] | None = None,
    derived: Iterable[str] = (),
    replace: bool = False,
) -> Tables:
    """Load a feed into ``out_dir`` and return the audited tables.

    A version is published last, once the audits hold; ``read_dataset`` sees nothing before that.
    A directory with a version is refused unless ``replace`` is set: the feed then becomes the
    next version, and who reads an earlier one keeps it. ``derived`` names tables of
    :data:`tradewind.plans.derived.DERIVED` to store as well. The audits read what was written,
    not the feed, and count no rows that the writes have counted. ``multi_line`` is that of
    :func:`tradewind.sources.read_feed`.

    Where a load fails on records that don't fit, all such records of the feed are written to
    ``<out_dir>/rejected`` before the error names them.
    """
    if not replace and latest(spark, out_dir):
        raise AnalysisException(message=f"{out_dir} holds a version already; replace is not set")
    commit = Commit(spark, out_dir)
    loaded: Tables = {}
    for name, staged in read_feed(spark, feed_dir, prefix, suffix, multi_line).items():
        try:
            loaded[name] = store_table(commit, name, conform(name, staged, loaded))
        except Exception as error:
            rejects = f"{out_dir}/rejected/commit={commit.id}"
            _refuse_rejected(rejected_rows(spark, feed_dir, prefix, suffix), rejects, error)
            raise
    ops.require_written_keys(loaded, commit.metrics, FOLDED)
    ops.require_foreign_keys(loaded)
    for name in derived:
        store_derived(commit, name, loaded)
    commit.publish()
    return loaded


def _refuse_rejected(rejected: DataFrame, path: str, cause: Exception, named: int = 20) -> None:
    """Write rejected records, if any, and raise an error that names the first of them."""
    spark = rejected.sparkSession
    try:
        rejected.write.parquet(path)
    except Exception as error:  # the feed can't be told into records
        cause.add_note(f"its rejected records could not be listed: {error}")
        return
    found = spark.read.parquet(path)
    if n := found.count():
        first = found.orderBy("table_name", "file", "line").limit(named).collect()
        places = "; ".join(f"{r.table_name}, line {r.line} ({r.reason})" for r in first)
        raise ops.DataQualityError(f"{n} rejected records, listed in {path}: {places}") from cause


def append_new(batch: DataFrame, table: str, directory: str) -> Version:
    """Append the rows of ``batch`` whose key the stored table does not hold yet, and return the
    version that then holds them.

    Of tables stored by parts of their key, only the parts that keys of the batch fall into are
    read. Derived tables that the dataset holds are carried on. Everything is written once, unseen,
    and published together at the end: an append that fails, or raises as a new row's key is
    incomplete or refers to nothing stored, changes nothing. Nor does appending a batch twice.
    """
    spark = batch.sparkSession
    base = latest_version(spark, directory)
    model = TABLES[table]
    batch = batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in model.schema.fields])
    parts = None
    if model.key_parts:  # at most that many values
        numbers = [r[0] for r in batch.select(key_part(table)).distinct().collect()]
        if model.part_by:
            numbers += range(model.key_parts)
        parts = [f"{KEY_PART}={n}" for n in numbers]
    stored = base.read(table, model.schema, parts)
    commit = Commit(spark, directory, base)
    new = store_table(commit, table, ops.insert_if_absent(batch, stored, model.key))
    observed = commit.metrics[table]
    if not observed["rows"]:
        return base
    parents = {link.parent for link in FOREIGN_KEYS if link.child == table}
    known = {name: base.read(name, TABLES[name].schema) for name in parents}
    ops.require_appendable(new, table, known, observed["null_keys"])
    if table == "order_items":
        kept = base.tables & set(DERIVED)
        read = {n: base.read(n, TABLES[n].schema) for n in ("orders", "customers") if kept}
        for name in sorted(kept):
            store_derived(commit, name, read | {"order_items": new})
    return commit.publish()
