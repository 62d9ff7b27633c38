"""How rows of one table find their parent in another: missing, joined and covered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions import percent
from tradewind.model import FOREIGN_KEYS, SOFT_LINKS, Link, Tables


def link_counts(tables: Tables, link: Link) -> DataFrame:
    """One row of counts for the outer join of ``link.child`` to ``link.parent``.

    ``missing`` child rows have no parent (a NULL key has none), ``joined`` is the size of the
    inner join and ``outer_rows`` that of the left join. Both tables are folded to key and count
    first: the counts follow from those without building the join, and neither a frequent
    child key nor a parent with many rows per key reaches a single task.
    """
    children = (
        tables[link.child]
        .groupBy(F.col(link.child_key).alias("key"))
        .agg(F.count("*").alias("n_child"))
    )
    parents = (
        tables[link.parent]
        .groupBy(F.col(link.parent_key).alias("key"))
        .agg(F.count("*").alias("n_parent"))
    )
    # A join nobody builds may have more rows than a 64-bit integer counts.
    wide = "CAST(n_child AS DECIMAL(19,0))"
    counts = children.join(parents, "key", "left").agg(
        F.expr("sum(n_child) FILTER (WHERE n_parent IS NULL)").alias("missing"),
        F.expr(f"sum({wide} * n_parent)").alias("joined"),
        F.expr(f"sum({wide} * coalesce(n_parent, 1))").alias("outer_rows"),
    )
    return counts.na.fill(0)


def link_missing(tables: Tables, link: Link) -> DataFrame:
    """Child rows without a parent."""
    return link_counts(tables, link).select(
        F.lit(f"{link.arrow} missing").alias("check"), F.col("missing").alias("count")
    )


def link_volume(tables: Tables, link: Link) -> DataFrame:
    """Size of the inner join of child and parent."""
    return link_counts(tables, link).select(
        F.lit(link.relation).alias("relation"), F.col("joined").cast("bigint").alias("count")
    )


def link_coverage(tables: Tables, link: Link) -> DataFrame:
    """Share of left-join rows that found a parent.

    Weighted by parent rows: a child matching three parent rows counts three times.
    """
    return link_counts(tables, link).select(
        F.lit(f"{link.arrow} coverage_pct").alias("metric"),
        percent(F.col("joined"), F.col("outer_rows")).alias("pct"),
    )


def relations_report(tables: Tables) -> DataFrame:
    """Every link with its missing rows, join size and coverage."""
    counts = None
    for link in FOREIGN_KEYS + SOFT_LINKS:
        row = link_counts(tables, link).withColumn("link", F.lit(link.arrow))
        counts = row if counts is None else counts.unionByName(row)
    coverage = percent(F.col("joined"), F.col("outer_rows"))
    joined = F.col("joined").cast("bigint").alias("joined")
    return counts.select("link", "missing", joined, coverage.alias("coverage_pct"))
