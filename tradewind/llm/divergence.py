"""How the sources of a language differ in their words: pairs of sources, and telling terms.

Terms of a group are taken by cells, a cell being all terms of one count in the group and one in
the language. Values are worked out per cell, cells of equal value are merged and ranked by how
many terms come before them, and only the cells that reach the report are opened into terms.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.scratch import written

#: Documents of a language that hold a term that is kept.
MIN_DOCS = 10
#: Ranks of terms that are reported.
TERM_RANKS = 10
#: What shares are counted in, and what is added to every count.
UNIT, ADDED = 1_000_000_000, 2

#: Different terms that a task counts before it hands them on.
HELD_TERMS = 500_000
#: Bytes of text that are listed at a time.
CHUNK_BYTES = 1_000_000
#: Counts that a task compares at a time.
GRID = 1 << 22

#: ASCII letters, A-Z as a-z, and all bytes beyond ASCII belong to terms.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def _terms(text: bytes, size: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, listed in chunks of about ``size`` bytes."""
    text = text.translate(_TERM_BYTES)
    start = 0
    while start < len(text):
        end = text.find(b" ", start + size)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each group's terms, added up as far as memory allows."""
    counts: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in counts.items():
            terms = list(found)
            held = docs[lang, source]
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(terms), pa.string()),
                "source": pa.array([source] * len(terms), pa.string()),
                "term": pa.array(terms, pa.binary()).cast(pa.string()),
                "n": pa.array(list(found.values()), pa.int64()),
                "docs": pa.array([held[t] for t in terms], pa.int64()),
            })
        counts.clear()
        docs.clear()

    n_held = 0
    for batch in batches:
        lang, source, texts = batch.columns
        texts = texts.cast(pa.binary())
        for group, text in zip(zip(lang.to_pylist(), source.to_pylist()), texts, strict=True):
            found, before = counts[group], len(counts[group])
            seen: set[bytes] = set()
            for terms in _terms(text.as_py()):
                found.update(terms)
                seen.update(terms)
            docs[group].update(seen)
            n_held += len(found) - before
            if n_held >= HELD_TERMS:
                yield from flushed()
                n_held = 0
    yield from flushed()


def _share(n: Column, total: Column) -> Column:
    """1 + floor(UNIT * (n + ADDED) / total), exact for any counts."""
    return F.expr("1L") + F.call_function(
        "div", F.lit(UNIT).cast("decimal(10,0)") * (n + ADDED).cast("decimal(20,0)"), total.cast("decimal(20,0)")
    )


def _shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """As :func:`_share`, by long division in steps that 64 bits hold."""
    rest, share = n + ADDED, np.zeros_like(n)
    for _ in range(3):
        rest = rest * 1000
        share = share * 1000 + rest // total
        rest = rest % total
    return 1 + share


def _compare(counts: pa.Table, groups: pa.Table) -> pa.Table:
    """Values of each two sources over some terms of a language; ``source < item``."""
    names = groups.column("source").to_pylist()
    order = sorted(range(len(names)), key=lambda i: names[i].encode())
    names = [names[i] for i in order]
    totals = groups.column("total").to_numpy()[order]
    first, second, values = [], [], []
    if counts.num_rows:
        terms = pc.dictionary_encode(counts.column("term").combine_chunks()).indices.to_numpy()
        place = pc.index_in(counts.column("source"), pa.array(names)).to_numpy()
        n = np.zeros((terms.max() + 1, len(names)), np.int64)
        n[terms, place] = counts.column("n").to_numpy()
        p = _shares(n, totals)
        for i in range(len(names) - 1):
            own, others = p[:, i : i + 1], p[:, i + 1 :]
            apart = others - own
            values.append((apart * apart // (others + own)).sum(axis=0))
            first += [names[i]] * (len(names) - 1 - i)
            second += names[i + 1 :]
    lang = groups.column("lang")[0].as_py() if groups.num_rows else ""
    value = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.table({
        "lang": pa.array([lang] * len(first), pa.string()),
        "source": pa.array(first, pa.string()),
        "item": pa.array(second, pa.string()),
        "value": pa.array(value, pa.int64()),
    })


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """The value of every two sources of a language, either way round.

    A language's terms are dealt into buckets so that no task compares more than about ``GRID``
    counts, and each bucket gives one row for two sources.
    """
    spark = kept.sparkSession
    largest = groups.groupBy("lang").agg((F.max("v") * F.count("*")).alias("grid")).agg(F.max("grid"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-(largest.first()[0] or 0) // GRID))
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket")
    dealt = kept.select("lang", bucket, "term", "source", "n").groupBy("lang", "bucket")
    sources = groups.where("v > 0").select(
        "lang", F.expr(f"explode(sequence(0L, {buckets - 1}L)) AS bucket"), "source", "total"
    )
    compared = dealt.cogroup(sources.groupBy("lang", "bucket")).applyInArrow(
        _compare, "lang string, source string, item string, value long"
    )
    summed = compared.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = summed.unionByName(summed.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    every = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return (
        every.where("source <> item")
        .join(both, ["lang", "source", "item"], "left")
        .withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
        .withColumn("rank", F.row_number().over(ranked))
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    )


def _telling_terms(kept: DataFrame, groups: DataFrame, ranks: int) -> DataFrame:
    """The terms that a group has more of than its language, the most apart first."""
    group = ["lang", "source"]
    cells = kept.groupBy(*group, "n", "lang_n").agg(F.count("*").alias("terms"))
    valued = (
        cells.join(groups.select(*group, "total", "lang_total"), group)
        .withColumn("p", _share(F.col("n"), F.col("total")))
        .withColumn("q", _share(F.col("lang_n"), F.col("lang_total")))
        .where("p > q")
        .withColumn("value", F.expr("(p - q) * (p - q) div (p + q)"))
        .select(*group, "n", "lang_n", "value", "terms")
    )
    valued = written(valued)
    # A value has one term at least, so that the first ``ranks`` values hold all terms to report.
    falling = Window.partitionBy(*group).orderBy(F.desc("value"))
    merged = (
        valued.groupBy(*group, "value").agg(F.sum("terms").alias("terms"))
        .withColumn("place", F.row_number().over(falling)).where(F.col("place") <= ranks)
        .withColumn("before", F.sum("terms").over(falling) - F.col("terms"))
        .where(F.col("before") < ranks)
    )
    opened = valued.drop("terms").join(merged.select(*group, "value", "before"), [*group, "value"])
    named = kept.join(opened, [*group, "n", "lang_n"])
    within = Window.partitionBy(*group, "value", "before").orderBy(F.asc("term"))
    return (
        named.select(*group, "value", "before", "term")
        .withColumn("own", F.row_number().over(within))
        .where(F.col("own") <= ranks)
        .withColumn("rank", (F.col("before") + F.col("own")).cast("int"))
        .where(F.col("rank") <= ranks)
        .select(*group, F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    )


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, ranks: int = TERM_RANKS) -> DataFrame:
    """``lang``, ``source``, ``part`` (pair or term), ``item``, ``value``, ``rank``.

    ``docs`` has ``text``, ``lang`` and ``source``; nulls read as empty texts, and each row is a
    document, repeated rows and ids among them. Part ``pair`` ranks the other sources of the
    group's language by how far their shares of the kept terms lie apart, summed over these;
    part ``term`` ranks the terms that the group has a larger share of than its language. Equal
    values follow in the UTF-8 order of the items. A group without terms has its pairs, and an
    empty table gives an empty result. Columns of other names are not looked at.
    """
    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = named.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counts = written(
        counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    terms = terms.where(F.col("docs") >= min_docs).drop("docs")
    kept = written(counts.drop("docs").join(terms, ["lang", "term"]))

    whole = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang")
    langs = whole.agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_n"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = written(
        named.select("lang", "source").distinct()
        .join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
        .select(
            "lang", "source", F.expr("coalesce(v, 0L) AS v"),
            F.expr(f"coalesce(own, 0L) + {ADDED} * coalesce(v, 0L) AS total"),
            F.expr(f"coalesce(lang_n, 0L) + {ADDED} * coalesce(v, 0L) AS lang_total"),
        )
    )
    return _pairs(kept, groups).unionByName(_telling_terms(kept, groups, ranks))
