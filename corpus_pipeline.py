"""Cleans a corpus in stages, each writing the documents that the next one reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm import pieces
from tradewind.llm.batches import unused
from tradewind.llm.decontaminate import flagged
from tradewind.llm.line_dedup import line_dedup
from tradewind.llm.quality import is_kept
from tradewind.llm.simhash import simhash_components
from tradewind.scratch import written

#: ``documents``' columns, and those that the operators add and a stage takes off again.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and all columns as one, so that no operator's column meets another."""
    return docs.select("doc_id", "text", F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"))


def _unpacked(packed: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    return packed.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged.

    Each row is judged by its own text: repeated rows alike, a null or empty text goes as too short.
    Nulls in other columns and further columns stay; an empty table gives an empty one.
    """
    return docs.where(is_kept(F.col("text")))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others keep; ``n_chars``, if there, is that of what is left.

    A document that loses all its lines stays, with an empty text. Rows that repeat a ``doc_id`` are
    one document; a row without one keeps no line for others, but loses those that others keep.
    """
    n_chars = F.length("text").cast("long")
    return _unpacked(line_dedup(_packed(docs)), docs.columns, text=F.col("text"), n_chars=n_chars)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: a row with its smallest ``doc_id``.

    Of repeated rows one stays. Texts without words are one group; a row without a ``doc_id`` stays
    only if no row of its group has one.
    """
    return _unpacked(simhash_components(_packed(docs)).where("is_first"), docs.columns)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item is found; each row is judged by its own text.

    Items of a few words make no leak (``decontaminate.LEAK_WORDS``). Repeated rows stay or go alike,
    null and empty texts hold no item, and without items all stay.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leak = unused(docs, "leak")
    return flagged(docs, items, leak).where(~F.col(leak)).drop(leak)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, with whether they decode to its text again, in place of the text.

    A null or empty text has no ids and is lossless. Repeated rows each get theirs, an empty table
    gives an empty one.
    """
    return pieces.encode(docs).drop("text")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_shared_lines),
    ("simhash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_test_items),
    ("sentencepiece encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        done = stage(spark, docs, sf_dir)
        docs = done if name == STAGES[-1][0] else written(done)
    return docs


#: SQL has neither SimHash nor the piece encoder; tests hold the rows against brute force.
ORACLE_SQL = None
