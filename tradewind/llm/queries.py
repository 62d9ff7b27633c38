"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm import pieces, warc
from tradewind.llm.conversations import conversation_trie
from tradewind.llm.decontaminate import contaminated
from tradewind.llm.divergence import divergence
from tradewind.llm.license_scan import license_scan
from tradewind.llm.line_dedup import line_dedup
from tradewind.llm.main_text import extract
from tradewind.llm.pairwise import pairwise_quality
from tradewind.llm.quality import quality
from tradewind.llm.secret_scan import secret_scan
from tradewind.llm.simhash import simhash_components
from tradewind.llm.token_counts import token_counts

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages", "page_id", "url", "html")
    found = warc.read_pages(warc.archive(spark, pages), pages)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages", "page_id", "url", "html")).drop("html")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents", "doc_id", "text")).drop("text", "notices")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(_table(spark, sf_dir, "documents", "doc_id", "text")).drop("text", "secrets")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    found = simhash_components(docs, keep_text=False)
    return found.select("doc_id", "fingerprint", "component_id")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return contaminated(docs, _table(spark, sf_dir, "benchmark", "item_id", "text"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return quality(docs).drop("text")


def op11_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    labels = _table(spark, sf_dir, "labels", "doc_id", "quality")
    return pairwise_quality(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(_table(spark, sf_dir, "documents", "text", "lang", "source"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return conversation_trie(turns)


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_warc": op2_warc,
        "op3_main_text": op3_main_text,
        "op4_token_counts": op4_token_counts,
        "op5_license_scan": op5_license_scan,
        "op6_secret_scan": op6_secret_scan,
        "op7_simhash": op7_simhash,
        "op8_decontaminate": op8_decontaminate,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_quality_rules": op10_quality_rules,
        "op11_pairwise_quality": op11_pairwise_quality,
        "op12_divergence": op12_divergence,
        "op13_conversation_trie": op13_conversation_trie,
    }
