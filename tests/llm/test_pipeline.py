"""The pipeline's stages against plain versions, and the registered queries against SQL."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as registered
import corpus_pipeline
from tests.llm.tables import messy
from tests.llm.test_filters import plain_components, plain_fingerprint
from tradewind.llm import oracle, pieces
from tradewind.llm.decontaminate import words_of

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "conversations")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_sql(spark, sql, name):
    found = registered.queries()[name](spark, SF)
    columns = sorted(found.columns)
    relation = sql.sql(f"SELECT {', '.join(columns)} FROM ({oracle.oracle_sql()[name]})")
    assert sorted(relation.columns) == columns
    rows = sorted(map(str, (tuple(r) for r in found.select(columns).collect())))
    assert rows == sorted(map(str, relation.fetchall()))


def test_pipeline(spark, sql):
    """Each operator has a brute-force test of its own; here the stages' rows are worked out anew."""
    q10, q1 = oracle.OP10, oracle.OP1
    sql.sql(f"CREATE TEMP TABLE good AS SELECT d.* FROM documents d JOIN ({q10}) USING (doc_id) WHERE kept")
    lines = q1.replace("FROM documents", "FROM good").replace("sha256(coalesce(", "(coalesce(")
    kept = dict(sql.sql(f"SELECT doc_id, kept_sha256 FROM ({lines})").fetchall())
    roots = plain_components({d: plain_fingerprint(t) for d, t in kept.items()}, 4)
    items = [b" " + b" ".join(words_of(t)) + b" " for (t,) in sql.sql("SELECT text FROM benchmark").fetchall()]
    model = pieces.load(pieces.default_path())
    wanted = {}
    for d, text in kept.items():
        own = b" " + b" ".join(words_of(text)) + b" "
        if roots[d] == d and not any(i in own for i in items):
            wanted[d] = (len(text), model.encode(text), True)
    found = corpus_pipeline.run(spark, SF)
    rows = {r["doc_id"]: (r["n_chars"], r["ids"], r["lossless"]) for r in found.collect()}
    assert rows == wanted


def test_stages_take_messy_documents(spark):
    docs = messy(spark, "kept", "_leak", "ids")
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert done.columns == docs.columns
        assert done.count() <= docs.count()
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_decontamination_judges_rows_not_keys(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").first()["text"]
    texts = [(None, item), (None, "clean"), (None, None), (1, f"x {item}"), (1, "clean too"), (2, "other")]
    schema = "doc_id long, text string, leak string"
    docs = spark.createDataFrame([(d, t, "own") for d, t in texts], schema)
    kept = corpus_pipeline.without_test_items(spark, docs, SF)
    assert kept.columns == docs.columns
    assert [tuple(r) for r in kept.collect()] == [(d, t, "own") for d, t in texts if item not in (t or "")]
