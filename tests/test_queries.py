"""Every registered query against its SQL, and the contract of the entry points."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, close, rows_of


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(entry.oracle_sql()))
def test_matches_sql(spark, sf, con, key):
    df = entry.queries()[key](spark, sf)
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[key])
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert cols == want_cols
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(close(x, y) for x, y in zip(a, b)), (a, b)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "product_id", "score", "retrieval_rank", "rerank_score", "rank"]
    assert df.count() > 0


def test_eval_report_export_equals_the_macro_average(spark, sf):
    exported = {r["metric"]: r["average_value"] for r in entry.queries()["eval_report_export"](spark, sf).collect()}
    direct = entry.queries()["eval_macro"](spark, sf).first().asDict()
    assert exported == {k: v for k, v in direct.items() if k != "num_queries"}


def test_embeddings_are_unit_vectors(spark, sf):
    sizes = entry.queries()["embed_corpus"](spark, sf).selectExpr("product_id", "weight * weight AS w").groupBy("product_id").sum("w").collect()
    assert len(sizes) <= spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(abs(r["sum(w)"] - 1) < 1e-4 for r in sizes)
