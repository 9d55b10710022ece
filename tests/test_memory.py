"""What tasks and the driver hold at once does not grow with the tables."""

import numpy as np
from pyspark.sql import functions as F

from shelfscan.operators import cells, index, retrieval
from shelfscan.plans import QUERIES

SMALL = "spark.sql.execution.arrow.maxBytesPerBatch"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def texts(spark, n=40):
    rows = [(str(i), " ".join(f"w{j}" for j in range(i % 7 + 1)) if i else None) for i in range(n)]
    return spark.createDataFrame(rows, "product_id string, searchable_text string")


def test_words_reach_the_scan_as_one_string(spark):
    docs = texts(spark)
    queries = spark.createDataFrame([("q", "W6 w0 none"), ("r", "?")], "query_id string, query string")
    spark.conf.unset(SMALL)
    hits = retrieval.bm25_topk(queries, docs, 50)
    assert SMALL in spark.conf.getAll and "array_join(" in plan(hits)
    assert {r["product_id"] for r in hits.collect()} == {str(i) for i in range(1, 40)}


def test_terms_reach_the_encoder_as_one_string(spark):
    made = index.embed(texts(spark, 3000), dim=16, keep=["searchable_text"])
    assert made.columns == ["product_id", "embedding", "searchable_text"]
    assert "MapInArrow" in plan(made) and "ArrowEvalPython" not in plan(made)
    rows = {r["product_id"]: r["embedding"] for r in made.collect()}
    assert len(rows) == 3000 and not any(rows["0"]) and rows["6"] == rows["2057"] and abs(np.linalg.norm(rows["6"]) - 1) < 1e-6


def test_all_cells_of_a_vector_come_as_flat_columns(spark):
    rng = np.random.default_rng(3)
    rows, centres = rng.normal(size=(50, 8)).astype(np.float32), np.floor(rng.normal(size=(9, 8)) * cells.GRID)
    df = spark.createDataFrame([(str(i), v.tolist(), "x") for i, v in enumerate(rows)], "product_id string, embedding array<float>, note string")
    found = cells.nearest_cells(df, centres, len(centres))
    assert "MapInArrow" in plan(found)
    got = {(r["product_id"], r["cell"]): r["cosine"] for r in found.collect()}
    want = cells.unit(rows.astype(float)) @ cells.unit(centres).T
    assert len(got) == 450 and all(abs(want[int(p), c] - x) < 1e-9 for (p, c), x in got.items())


def test_texts_are_dealt_to_buckets_instead_of_postings(spark, tmp_path):
    stored = index.StoredIndex(spark, str(tmp_path), buckets=4)
    docs = texts(spark).union(spark.createDataFrame([("5", "w0 twice"), (None, "no id"), (None, "no id")], "product_id string, searchable_text string"))
    dealt = stored.table.dealt(docs, 3)
    assert plan(index.postings(dealt)).count("Exchange hashpartitioning") == 1  # the texts'; their postings stay
    places = dealt.select(F.spark_partition_id().alias("p"), stored.table.bucket_of().alias("b")).distinct().collect()
    assert len(places) == len({r["p"] for r in places}) > 4
    key = lambda df: sorted(map(str, df.select("product_id", "dl", "term", "tf").collect()))
    stored.build(docs)
    assert key(stored.postings()) == key(index.postings(docs))
    new = docs.where("product_id <> '3'").union(spark.createDataFrame([("77", "w1 w1 new")], docs.schema))
    stored.refresh(new, spark.createDataFrame([("3", "delete"), ("77", "insert")], "product_id string, change_type string"))
    assert key(stored.postings()) == key(index.postings(new.union(docs.where("product_id is null"))))


def test_strategies_share_lists_and_grades(spark, sf):
    assert "MapInPandas" not in plan(QUERIES["eval_compare"](spark, sf))
