"""Retrieval, fusion, calibration and metrics on small cases and by property."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfscan.operators import evaluate, index, retrieval, search
from shelfscan.sources.fixtures import Tables

HIT = "query_id string, product_id string, rank int, score double"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_dense_blocks_with_copies(spark, monkeypatch):
    """A third of the documents are copies of one vector: ties everywhere."""
    rng = np.random.default_rng(1)
    vecs = [[float(x) for x in rng.standard_normal(8)] for _ in range(200)] + [[1.0] * 8] * 100
    docs = spark.createDataFrame([(str(i), v) for i, v in enumerate(vecs)], "product_id string, embedding array<float>")
    queries = docs.filter(F.col("product_id").cast("int") % 30 == 0).withColumnRenamed("product_id", "query_id")
    a = retrieval.dense_topk(queries, docs, 7)
    monkeypatch.setattr(retrieval, "BLOCK_DOCS", 40)
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 3)
    b = retrieval.dense_topk(queries, docs, 7)
    assert rows(a, *a.columns) == rows(b, *b.columns)
    mat = np.array(vecs, dtype=np.float32).astype(float)
    mat /= np.linalg.norm(mat, axis=1, keepdims=True)
    for q in (0, 210):
        want = sorted(range(300), key=lambda i: (-round(float(mat[q] @ mat[i]), 6), str(i)))[:7]
        got = [r["product_id"] for r in a.filter(F.col("query_id") == str(q)).orderBy("rank").collect()]
        assert got == [str(i) for i in want]


def test_intent_narrows_the_candidates_not_the_answer(spark):
    """30 better matches fail the filter; the list is full all the same."""
    docs = spark.createDataFrame(
        [(f"{i:02d}", "oak table", "oak table " * (3 if i < 30 else 1) + "word " * i, "SRC1" if i >= 30 else "SRC2", "en", "Color: Red", 10.0 if i < 45 else None, 4.0, 1) for i in range(50)],
        "product_id string, product_name string, searchable_text string, category_path string, brand_name string, attribute_summary string, "
        "selling_price double, average_rating double, review_count int",
    )
    vectors = docs.select("product_id", F.expr("array(1.0F, float(product_id) / 10)").alias("embedding"))
    queries = spark.createDataFrame([("q", "oak table")], "query_id string, query string")
    q_vectors = queries.select("query_id", F.expr("array(1.0F, 0.0F)").alias("embedding"))
    intents = spark.createDataFrame(
        [("q", "src1", None, 20.0, {"color": "red"})], "query_id string, category string, brand string, price_max double, filters map<string,string>"
    )
    same = {c: F.lit("oak table") for c in ("original_query", "rewritten_query")}
    out = search.search_batch(queries, docs, 20, 10, intents.withColumns(same), query_vectors=q_vectors, vectors=vectors).collect()
    assert len(out) == 10 and all(int(r["product_id"]) >= 30 for r in out)
    none = intents.withColumn("filters", F.create_map(F.lit("color"), F.lit("blue")))
    assert search.search_batch(queries, docs, 20, 10, none.withColumns(same), query_vectors=q_vectors, vectors=vectors).count() == 0


def test_substring_search_equals_brute_force(spark):
    texts = ["red oak table", "redoak", "Red oak", "a b c d", "xa b cd", "b", "", "oak red", "déjà vu", "ab"]
    needles = ["red oak", "oak", "b", "a b c", "ed oak tab", "vu", "à v", "zz", "d oak t", " oak", "a ", "ab", ""]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "product_id string, searchable_text string")
    queries = spark.createDataFrame([(str(i), n) for i, n in enumerate(needles)], "query_id string, query string")
    want = sorted((str(i), str(j)) for i, n in enumerate(needles) for j, t in enumerate(texts) if n.strip() and n in t)
    assert rows(retrieval.keyword_contains(queries, docs, 100), "query_id", "product_id") == want


def test_large_query_batch_by_term_join(spark, sf):
    t = Tables(spark, sf)
    a = retrieval.bm25_topk(t["v_queries"], t["v_catalog"], 5).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = retrieval.bm25_topk(t["v_queries"], t["v_catalog"], 5).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_texts_are_tokenised_once(spark, sf):
    df = entry.queries()["bm25_topk"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("WindowGroupLimit") >= 2


def test_fusion_positions(spark):
    dense = spark.createDataFrame([("q", "a", 1, 0.9), ("q", "b", 2, 0.8)], HIT)
    words = spark.createDataFrame([("q", "b", 1, 5.0), ("q", "c", 2, 4.0), ("r", "c", 1, 1.0)], HIT)
    out = {(r["query_id"], r["product_id"]): r["score"] for r in search.fuse_ranks(dense, words).collect()}
    assert out == {("q", "a"): 0.7, ("q", "b"): 0.65, ("q", "c"): 0.15, ("r", "c"): 0.3}


def test_flat_scores_calibrate_by_rank(spark):
    hits = spark.createDataFrame([("q", f"p{i}", i, 0.5, "red lamp", "x") for i in range(1, 4)], HIT + ", product_name string, category_path string")
    queries = spark.createDataFrame([("q", "red lamp for the desk")], "query_id string, query string")
    out = [r["match_score"] for r in search.calibrate(hits, queries).orderBy("rank").collect()]
    assert out == sorted(out, reverse=True) and all(0.6 <= s <= 0.98 for s in out)


def test_filters_ignore_missing_price_and_zero_bounds(spark):
    cols = HIT + ", category_path string, brand_name string, selling_price double, average_rating double, attribute_summary string"
    hits = spark.createDataFrame(
        [("q", "a", 1, 1.0, "Home > Beds", "Ikea", None, None, "Color: Red"), ("q", "b", 2, 1.0, "Home > Beds", "IKEA", 600.0, 4.0, "Color: Red"),
         ("q", "c", 3, 1.0, "Home > beds", "ikea", 400.0, 4.0, "Color: Blue")], cols,
    )
    intent = spark.createDataFrame([("q", "BEDS", "ikea", 500.0, {"tint": "RED"})], "query_id string, category string, brand string, price_max double, filters map<string,string>")
    assert rows(search.intent_filter(hits, intent), "product_id") == [("a",)]
    request = spark.createDataFrame([("q", "", None, 0.0, 500.0, 0.0)], "query_id string, category string, brand string, min_price double, max_price double, min_rating double")
    assert rows(search.request_filter(hits, request), "product_id") == [("a",), ("c",)]
    request = spark.createDataFrame([("q", None, None, 100.0, 0.0, 3.0)], request.schema)
    assert rows(search.request_filter(hits, request), "product_id") == [("b",), ("c",)]


def test_intent_of_plain_replies(spark):
    replies = spark.createDataFrame(
        [("1", "q", '```json\n{"rewritten_query": "r", "price_max": 20}\n```'), ("2", "q", "no json"), ("3", "q", "")],
        "query_id string, query string, response string",
    )
    out = {r["query_id"]: (r["rewritten_query"], r["price_max"], r["filters"]) for r in search.parse_intent_json(replies).collect()}
    assert out == {"1": ("r", 20.0, {}), "2": ("q", None, {}), "3": ("q", None, {})}


def test_longest_phrase_wins(spark):
    words = spark.createDataFrame(
        [("category", "table", "Tables"), ("category", "coffee table", "Coffee Tables"), ("brand", "acme", "Acme")], "kind string, phrase string, value string"
    )
    queries = spark.createDataFrame([("1", "Acme coffee  TABLE less than 99.5"), ("2", "acme"), ("3", "")], "query_id string, query string")
    out = {r["query_id"]: r for r in search.query_intent(queries, words).collect()}
    assert (out["1"]["category"], out["1"]["brand"], out["1"]["price_max"]) == ("Coffee Tables", "Acme", 99.5)
    assert out["1"]["rewritten_query"] == "Acme coffee  TABLE less than 99.5"  # nothing is left, so the query stands
    assert out["2"]["brand"] == "Acme" and out["3"]["category"] is None


def test_understanding_broadcasts_no_queries(spark, tmp_path):
    # repeated texts make a small file of many queries, which Spark takes for a small table
    spark.range(20_000).selectExpr("cast(id as string) query_id", "'Acme coffee table in the old hall' query").write.parquet(str(tmp_path / "q"))
    spark.range(5_000).selectExpr("'brand' kind", "if(id = 0, 'acme', md5(cast(id as string))) phrase", "phrase value").write.parquet(str(tmp_path / "d"))
    queries, words = spark.read.parquet(str(tmp_path / "q")), spark.read.parquet(str(tmp_path / "d"))
    found = search.query_intent(queries, words)
    joins = [j for j in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in j]
    assert joins and not any("Broadcast" in j and ("query_id" in j or "BuildLeft" in j) for j in joins)
    assert found.where("brand = 'acme' and rewritten_query = 'coffee table in the old hall'").count() == 20_000


def hits_of(spark, ids):
    return spark.createDataFrame([("q", p, i + 1, 1.0 - i / 10) for i, p in enumerate(ids)], HIT)


def graded(spark, pairs):
    return spark.createDataFrame([("q", p, g) for p, g in pairs], "query_id string, product_id string, label_score double")


def test_precision_and_recall(spark):
    queries = spark.createDataFrame([("q",), ("none",)], "query_id string")
    out = {r["query_id"]: r for r in evaluate.per_query(hits_of(spark, "adefg"), graded(spark, [(p, 1.0) for p in "abc"]), queries).collect()}
    assert out["q"]["precision_5"] == pytest.approx(0.2) and out["q"]["recall_5"] == pytest.approx(1 / 3)
    assert out["q"]["mrr"] == 1.0 and out["q"]["num_retrieved"] == 5
    assert (out["none"]["recall_5"], out["none"]["precision_5"], out["none"]["ndcg_5"]) == (1.0, 0.0, 0.0)


def test_ndcg_exponential(spark):
    queries = spark.createDataFrame([("q",)], "query_id string")
    report = evaluate.per_query(hits_of(spark, "axbz"), graded(spark, [("a", 1.0), ("b", 1.0), ("c", 1.0)]), queries, ks=(4,), gain="exponential")
    assert report.first()["ndcg_4"] == pytest.approx(0.703918, abs=1e-6)


def test_ndcg_graded(spark):
    grades = {"a": 0.75, "b": 1.0, "c": 0.0, "d": 0.75}
    queries = spark.createDataFrame([("q",)], "query_id string")
    got = evaluate.per_query(hits_of(spark, "cab"), graded(spark, grades.items()), queries, ks=(3,)).first()["ndcg_3"]
    dcg = sum(grades[p] / math.log2(i + 2) for i, p in enumerate("cab"))
    ideal = sum(g / math.log2(i + 2) for i, g in enumerate([1.0, 0.75, 0.75]))
    assert got == pytest.approx(dcg / ideal)


def test_keyword_relevance(spark):
    docs = spark.createDataFrame([("a", "USB cable for fast charging"), ("b", "Bluetooth headphones wireless")], "product_id string, searchable_text string")
    suites = spark.createDataFrame([("q", ["cable", "usb"]), ("r", ["tv"])], "query_id string, keywords array<string>")
    out = {r[0]: r[1] for r in evaluate.keyword_relevance(hits_of(spark, "ab"), docs, suites).collect()}
    assert out == {"q": 0.5, "r": 0.0}


def test_metrics_stay_in_range(spark, sf):
    for r in entry.queries()["eval_per_query"](spark, sf).collect():
        assert all(0 <= v <= 1 + 1e-9 for k, v in r.asDict().items() if isinstance(v, float)), r


def test_refresh_equals_rebuild(spark):
    schema = "product_id string, searchable_text string"
    old = spark.createDataFrame([("1", "a b a"), ("2", "c"), ("3", "d e")], schema)
    new = spark.createDataFrame([("1", "a b a"), ("2", "c c"), ("4", "f")], schema)
    changes = index.snapshot_diff(old, new, "product_id")
    assert rows(changes, "product_id", "change_type") == [("2", "update"), ("3", "delete"), ("4", "insert")]
    cols = ("product_id", "dl", "term", "tf")
    assert rows(index.refresh_postings(index.postings(old), new, changes), *cols) == rows(index.postings(new), *cols)


def test_null_payload_is_a_change(spark):
    schema = "id string, a string, b string"
    old = spark.createDataFrame([("1", None, "x"), ("2", None, None)], schema)
    new = spark.createDataFrame([("1", "x", None), ("2", None, None)], schema)
    assert rows(index.snapshot_diff(old, new, "id"), "id", "change_type") == [("1", "update")]
