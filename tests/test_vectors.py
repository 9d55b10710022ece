"""Cells of vectors, pruned exact search, the encoder and the flagship chained on it."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfscan.operators import cells, index, retrieval, search
from shelfscan.sources.fixtures import Tables


def clustered(spark, n, clusters, dim=16, seed=5):
    """``n`` vectors in tight clusters, as (product_id, embedding)."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim)) * 3
    rows = centres[rng.integers(0, clusters, n)] + rng.standard_normal((n, dim)) * 0.15
    return spark.createDataFrame([(f"{i:05d}", [float(x) for x in v]) for i, v in enumerate(rows)], "product_id string, embedding array<float>")


def queries_of(docs, step):
    return docs.filter(F.col("product_id").cast("int") % step == 0).withColumnRenamed("product_id", "query_id")


def hits(df):
    return sorted(map(tuple, df.select("query_id", "product_id", "rank", "score").collect()))


def test_ann_recall_and_scores(spark, sf):
    t = Tables(spark, sf)
    exact = {(r[0], r[1]): r[3] for r in hits(retrieval.dense_topk(t["v_query_vectors"], t["v_vec_products"], 10))}
    near = {(r[0], r[1]): r[3] for r in hits(retrieval.dense_ann(t["v_query_vectors"], t["v_vec_products"], 10))}
    assert len(exact.keys() & near.keys()) >= 0.9 * len(exact)
    assert all(near[k] == exact[k] for k in exact.keys() & near.keys())


def test_ann_compares_a_falling_share(spark):
    shares = []
    for n in (400, 6400):
        docs = clustered(spark, n, n // 20)
        queries = queries_of(docs, n // 50)
        probes, assigned = retrieval.ann_plan(queries, docs, share=0.3)
        assert assigned.count() == n
        shares.append(cells.comparisons(probes, assigned) / (n * queries.count()))
        exact = {r[:2] for r in hits(retrieval.dense_topk(queries, docs, 10))}
        assert len(exact & {r[:2] for r in hits(retrieval.dense_ann(queries, docs, 10, share=0.3))}) >= 0.9 * len(exact)
    assert shares[1] < 0.8 * shares[0] < 0.25


@pytest.mark.parametrize("skip_self", [False, True])
def test_cell_by_cell_equals_the_scan(spark, skip_self):
    docs = clustered(spark, 600, 12).union(spark.createDataFrame([("zero", [0.0] * 16), ("copy", [1.0] * 16), ("copy2", [1.0] * 16)], "product_id string, embedding array<float>"))
    docs = docs.union(spark.createDataFrame([("none", None)], docs.schema))
    queries = docs.withColumnRenamed("product_id", "query_id")
    assert hits(retrieval.dense_topk(queries, docs, 5, skip_self)) == hits(retrieval.dense_topk(queries, docs, 5, skip_self, chunk=10))


def test_cell_by_cell_with_wishes(spark):
    docs = clustered(spark, 300, 6).withColumn("shelf", F.col("product_id").cast("int") % 3)
    queries = queries_of(docs.drop("shelf"), 7).withColumn("wish", F.col("query_id").cast("int") % 3)
    allow = lambda wants, facts: (facts["shelf"] == wants[0]).to_numpy()
    run = lambda chunk: hits(retrieval.dense_topk(queries, docs, 4, wants=["wish"], facts=["shelf"], allow=allow, chunk=chunk))
    assert run(4096) == run(3)
    assert all(int(q) % 3 == int(p) % 3 for q, p, _, _ in run(3))


def test_bounds_leave_most_cells_out(spark):
    docs = clustered(spark, 2000, 40)
    queries = queries_of(docs, 20)
    centres = cells.fit_centres(docs, "product_id")
    placed = cells.nearest_cells(docs, centres)
    floors = retrieval.dense_topk(queries, docs, 10).where("rank = 10").select("query_id", F.col("score").alias("floor"))
    visited = retrieval.visits(queries, placed, floors, centres)
    assert visited.count() < 0.4 * queries.count() * len(centres)


def test_cells_of_nothing_and_of_one(spark):
    none = spark.createDataFrame([], "product_id string, embedding array<float>")
    one = spark.createDataFrame([("a", [1.0, 0.0])], none.schema)
    queries = one.withColumnRenamed("product_id", "query_id")
    assert retrieval.dense_topk(queries, none, 3).count() == 0 == retrieval.dense_ann(queries, none, 3).count()
    assert hits(retrieval.dense_ann(queries, one, 3)) == hits(retrieval.dense_topk(queries, one, 3, chunk=0)) == [("a", "a", 1, 1.0)]


def test_encoder_needs_no_fit(spark):
    docs = spark.createDataFrame([("a", "Red oak, red table"), ("b", ""), ("c", None), ("d", "word " * 20_000 + "end")], "product_id string, searchable_text string")
    got = {r["product_id"]: np.array(r["embedding"]) for r in index.embed(docs).collect()}
    want = np.zeros(256)
    for term in ("red", "oak", "table"):
        d = hashlib.md5(term.encode()).digest()
        want[int.from_bytes(d[:4], "big") % 256] += -1 if d[4] & 1 else 1
    assert np.allclose(got["a"], want / np.linalg.norm(want)) and not got["b"].any() and not got["c"].any() and abs(np.linalg.norm(got["d"]) - 1) < 1e-6
    alone = index.embed(docs.where("product_id = 'a'")).first()["embedding"]
    assert list(got["a"]) == alone


def catalog(spark):
    return spark.createDataFrame(
        [(f"{i:02d}", f"lamp {i}", f"{'steel' if i % 2 else 'oak'} lamp number {i}", "src1" if i < 20 else "src2", "Ikea" if i % 3 else "Muji", f"Color: {'Red' if i % 4 else 'Blue'}", float(i * 10), 4.0, 1) for i in range(40)],
        "product_id string, product_name string, searchable_text string, category_path string, brand_name string, attribute_summary string, selling_price double, average_rating double, review_count int",
    )


def test_flagship_understands_rewrites_and_encodes(spark):
    docs = catalog(spark)
    queries = spark.createDataFrame([("q", "red Muji steel lamp under 300"), ("r", "lamp"), ("s", "blue")], "query_id string, query string")
    seen = []

    def encoder(batches):
        for pdf in batches:
            yield pd.DataFrame({"product_id": pdf["product_id"], "embedding": [[float("steel" in (t or "")), 1.0] for t in pdf["text"]]})

    for kwargs in ({}, {"encoder": encoder}):
        out = search.search_batch(queries, docs, **kwargs).collect()
        mine = [int(r["product_id"]) for r in out if r["query_id"] == "q"]
        assert sorted(mine) == [i for i in range(40) if i % 3 == 0 and i % 4 and i * 10 <= 300]
        assert sum(r["query_id"] == "r" for r in out) == 10 == sum(r["query_id"] == "s" for r in out)
        seen.append([r["product_id"] for r in out if r["query_id"] == "r"])
    assert seen[0] != seen[1]  # the encoder passed in decides
    upside_down = search.search_batch(queries, docs, score=-F.col("score")).where("query_id = 'r'").orderBy("rank").collect()
    assert [r["retrieval_rank"] for r in upside_down] == sorted((r["retrieval_rank"] for r in upside_down), reverse=True)


def test_phrases_of_any_length(spark):
    long = " ".join(f"w{i}" for i in range(1000))
    dictionary = spark.createDataFrame([("brand", long, "LONG"), ("brand", "w0", "SHORT"), ("category", "w1 w2", "C"), ("brand", "w0 w1 w2", "MID")], "kind string, phrase string, value string")
    queries = spark.createDataFrame([("a", f"see {long} now"), ("b", "w0 w1"), ("c", "x " * 3000 + "w1 w2"), ("d", ""), ("e", None), ("f", long[:-1])], "query_id string, query string")
    got = {r["query_id"]: r for r in search.query_intent(queries, dictionary).collect()}
    assert (got["a"]["brand"], got["a"]["category"], got["a"]["rewritten_query"]) == ("LONG", "C", "see now")
    assert (got["b"]["brand"], got["c"]["category"], got["f"]["brand"]) == ("SHORT", "C", "MID") and got["d"]["brand"] is got["e"]["brand"] is None
    split = queries.select("query_id", F.split("query", " ").alias("_words")).where("query_id = 'c'")
    assert search.phrase_matches(split, dictionary).count() == 1


def test_substring_search_in_chunks(spark, sf):
    t = Tables(spark, sf)
    whole = hits(retrieval.keyword_contains(t["v_queries"], t["v_catalog"], 20, query="base_query"))
    parts = hits(retrieval.keyword_contains(t["v_queries"], t["v_catalog"], 20, query="base_query", chunk_chars=2000))
    assert whole == parts and whole
    plan = retrieval.keyword_contains(t["v_queries"], t["v_catalog"], 20, query="base_query")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1  # only the hits are shuffled
