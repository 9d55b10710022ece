"""Exact search of a large batch: blocks of queries read the written blocks of documents, and no row is made per query and cell."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfscan.operators import retrieval
from shelfscan.session import shared_dir


def frame(spark, ids, vectors, id_col="product_id"):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in zip(ids, vectors)], f"{id_col} string, embedding array<float>")


def hits(df):
    return sorted((q, p, rank, score + 0.0) for q, p, rank, score in df.select("query_id", "product_id", "rank", "score").collect())


def brute(q_ids, queries, ids, docs, k, skip_self=False, allowed=lambda q, d: True):
    unit = lambda m: m.astype(np.float64) / np.where((n := np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)) == 0, 1, n)
    scores, lists = np.round(unit(queries) @ unit(docs).T, 6), {}
    for i, q in enumerate(q_ids):
        lists.setdefault(q, []).extend((-scores[i, j], d) for j, d in enumerate(ids) if not (skip_self and d == q) and allowed(q, d))
    return sorted((q, d, rank, -s + 0.0) for q, own in lists.items() for rank, (s, d) in enumerate(sorted(own)[:k], 1))


def files(spark):
    """Sizes of what lies in Spark's own folder and the shared one."""
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    sizes = {f.getPath(): f.length() for f in (found.apply(i) for i in range(found.size()))}
    shared = shared_dir(spark).removeprefix("file:")
    return sizes | {p: os.path.getsize(p) for d, _, names in os.walk(shared) for p in (os.path.join(d, n) for n in names)}


def test_disk_grows_with_the_rows_and_not_with_the_cells(spark):
    vectors = np.random.default_rng(2).standard_normal((3000, 32)).astype(np.float32)  # no clusters: every cell can hold a hit
    ids = [f"{i:05d}" for i in range(3000)]
    docs = frame(spark, ids, vectors).cache()
    docs.count()
    before = files(spark)
    found = retrieval.dense_topk(docs.withColumnRenamed("product_id", "query_id"), docs, 4, skip_self=True, chunk=100, block=500)
    got = hits(found)
    written = sum(n for p, n in files(spark).items() if p not in before)
    docs.unpersist()
    assert got == brute(ids, vectors, ids, vectors, 4, True)
    assert written < 10 * vectors.nbytes, written


@pytest.mark.parametrize("clusters, block", [(0, 60), (8, 60), (8, None), (3, 7)])
def test_blocks_equal_all_pairs(spark, clusters, block):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((400, 8))
    if clusters:
        vectors = (rng.standard_normal((clusters, 8)) * 3)[rng.integers(0, clusters, 400)] + vectors * 0.1
    vectors[:5], vectors[100:190], vectors[300] = 0, vectors[100], -vectors[301]  # nothing, a very common vector, an opposite
    vectors = vectors.astype(np.float32)
    ids = [f"{i:04d}" for i in range(400)]
    ids[40], ids[105], ids[106] = ids[41], ids[107], ids[107]  # ids that come again
    docs = frame(spark, ids, vectors)
    for skip_self in (False, True):
        found = retrieval.dense_topk(docs.withColumnRenamed("product_id", "query_id"), docs, 4, skip_self, chunk=10, block=block)
        assert hits(found) == brute(ids, vectors, ids, vectors, 4, skip_self)


@pytest.mark.parametrize("n_queries, n_docs", [(20, 2000), (2000, 20), (50, 3)])
def test_blocks_of_unlike_sides(spark, n_queries, n_docs):
    rng = np.random.default_rng(6)
    queries, docs = (rng.standard_normal((n, 8)).astype(np.float32) for n in (n_queries, n_docs))
    q_ids, ids = [f"q{i}" for i in range(n_queries)], [f"d{i}" for i in range(n_docs)]
    found = retrieval.dense_topk(frame(spark, q_ids, queries, "query_id"), frame(spark, ids, docs), 6, chunk=5, block=100)
    assert hits(found) == brute(q_ids, queries, ids, docs, 6)


def test_blocks_with_wishes(spark):
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((300, 8)).astype(np.float32)
    vectors[50:120] = vectors[50]
    ids = [f"{i:03d}" for i in range(300)]
    docs = frame(spark, ids, vectors).withColumn("shelf", F.col("product_id").cast("int") % 3)
    queries = docs.drop("shelf").withColumnRenamed("product_id", "query_id").withColumn("wish", F.col("query_id").cast("int") % 4)
    allow = lambda wants, facts: (facts["shelf"] == wants[0]).to_numpy()  # a wish of 3 is never met
    found = retrieval.dense_topk(queries, docs, 4, True, wants=["wish"], facts=["shelf"], allow=allow, chunk=5, block=40)
    assert hits(found) == brute(ids, vectors, ids, vectors, 4, True, lambda q, d: int(d) % 3 == int(q) % 4)


def test_blocks_with_missing_numbers(spark):
    vectors = np.random.default_rng(9).standard_normal((60, 4)).astype(np.float32)
    ids = [f"{i:02d}" for i in range(60)]
    odd = spark.createDataFrame([("odd", [1.0, None, 0.0, 0.0]), ("none", None), (None, [1.0, 0.0, 0.0, 0.0])], "product_id string, embedding array<float>")
    docs = frame(spark, ids, vectors).union(odd)
    queries = docs.withColumnRenamed("product_id", "query_id")
    run = lambda chunk: sorted(map(str, retrieval.dense_topk(queries, docs, 3, True, chunk=chunk, block=10).select("query_id", "product_id", "rank", "score").collect()))
    assert run(5) == run(100)
