"""Registered queries against SQL and brute force."""

import zlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from shelfscan.llm import queries, sql, toxicity
from tests.llm import brute


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def items(spark, sf):
    return [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]


def rows(spark, sf, key):
    return queries.QUERIES[key](spark, sf).collect()


def test_contamination(spark, sf, docs, items):
    got = {r["doc_id"]: r for r in rows(spark, sf, "op1_decontaminate")}
    assert len(got) == len(docs)
    for doc, n, hit, found in brute.contamination(docs, items):
        r = got[doc]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, len(hit), len(found), bool(hit))
    assert any(r["contaminated"] for r in got.values())


def test_simhash(spark, sf, docs):
    prints = [(doc, brute.fingerprint(text)) for doc, text in docs]
    want = brute.components(prints)
    got = {r["doc_id"]: r for r in rows(spark, sf, "op5_simhash")}
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: f"{fp:016x}" for d, fp in prints}
    assert {d: r["component_id"] for d, r in got.items()} == want


def test_exact(spark, sf, docs):
    want = brute.exact_groups(docs)
    for r in rows(spark, sf, "op4_exact_dedup"):
        assert (r["keep_id"], r["group_size"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["keep_id"])


def packed_well(out, want, length=4096):
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in out} == want
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= length
    least = -(-sum(n for _, n, _ in want.values()) // length)
    assert len(sequences) <= max(least + 2, least * 1.02)


def test_packing(spark, sf, docs):
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    packed_well(rows(spark, sf, "op8_pack"), brute.pieces(docs, tokenizer))


def test_toxicity_on_folds(spark):
    """Accuracy on folds of the rows that may be learned from: each fold judged by a lexicon that has seen the others."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    judged = []
    for k in (0, 1, 3):
        lexicon = toxicity.learn(docs, labels.where(fold != k))
        out = toxicity.score(docs.where(fold == k), lexicon).join(labels.select("doc_id", "toxic"), "doc_id")
        judged += [(r["toxic"], r["predicted"]) for r in out.collect()]
    assert sum(a == b for a, b in judged) >= 0.97 * len(judged)
    assert sum(a and b for a, b in judged) >= 0.9 * sum(a for a, _ in judged)


def test_toxicity_query(spark, sf):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = rows(spark, sf, "op9_toxicity")
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    clean = [r["predicted"] for r in out if r["held_out"] and labels.get(r["doc_id"]) == 0]
    assert sum(clean) <= 0.05 * len(clean)


def test_every_sql_has_a_query():
    assert set(sql.ORACLES) <= set(queries.QUERIES)


def test_pipeline(spark, sf, docs, items):
    """Each stage against a brute-force version of it, on what the stage before kept."""
    source = spark.read.parquet(f"{sf}/documents.parquet")
    toxic, exact, near, clean, packing = (f for _, f in corpus_pipeline.STAGES)
    a = toxic(spark, source, sf)
    assert a.columns == source.columns
    predicted = {r["doc_id"] for r in rows(spark, sf, "op9_toxicity") if r["predicted"]}
    left = [(d, t) for d, t in docs if d not in predicted]
    assert sorted(r["doc_id"] for r in a.select("doc_id").collect()) == sorted(d for d, _ in left)
    b = exact(spark, a, sf)
    keep = {k for k, _ in brute.exact_groups(left).values()}
    left = [(d, t) for d, t in left if d in keep]
    assert sorted(map(tuple, b.select("doc_id", "text").collect())) == sorted(left)
    c = near(spark, b, sf)
    least = brute.smallest_reachable([d for d, _ in left], brute.similar_pairs(left))
    left = [(d, t) for d, t in left if least[d] == d]
    assert sorted(map(tuple, c.select("doc_id", "text").collect())) == sorted(left)
    d = clean(spark, c, sf)
    assert d.columns == source.columns
    out = {r["doc_id"]: r for r in d.collect()}
    for doc, n, hit, _ in brute.contamination(left, items):
        if not hit:
            assert out[doc]["text"] == dict(left)[doc]
        elif len(hit) > 0.5 * n:
            assert doc not in out
        else:
            assert out[doc]["n_chars"] == len(out[doc]["text"]) < len(dict(left)[doc])
    cut = [(r["doc_id"], r["text"]) for r in out.values()]
    assert not any(hit for _, _, hit, _ in brute.contamination(cut, items))
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    packed_well(packing(spark, d, sf).collect(), brute.pieces(cut, tokenizer))


def test_pipeline_on_odd_rows(spark, sf, tmp_path):
    """Nulls, empty texts, repeated ids and rows, an extra column and an empty table go through all stages."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    own = spark.read.parquet(f"{sf}/documents.parquet").limit(30).withColumn("row", F.lit("clash"))
    odd = spark.createDataFrame([(5000, None), (5001, ""), (5002, "one"), (5002, "one"), (5002, "two words"), (None, "no id at all"), (None, None), (5003, "long " * 60_000)], "doc_id long, text string")
    docs = own.unionByName(odd, allowMissingColumns=True)
    for table in (docs, docs.where("false")):
        left = table
        for _, stage in corpus_pipeline.STAGES:
            left = stage(spark, left, str(tmp_path))
        out = left.collect()
        if table is docs:
            ids = {r["doc_id"] for r in out}
            assert {5000, 5002, 5003, None} <= ids and 5001 not in ids
            assert sum(r["length"] for r in out if r["doc_id"] == 5003) == 60_001
        else:
            assert out == []
