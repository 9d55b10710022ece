"""Near copies by similarity, against all pairs compared."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfscan.llm import graph, simhash
from tests.llm import brute


def kept(texts):
    """Smallest id of each connected group."""
    least = brute.smallest_reachable([i for i, _ in texts], brute.similar_pairs(texts))
    return {i for i in least if least[i] == i}


def test_the_stage_drops_similar_documents(spark):
    rng = random.Random(5)
    texts = []
    for group in range(12):
        words = [f"g{group}w{rng.randrange(400)}" for _ in range(200)]
        for copy in range(90 if group == 0 else 2):  # one group larger than a small bucket
            own = list(words)
            for _ in range(0 if not copy else rng.choice([1, 3, 4, 16])):
                own[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
            texts.append((len(texts), " ".join(own)))
    texts += [(900, ""), (901, "a b"), (902, "A  b"), (903, "a c")]
    table = spark.createDataFrame([*texts, (None, "a b")], "doc_id long, text string")
    got = [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, table, "").collect()]
    want = kept(texts)
    assert None in got and len(want) < len(texts) - 30
    assert sorted(x for x in got if x is not None) == sorted(want)
    two_bits = simhash.drop_near_copies(table).where("doc_id is not null").count()
    assert two_bits > len(want) + 10  # what the stage was before


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall_of_similar_pairs(spark, scale):
    """Of all pairs of different texts with a 5-word similarity of 0.8, found by exact prefix filtering."""
    rows = {r["text"]: r["doc_id"] for r in spark.read.parquet(f"/root/testdata/{scale}/documents.parquet").collect() if r["text"]}
    texts = [(d, t) for t, d in rows.items()]
    want = brute.similar_pairs(texts)
    links = simhash.similar_links(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {(r["b"], r["a"]) for r in links} | {(r["a"], r["b"]) for r in links} <= {p for a, b in want for p in ((a, b), (b, a))}  # no false ones
    least = brute.smallest_reachable([d for d, _ in texts], [(r["a"], r["b"]) for r in links])
    found = sum(least[a] == least[b] for a, b in want)
    assert len(want) >= 5 and found >= 0.95 * len(want), (found, len(want))


def test_crowded_buckets_meet_heads(spark, monkeypatch):
    """A crowd of copies of one text that are similar to it, though hardly to each other."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = [(0, " ".join(base))]
    for i in range(1, 400):
        own = list(base)
        for _ in range(6):
            own[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        texts.append((i, " ".join(own)))
    monkeypatch.setattr(simhash, "CROWD", 60)  # in the workers too: the function is sent by value where they are forked
    got = simhash.similar_links(spark.createDataFrame(texts, "doc_id long, text string"))
    roots = {r["node"]: r["root"] for r in graph.components(got).collect()}
    assert sum(roots.get(i) == 0 for i, _ in texts) >= 0.97 * len(texts)
    assert got.count() < 5 * len(texts)


def test_odd_rows(spark):
    rows = [(1, "a b c d e f", 1), (1, "x y z", 2), (2, "a b c d e f", 3), (3, None, 4), (4, "", 5), (5, "w " * 50_000, 6), (6, "w " * 50_000 + "v", 7), (None, "a b c d e f", 8)]
    table = spark.createDataFrame(rows, "doc_id long, text string, label int").withColumns({c: F.lit("clash") for c in ("fp", "key", "sketch", "size", "a", "gone_id")})
    kept_rows = simhash.drop_similar(table)
    assert kept_rows.columns == table.columns
    assert sorted((str(r["doc_id"]), r["label"]) for r in kept_rows.collect()) == [("1", 1), ("1", 2), ("3", 4), ("5", 6), ("6", 7), ("None", 8)]
    assert simhash.drop_similar(table.where("false")).count() == 0


def copies_without_their_text(rows):
    """Copies of one text that is not there; about half are similar to others, and to few."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for i in range(rows):
        own = list(base)
        for _ in range(rng.choice([1, 2, 2, 3, 3, 4, 5])):
            own[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append((i, " ".join(own)))
    return texts


def test_no_candidate_is_left_out(spark):
    """Rows of one bucket that can be similar by fingerprint and sketch, and are, end up connected; whatever a row went on with before."""
    texts = copies_without_their_text(700)
    links = [(r["a"], r["b"]) for r in simhash.similar_links(spark.createDataFrame(texts, "doc_id long, text string")).collect()]
    least = brute.smallest_reachable([i for i, _ in texts], links)
    width, segments = simhash.planned_segments(len(texts))
    prints = np.array([simhash.fingerprint(t.encode()) for _, t in texts], np.uint64)
    sketches = [simhash.sketch(simhash.word_set(t.encode(), simhash.WORDS)) for _, t in texts]
    parts = [simhash._segment(prints, p, width, segments) for p in range(segments)]
    met = [
        (a, b) for a, b in brute.similar_pairs(texts)
        if any((int(p[a]) ^ int(p[b])).bit_count() <= 1 for p in parts)
        and (int(prints[a]) ^ int(prints[b])).bit_count() <= simhash.NEAR_BITS and (sketches[a] ^ sketches[b]).bit_count() <= simhash.SKETCH_BITS
    ]
    assert len(met) > 1000 and not [(a, b) for a, b in met if least[a] != least[b]]
    assert set(map(frozenset, links)) <= set(map(frozenset, brute.similar_pairs(texts)))


def test_rows_of_a_large_group_meet_few(spark, monkeypatch):
    """What leaves the buckets in all rounds, for a group that stays in many parts."""
    given, of = spark.sparkContext.accumulator(0), simhash._candidates

    def counted(*args):
        candidates = of(*args)

        def count(batches):
            for batch in candidates(batches):
                given.add(batch.num_rows)
                yield batch

        return count

    monkeypatch.setattr(simhash, "_candidates", counted)
    texts = copies_without_their_text(700)
    simhash.similar_links(spark.createDataFrame(texts, "doc_id long, text string"))
    assert given.value < 10 * len(texts)


@pytest.mark.parametrize("rows", [40, 150])
def test_each_pair_of_the_rest_comes_once(rows):
    """All buckets of rows in a few components: small and large ones, batches that cut them."""
    rng = np.random.default_rng(3)
    fp = np.uint64(0x0123456789ABCDEF) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (rows, 3)).astype(np.uint64), axis=1)
    label = rng.integers(0, 5, rows)
    zero = np.zeros(rows, np.int64)
    columns = [np.arange(rows), fp.view(np.int64), zero, np.full(rows, 50, np.int32), label, *[zero] * len(simhash.ODDS)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list(simhash._NEAR_COLUMNS))
    spread = pa.Table.from_batches(simhash._spread(12, 6, range(6))(iter([batch]))).sort_by("key")
    got = [(r["a"], r["b"]) for b in simhash._candidates(12, 6, 12, 0.8, "rest")(iter(spread.to_batches(max_chunksize=100))) for r in b.to_pylist()]
    want = {(a, b) for a in range(rows) for b in range(a) if label[a] != label[b]}
    parts = [simhash._segment(fp, p, 12, 6) for p in range(6)]
    want = {(a, b) for a, b in want if any(int(p[a] ^ p[b]).bit_count() <= 1 for p in parts)}
    assert len(got) == len(set(got)) and {(max(p), min(p)) for p in got} == want and len(got) == len(want)


def test_parities_part_no_similar_sets():
    rng = np.random.default_rng(8)
    for size in (1, 30, 120, 5000):
        own = rng.integers(0, 2**63, size).astype(np.uint64)
        other = np.unique(np.r_[own[size // 9 :], rng.integers(0, 2**63, size // 10).astype(np.uint64)])
        unlike = np.bitwise_count(simhash.parities(own) ^ simhash.parities(other)).sum()
        assert unlike <= len(np.setxor1d(own, other)) and simhash.parities(own[:0]).sum() == 0
