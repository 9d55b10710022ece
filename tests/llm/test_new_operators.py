"""Backtracking BPE, source divergence and embedding whitening against brute force and on edge cases."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfscan.llm import bidiagonal, bpe, divergence, queries, whitening

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))
TEXTS = [
    "Don't stop, it's 12.5% of 日本語 and Ünïcödé ΣΑΣ", None, "", " \n\t", LONG, "a" * 30_000, "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|>", "same", "same",
    "é ẛ̣ ſ K ﬁ 🙂🙂 ＡＢ   x", "<|endoftext|><|endoftext|>", "'s 't 're'VE!!??‍--__  9 99",
]
def letters(i):
    """A word of letters for a number."""
    return "t" + "".join("abcdefghij"[int(d)] for d in str(i))


CLASH = {"ids": "int", "n_tokens": "int", "decoded": "int", "words": "int", "term": "int", "block": "int", "p": "int"}


def with_clashes(df):
    for name, kind in CLASH.items():
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_path()


def digests(text, tokenizer):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    raw = b"".join(i.to_bytes(4, "little") for i in ids)
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_query_equals_the_library(spark, sf, path):
    tokenizer = Tokenizer.from_file(path)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op11_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == digests(texts[r["doc_id"]], tokenizer)


def test_bpe_cases(spark, path):
    tokenizer = Tokenizer.from_file(path)
    docs = with_clashes(spark.createDataFrame([*enumerate(TEXTS), (7, TEXTS[0]), (None, "x")], "doc_id long, text string"))
    out = bpe.decode(bpe.encode(docs, path), path)
    got = out.collect()
    assert len(got) == len(TEXTS) + 2 and out.where("false").count() == 0 == bpe.encode(docs.where("false"), path).count()
    want = Counter((d, *digests(t, tokenizer)) for d, t in [*enumerate(TEXTS), (7, TEXTS[0]), (None, "x")])
    assert want == Counter((r["doc_id"], r["n_tokens"], hashlib.sha256(r["ids"]).hexdigest(), hashlib.sha256(r["decoded"].encode()).hexdigest()) for r in got)


def test_bpe_random_words(path):
    tokenizer, encoder, decoder = Tokenizer.from_file(path), bpe.Encoder(path), bpe.decoder_of(path)
    rng = random.Random(11)
    for alphabet in ("etaoinshrdlu", "aab", "the an in", "aehm!.-'st", "日本語のΣσςßéñ1<|>"):
        for _ in range(400):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            ids = tokenizer.encode(text, add_special_tokens=False).ids
            own = np.frombuffer(encoder.ids(text), "<u4")
            assert own.tolist() == ids, text
            assert decoder.bytes_of(own).decode() == tokenizer.decode(ids, skip_special_tokens=False)
    assert decoder.bytes_of(np.array([10**9], "<u4")) == b""


def test_bpe_of_a_made_up_vocabulary(tmp_path):
    """Merges that get into each other's way, and tokens that no word can hold."""
    rng = random.Random(2)
    for case in range(30):
        vocabulary, merges = ["a", "b", "c"], []
        while len(merges) < 25:
            pair = rng.choice(vocabulary), rng.choice(vocabulary)
            if "".join(pair) not in vocabulary and len("".join(pair)) < 9:
                merges.append(list(pair))
                vocabulary.append("".join(pair))
        file = tmp_path / f"{case}.json"
        ids = {t: i for i, t in enumerate(vocabulary)}
        file.write_text(json.dumps({"added_tokens": [], "model": {"type": "BPE", "vocab": ids, "merges": merges}}))
        tables = bpe.Tables(str(file))
        pairs = {(a, b): i for i, (a, b) in enumerate(merges)}
        for _ in range(200):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 24)))
            parts = list(word)
            while found := [(pairs[a, b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (a, b) in pairs]:
                i = min(found)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert tables.encode(word) == [ids[p] for p in parts], (merges, word)


def divergence_by_hand(rows, least=30, top=50):
    words = [(lang or "", source or "", re.findall(divergence.TERM, (text or "").translate({c: c + 32 for c in range(65, 91)}))) for text, lang, source in rows]
    out = []
    for lang in {x[0] for x in words}:
        own = [x for x in words if x[0] == lang]
        docs = Counter(t for _, _, w in own for t in set(w))
        kept = sorted((t for t, n in docs.items() if n >= least), key=str.encode)
        counts = defaultdict(Counter)
        for _, source, w in own:
            counts[source].update(t for t in w if docs[t] >= least)
        whole = sum(counts.values(), Counter())

        def shares(c):
            size = sum(c.values()) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // size for t in kept}

        q, p = shares(whole), {s: shares(c) for s, c in counts.items()}
        for s in p:
            pairs = [(b, sum(abs(p[s][t] - p[b][t]) for t in kept)) for b in p if b != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.append((lang, s, part, item, value, rank))
    return sorted(out)


def test_divergence_cases(spark):
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in "abcdefghijklm" for b in ("x", "Y", "é", "日", "zz")]
    rows = [
        (" ".join(rng.choice(vocabulary[: 5 + 12 * (i % 5)]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "hot", "a", "b", None, "ü"]))
        for i in range(900)
    ]
    rows += [(None, "en", "silent"), ("", "xx", "one"), ("only a few words", "xx", "two"), ("9 8", None, ""), (" ".join(vocabulary) * 3000, "en", "long"), ("ax ax", "en", "a"), ("ax ax", "en", "a")]
    docs = with_clashes(spark.createDataFrame(rows, "text string, lang string, source string"))
    got = divergence.audit(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == divergence_by_hand(rows)
    assert sorted(map(tuple, divergence.audit(docs, least_docs=2, top_terms=3).collect())) == divergence_by_hand(rows, 2, 3)
    assert divergence.audit(docs.where("false")).count() == 0


def test_words_are_counted_before_spark_sees_them(spark, monkeypatch):
    """A task gives a row per term of a group, whatever the number of words; pieces and hand-overs change no count."""
    rows = [("Ab aB\x00c\x7fé日 É[z]9`ab@" * 50 + "tail", "en", "s"), ("ab", "en", "s"), (None, "en", "s"), ("ab", "de", "s")]
    rows += [(" ".join(letters(i % 40) for i in range(j, j + 30)), "en", "s") for j in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["text", "lang", "source"])
    want = Counter()
    for text, lang, source in rows:
        words = re.findall(divergence.TERM, (text or "").translate({c: c + 32 for c in range(65, 91)}))
        for term, n in Counter(words).items():
            want[lang, source, term, "n"] += n
            want[lang, source, term, "docs"] += 1

    def totals(counted):
        got = Counter()
        for r in counted:
            got[r["lang"], r["source"], r["term"], "n"] += r["n"]
            got[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        return got

    whole = [r for b in divergence._counted(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
    assert totals(whole) == want and len(whole) == len(want) // 2
    monkeypatch.setattr(divergence, "PIECE", 7)
    monkeypatch.setattr(divergence, "HELD", 20)
    parts = [r for b in divergence._counted(iter([batch])) for r in b.to_pylist()]
    assert totals(parts) == want and len(parts) > len(whole)
    assert totals(divergence.term_counts(spark.createDataFrame(rows, "text string, lang string, source string")).collect()) == want


def test_divergence_over_many_blocks(spark):
    """More terms than a block holds, counts far past a double's whole numbers."""
    rows = [(f"{letters(i // 30)} " * (1 + (i // 30) % 3), "en", f"s{i % 4}") for i in range(60 * 30)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    bits, size = divergence.BLOCK_BITS, divergence.BLOCK
    divergence.BLOCK_BITS, divergence.BLOCK = 3, 8
    try:
        assert sorted(map(tuple, divergence.audit(docs).collect())) == sorted(divergence_by_hand(rows))
    finally:
        divergence.BLOCK_BITS, divergence.BLOCK = bits, size
    share = spark.range(1).select(divergence._share("987654321987654321", "9876543219876543210", "12345678").alias("p")).first()["p"]
    assert share == 1 + 10**9 * (987654321987654321 + 5) // (9876543219876543210 + 5 * 12345678)


def test_equal_counts_lie_together(spark):
    """The order shortens the columns: far fewer runs than the vocabulary's own order gives."""
    rng = random.Random(6)
    rows = [(" ".join(letters(rng.randrange(400)) for _ in range(12)), "en", f"s{i % 5}") for i in range(900)]
    counts = divergence.term_counts(spark.createDataFrame(rows, "text string, lang string, source string")).cache()
    vocabulary = divergence.ordered_vocabulary(counts, 1)
    columns = defaultdict(dict)
    for r in counts.collect():
        columns[r["source"]][r["term"]] = r["n"]

    def runs(terms):
        values = [[c.get(t, 0) for t in terms] for c in columns.values()]
        return sum(1 + sum(a != b for a, b in zip(v, v[1:])) for v in values)

    ordered = [r["term"] for r in vocabulary.orderBy("block", "pos").collect()]
    assert len(ordered) == len(set(ordered)) and runs(ordered) < 0.8 * runs(sorted(ordered))


@pytest.mark.parametrize(
    "rows",
    [
        np.random.default_rng(1).normal(size=(300, 64)), np.random.default_rng(2).normal(size=(300, 24)) * 10.0 ** np.linspace(0, -8, 24), np.eye(20), np.zeros((9, 5)),
        np.random.default_rng(3).normal(size=(90, 4)) @ np.random.default_rng(4).normal(size=(4, 30)), np.random.default_rng(5).normal(size=(6, 19)), np.kron(np.eye(6), np.ones((4, 4))),
        np.diag(np.r_[np.full(9, 3.0), np.full(9, 2.0), np.linspace(1, 1 + 1e-9, 6)]) @ np.linalg.qr(np.random.default_rng(6).normal(size=(24, 24)))[0],
        np.diag(np.abs(np.arange(-20, 21.0)) + 22) + np.diag(np.ones(40), 1) + np.diag(np.ones(40), -1), np.ones((1, 1)),
        np.array([[(-1.0) ** (i & j).bit_count() for j in range(32)] for i in range(32)]),
    ],
)
def test_singular_values_and_vectors(rows):
    size = rows.shape[1]
    triangle = np.linalg.qr(np.vstack([rows, np.zeros((size, size))]), mode="r")
    squares, v = bidiagonal.right_singular(triangle)
    want = np.r_[np.linalg.svd(rows, compute_uv=False), np.zeros(size)][:size]
    k = v.shape[1]
    assert k == np.linalg.matrix_rank(rows) and np.allclose(np.sqrt(squares[:k]), want[:k], rtol=1e-9 * (want[0] / want[k - 1] if k else 1), atol=0)
    projected = rows @ v / np.sqrt(squares[:k])
    assert np.allclose(v.T @ v, np.eye(k), atol=1e-9) and np.allclose(projected.T @ projected, np.eye(k), atol=1e-6)


def whitened_by_hand(vectors, k=32):
    x = np.floor(64 * np.array(vectors)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    deviation = [sum((n * int(e) - int(s)) ** 2 for e, s in zip(row, sums)) for row in x]
    return centred @ directions[:, order] / np.sqrt(values[order]), values[order] / values.sum(), deviation


def compare(rows, ids, vectors, k=32):
    want, shares, deviation = whitened_by_hand(vectors, k)
    got = defaultdict(dict)
    for r in rows:
        assert r["n"] == len(vectors) and r["identity_error"] < 1e-4
        got[r["vec_id"]][r["component"]] = r
    for c in range(want.shape[1]):
        own = np.array([got[i][c + 1]["whitened"] for i in ids])
        assert min(np.abs(own - want[:, c]).max(), np.abs(own + want[:, c]).max()) < 1e-6
        assert abs(got[ids[0]][c + 1]["explained"] - shares[c]) <= 1e-4 * shares[c]
    assert [got[i][1]["deviation"] for i in ids] == deviation
    assert len(rows) == len(ids) * want.shape[1]


def test_whitening_query(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    compare(queries.op13_whitening(spark, sf).collect(), [r["vec_id"] for r in table], [r["embedding"] for r in table])


def test_whitening_cases(spark):
    rng = np.random.default_rng(8)
    good = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(40)]
    bad = [(90, None), (91, [1.0, None]), (92, [float("nan")] * 6), (93, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0])]
    schema = "vec_id long, embedding array<double>"
    table = spark.createDataFrame(good + bad, schema).withColumn("vector", F.lit(1)).withColumn("n", F.lit(1)).withColumn("component", F.lit(1))
    compare(whitening.whiten(table.repartition(7)).collect(), [i for i, _ in good], [v for _, v in good])
    assert whitening.whiten(table, components=2).count() == 80
    assert whitening.whiten(table.where("false")).count() == 0 and whitening.whiten(spark.createDataFrame(bad, schema)).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)
    assert whitening.whiten(same).count() == 0 and whitening.whiten(same.limit(1)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, [])], schema)).count() == 0
    short = spark.createDataFrame([(1, [1.0]), (1, [1.0]), (2, [2.0, 3.0]), (3, [0.0, 5.0]), (None, [])], schema).collect()
    padded = [[*r["embedding"], 0.0, 0.0][:2] for r in short]
    _, shares, _ = whitened_by_hand(padded)
    out = whitening.whiten(spark.createDataFrame(short, schema)).collect()
    assert len(out) == 10 and {r["component"] for r in out} == {1, 2} and abs(out[0]["explained"] - shares[0]) < 1e-9
    large = spark.createDataFrame([(1, [2.0**50, 0.0]), (2, [0.0, 1.0]), (3, [-(2.0**50), 5.0])], schema)
    assert {r["deviation"] for r in whitening.whiten(large).collect()} == {None, 36864}
