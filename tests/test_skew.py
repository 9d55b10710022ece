"""One key holds a large part of the rows; results must equal brute force."""

import datetime
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from shelfscan.operators import events as ev
from shelfscan.operators import quality as q
from shelfscan.operators import retrieval


def test_price_overlap_of_a_hot_product(spark):
    rng = random.Random(5)
    day0 = datetime.date(2020, 1, 1)
    rows = []
    for i in range(900):
        start = day0 + datetime.timedelta(days=rng.randrange(700))
        end = None if rng.random() < 0.1 else start + datetime.timedelta(days=rng.randrange(1, 60))
        rows.append((f"{i:04d}", "hot" if i % 3 == 0 else f"p{rng.randrange(60)}", start, end))
    df = spark.createDataFrame(rows, "price_id string, product_id string, effective_from date, effective_to date")
    want, last = set(), {}
    for price, product, start, end in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if product in last:
            _, until, _, before = last[product]
            if until is None or until > start:
                want.add((price, before))
        key = lambda r: (r[0], r[1] or day0, r[2], r[3])
        last[product] = max(last.get(product, (False, day0, day0, "")), (end is None, end, start, price), key=key)
    assert {(r["price_id"], r["previous_price_id"]) for r in q.price_overlap(df).collect()} == want


def test_sessions_of_a_hot_user(spark):
    rng = random.Random(6)
    t0 = datetime.datetime(2024, 1, 1)
    rows = [("bot" if i % 3 else f"u{rng.randrange(9)}", t0 + datetime.timedelta(minutes=rng.randrange(20000))) for i in range(2000)]
    want = Counter()
    last, run = {}, {}
    for user, at in sorted(rows):
        if user not in last or at - last[user] > datetime.timedelta(minutes=30):
            run[user] = at
        last[user] = at
        want[(user, run[user])] += 1
    df = spark.createDataFrame(rows, "u string, ts timestamp_ntz")
    assert {(r["u"], r["start"]): r["n"] for r in ev.event_sessions(df, "u", 30).collect()} == want


def test_bm25_with_a_term_in_every_document(spark):
    rng = random.Random(7)
    words = ["the"] * 6 + [f"w{i}" for i in range(30)]
    docs = {str(i): " ".join(["The"] + [rng.choice(words) for _ in range(rng.randrange(1, 25))]) for i in range(120)}
    docs["empty"] = ""
    queries = {"1": "the", "2": "the w1 w2", "3": "w3, W3 w4!", "4": "unknown"}
    toks = {d: re.findall(r"\w+", t.lower()) for d, t in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(w for ts in toks.values() for w in set(ts))
    want = []
    for query_id, text in queries.items():
        scores = {}
        for d, ts in toks.items():
            tf = Counter(ts)
            terms = set(re.findall(r"\w+", text.lower())) & set(ts)
            if terms:
                scores[d] = round(
                    sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ts) / avg)) for w in terms), 6
                )
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:15]
        want += [(query_id, d, i + 1, s) for i, (d, s) in enumerate(best)]
    got = retrieval.bm25_topk(
        spark.createDataFrame(list(queries.items()), "query_id string, query string"),
        spark.createDataFrame(list(docs.items()), "product_id string, searchable_text string"), 15,
    )
    rows = sorted((r["query_id"], r["product_id"], r["rank"], r["score"]) for r in got.collect())
    assert [r[:3] for r in rows] == [w[:3] for w in sorted(want)]
    assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(rows, sorted(want)))


def test_copies_of_one_key(spark):
    rows = [("hot" if i % 3 else str(i), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, seq long").repartition(6)
    out = {r["k"]: (r["seq"], r["copies"]) for r in q.deduplicate(df, ["k"], [F.col("seq")]).collect()}
    assert out["hot"] == (1, 2000) and len(out) == 1001
    plan = q.deduplicate(df, ["k"], [F.col("seq")])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan  # map tasks reduce a key before the shuffle
