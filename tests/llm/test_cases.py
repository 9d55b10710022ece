"""Each operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfscan.llm import chat, decontaminate, exact, graph, html_text, licenses, lines, packing, queries, simhash, toxicity, urls
from tests.llm import brute

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
TEXTS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa\nA line that repeats itself\nend"),
    (2, None), (3, ""), (4, "  \n\t"), (5, LONG), (6, "A LINE that repeats itself \nown words here, quite some"),
    (6, "A LINE that repeats itself \nown words here, quite some"), (7, "alphabeta gammadelta epsilon zeta eta theta iota kappa\nAlinethatrepeats itself end"),
    (None, "a line that repeats itself"), (9, "ñandú Ünïcödé ΣΑΣ 日本語 e\u0301 \ud7ff 12.5% <|endoftext|> it's"),
]
CLASH = "row string, lead string, digest string, first boolean, fp long, hash long, spans string, items string, key string, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame(TEXTS, "doc_id long, text string")
    for name in CLASH.split(", "):
        base = base.withColumn(name.split()[0], F.lit(None).cast(name.split()[1]))
    return base


def none_of(df):
    return df.where("false")


def test_exact(docs):
    got = exact.exact_groups(docs).collect()
    assert len(got) == len(TEXTS)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["keep_id"] == by[3]["keep_id"] == by[4]["keep_id"] == 4 and by[2]["group_size"] == 3  # the longest of the empty ones
    assert [r["kept"] for r in got if r["doc_id"] == 6].count(True) == 1 and by[6]["group_size"] == 2
    kept = exact.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 4, 5, 6, None, 9]))  # 1 and 7 differ in white space only
    assert exact.exact_groups(none_of(docs)).count() == 0 and exact.drop_exact_copies(none_of(docs)).count() == 0


def test_exact_group_over_many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.repeat(F.lit("same "), 20)).otherwise(F.col("id").cast("string")).alias("text"))
        assert exact._sorted_runs(table, F.lit(None).cast("boolean"), "boolean").where("n_chars = 100").count() > 1
        assert exact.drop_exact_copies(table).count() == 1334 + 1
        assert {(r["keep_id"], r["group_size"]) for r in exact.exact_groups(table).where("doc_id % 3 > 0").collect()} == {(1, 2666)}
        assert exact.exact_groups(table).where("kept").count() == 1335
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_simhash(docs):
    got = simhash.near_groups(docs).collect()
    assert len(got) == len(TEXTS)
    for r, want in zip(sorted(got, key=lambda r: (r["doc_id"] or 0)), sorted(TEXTS, key=lambda t: t[0] or 0)):
        assert r["fp"] & (1 << 64) - 1 == brute.fingerprint(want[1])
    assert {r["component_id"] for r in got if r["doc_id"] in (2, 3, 4)} == {2}
    assert simhash.near_groups(none_of(docs)).count() == 0
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 5, 6, 7, None, 9}


@pytest.mark.parametrize("hot", [simhash.HOT, 4])
def test_links_find_every_pair(spark, hot):
    """Clusters of close fingerprints, large buckets and lone ones; also with every crowded segment taken the other way."""
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(4):
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (0, 1, 2, 3) for _ in range(60)}
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(32), 5)) for _ in range(100)}
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = simhash.links(table, hot).collect()
    back = dict(zip(signed, prints))
    assert all(0 < (back[r["a"]] ^ back[r["b"]]).bit_count() for r in found)
    roots = {r["node"]: r["root"] for r in graph.components(simhash.links(table, hot)).collect()}
    want = brute.components([(i, fp) for i, fp in enumerate(prints)])
    groups, wanted = {}, {}
    for i, s in enumerate(signed):
        groups.setdefault(roots.get(s, s), set()).add(i)
        wanted.setdefault(want[i], set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_components_of_a_path(spark):
    edges = spark.range(500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in graph.components(edges).collect()} == {0}
    assert graph.components(none_of(edges)).count() == 0


def test_automaton_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(4)]

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    items = [(i, text(rng.randint(0, 14))) for i in range(60)] + [(None, text(12)), (7, None), (3, text(6))]
    docs = [(i, text(rng.randint(0, 300))) for i in range(40)] + [(99, None)]
    for window in (10, 5, 3):
        table = spark.createDataFrame(docs, "doc_id long, text string")
        tests = spark.createDataFrame(items, "item_id long, text string")
        for block in (1 << 20, 300):
            got = {r["doc_id"]: r for r in decontaminate.contamination(table, tests, window, block).collect()}
            for doc, n, hit, found in brute.contamination(docs, items, window):
                r = got[doc]
                assert r["n_words"] == n and r["items"] == found
                assert sorted(w for s in r["spans"] for w in range(s["first"], s["last"] + 1)) == hit


def test_decontaminate_cases(spark, docs):
    items = spark.createDataFrame([(1, "alpha BETA gamma delta epsilon zeta eta theta iota kappa"), (2, None)], "item_id long, text string")
    out = decontaminate.decontaminate(docs, items)
    assert out.columns == docs.columns and out.count() == len(TEXTS) - 1
    assert out.where("doc_id = 1").count() == 0  # ten of its sixteen words are hit
    assert decontaminate.decontaminate(docs, none_of(items)).count() == len(TEXTS)
    assert decontaminate.contamination(none_of(docs), items).count() == 0


def test_decontaminate_carries_any_column(spark):
    columns = ("llm_clean", "llm_cut", "row", "cut", "dropped", "text2", "spans", "n_words", "items")
    text = " ".join([*(f"a{i}" for i in range(40)), *(f"t{i}" for i in range(10))])
    table = spark.createDataFrame([(1, text), (2, "clean"), (3, None)], "doc_id long, text string").withColumns({c: F.lit(c) for c in columns})
    out = decontaminate.decontaminate(table, spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(10)))], "item_id long, text string"))
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == table.columns and got[1]["text"].strip() == " ".join(f"a{i}" for i in range(40)) and got[2]["text"] == "clean" and got[3]["text"] is None
    assert all(r[c] == c for r in got.values() for c in columns)


def test_cut_words_that_meet_anew(spark):
    words = [f"t{i}" for i in range(10)]
    inner = " ".join(words)
    text = " ".join([*(f"a{i}" for i in range(40)), *words[:4], inner, *words[4:], *(f"b{i}" for i in range(40))])
    table = spark.createDataFrame([(1, text, 5)], "doc_id long, text string, n_chars long")
    out = decontaminate.decontaminate(table, spark.createDataFrame([(1, inner)], "item_id long, text string")).first()
    assert "t4" not in out["text"].split() and out["n_chars"] == len(out["text"]) and "a39" in out["text"] and "b0" in out["text"]


def test_packing(docs):
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    out = packing.pack(docs, queries.tokenizer_path()).collect()
    want = brute.pieces([t for t in TEXTS if t[0] != 6], tokenizer)
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in out if r["doc_id"] != 6}
    assert got == want and sum(r["doc_id"] == 6 for r in out) == 2
    assert packing.pack(none_of(docs), queries.tokenizer_path()).count() == 0


def test_packing_in_rounds(spark):
    """Many small tasks leave underfull bins that the tree has to merge."""
    table = spark.range(3000).repartition(64).select(F.col("id").alias("doc_id"), F.repeat(F.lit("to be "), (F.col("id") % 700 + 1).cast("int")).alias("text"))
    out = packing.pack(table, queries.tokenizer_path(), bins_per_task=20).collect()
    assert len(out) == 3000
    fill = {}
    for r in out:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in fill.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:])) and sum(n for _, n in own) <= 4096
    assert len(fill) <= 1.03 * -(-sum(r["length"] for r in out) // 4096)


def test_best_fit_never_overfills():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 4097, 500)
    bins, offsets, n = packing.best_fit(sizes, 4096)
    assert n >= sizes.sum() / 4096 and np.bincount(bins, weights=sizes).max() <= 4096
    for a, b in combinations(range(80), 2):
        if bins[a] == bins[b]:
            assert offsets[a] + sizes[a] <= offsets[b] or offsets[b] + sizes[b] <= offsets[a]


def test_lines(docs):
    got = lines.drop_repeated_lines(docs).collect()
    want = brute.kept_lines([(d if d is not None else 1 << 62, t) for d, t in TEXTS])
    assert len(got) == len(TEXTS)
    for r in got:
        assert (r["n_lines"], r["n_dropped"], r["kept"]) == want[r["doc_id"] if r["doc_id"] is not None else 1 << 62]
    assert lines.drop_repeated_lines(none_of(docs)).count() == 0


def test_the_largest_id_is_an_id(spark):
    line = "a line of both of them"
    table = spark.createDataFrame([((1 << 63) - 1, line), (None, line), (None, line), (-(1 << 63), "own words here")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_dropped"]) for r in lines.drop_repeated_lines(table).collect())
    assert got == [("-9223372036854775808", 0), ("9223372036854775807", 0), ("None", 1), ("None", 1)]


def test_lines_over_many_shards(spark):
    rng = random.Random(2)
    docs = [(i, "\n".join(f"Line number {rng.randint(0, 400)} of it" for _ in range(rng.randint(0, 9)))) for i in range(200)]
    want = brute.kept_lines(docs)
    for r in lines.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), shard_lines=50).collect():
        assert (r["n_lines"], r["n_dropped"], r["kept"]) == want[r["doc_id"]]


def test_toxicity_cases(spark, docs):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    for own in (labels, none_of(labels), labels.where("toxic = 1")):
        lexicon = toxicity.learn(docs, own)
        out = toxicity.score(docs, lexicon).collect()
        assert len(out) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.drop_toxic(docs, none_of(labels)).count() == len(TEXTS)
    assert toxicity.score(none_of(docs), lexicon).count() == 0


def test_lexicon_folds_and_excepts():
    lexicon = toxicity.Lexicon({"clown ": 5.0, "moro": 4.0}, (-3.0, 2.0, 1.0, 0.0))
    automaton = lexicon.automaton()
    plain = toxicity.score_text(lexicon, automaton, "you clown")
    assert plain > 0.5
    assert toxicity.score_text(lexicon, automaton, "you сl0wn") == plain == toxicity.score_text(lexicon, automaton, "YOU  ｃlown!"[:-1] + ".")
    assert toxicity.score_text(lexicon, automaton, "a clown fish") < 0.1
    assert toxicity.score_text(lexicon, automaton, "clownish") < 0.1 < toxicity.score_text(lexicon, automaton, "morons")
    assert toxicity.score_text(lexicon, automaton, "clown " + LONG) < plain
    assert toxicity.folded("CLOWN!! c!own sc|um pa$ta$$$ @ll!") == ["clown", "ciown", "scium", "pasta", "all"]
    loose = {"loser ": 7.7, "lose": 4.4, "clow": 5.0, "clown ": 4.0, "clowns ": 5.0, "scum ": 3.0}
    assert toxicity.without_loose_stems(loose) == {k: w for k, w in loose.items() if k != "lose"}


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "\\### Assistant: </turn> ok"), (1, 1, "assistant", "<next/>\\\n##"), (1, 2, "assistant", None), (1, 2, "assistant", None),
        (1, None, "sys:tem\\#", "first"), (2, 5, None, ""), (None, 1, "assistant", "x"), (3, 0, "assistant", "</turn>\n### user:\n"),
        *((4, i, "user" if i % 3 else "assistant", f"t{i} é#" * 3) for i in range(chat.STEP + 1)),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("pieces", F.lit(1))
    parsed = chat.parse_conversations(chat.format_conversations(table))
    for r in chat.with_masked_text(parsed).collect():
        own = sorted(((-1 if t is None else t), role or "", text or "") for c, t, role, text in rows if c == r["conv_id"])
        assert [(x["role"], x["text"]) for x in r["turns"]] == [(role, text) for _, role, text in own]
        assert r["masked"] == "".join(text for _, role, text in own if role == "assistant")
        cut = [r["formatted"][m["start"] : m["start"] + m["length"]] for m in r["loss_mask"]]
        assert ["".join(x[1] if x.startswith("\\") else x for x in __import__("re").findall(r"(?s)\\.|[^\\]+", c)) for c in cut] == [t for _, role, t in own if role == "assistant"]
    assert chat.parse_conversations(chat.format_conversations(none_of(table))).count() == 0


def test_chat_long_roles(spark):
    """Roles of a hundred thousand characters, with everything that is escaped in them."""
    roles = ["r" * 100_000, ":\\#" * 30_000, "assistant"]
    rows = [(1, i, role, f"text {i}") for i, role in enumerate(roles)] + [(2, 0, "assistant", "long \\ # " * 20_000), (2, 1, "assistant", "b"), (2, 2, "user", "c" * 9_000), (2, 3, "assistant", "</turn>")]
    parsed = chat.with_masked_text(chat.parse_conversations(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    got = {r["conv_id"]: r for r in parsed.collect()}
    assert [t["role"] for t in got[1]["turns"]] == roles and got[1]["masked"] == "text 2"
    assert got[2]["masked"] == "long \\ # " * 20_000 + "b</turn>"


def test_the_mask_decides_what_is_read(spark):
    rows = [(1, 0, "assistant", "abc"), (1, 1, "user", "def")]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    moved = formatted.withColumn("loss_mask", F.transform("loss_mask", lambda m: F.struct(m["turn"], (m["start"] + 1).alias("start"), m["length"])))
    assert chat.with_masked_text(moved).first()["masked"] != "abc" == chat.with_masked_text(formatted).first()["masked"]


def test_urls(spark):
    rows = [
        (1, None), (2, "no scheme"), (3, "HTTP://A.Example.ORG/es/x?y"), (4, "http://example.org/en/12#f"), (5, "x://org"), (6, "x://org/"), (7, "x://bad.host.net/p?q"),
        (8, "x://y.com/fr/a://b"), (9, "x://notorg/es/"), (9, "x://notorg/es/"), (10, "x://?q"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("n", F.lit(1))
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = {r["page_id"]: r for r in urls.judge(pages, none).collect()}
    assert urls.judge(pages, none).count() == len(rows) and urls.judge(none_of(pages), none).count() == 0
    assert (got[1]["host"], got[1]["path"], got[1]["verdict"]) == ("", "", "allow")
    assert (got[3]["host"], got[3]["path"], got[3]["rule"], got[3]["verdict"]) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[4]["rule"] == "example.org/en/1" and got[5]["rule"] is None and got[6]["rule"] == "org/" and got[8]["rule"] == "com/fr/" and got[9]["rule"] is None
    many = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("x://"), F.when(F.col("id") % 2 == 0, "bad").otherwise("good"), F.lit(".host.net/p")).alias("url"))
    seen = many.select("page_id", (F.col("page_id") % 2 == 0).alias("bad"))
    assert {r["verdict"] for r in urls.judge(many, seen).where("page_id % 2 = 0").collect()} == {"block"}
    assert {r["verdict"] for r in urls.judge(many, seen).where("page_id % 2 = 1").collect()} == {"allow"}


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href=/a>Menu</a></ul></nav><div class="cookie-notice">We use cookies, do you agree to that? Long enough text here.</div>
%s<aside class="sidebar"><p>Popular now, a rather long teaser text that goes on and on.</p></aside>
<section id="comments"><article><p>First! What a very long comment this is, longer than the article.</p></article></section>
<form><label>Mail</label><input></form><script>var a = "<p>no</p>";</script><footer>&copy; 2020</footer></body></html>"""
TEXT = "<h2>A &lt;title&gt;</h2><p>One&nbsp;two<br>three <b>four</b>\n five<p>Short.<div class=ad>Buy!</div><ul><li>x<li>y</ul>"
BLOCKS = ["A <title>", "One two three four five", "Short.", "x", "y"]


@pytest.mark.parametrize("wrapped", ["<article>%s</article>", "<main>%s</main>", "<div class='story'>%s" + "<p>" + "More words of the story. " * 9 + "</div>"])
def test_main_text(wrapped):
    got = html_text.main_blocks(PAGE % (wrapped % TEXT))
    assert got[: len(BLOCKS)] == BLOCKS and len(got) <= len(BLOCKS) + 1 and not any("comment" in b or "teaser" in b for b in got)


LONG_PARAGRAPH = "A long paragraph of the article with plenty of words in it, so that it is dense. " * 3


@pytest.mark.parametrize(
    "page, want",
    [
        ('<div class="content has-sidebar"><h1>Head</h1><p>%s<p>%s</div><p>&copy; 2020 foo', ["Head", "@", "@"]),
        ("<p>%s</p><p>%s</p><p>%s</p><article><p>teaser</p></article>", ["@", "@", "@"]),
        ("<article><p>one %s</p></article><article><p>two %s</p></article>", ["one @", "two @"]),
        ("<main><h1>Head</h1><p>Lead.</p><article><p>%s</p></article></main>", ["Head", "Lead.", "@"]),
        ("<article><header><h1>Title</h1></header><p>%s</p></article>", ["Title", "@"]),
        ("<p>%s</p><!-- x <p>tail", ["@"]),
        ('<form action="/"><div><h2>Head</h2><p>%s</p><p>%s</p><p>Short.</p></div></form>', ["Head", "@", "@", "Short."]),
        ('<article><p>%s</p><div class="comments"><p>%s</p><p>%s</p></div></article>', ["@"]),
        ("<article><p>%s</p></article><footer><p>A footer that has quite some words in it, too.</p></footer>", ["@"]),
    ],
)
def test_what_decides_is_density(page, want):
    text = LONG_PARAGRAPH.strip()
    got = html_text.main_blocks(page.replace("%s", text))
    assert got == [w.replace("@", text) for w in want] or (want == ["@", "@", "@"] and got[:3] == [text] * 3)


def test_pages_against_regular_expressions(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op3_html_text(spark, sf).collect()
    assert len(got) == len(pages)
    compared = [(r["text"], brute.article_text(pages[r["page_id"]])) for r in got]
    assert all(a == b for a, b in compared if b is not None) and sum(b is not None for _, b in compared) > 10


def test_html_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "just text &amp; more"), (4, "u", "<![foo[<p>x</p>"), (5, "u", "<p>" * 2000 + "deep"), (5, "u", "<p>" * 2000 + "deep"), (6, "u", "<p>long " + "word " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    assert html_text.extract(pages).count() == len(rows) and html_text.extract(none_of(pages)).count() == 0
    assert got[1]["text"] == got[2]["text"] == "" and got[3]["text"] == "just text & more" and got[5]["text"] == "deep" and got[6]["n_chars"] == len(got[6]["text"]) == 250_004


def test_licences(spark):
    rows = [
        (1, "a/b/c/f.py", "code", False), (2, "a/LICENSE", "Released under the MIT License.", True), (3, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0.", True),
        (4, "a/x.py", None, None), (5, None, "", False), (6, "top.py", "no such word", False), (7, "a/b/own.py", "# This work is licensed under CC BY-NC 4.0.\ncode", False),
        (7, "a/b/own.py", "# This work is licensed under CC BY-NC 4.0.\ncode", False), (8, "a/b/d/g.py", "x " * 40_000, False),
    ]
    files = spark.createDataFrame(rows, "id long, path string, text string, is_licence_file boolean").withColumn("statement", F.lit(0)).withColumn("dir", F.lit(0))
    got = {r["id"]: (r["licence"], r["origin"], r["from_path"]) for r in licenses.scan(files).collect()}
    assert licenses.scan(files).count() == len(rows) and licenses.scan(none_of(files)).count() == 0
    assert got[1] == got[8] == ("Apache-2.0", "inherited", "a/b/LICENSE") and got[4] == ("MIT", "inherited", "a/LICENSE")
    assert got[5] == got[6] == (None, "none", None) and got[7] == ("CC-BY-NC-4.0", "own", "a/b/own.py")


def test_whole_licence_texts(spark):
    """A licence file is read whole, wrapped as it comes; other files by their leading comment."""
    wrap = lambda text: "\n".join(text[i : i + 70] for i in range(0, len(text), 70))
    mit, bsd, apache = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["BSD-3-Clause"], licenses.TEMPLATES["Apache-2.0"]
    rows = [
        (1, "a/LICENSE", "Copyright (c) 2020 Someone\n\n" + wrap(mit[2]), True), (2, "b/LICENSE", wrap(bsd[2]), True), (3, "c/LICENSE", mit[1], True), (4, "d/LICENSE", bsd[1], True),
        (5, "e/x.c", "/*\n * " + apache[1].replace(". ", ".\n * ") + "\n */\nint main;", False), (6, "f/y.py", "# " + mit[1] + "\n#\ncode", None),
        (7, "g/z.py", "code\n# " + mit[1] + "\n", False), (8, "h/LICENSE", "All rights are ours. " * 20_000, True), (9, "i/w.py", "#" * 300_000 + "\n" + "# x\n" * 50_000, False),
        (10, "j/v.c", "/* never closed " + "* " * 100_000, False), (11, "k/LICENSE", mit[0], True), (12, "k/COPYING", licenses.TEMPLATES["GPL-3.0"][0], True), (13, "k/f.py", "code", False),
    ]
    files = spark.createDataFrame(rows, "id long, path string, text string, is_licence_file boolean").withColumn("parts", F.lit(0)).withColumn("row", F.lit(0))
    got = {r["id"]: r["licence"] for r in licenses.scan(files).collect()}
    assert [got[i] for i in range(1, 7)] == ["MIT", "BSD-3-Clause", "MIT", "BSD-3-Clause", "Apache-2.0", "MIT"]
    assert [got[i] for i in range(7, 11)] == [None] * 4
    assert got[13] == "GPL-3.0"  # both files are as close as can be; the smaller path counts
