"""Everything after retrieval, for many queries at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscan.functions.ranking import top_hits, top_k
from shelfscan.functions.text import collapse_spaces, display, tokens, words
from shelfscan.operators.index import DOCUMENT, Encoder, embed, term_counts
from shelfscan.operators.retrieval import bm25_topk, dense_topk, query_terms
from shelfscan.session import cut_lineage

# Words ignored when matching a query against titles.
MATCH_STOPWORDS = ["with", "for", "the", "and", "under", "in", "of", "to", "a", "an"]
# Words ignored by the pass-through intent.
INTENT_STOPWORDS = ["with", "for", "the", "and", "under"]

SIMILARITY_THRESHOLD = 0.58
# First characters by which completions of equal use are put in order, before their keys.
ORDER_CHARS = 64


# ── fusion, thresholds, ranks ────────────────────────────────────────────


def rank_hits(scored: DataFrame, k: int | None = None) -> DataFrame:
    """Rank within each query: score descending, then product id."""
    if k is not None:
        return top_hits(scored, k)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("product_id"))
    return scored.withColumn("rank", F.row_number().over(w))


def fuse_ranks(semantic: DataFrame, keyword: DataFrame, k: int = 10, w_semantic: float = 0.7, w_keyword: float = 0.3) -> DataFrame:
    """Weighted fusion of two ranked lists.

    Position i (from zero) of a list of n is worth ``(1 - i/n) * weight``; a
    product missing from one list gets nothing from it.
    """

    def worth(hits: DataFrame, weight: float) -> DataFrame:
        n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
        return hits.select("query_id", "product_id", ((1 - (F.col("rank") - 1) / n) * weight).alias("score"))

    both = worth(semantic, w_semantic).unionByName(worth(keyword, w_keyword))
    return top_hits(both.groupBy("query_id", "product_id").agg(F.sum("score").alias("score")), k)


def above_threshold(hits: DataFrame, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """Hits whose retrieval score reaches the threshold."""
    return hits.filter(F.coalesce("score", F.lit(0.0)) >= threshold)


def paginate(hits: DataFrame, page: int, page_size: int = 20, threshold: float | None = None) -> DataFrame:
    """One page of every query's list, with totals.

    ``page * page_size + 50`` hits are considered, as an index would be asked
    for; the threshold is applied before counting.
    """
    page, page_size = max(1, page), min(max(1, page_size), 50)
    found = hits.filter(F.col("rank") <= page * page_size + 50)
    if threshold is not None:
        found = above_threshold(found, threshold)
    w = Window.partitionBy("query_id")
    placed = found.withColumn("position", F.row_number().over(w.orderBy("rank", "product_id"))).withColumn(
        "total_results", F.count(F.lit(1)).over(w)
    )
    pages = F.greatest(F.lit(1), F.ceil(F.col("total_results") / page_size)).cast("int")
    first = (page - 1) * page_size
    return placed.filter((F.col("position") > first) & (F.col("position") <= first + page_size)).select(
        "query_id", "product_id", "position", "score", "total_results", pages.alias("total_pages"), F.lit(page).alias("page")
    )


def sort_modes(rows: DataFrame) -> DataFrame:
    """Rank of each hit under every offered ordering; missing values count as 0."""
    w = Window.partitionBy("query_id")

    def place(col: str, desc: bool) -> Column:
        key = F.coalesce(F.col(col), F.lit(0.0))
        return F.row_number().over(w.orderBy(key.desc() if desc else key.asc(), F.col("product_id")))

    return rows.select(
        "query_id", "product_id",
        place("score", True).alias("by_relevance"),
        place("selling_price", False).alias("by_price_asc"),
        place("selling_price", True).alias("by_price_desc"),
        place("average_rating", True).alias("by_rating"),
    )


# ── enrichment and filters ───────────────────────────────────────────────


def enrich_hits(hits: DataFrame, details: DataFrame) -> DataFrame:
    """Left join product details onto hits, field by field with fallbacks."""
    d = details.select(
        "product_id",
        *[F.col(c).alias(f"_{c}") for c in
          ("product_name", "searchable_text", "attribute_summary", "brand_name", "category_path", "selling_price", "average_rating", "review_count")],
    )
    named = F.nullif(F.col("_product_name"), F.lit(""))
    return hits.join(d, "product_id", "left").select(
        *hits.columns,
        F.coalesce(named, F.concat(F.lit("Product "), F.col("product_id")), F.lit("Unnamed Product")).alias("product_name"),
        F.coalesce(F.nullif(F.col("_searchable_text"), F.lit("")), F.col("_attribute_summary"), F.lit("")).alias("description"),
        F.coalesce("_brand_name", F.lit("")).alias("brand_name"),
        F.coalesce("_category_path", F.lit("")).alias("category_path"),
        F.coalesce("_attribute_summary", F.lit("")).alias("attribute_summary"),
        F.col("_selling_price").alias("selling_price"),
        F.col("_average_rating").alias("average_rating"),
        F.coalesce("_review_count", F.lit(0)).alias("review_count"),
    )


def products_by_id(products: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the listed ids."""
    return products.join(ids.select("product_id").distinct(), "product_id", "left_semi")


def intent_filter(rows: DataFrame, intents: DataFrame) -> DataFrame:
    """Keep rows that satisfy their query's intent.

    category: substring of the path; brand: equal; price: at most the maximum
    or unknown; every attribute value: substring of the attribute summary.
    Letter case is ignored.
    """
    i = intents.select(
        "query_id", F.lower("category").alias("_cat"), F.lower("brand").alias("_brand"),
        F.col("price_max").alias("_max"), F.col("filters").alias("_filters"),
    )
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    wanted = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    values = F.coalesce(F.map_values("_filters"), F.array().cast("array<string>"))
    return (
        rows.join(i, "query_id", "left")
        .filter(F.coalesce(~wanted("_cat"), F.lit(True)) | F.contains(low("category_path"), F.col("_cat")))
        .filter(F.coalesce(~wanted("_brand"), F.lit(True)) | (low("brand_name") == F.col("_brand")))
        .filter(F.col("_max").isNull() | F.col("selling_price").isNull() | (F.col("selling_price") <= F.col("_max")))
        .filter(F.forall(values, lambda v: F.contains(low("attribute_summary"), F.lower(v))))
        .select(*rows.columns)
    )


def request_filter(rows: DataFrame, requests: DataFrame, intents: DataFrame | None = None) -> DataFrame:
    """Explicit request bounds; a missing value counts as 0, a bound of 0 is no bound.

    Category, brand and maximum price of the request win over the intent's.
    """
    r = requests.select("query_id", *[F.col(c).alias(f"_{c}") for c in ("category", "brand", "min_price", "max_price", "min_rating")])
    if intents is not None:
        r = r.join(
            intents.select("query_id", F.col("category").alias("_ic"), F.col("brand").alias("_ib"), F.col("price_max").alias("_ip")),
            "query_id", "full_outer",
        )
        r = (
            r.withColumn("_category", F.coalesce(F.nullif("_category", F.lit("")), "_ic"))
            .withColumn("_brand", F.coalesce(F.nullif("_brand", F.lit("")), "_ib"))
            .withColumn("_max_price", F.coalesce(F.nullif("_max_price", F.lit(0.0)), "_ip"))
        )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    unset = lambda c: zero(c) == 0
    text_unset = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return (
        rows.join(r, "query_id", "left")
        .filter(text_unset("_category") | (F.col("category_path") == F.col("_category")))
        .filter(text_unset("_brand") | (F.col("brand_name") == F.col("_brand")))
        .filter(unset("_max_price") | (zero("selling_price") <= F.col("_max_price")))
        .filter(unset("_min_price") | (zero("selling_price") >= F.col("_min_price")))
        .filter(unset("_min_rating") | (zero("average_rating") >= F.col("_min_rating")))
        .select(*rows.columns)
    )


# ── rerank and calibration ───────────────────────────────────────────────


def term_weights(queries: DataFrame, docs: DataFrame, query: str = "query", text: str = "searchable_text") -> DataFrame:
    """(query_id, weights array<struct<term, idf>>); an unseen term has the largest idf."""
    q_terms = query_terms(queries, query)
    counts = cut_lineage(term_counts(docs, q_terms, text))
    df = counts.where(F.col("term") != DOCUMENT)
    n = counts.where(F.col("term") == DOCUMENT).select(F.coalesce(F.max("df"), F.lit(0)).alias("n")).select("n").scalar()
    freq = F.coalesce("df", F.lit(0))
    idf = F.log(1 + (n - freq + 0.5) / (freq + 0.5))
    return (
        q_terms.join(df, "term", "left")
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("term", idf.alias("idf")))).alias("weights"))
    )


def coverage_score(weights: Column, doc_tokens: Column) -> Column:
    """Share of the query's idf weight whose terms the document fields hold."""
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda acc, w: acc + w["idf"])
    held = F.filter(weights, lambda w: F.array_contains(doc_tokens, w["term"]))
    return F.try_divide(total(held), total(weights))


def rerank(rows: DataFrame, weights: DataFrame, top_n: int = 10, score: Column | None = None) -> DataFrame:
    """Re-order hits by a second score, the retrieval score standing in when it is missing.

    ``score`` is any column over the hit rows; by default term coverage over
    name, category and attributes. Equal scores keep the retrieval order.
    """
    joined = rows.join(weights, "query_id", "left")
    if score is None:
        fields = tokens(F.concat_ws(" ", "product_name", "category_path", "attribute_summary"))
        score = coverage_score(F.col("weights"), fields)
    scored = joined.withColumn("rerank_score", F.round(F.coalesce(score, F.col("score"), F.lit(0.0)), 6)).drop("weights")
    scored = scored.withColumnRenamed("rank", "retrieval_rank")
    return top_k(scored, ["query_id"], [F.col("rerank_score").desc(), F.col("retrieval_rank")], top_n)


def calibrate(rows: DataFrame, queries: DataFrame, query: str = "query") -> DataFrame:
    """Match scores in [0.60, 0.98] from rank, relative score and title/category words."""
    q = queries.select(
        "query_id",
        F.filter(tokens(F.col(query)), lambda t: ~t.isin(MATCH_STOPWORDS) & (F.length(t) > 1)).alias("_toks"),
    )
    w = Window.partitionBy("query_id")
    total = F.count(F.lit(1)).over(w)
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    hits_in = lambda c: F.size(F.filter("_toks", lambda t: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), t)))
    n_toks = F.size("_toks")
    kw = F.when(n_toks > 0, (hits_in("product_name") * 1.5 + hits_in("category_path")) / F.greatest(n_toks, F.lit(1))).otherwise(0.0)
    place = (F.row_number().over(w.orderBy("rank", "product_id")) - 1) / F.greatest(total - 1, F.lit(1))
    base = rows.join(q, "query_id").select(*rows.columns, kw.alias("_kw"), place.alias("_place"), lo.alias("_lo"), hi.alias("_hi"))
    rel = F.when(F.col("_hi") > F.col("_lo"), F.try_divide(F.col("score") - F.col("_lo"), F.col("_hi") - F.col("_lo"))).otherwise(
        1 - F.col("_place") * 0.3
    )
    top = F.least(0.88 + 0.08 * F.col("_kw"), F.lit(0.97))
    value = 0.62 + (rel * 0.4 + (1 - F.col("_place")) * 0.6) * (top - 0.62) + 0.03 * F.col("_kw")
    bounded = F.least(F.greatest(value, F.lit(0.60)), F.lit(0.98))
    return base.withColumn("match_exact", F.round(bounded, 6)).withColumn("match_score", F.round(bounded, 3)).drop(
        "_kw", "_place", "_lo", "_hi"
    )


# ── presentation ─────────────────────────────────────────────────────────


def result_table(rows: DataFrame, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """Display rows: leaf category, formatted price, raw score, relevance status, best-match flag."""
    leaf = F.trim(F.element_at(F.split(F.coalesce("category_path", F.lit("")), ">"), -1))
    price = F.concat(F.lit("₹"), F.format_number(F.coalesce("selling_price", F.lit(0.0)), 2))
    return rows.select(
        "query_id", "rank", "product_id", "product_name", leaf.alias("category_leaf"), price.alias("price"),
        F.round("score", 4).alias("raw_score"),
        F.when(F.col("score") >= threshold, "Relevant Match").otherwise("Low Match (Filtered)").alias("relevance_status"),
        (F.col("rank") == 1).alias("best_match"),
    )


def result_digest(rows: DataFrame, queries: DataFrame, top_n: int = 5) -> DataFrame:
    """Text summary of each query's first hits, with the no-match message as fallback."""
    line = F.concat(
        F.lit("- "), display(F.col("product_name"), "Unknown"), F.lit(" | Category: "), display(F.col("category_path"), "N/A"),
        F.lit(" | Price: $"), display(F.col("selling_price"), "N/A"), F.lit(" | Rating: "), display(F.col("average_rating"), "N/A"),
    )
    first = F.when(F.col("rank") <= top_n, F.struct("rank", line.alias("line")))
    parts = F.transform(F.sort_array(F.collect_list(first)), lambda s: s["line"])
    digests = rows.groupBy("query_id").agg(
        F.array_join(parts, "\n").alias("lines"),
        F.count(F.lit(1)).alias("found"),
        F.round(F.avg(F.coalesce("average_rating", F.lit(0.0))), 6).alias("average_rating"),
    )
    message = F.concat(F.lit("Found "), F.col("found").cast("string"), F.lit(" products matching '"), F.col("query"), F.lit("'."))
    return queries.select("query_id", "query").join(digests, "query_id", "left").select(
        "query_id",
        F.coalesce("lines", F.lit("I couldn't find any products matching your search. Try different search terms.")).alias("digest"),
        F.coalesce(message, F.lit("")).alias("message"),
        F.coalesce("average_rating", F.lit(0.0)).alias("average_rating"),
    )


def stage_funnel(queries: DataFrame, **stages: DataFrame) -> DataFrame:
    """Rows per query after each named stage; the stages are counted in one aggregate."""
    frames = [df.select("query_id", F.lit(name).alias("stage")) for name, df in stages.items()]
    rows = queries.select("query_id", F.lit(None).cast("string").alias("stage"))
    for f in frames:
        rows = rows.unionByName(f)
    return rows.groupBy("query_id").agg(*[F.count_if(F.col("stage") == name).alias(name) for name in stages])


def zero_result_queries(queries: DataFrame, hits: DataFrame, threshold: float | None = None) -> DataFrame:
    """Queries left with nothing, and why."""
    good = hits if threshold is None else above_threshold(hits, threshold)
    had_any = hits.select("query_id").distinct().withColumn("_any", F.lit(True))
    return queries.join(good.select("query_id").distinct(), "query_id", "left_anti").join(had_any, "query_id", "left").select(
        "query_id", "query", F.when(F.col("_any"), "below threshold").otherwise("no results").alias("reason")
    )


def benchmark_sweep(queries: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """Per query: top relevant product, top score, status and number of relevant hits."""
    ok = F.col("score") >= threshold
    best = rows.groupBy("query_id").agg(
        F.min_by(F.when(ok, F.col("product_name")), F.when(ok, F.col("rank"))).alias("top_name"),
        F.max("score").alias("top_score"),
        F.count_if(ok).alias("relevant"),
    )
    n = F.coalesce("relevant", F.lit(0))
    return queries.join(best, "query_id", "left").select(
        "query_id", "query",
        F.when(n > 0, F.concat(F.lit("Passed ("), n.cast("string"), F.lit(" items)"))).otherwise("No Match (Threshold Filtered)").alias("status"),
        F.coalesce("top_name", F.lit("None (Filtered Out)")).alias("top_product"),
        F.round(F.coalesce("top_score", F.lit(0.0)), 4).alias("top_raw_score"),
        n.alias("relevant_results"),
    )


# ── query understanding ──────────────────────────────────────────────────


def phrase_dictionary(products: DataFrame) -> DataFrame:
    """(kind, phrase, value) of a catalog: its categories, brands and attribute values; phrases in lower case."""

    def of(kind: Column, value: Column, rows: DataFrame) -> DataFrame:
        named = rows.select(kind.alias("kind"), F.lower(collapse_spaces(value)).alias("phrase"), value.alias("value"))
        return named.where("phrase <> ''").distinct()

    attributes = products.select(F.explode(F.split("attribute_summary", ", ")).alias("a")).where(F.contains("a", F.lit(": ")))
    name, value = F.lower(F.substring_index("a", ": ", 1)), F.substring(F.col("a"), F.length(F.substring_index("a", ": ", 1)) + 3, F.length("a"))
    return (
        of(F.lit("category"), F.col("category_path"), products).unionByName(of(F.lit("brand"), F.col("brand_name"), products)).unionByName(of(name, value, attributes))
    )


def _opening(phrase_words: Column) -> Column:
    """What a phrase begins with: its first two words, or its only one."""
    return F.array_join(F.slice(phrase_words, 1, 2), " ")


def phrase_matches(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(query_id, start, n, kind, value) of every dictionary phrase in ``_words``.

    A query looks up the openings at each of its places, and is cut only to
    lengths that phrases of that opening have. So a phrase of a thousand words
    costs nothing where its first two are absent, and texts are put together
    only where a phrase of that length may stand. Places and words are many more
    than their file tells, so the joins are hinted: none of them is broadcast.
    """
    entries = dictionary.select("kind", "value", "phrase", F.split("phrase", " ").alias("_parts"))
    entries = entries.select("kind", "value", "phrase", F.size("_parts").alias("n"), _opening(F.col("_parts")).alias("opening"))
    lengths = entries.groupBy("opening").agg(F.collect_set("n").alias("lengths"))  # as many as phrases of one opening differ in length

    def openings(word: Column, i: Column) -> Column:
        after = F.get("_words", i + 1)
        return F.array_compact(F.array(word, F.when(after.isNotNull(), F.concat(word, F.lit(" "), after))))

    places = queries.select("query_id", F.posexplode(F.transform("_words", openings)).alias("start", "openings"))
    found = places.select("query_id", "start", F.explode("openings").alias("opening")).join(lengths.hint("shuffle_hash"), "opening")
    found = found.select("query_id", "start", "opening", F.explode("lengths").alias("n"))
    # the words come back only for places where a phrase may stand
    found = found.join(queries.select("query_id", "_words").hint("merge"), "query_id").where("start + n <= size(_words)")
    spans = found.select("query_id", "start", "n", "opening", F.array_join(F.slice("_words", F.col("start") + 1, F.col("n")), " ").alias("phrase"))
    return spans.join(entries, ["opening", "n", "phrase"]).select("query_id", "start", "n", "kind", "value")


def query_intent(queries: DataFrame, dictionary: DataFrame, query: str = "query") -> DataFrame:
    """Rule-based intent: price limit by pattern, other fields by dictionary.

    ``dictionary``: (kind, phrase, value), phrase in lower case. Per kind the
    longest matching phrase wins, then the earliest. ``category`` and
    ``brand`` have their own columns, other kinds go to ``filters``. The
    rewritten query is the query without the matched spans.
    """
    limit_pattern = r"\b(?:under|below|less than)\s+[$₹]?([0-9]+(?:\.[0-9]+)?)"
    low = F.lower(collapse_spaces(F.col(query)))
    q = queries.select(
        "query_id", F.col(query).alias("original_query"),
        F.regexp_extract(low, limit_pattern, 1).alias("_limit"),
        words(F.regexp_replace(low, limit_pattern, " ")).alias("_words"),
    )
    # a hot phrase is reduced per query and kind in the map tasks
    best = (
        phrase_matches(q, dictionary)
        .groupBy("query_id", "kind")
        .agg(F.min(F.struct((-F.col("n")).alias("n"), "start", "value")).alias("m"))
    )
    matches = best.groupBy("query_id").agg(
        F.collect_list(F.struct("kind", F.col("m.value").alias("value"), F.col("m.start").alias("start"), (-F.col("m.n")).alias("n"))).alias("ms")
    )
    none = F.array().cast("array<struct<kind:string,value:string,start:int,n:int>>")
    ms = F.coalesce("ms", none)
    value_of = lambda kind: F.get(F.filter(ms, lambda m: m["kind"] == kind), F.lit(0))["value"]
    rest = F.filter("_words", lambda w, i: ~F.exists(ms, lambda m: (i >= m["start"]) & (i < m["start"] + m["n"])))
    rewritten = F.array_join(rest, " ")
    others = F.array_sort(F.filter(ms, lambda m: ~m["kind"].isin("category", "brand")))
    return q.join(matches.hint("merge"), "query_id", "left").select(
        "query_id", "original_query",
        F.when(rewritten == "", F.col("original_query")).otherwise(rewritten).alias("rewritten_query"),
        value_of("category").alias("category"), value_of("brand").alias("brand"),
        F.expr("try_cast(nullif(_limit, '') as double)").alias("price_max"),
        F.map_from_entries(F.transform(others, lambda m: F.struct(m["kind"], m["value"]))).alias("filters"),
    )


_INTENT_FIELDS = "rewritten_query:string,category:string,brand:string,price_max:string,filters:map<string,string>"


def parse_intent_json(rows: DataFrame, query: str = "query", response: str = "response") -> DataFrame:
    """Intent from a model's reply: code fences dropped, a reply that is not one object pass the query through."""
    bare = F.regexp_replace(F.col(response), "```(?:json)?", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^\s+|\s+$", ""), r"`+$", "")
    # as the only element of an array, so that text after the object makes the reply malformed
    listed = F.from_json(F.concat(F.lit("["), bare, F.lit("]")), f"array<struct<{_INTENT_FIELDS}>>", {"mode": "PERMISSIVE", "allowSingleQuotes": "false"})
    parsed = F.when(F.size(listed) == 1, F.get(listed, F.lit(0)))
    p = rows.withColumn("_p", parsed)
    return p.select(
        "query_id", F.col(query).alias("original_query"),
        F.coalesce(F.nullif(F.col("_p.rewritten_query"), F.lit("")), F.col(query)).alias("rewritten_query"),
        F.col("_p.category").alias("category"), F.col("_p.brand").alias("brand"),
        F.expr("try_cast(_p.price_max as double)").alias("price_max"),
        F.coalesce(F.col("_p.filters"), F.create_map().cast("map<string,string>")).alias("filters"),
    )


def intent_tokens(query: Column) -> Column:
    """First six longer words of the pass-through intent."""
    return F.slice(F.filter(words(F.lower(query)), lambda w: (F.length(w) > 3) & ~w.isin(INTENT_STOPWORDS)), 1, 6)


def _uses(rows: DataFrame, query: str, name: str) -> DataFrame:
    """(name, uses): distinct lower-case texts and how often each occurs."""
    return rows.select(F.lower(collapse_spaces(F.col(query))).alias(name)).where(f"{name} <> ''").groupBy(name).agg(F.count(F.lit(1)).alias("uses"))


def suggest_prefixes(log: DataFrame, query: str = "query", n: int = 5, min_length: int = 2) -> DataFrame:
    """(prefix_key, n_chars, rank, completion_key, uses): the most used logged queries per prefix.

    Keys are MD5s: a text of length L makes L rows of a few numbers, never L
    prefixes, so long queries cost no more than their length. The log is
    reduced to distinct queries first, so a query asked by everyone still makes
    one row per prefix. Equal uses go by the completion's first characters, then
    by its key.
    """
    uses = _uses(log, query, "completion")
    keyed = uses.select(F.md5("completion").alias("completion_key"), "uses", "completion")
    rows = keyed.filter(F.length("completion") >= min_length).select(
        "completion_key", "uses", F.substring("completion", 1, ORDER_CHARS).alias("opening"),
        F.posexplode(F.transform(F.sequence(F.lit(min_length), F.length("completion")), lambda i: F.md5(F.substring(F.col("completion"), F.lit(1), i)))).alias("at", "prefix_key"),
    )
    best = top_k(rows, ["prefix_key"], [F.col("uses").desc(), F.col("opening"), F.col("completion_key")], n)
    return best.select("prefix_key", (F.col("at") + min_length).alias("n_chars"), "rank", "completion_key", "uses")


def suggest(typed: DataFrame, log: DataFrame, products: DataFrame, n: int = 5) -> DataFrame:
    """(typed, part, rank, suggestion, uses): what to offer for each typed text, in three parts.

    ``completions``: logged queries that begin with it; ``categories``: product
    categories that begin with it; ``related``: queries asked most often in the same sessions as
    its completions. ``log``: (session_id, query); ``products``: (category).
    """
    texts = _uses(log, "query", "text")
    asked = typed.select(F.lower(collapse_spaces(F.col("typed"))).alias("typed")).where("typed <> ''").distinct()
    # as many numbers as typed texts differ in length
    lengths = sorted(r["n"] for r in asked.select(F.length("typed").alias("n")).distinct().collect())

    def beginning(rows: DataFrame) -> DataFrame:
        """(typed, text, uses) by the key of the typed text; only prefixes of lengths that were typed are made."""
        fitting = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("text"))
        cut = rows.select("text", "uses", F.explode(F.transform(fitting, lambda n: F.substring(F.col("text"), F.lit(1), n))).alias("typed"))
        return cut.join(asked, "typed")

    def part(rows: DataFrame, name: str) -> DataFrame:
        best = top_k(rows, ["typed"], [F.col("uses").desc(), F.col("text")], n)
        return best.select("typed", F.lit(name).alias("part"), "rank", F.col("text").alias("suggestion"), "uses")

    completions = beginning(texts)
    offered = top_k(completions, ["typed"], [F.col("uses").desc(), F.col("text")], n).select("typed", "text")
    categories = beginning(_uses(products, "category", "text"))
    told = log.select("session_id", F.lower(collapse_spaces(F.col("query"))).alias("text")).where("text <> ''").distinct()
    sessions = told.join(offered, "text").select("typed", "session_id").distinct()
    together = sessions.join(told, "session_id").join(offered, ["typed", "text"], "left_anti")
    related = together.groupBy("typed", "text").agg(F.count(F.lit(1)).alias("uses"))
    return part(completions, "completions").unionByName(part(categories, "categories")).unionByName(part(related, "related"))


def _intent_mask(wants: tuple, facts: pd.DataFrame) -> np.ndarray:
    """:func:`intent_filter` for one query and the lower-case facts of a block of products."""
    category, brand, most, values = wants
    kept = np.ones(len(facts), dtype=bool)
    if category:
        kept &= facts["_path"].str.contains(category, regex=False).to_numpy(dtype=bool)
    if brand:
        kept &= (facts["_brand_name"] == brand).to_numpy(dtype=bool)
    if pd.notna(most):
        kept &= ~(facts["_price"] > most).to_numpy(dtype=bool)
    for value in values:
        kept &= facts["_attributes"].str.contains(value, regex=False).to_numpy(dtype=bool)
    return kept


def search_batch(
    queries: DataFrame, docs: DataFrame, top_k_hits: int = 20, top_n: int = 10, intents: DataFrame | None = None,
    dictionary: DataFrame | None = None, query_vectors: DataFrame | None = None, vectors: DataFrame | None = None,
    encoder: Encoder | None = None, score: Column | None = None,
) -> DataFrame:
    """Understand, rewrite, retrieve by words and by vectors, fuse, enrich, rerank: the answer to every query in one job.

    Each stage feeds the next: intents come from ``query_intent`` with the
    catalog's own phrases, the rewritten text is what is searched, encoded and
    reranked by, and both sides are encoded by the same encoder. What a caller
    has already (intents, vectors) can be passed in. A query retrieves only
    products that satisfy its intent, so a list is short only where no more
    products qualify.
    """
    if intents is None:
        intents = query_intent(queries, dictionary if dictionary is not None else phrase_dictionary(docs))
        intents = cut_lineage(intents)  # small, and read by every later stage
    asked = intents.select("query_id", F.coalesce(F.nullif("rewritten_query", F.lit("")), "original_query").alias("query"))
    query_vectors = embed(asked, text="query", id_col="query_id", encoder=encoder) if query_vectors is None else query_vectors
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    docs = docs.withColumns(
        {
            "_path": low("category_path"), "_brand_name": low("brand_name"), "_attributes": low("attribute_summary"),
            "_price": F.col("selling_price").cast("double"),
        }
    )
    facts = ["_path", "_brand_name", "_attributes", "_price"]
    vectors = embed(docs, encoder=encoder, keep=facts) if vectors is None else vectors.join(docs.select("product_id", *facts), "product_id")
    no_values = F.array().cast("array<string>")
    wishes = intents.select(
        "query_id", F.lower("category").alias("_category"), F.lower("brand").alias("_brand"), F.col("price_max").cast("double").alias("_most"),
        F.transform(F.coalesce(F.map_values("filters"), no_values), F.lower).alias("_values"),
    )
    narrowed = {"wants": ["_category", "_brand", "_most", "_values"], "facts": facts, "allow": _intent_mask}
    wishing = lambda rows: rows.join(wishes, "query_id", "left").withColumn("_values", F.coalesce("_values", no_values))
    lexical = bm25_topk(wishing(asked), docs, top_k_hits, **narrowed)
    dense = dense_topk(wishing(query_vectors), vectors, top_k_hits, **narrowed)
    fused = cut_lineage(fuse_ranks(dense, lexical, top_k_hits))
    found = enrich_hits(fused, docs.join(fused.select("product_id").distinct(), "product_id", "left_semi"))
    return rerank(found, term_weights(asked, docs), top_n, score)
