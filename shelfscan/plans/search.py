"""From hits to answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfscan.operators import search
from shelfscan.plans.ranking import hashed_vectors
from shelfscan.plans.registry import register
from shelfscan.plans.relevance import bm25_hits
from shelfscan.sources.fixtures import Tables

CUT = 14.0  # BM25 scores are not cosines; a cut that keeps part of the fixture hits

ENRICHED = """(SELECT query_id, product_id, rank, score, coalesce(nullif(product_name, ''), 'Product ' || product_id) AS product_name,
      coalesce(brand_name, '') AS brand_name, coalesce(category_path, '') AS category_path, coalesce(attribute_summary, '') AS attribute_summary,
      selling_price, average_rating FROM v_bm25_hits LEFT JOIN v_catalog USING (product_id))"""


def enriched(t: Tables, k: int = 20):
    return search.enrich_hits(bm25_hits(t, k), t["v_catalog"])


@register("threshold", f"SELECT query_id, product_id, rank, score FROM v_bm25_hits WHERE score >= {CUT}")
def threshold(t: Tables):
    """R8."""
    return search.above_threshold(bm25_hits(t), CUT)


@register(
    "paginate",
    f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM v_bm25_scores),
    f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position, count(*) OVER (PARTITION BY query_id) AS total_results
      FROM h WHERE rank <= 2 * 5 + 50 AND score >= {CUT})
    SELECT query_id, product_id, position::INT AS position, score, total_results, CAST(greatest(1, ceil(total_results / 5.0)) AS INT) AS total_pages, 2 AS page
    FROM f WHERE position BETWEEN 6 AND 10""",
)
def paginate(t: Tables):
    """L2: the second page of five."""
    return search.paginate(bm25_hits(t, 2 * 5 + 50), page=2, page_size=5, threshold=CUT)


@register(
    "sort_modes",
    f"""SELECT query_id, product_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS INT) AS by_relevance,
      CAST(row_number() OVER (PARTITION BY query_id ORDER BY coalesce(selling_price, 0), product_id) AS INT) AS by_price_asc,
      CAST(row_number() OVER (PARTITION BY query_id ORDER BY coalesce(selling_price, 0) DESC, product_id) AS INT) AS by_price_desc,
      CAST(row_number() OVER (PARTITION BY query_id ORDER BY coalesce(average_rating, 0) DESC, product_id) AS INT) AS by_rating FROM {ENRICHED}""",
)
def sort_modes(t: Tables):
    """L3."""
    return search.sort_modes(enriched(t))


def intents(t: Tables):
    i = t["v_intents"]
    pairs = F.array(
        F.struct(F.lit("color").alias("k"), F.col("color").alias("v")), F.struct(F.lit("material").alias("k"), F.col("material").alias("v"))
    )
    return i.select(
        "query_id", "original_query", "rewritten_query", "category", "brand", F.col("price_max").cast("double").alias("price_max"),
        F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("filters"),
    )


def intent_where(price: str = "selling_price") -> str:
    return f"""(category IS NULL OR contains(lower(category_path), lower(category))) AND (brand IS NULL OR lower(brand_name) = lower(brand))
      AND (price_max IS NULL OR {price} IS NULL OR {price} <= price_max) AND (color IS NULL OR contains(lower(attribute_summary), lower(color)))
      AND (material IS NULL OR contains(lower(attribute_summary), lower(material)))"""


@register("intent_filter", f"SELECT query_id, product_id, rank FROM {ENRICHED} JOIN v_intents USING (query_id) WHERE {intent_where()}")
def intent_filter(t: Tables):
    """R6."""
    return search.intent_filter(enriched(t), intents(t)).select("query_id", "product_id", "rank")


@register(
    "request_filter",
    f"""WITH r AS (SELECT query_id, CASE WHEN CAST(query_id AS INT) % 6 = 1 THEN 'src3' ELSE '' END AS category, CASE WHEN CAST(query_id AS INT) % 5 = 1 THEN 'en' END AS brand,
      100.0 * (CAST(query_id AS INT) % 3) AS min_price, 1000.0 * (CAST(query_id AS INT) % 4) AS max_price, 1.5 * (CAST(query_id AS INT) % 2) AS min_rating FROM v_queries),
    i AS (SELECT query_id, CASE WHEN CAST(query_id AS INT) % 10 = 0 THEN 'en' END AS ib, CASE WHEN CAST(query_id AS INT) % 8 = 0 THEN 700.0 END AS ip FROM v_queries)
    SELECT h.query_id, product_id, rank FROM {ENRICHED} h JOIN r USING (query_id) JOIN i USING (query_id)
    WHERE (r.category = '' OR category_path = r.category) AND (coalesce(r.brand, ib) IS NULL OR brand_name = coalesce(r.brand, ib))
      AND (coalesce(nullif(max_price, 0), ip) IS NULL OR coalesce(selling_price, 0) <= coalesce(nullif(max_price, 0), ip))
      AND (min_price = 0 OR coalesce(selling_price, 0) >= min_price) AND (min_rating = 0 OR coalesce(average_rating, 0) >= min_rating)""",
)
def request_filter(t: Tables):
    """R7."""
    n = F.col("query_id").cast("int")
    requests = t["v_queries"].select(
        "query_id", F.when(n % 6 == 1, "src3").otherwise("").alias("category"), F.when(n % 5 == 1, "en").alias("brand"),
        (100.0 * (n % 3)).alias("min_price"), (1000.0 * (n % 4)).alias("max_price"), (1.5 * (n % 2)).alias("min_rating"),
    )
    wanted = t["v_queries"].select(
        "query_id", F.lit(None).cast("string").alias("category"), F.when(n % 10 == 0, "en").alias("brand"), F.when(n % 8 == 0, 700.0).alias("price_max")
    )
    return search.request_filter(enriched(t), requests, wanted).select("query_id", "product_id", "rank")


# Checking side of the default rerank score.
WEIGHTS = r"""w AS (SELECT query_id, term, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf
      FROM (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}_]+')) AS term FROM v_queries)
      LEFT JOIN (SELECT term, count(*) AS df FROM v_postings GROUP BY term) USING (term) CROSS JOIN (SELECT count(*) AS n FROM v_doc_tokens))"""


def rerank_sql(source: str, n: int) -> str:
    return rf"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, retrieval_rank) AS INT) AS rank FROM (
      SELECT h.query_id, h.product_id, h.score, h.rank AS retrieval_rank,
        round(coalesce(sum(CASE WHEN list_contains(toks, term) THEN idf ELSE 0 END) / sum(idf), h.score), 6) AS rerank_score
      FROM (SELECT *, regexp_extract_all(lower(concat_ws(' ', product_name, category_path, attribute_summary)), '[\p{{L}}\p{{N}}_]+') AS toks FROM {source}) h
      LEFT JOIN w USING (query_id) GROUP BY h.query_id, h.product_id, h.score, h.rank)) WHERE rank <= {n}"""


@register("rerank", f"WITH {WEIGHTS} SELECT query_id, product_id, score, retrieval_rank, rerank_score, rank FROM ({rerank_sql(ENRICHED, 10)})")
def rerank(t: Tables):
    """R9."""
    out = search.rerank(enriched(t), search.term_weights(t["v_queries"], t["v_catalog"]), 10)
    return out.select("query_id", "product_id", "score", "retrieval_rank", "rerank_score", "rank")


@register(
    "calibrate_scores",
    rf"""WITH q AS (SELECT query_id, list_filter(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) > 1 AND
        x NOT IN ('with', 'for', 'the', 'and', 'under', 'in', 'of', 'to', 'a', 'an')) AS toks FROM v_queries),
    b AS (SELECT h.*, (len(list_filter(toks, lambda x: contains(lower(product_name), x))) * 1.5::DOUBLE + len(list_filter(toks, lambda x: contains(lower(category_path), x)))) / greatest(len(toks), 1) AS kw,
        (rank - 1) / greatest(count(*) OVER w - 1, 1) AS place, min(score) OVER w AS lo, max(score) OVER w AS hi
      FROM {ENRICHED} h JOIN q USING (query_id) WINDOW w AS (PARTITION BY query_id)),
    s AS (SELECT *, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 - place * 0.3 END AS rel, least(0.88 + 0.08 * kw, 0.97) AS top FROM b),
    v AS (SELECT *, least(greatest(0.62::DOUBLE + (rel * 0.4::DOUBLE + (1 - place) * 0.6::DOUBLE) * (top - 0.62::DOUBLE) + 0.03::DOUBLE * kw, 0.6), 0.98) AS m FROM s)
    SELECT query_id, product_id, rank, round(m, 6) AS match_exact, round(m, 3) AS match_score FROM v""",
)
def calibrate_scores(t: Tables):
    """R10, W4."""
    out = search.calibrate(enriched(t), t["v_queries"])
    return out.select("query_id", "product_id", "rank", "match_exact", "match_score")


@register(
    "result_table",
    f"""SELECT query_id, rank, product_id, product_name, trim(string_split(category_path, '>')[-1]) AS category_leaf,
      '₹' || format('{{:,.2f}}', coalesce(selling_price, 0)) AS price, round(score, 4) AS raw_score,
      CASE WHEN score >= {CUT} THEN 'Relevant Match' ELSE 'Low Match (Filtered)' END AS relevance_status, rank = 1 AS best_match FROM {ENRICHED}""",
)
def result_table(t: Tables):
    """P29, L4."""
    return search.result_table(enriched(t), CUT)


@register(
    "result_digest",
    f"""WITH h AS (SELECT * FROM {ENRICHED} WHERE score >= {CUT}),
    g AS (SELECT query_id, string_agg(CASE WHEN rank <= 5 THEN '- ' || product_name || ' | Category: ' || category_path || ' | Price: $' || coalesce(CAST(selling_price AS VARCHAR), 'N/A')
        || ' | Rating: ' || coalesce(CAST(average_rating AS VARCHAR), 'N/A') END, chr(10) ORDER BY rank) AS lines, count(*) AS found, round(avg(coalesce(average_rating, 0)), 6) AS ar FROM h GROUP BY 1)
    SELECT query_id, coalesce(lines, 'I couldn''t find any products matching your search. Try different search terms.') AS digest,
      coalesce('Found ' || found || ' products matching ''' || query || '''.', '') AS message, coalesce(ar, 0) AS average_rating FROM v_queries LEFT JOIN g USING (query_id)""",
)
def result_digest(t: Tables):
    """P30, G11."""
    return search.result_digest(search.above_threshold(enriched(t), CUT), t["v_queries"])


@register(
    "stage_funnel",
    f"""WITH {WEIGHTS}, f AS (SELECT * FROM {ENRICHED} JOIN v_intents USING (query_id) WHERE {intent_where()}), r AS ({rerank_sql('f', 5)})
    SELECT query_id, (SELECT count(*) FROM v_bm25_hits h WHERE h.query_id = q.query_id) AS searched,
      (SELECT count(*) FROM f WHERE f.query_id = q.query_id) AS filtered, (SELECT count(*) FROM r WHERE r.query_id = q.query_id) AS reranked FROM v_queries q""",
)
def stage_funnel(t: Tables):
    """R15."""
    found = enriched(t)
    kept = search.intent_filter(found, intents(t))
    final = search.rerank(kept, search.term_weights(t["v_queries"], t["v_catalog"]), 5)
    return search.stage_funnel(t["v_queries"], searched=found, filtered=kept, reranked=final)


@register(
    "zero_result_queries",
    f"""SELECT query_id, query, CASE WHEN query_id IN (SELECT query_id FROM v_bm25_hits) THEN 'below threshold' ELSE 'no results' END AS reason
    FROM v_queries WHERE query_id NOT IN (SELECT query_id FROM v_bm25_hits WHERE score >= 20)""",
)
def zero_result_queries(t: Tables):
    """R20."""
    return search.zero_result_queries(t["v_queries"].select("query_id", "query"), bm25_hits(t), 20.0)


@register(
    "benchmark_sweep",
    f"""WITH g AS (SELECT query_id, min_by(product_name, rank) FILTER (score >= {CUT}) AS top_name, max(score) AS top_score, count(*) FILTER (score >= {CUT}) AS n FROM {ENRICHED} GROUP BY 1)
    SELECT query_id, query, CASE WHEN n > 0 THEN 'Passed (' || n || ' items)' ELSE 'No Match (Threshold Filtered)' END AS status,
      coalesce(top_name, 'None (Filtered Out)') AS top_product, round(coalesce(top_score, 0), 4) AS top_raw_score, coalesce(n, 0) AS relevant_results FROM v_queries LEFT JOIN g USING (query_id)""",
)
def benchmark_sweep(t: Tables):
    """R21."""
    return search.benchmark_sweep(t["v_queries"].select("query_id", "query"), enriched(t), CUT)


def dictionary(t: Tables):
    """Brand, category and attribute phrases of the catalog."""
    products = t["v_catalog"]
    cats = products.select(F.lit("category").alias("kind"), F.lower("category_path").alias("phrase"), F.col("category_path").alias("value")).distinct()
    brands = products.select(F.lit("brand").alias("kind"), F.lower("brand_name").alias("phrase"), F.col("brand_name").alias("value")).distinct()
    names = t["part"].select(F.explode(F.split("p_name", " ")).alias("w"), "p_type").select(
        F.lit("material").alias("kind"), F.col("w").alias("phrase"), F.col("w").alias("value")
    ).distinct()
    return cats.unionByName(brands).unionByName(names)


# Raw queries for intent extraction: product names, categories and limits over the part table.
RAW_QUERY = """CAST(p_partkey AS STRING) AS query_id, CASE WHEN p_partkey % 4 = 0 THEN 'cheap ' ELSE 'Best ' END || p_name ||
      CASE WHEN p_partkey % 3 = 0 THEN ' from  SRC' || CAST(p_partkey % 25 AS STRING) ELSE '' END ||
      CASE WHEN p_partkey % 5 = 0 THEN ' in en' WHEN p_partkey % 5 = 1 THEN ' de' ELSE '' END ||
      CASE WHEN p_partkey % 6 = 0 THEN ' under 500' WHEN p_partkey % 6 = 1 THEN ' less than $99.5 today' ELSE '' END AS query"""


def intent_sql(rows: str, entries: str, most: int = 3) -> str:
    """Checking side of query understanding over rows of (query_id, query) and entries of (kind, phrase, value) of up to ``most`` words.

    Leaves ``understood``: (query_id, original_query, rewritten_query, price_max) and ``m``, the best phrase of each kind.
    """
    limit = r"\b(?:under|below|less than)\s+[$₹]?([0-9]+(?:\.[0-9]+)?)"
    return rf"""r AS ({rows}), l AS (SELECT query_id, query, lower(trim(regexp_replace(query, '\s+', ' ', 'g'))) AS low FROM r),
    s AS (SELECT query_id, query, regexp_extract(low, '{limit}', 1) AS lim,
      list_filter(regexp_split_to_array(regexp_replace(low, '{limit}', ' ', 'g'), '\s+'), lambda x: x <> '') AS words FROM l),
    g AS (SELECT query_id, i AS start, n, array_to_string(words[i:i + n - 1], ' ') AS phrase FROM (SELECT query_id, words, unnest(range(1, len(words) + 1)) AS i FROM s), (SELECT unnest(range(1, {most} + 1)) AS n) WHERE i + n - 1 <= len(words)),
    d AS ({entries}),
    m AS (SELECT * FROM g JOIN d USING (phrase) QUALIFY row_number() OVER (PARTITION BY query_id, kind ORDER BY n DESC, start, value) = 1),
    k AS (SELECT s.query_id, array_to_string(list_filter(words, lambda x, i: len(list_filter(coalesce(ms, []), lambda y: i >= y.start AND i < y.start + y.n)) = 0), ' ') AS rest
      FROM s LEFT JOIN (SELECT query_id, list({{'start': start, 'n': n}}) AS ms FROM m GROUP BY 1) x USING (query_id)),
    understood AS (SELECT query_id, query AS original_query, CASE WHEN rest = '' THEN query ELSE rest END AS rewritten_query, try_cast(nullif(lim, '') AS DOUBLE) AS price_max FROM s JOIN k USING (query_id))"""


def intent_value(kind: str) -> str:
    return f"(SELECT value FROM m WHERE m.query_id = u.query_id AND kind = '{kind}') AS {kind}"


PART_PHRASES = """SELECT DISTINCT 'category' AS kind, lower(source) AS phrase, source AS value FROM documents UNION ALL SELECT DISTINCT 'brand', lower(lang), lang FROM documents
      UNION ALL SELECT DISTINCT 'material', w, w FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)"""


@register(
    "query_intent",
    f"""WITH {intent_sql(f"SELECT {RAW_QUERY} FROM part", PART_PHRASES)}
    SELECT query_id, original_query, rewritten_query, {intent_value("category")}, {intent_value("brand")}, price_max, {intent_value("material")} FROM understood u""",
)
def query_intent(t: Tables):
    """R12 over one query per part."""
    raw = t["part"].selectExpr(*_split_select(RAW_QUERY))
    out = search.query_intent(raw, dictionary(t))
    return out.select(
        "query_id", "original_query", "rewritten_query", "category", "brand", "price_max", F.try_element_at("filters", F.lit("material")).alias("material")
    )


def _split_select(sql: str) -> list[str]:
    first, second = sql.split(" AS query_id, ", 1)
    return [first + " AS query_id", second]


RESPONSE = """CASE p_partkey % 5
      WHEN 0 THEN '```json' || chr(10) || '{"rewritten_query": "' || p_name || '", "category": "' || p_type || '", "brand": null, "price_max": ' || CAST(p_size AS STRING) || ', "filters": {"color": "red"}}' || chr(10) || '```'
      WHEN 1 THEN '{"rewritten_query": "", "category": null, "brand": "' || p_brand || '", "price_max": "12.5", "filters": {}}'
      WHEN 2 THEN 'Sorry, I cannot help with that.'
      WHEN 3 THEN '{"rewritten_query": "' || p_name || '", "price_max": "cheap"}'
      ELSE '{"rewritten_query": "broken' END"""


@register(
    "parse_intent_json",
    rf"""WITH r AS (SELECT CAST(p_partkey AS VARCHAR) AS query_id, p_name AS query, {RESPONSE} AS response FROM part),
    c AS (SELECT query_id, query, trim(rtrim(regexp_replace(regexp_replace(response, '```(json)?', '', 'g'), '^\s+|\s+$', '', 'g'), '`')) AS j FROM r),
    p AS (SELECT query_id, query, CASE WHEN json_valid(j) THEN j END AS j FROM c)
    SELECT query_id, query AS original_query, coalesce(nullif(json_extract_string(j, '$.rewritten_query'), ''), query) AS rewritten_query,
      json_extract_string(j, '$.category') AS category, json_extract_string(j, '$.brand') AS brand, try_cast(json_extract_string(j, '$.price_max') AS DOUBLE) AS price_max,
      coalesce(json_extract_string(j, '$.filters.color'), '') AS color FROM p""",
)
def parse_intent_json(t: Tables):
    """R13 over one reply per part."""
    rows = t["part"].select(F.col("p_partkey").cast("string").alias("query_id"), F.col("p_name").alias("query"), F.expr(RESPONSE).alias("response"))
    out = search.parse_intent_json(rows)
    color = F.coalesce(F.try_element_at("filters", F.lit("color")), F.lit("")).alias("color")
    return out.select("query_id", "original_query", "rewritten_query", "category", "brand", "price_max", color)


@register(
    "intent_tokens",
    r"""SELECT item_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: length(x) > 3 AND x NOT IN ('with', 'for', 'the', 'and', 'under'))[1:6], ' ') AS tokens FROM benchmark""",
)
def intent_tokens(t: Tables):
    """R14."""
    return t["benchmark"].select("item_id", F.array_join(search.intent_tokens(F.col("text")), " ").alias("tokens"))


@register(
    "suggest_prefix",
    f"""WITH u AS (SELECT completion, count(*) AS uses FROM (SELECT query AS completion FROM v_search_log UNION ALL SELECT lower(source) FROM documents) GROUP BY 1),
    p AS (SELECT completion, uses, i AS n_chars, md5(substring(completion, 1, i)) AS prefix_key FROM (SELECT completion, uses, unnest(range(2, length(completion) + 1)) AS i FROM u WHERE length(completion) >= 2))
    SELECT prefix_key, CAST(n_chars AS INT) AS n_chars, CAST(row_number() OVER w AS INT) AS rank, md5(completion) AS completion_key, uses FROM p
    WINDOW w AS (PARTITION BY prefix_key ORDER BY uses DESC, substring(completion, 1, {search.ORDER_CHARS}), md5(completion)) QUALIFY row_number() OVER w <= 5""",
)
def suggest_prefix(t: Tables):
    """The index of prefixes of logged queries and category names."""
    log = t["v_search_log"].select("query").unionByName(t["documents"].select(F.col("source").alias("query")))
    return search.suggest_prefixes(log)


@register(
    "suggest_parts",
    """WITH log AS (SELECT CAST(user_id AS VARCHAR) AS session_id, 'q' || regexp_extract(props, '[0-9]+', 0) AS text FROM events),
    t AS (SELECT DISTINCT substring(text, 1, 2) AS typed FROM log UNION SELECT DISTINCT lower(substring(source, 1, 4)) FROM documents),
    c AS (SELECT typed, text, count(*) AS uses FROM t JOIN log ON starts_with(text, typed) GROUP BY ALL),
    o AS (SELECT typed, text FROM c QUALIFY row_number() OVER (PARTITION BY typed ORDER BY uses DESC, text) <= 5),
    k AS (SELECT typed, lower(source) AS text, count(*) AS uses FROM t JOIN documents ON starts_with(lower(source), typed) GROUP BY ALL),
    d AS (SELECT DISTINCT session_id, text FROM log),
    r AS (SELECT typed, text, count(*) AS uses FROM (SELECT DISTINCT typed, session_id FROM o JOIN d USING (text)) JOIN d USING (session_id)
      WHERE (typed, text) NOT IN (SELECT typed, text FROM o) GROUP BY ALL),
    a AS (SELECT 'completions' AS part, * FROM c UNION ALL SELECT 'categories', * FROM k UNION ALL SELECT 'related', * FROM r)
    SELECT typed, part, CAST(row_number() OVER w AS INT) AS rank, text AS suggestion, uses FROM a WINDOW w AS (PARTITION BY typed, part ORDER BY uses DESC, text) QUALIFY row_number() OVER w <= 5""",
)
def suggest_parts(t: Tables):
    """Completions, categories and related queries for beginnings of everything that was asked or is sold."""
    log = t["events"].select(F.col("user_id").cast("string").alias("session_id"), F.concat(F.lit("q"), F.regexp_extract("props", "[0-9]+", 0)).alias("query"))
    categories = t["documents"].select(F.col("source").alias("category"))
    typed = log.select(F.substring("query", 1, 2).alias("typed")).union(categories.select(F.substring("category", 1, 4)))
    return search.suggest(typed, log, categories)


CATALOG_PHRASES = """SELECT DISTINCT kind, lower(trim(value)) AS phrase, value FROM (
      SELECT 'category' AS kind, category_path AS value FROM v_catalog UNION ALL SELECT 'brand', brand_name FROM v_catalog
      UNION ALL SELECT lower(split_part(a, ': ', 1)), split_part(a, ': ', 2) FROM (SELECT unnest(string_split(attribute_summary, ', ')) AS a FROM v_catalog)) WHERE trim(value) <> ''"""


def within_intent(scores: str) -> str:
    """A query's best 20 of the scored products that its intent allows."""
    return f"""SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank
      FROM {scores} LEFT JOIN v_catalog USING (product_id) LEFT JOIN wishes USING (query_id) WHERE {intent_where()}
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) <= 20"""


def vector_lists(sparse: str) -> str:
    return f"""SELECT i.id, list(coalesce(CAST(e.weight AS DOUBLE), 0.0) ORDER BY i.dim) AS v FROM (SELECT id, unnest(range(256)) AS dim FROM (SELECT DISTINCT id FROM {sparse})) i
      LEFT JOIN {sparse} e ON e.id = i.id AND e.dim = i.dim GROUP BY i.id"""


@register(
    "search_batch",
    rf"""WITH {intent_sql("SELECT query_id, query FROM v_queries", CATALOG_PHRASES, 2)},
    wishes AS (SELECT query_id, price_max, {", ".join(map(intent_value, ("category", "brand", "color", "material")))} FROM understood u),
    qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(rewritten_query), '[\p{{L}}\p{{N}}_]+')) AS term FROM understood),
    freq AS (SELECT term, count(*) AS df FROM v_postings GROUP BY term), corpus AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM v_doc_tokens),
    w AS (SELECT query_id, term, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf FROM qt LEFT JOIN freq USING (term), corpus),
    by_words AS (SELECT query_id, product_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM w JOIN v_postings USING (term), corpus GROUP BY ALL),
    qe AS ({hashed_vectors("(SELECT query_id AS id, rewritten_query AS body FROM understood)")}), de AS ({hashed_vectors("(SELECT product_id AS id, searchable_text AS body FROM v_catalog)")}),
    ql AS ({vector_lists("qe")}), dl AS ({vector_lists("de")}),
    by_vectors AS (SELECT q.query_id, p.product_id, coalesce(round(list_cosine_similarity(ql.v, dl.v), 6), 0.0) AS score
      FROM v_queries q CROSS JOIN v_catalog p LEFT JOIN ql ON ql.id = q.query_id LEFT JOIN dl ON dl.id = p.product_id),
    words AS ({within_intent('by_words')}), vectors AS ({within_intent('by_vectors')}),
    fused AS (SELECT query_id, product_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS INT) AS rank, score
      FROM (SELECT query_id, product_id, round(sum(s), 6) AS score FROM (
        SELECT query_id, product_id, (1 - (rank - 1) / (count(*) OVER (PARTITION BY query_id))) * 0.7::DOUBLE AS s FROM vectors
        UNION ALL SELECT query_id, product_id, (1 - (rank - 1) / (count(*) OVER (PARTITION BY query_id))) * 0.3::DOUBLE FROM words) GROUP BY ALL)),
    f AS (SELECT query_id, product_id, rank, score, coalesce(nullif(product_name, ''), 'Product ' || product_id) AS product_name, coalesce(brand_name, '') AS brand_name,
      coalesce(category_path, '') AS category_path, coalesce(attribute_summary, '') AS attribute_summary, selling_price FROM fused LEFT JOIN v_catalog USING (product_id) WHERE rank <= 20)
    SELECT query_id, product_id, score, retrieval_rank, rerank_score, rank FROM ({rerank_sql('f', 10)})""",
)
def search_batch(t: Tables):
    """R16, flagship: every query understood, rewritten, searched and reranked in one job."""
    out = search.search_batch(t["v_queries"], t["v_catalog"])
    return out.select("query_id", "product_id", "score", "retrieval_rank", "rerank_score", "rank")
