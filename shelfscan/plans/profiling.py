"""Profiles, statistics, facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfscan.operators import profile
from shelfscan.plans.cleaning import NUMERIC, TIERS, featured, numeric
from shelfscan.plans.registry import register
from shelfscan.sources.fixtures import Tables

_COLS = ["asin", "title", "categories", "price", "discount", "stars", "num_ratings", "description", "review_title", "review_text"]


@register(
    "column_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (trim({c}) <> '') AS non_blank, count(*) - count(*) FILTER (trim({c}) <> '') AS blank_count,
        round(100.0 * (count(*) - count(*) FILTER (trim({c}) <> '')) / count(*), 2)::DOUBLE AS blank_pct, count(DISTINCT coalesce({c}, chr(1))) AS distinct_values FROM v_product_raw"""
        for c in _COLS
    ),
)
def column_profile(t: Tables):
    """F19, G8."""
    return profile.column_profile(t["v_product_raw"], _COLS)


def stats_sql(expr: str, source: str) -> str:
    return f"""SELECT count({expr}) AS n, round(avg({expr}), 2) AS avg_value, round(min({expr})::DOUBLE, 2) AS min_value, round(max({expr})::DOUBLE, 2) AS max_value,
    round(stddev({expr}), 2) AS stddev_value FROM {source}"""


@register("price_stats", stats_sql("discounted_price", f"({NUMERIC})"))
def price_stats(t: Tables):
    """G2."""
    return profile.number_stats(numeric(t), F.col("discounted_price"))


@register("doc_length_stats", stats_sql("length(searchable_text)", "v_catalog"))
def doc_length_stats(t: Tables):
    """G2 over text lengths."""
    return profile.number_stats(t["v_catalog"], F.length("searchable_text"))


@register(
    "tier_distribution",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS tier, {c} AS bucket, count(*) AS n, round(avg(discounted_price), 2) AS avg_value,
        round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS pct FROM ({TIERS}) GROUP BY {c}"""
        for c in ("price_tier", "rating_tier")
    ),
)
def tier_distribution(t: Tables):
    """G3."""
    rows = featured(t)
    parts = [
        profile.distribution(rows, c, F.col("discounted_price")).select(F.lit(c).alias("tier"), "*") for c in ("price_tier", "rating_tier")
    ]
    return parts[0].unionByName(parts[1])


@register(
    "discount_stats",
    """SELECT count(v) AS with_discount, round(avg(v), 6) AS avg_discount, min(v) AS min_discount, max(v) AS max_discount, count(*) FILTER (v > 50) AS high_discount
    FROM (SELECT try_cast(replace(discount, '%', '') AS DOUBLE) AS v FROM v_product_raw)""",
)
def discount_stats(t: Tables):
    """G4."""
    return profile.discount_stats(numeric(t))


@register(
    "price_rating_corr",
    f"""SELECT count(*) AS pairs, round(corr(discounted_price, rating), 6) AS correlation FROM ({NUMERIC}) WHERE discounted_price IS NOT NULL AND rating IS NOT NULL""",
)
def price_rating_corr(t: Tables):
    """G5."""
    return profile.correlation(numeric(t), "discounted_price", "rating")


@register(
    "facet_categories",
    """SELECT category_path AS name, count(*) AS product_count FROM v_catalog WHERE category_path <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30""",
)
def facet_categories(t: Tables):
    """G6, G7."""
    return profile.facet(t["v_catalog"], "category_path", 30)


@register(
    "facet_brands",
    """SELECT brand_name AS name, count(*) AS product_count FROM v_catalog WHERE brand_name <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""",
)
def facet_brands(t: Tables):
    """G6."""
    return profile.facet(t["v_catalog"], "brand_name", 50)


@register(
    "facet_brands_by_category",
    """SELECT category_path AS category, brand_name AS name, count(*) AS product_count, CAST(row_number() OVER w AS INT) AS rank FROM v_catalog WHERE brand_name <> '' AND category_path <> '' GROUP BY 1, 2
    WINDOW w AS (PARTITION BY category_path ORDER BY count(*) DESC, brand_name) QUALIFY row_number() OVER w <= 50""",
)
def facet_brands_by_category(t: Tables):
    """G6 within every category."""
    return profile.facet_within(t["v_catalog"], "brand_name", "category_path", 50)


@register(
    "longest_docs",
    "SELECT product_id, length(searchable_text)::INT AS n_chars FROM v_catalog ORDER BY n_chars DESC, product_id LIMIT 5",
)
def longest_docs(t: Tables):
    """L5."""
    return profile.longest_documents(t["v_catalog"], "product_id", "searchable_text")


@register(
    "top_queries",
    """SELECT query, count(*) AS searches, round(avg(results), 6) AS avg_results, round(avg(latency_ms), 6) AS avg_latency_ms FROM v_search_log
    WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY AND ts <= TIMESTAMP '2024-01-31 00:00:00' GROUP BY query ORDER BY searches DESC, query LIMIT 10""",
)
def top_queries(t: Tables):
    """G9."""
    return profile.top_queries(t["v_search_log"], "2024-01-31 00:00:00")


@register(
    "hit_rate",
    """SELECT count(*) FILTER (cached) AS hits, count(*) FILTER (NOT cached) AS misses, round(100.0 * count(*) FILTER (cached) / count(*), 2)::DOUBLE AS hit_rate FROM v_search_log""",
)
def hit_rate(t: Tables):
    """G10."""
    return profile.hit_rate(t["v_search_log"])


@register(
    "cart_totals",
    """WITH p AS (SELECT CAST(o_custkey AS VARCHAR) AS session_id, CAST(l_partkey AS VARCHAR) AS product_id, greatest(CAST(sum(CAST(l_quantity AS INT) - 3) AS BIGINT), 1) AS quantity
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
    SELECT session_id, product_id, quantity, CAST(sum(quantity) OVER (PARTITION BY session_id) AS BIGINT) AS item_count FROM p""",
)
def cart_totals(t: Tables):
    """G12 over all order lines."""
    lines = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("string").alias("session_id"), F.col("l_partkey").cast("string").alias("product_id"),
        (F.col("l_quantity").cast("int") - 3).alias("quantity"),
    )
    return profile.cart_totals(lines)
