"""Joins and Gold assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfscan.operators import catalog, clean, index, quality as q, search
from shelfscan.plans import checks
from shelfscan.plans.checks import D_ATTRIBUTES, D_BRANDS, D_CATEGORIES, D_PRICING, D_PRODUCT, D_REVIEWS
from shelfscan.plans.cleaning import decode_sql
from shelfscan.plans.registry import register
from shelfscan.plans.relevance import bm25_hits
from shelfscan.sources.fixtures import Tables

AS_OF = "2000-01-01"

ACTIVE = f"""(SELECT * FROM d_pricing WHERE rule_name IS NULL AND effective_from <= DATE '{AS_OF}' AND (effective_to IS NULL OR effective_to > DATE '{AS_OF}')
      QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY effective_from DESC, price_id DESC) = 1)"""


def active(t: Tables):
    return catalog.active_price(q.valid(checks.pricing(t)).drop("copies"), AS_OF)


@register(
    "active_price_asof",
    f"WITH {D_PRICING} SELECT price_id, product_id, list_price, selling_price, effective_from, effective_to FROM {ACTIVE}",
)
def active_price_asof(t: Tables):
    """J6."""
    return active(t).select("price_id", "product_id", "list_price", "selling_price", "effective_from", "effective_to")


SUMMARY = """(SELECT product_id, string_agg(attribute_name || ': ' || attribute_value || CASE WHEN trim(attribute_unit) <> '' THEN ' ' || attribute_unit ELSE '' END,
      ', ' ORDER BY attribute_name, attribute_value, attribute_id) AS attribute_summary FROM d_attributes WHERE rule_name IS NULL GROUP BY product_id)"""


@register("attribute_summary", f"WITH {D_ATTRIBUTES} SELECT * FROM {SUMMARY}")
def attribute_summary(t: Tables):
    """G1."""
    return catalog.attribute_summary(q.valid(checks.attributes(t)))


GOLD = rf"""SELECT m.product_id, p.product_name, regexp_replace(p.category_hierarchy, '\s+/\s+', ' › ', 'g') AS category_path,
      coalesce(a.attribute_summary, '') AS attribute_summary,
      CASE WHEN r.rating_count > 0 THEN 'Average rating: ' || CAST(r.average_rating AS VARCHAR) || ' out of 5 stars based on ' || CAST(r.rating_count AS VARCHAR)
        || ' reviews. Customer sentiment score is ' || CAST(r.sentiment_score AS VARCHAR) || '.' ELSE 'No reviews yet.' END AS review_summary,
      coalesce(b.brand_name, 'Generic') AS brand_name, x.selling_price, p.average_rating, CAST(p.review_count AS INT) AS review_count,
      {decode_sql('p.product_name')} AS nname, {decode_sql('p.product_description')} AS ndesc, p.product_features
    FROM v_master m JOIN (SELECT * FROM d_product WHERE rule_name IS NULL) p ON m.product_id = p.product_id
    LEFT JOIN (SELECT * FROM d_brand WHERE rule_name IS NULL) b ON m.brand_id = b.brand_id
    LEFT JOIN {ACTIVE} x ON x.product_id = m.product_id LEFT JOIN {SUMMARY} a ON a.product_id = m.product_id
    LEFT JOIN (SELECT * FROM d_reviews WHERE rule_name IS NULL) r ON r.product_id = m.product_id"""
GOLD_CTES = ", ".join([D_PRODUCT, D_PRICING, D_ATTRIBUTES, D_REVIEWS, D_BRANDS])


def gold(t: Tables):
    return catalog.search_catalog(
        clean.normalized_text(q.valid(checks.product(t)).drop("copies")), t["v_master"], q.valid(checks.brands(t)), active(t),
        q.valid(checks.attributes(t)), q.valid(checks.reviews(t)),
    )


@register(
    "gold_catalog",
    f"""WITH {GOLD_CTES} SELECT product_id, product_name, category_path, attribute_summary, review_summary, brand_name, selling_price, average_rating, review_count,
    concat_ws(' ' || chr(10) || ' ', nname, ndesc, product_features, category_path, attribute_summary, review_summary) AS searchable_text FROM ({GOLD})""",
)
def gold_catalog(t: Tables):
    """The Gold table, from cleaned, deduplicated, valid rows."""
    return q.require_text(gold(t))


@register(
    "searchable_text",
    f"""WITH {GOLD_CTES} SELECT product_id, concat_ws(' ' || chr(10) || ' ', nname, ndesc, product_features, category_path, attribute_summary, review_summary) AS searchable_text,
    length(concat_ws(' ' || chr(10) || ' ', nname, ndesc, product_features, category_path, attribute_summary, review_summary))::INT AS n FROM ({GOLD})""",
)
def searchable_text(t: Tables):
    """P16."""
    return gold(t).select("product_id", "searchable_text", F.length("searchable_text").alias("n"))


@register(
    "showcase_catalog",
    f"""WITH {D_PRODUCT}, {D_PRICING}, {D_REVIEWS}, {D_BRANDS}, {D_CATEGORIES}
    SELECT m.product_id, p.product_name, p.product_class, p.product_description, c.category_name, b.brand_name, x.list_price, x.selling_price, x.price_bucket,
      r.average_rating, r.sentiment_score, k.keywords
    FROM v_master m JOIN (SELECT * FROM d_product WHERE rule_name IS NULL) p ON m.product_id = p.product_id
    JOIN (SELECT * FROM d_category WHERE rule_name IS NULL) c ON m.category_id = c.category_id
    JOIN (SELECT * FROM d_brand WHERE rule_name IS NULL) b ON m.brand_id = b.brand_id
    JOIN {ACTIVE} x ON x.product_id = m.product_id JOIN (SELECT * FROM d_reviews WHERE rule_name IS NULL) r ON r.product_id = m.product_id
    LEFT JOIN (SELECT product_id, 'kw ' || lower(product_class) AS keywords FROM d_product WHERE arrival % 3 = 0) k ON k.product_id = m.product_id
    WHERE x.selling_price < 3000 AND r.average_rating >= 2""",
)
def showcase_catalog(t: Tables):
    """J9."""
    products = q.valid(checks.product(t)).drop("copies")
    kw = products.filter(F.col("arrival") % 3 == 0).select("product_id", F.concat(F.lit("kw "), F.lower("product_class")).alias("keywords"))
    return catalog.showcase(
        products, t["v_master"], q.valid(checks.categories(t)), q.valid(checks.brands(t)), active(t), q.valid(checks.reviews(t)), kw,
        where=(F.col("selling_price") < 3000) & (F.col("average_rating") >= 2),
    )


@register(
    "enrich_hits",
    """SELECT query_id, product_id, rank, score, coalesce(nullif(product_name, ''), 'Product ' || product_id) AS product_name,
      coalesce(nullif(searchable_text, ''), attribute_summary, '') AS description, coalesce(brand_name, '') AS brand_name, coalesce(category_path, '') AS category_path,
      coalesce(attribute_summary, '') AS attribute_summary, selling_price, average_rating, coalesce(review_count, 0) AS review_count
    FROM v_bm25_hits LEFT JOIN v_catalog USING (product_id)""",
)
def enrich_hits(t: Tables):
    """J7."""
    return search.enrich_hits(bm25_hits(t), t["v_catalog"])


@register(
    "category_paths",
    """WITH RECURSIVE up AS (SELECT category_id, parent_category_id AS next, category_name AS path, false AS cyclic, [category_id] AS seen FROM v_category
      UNION ALL SELECT u.category_id, CASE WHEN list_contains(u.seen, u.next) THEN NULL ELSE c.parent_category_id END,
        CASE WHEN list_contains(u.seen, u.next) OR c.category_id IS NULL THEN u.path ELSE concat_ws(' > ', c.category_name, u.path) END, list_contains(u.seen, u.next), list_append(u.seen, u.next)
      FROM up u LEFT JOIN v_category c ON c.category_id = u.next WHERE u.next IS NOT NULL AND NOT u.cyclic)
    SELECT category_id, path, cyclic FROM up QUALIFY row_number() OVER (PARTITION BY category_id ORDER BY len(seen) DESC) = 1""",
)
def category_paths(t: Tables):
    """Every category's path, by joins with its parents."""
    return catalog.category_paths(t["v_category"])


@register(
    "products_by_id",
    "SELECT product_id, product_name, brand_name FROM v_catalog WHERE product_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1)",
)
def products_by_id(t: Tables):
    """J8."""
    ids = t["labels"].filter("quality = 1").select(F.col("doc_id").cast("string").alias("product_id"))
    return search.products_by_id(t["v_catalog"], ids).select("product_id", "product_name", "brand_name")


@register(
    "cdc_snapshot_diff",
    """SELECT product_id, CASE WHEN o.p_name IS NULL THEN 'insert' WHEN n.p_name IS NULL THEN 'delete' ELSE 'update' END AS change_type
    FROM v_snapshot_old o FULL JOIN v_snapshot_new n USING (product_id)
    WHERE o.p_name IS DISTINCT FROM n.p_name OR o.p_brand IS DISTINCT FROM n.p_brand OR o.p_retailprice IS DISTINCT FROM n.p_retailprice""",
)
def cdc_snapshot_diff(t: Tables):
    """S11."""
    return index.snapshot_diff(t["v_snapshot_old"], t["v_snapshot_new"], "product_id")
