"""Cleaning and feature columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfscan.functions import text
from shelfscan.operators import clean, evaluate
from shelfscan.plans.registry import register
from shelfscan.sources.fixtures import Tables

INITCAP = "array_to_string(list_transform(string_split(lower({0}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


def initcap(expr: str) -> str:
    return INITCAP.format(expr)


@register(
    "clean_defaults",
    """SELECT 'brand' AS entity, brand_id AS id, coalesce(trim(brand_name), 'Generic') AS value, NULL AS extra FROM v_brand
    UNION ALL SELECT 'category', category_id, coalesce(trim(category_name), 'Unknown'), NULL FROM v_category
    UNION ALL SELECT 'pricing', price_id, coalesce(trim(currency), 'INR'), coalesce(trim(price_bucket), 'Mid-range') FROM v_pricing""",
)
def clean_defaults(t: Tables):
    none = F.lit(None).cast("string").alias("extra")
    brand = clean.clean_brand(t["v_brand"]).select(F.lit("brand").alias("entity"), F.col("brand_id").alias("id"), F.col("brand_name").alias("value"), none)
    cat = clean.clean_category(t["v_category"]).select(F.lit("category").alias("entity"), F.col("category_id").alias("id"), F.col("category_name").alias("value"), none)
    price = clean.clean_pricing(t["v_pricing"]).select(
        F.lit("pricing").alias("entity"), F.col("price_id").alias("id"), F.col("currency").alias("value"), F.col("price_bucket").alias("extra")
    )
    return brand.unionByName(cat).unionByName(price)


CLEAN_PRODUCT = """SELECT product_id, coalesce(trim(product_name), '') AS product_name,
      coalesce(product_description, trim(product_name), '') AS product_description, coalesce(product_features, '') AS product_features,
      CAST(coalesce(rating_count, 0) AS BIGINT) AS rating_count, CASE WHEN coalesce(rating_count, 0) > 0 THEN average_rating END AS average_rating,
      CAST(coalesce(review_count, 0) AS BIGINT) AS review_count,
      CASE WHEN trim(category_hierarchy) <> '' THEN category_hierarchy ELSE 'Unknown' END AS category_hierarchy,
      CASE WHEN trim(product_class) <> '' THEN product_class ELSE 'Unknown' END AS product_class, arrival FROM v_product"""


@register("clean_product", CLEAN_PRODUCT)
def clean_product(t: Tables):
    return clean.clean_product(t["v_product"])


@register(
    "category_levels",
    rf"""WITH c AS ({CLEAN_PRODUCT}), s AS (SELECT product_id, arrival, regexp_split_to_array(category_hierarchy, '\s+/\s+') AS p FROM c)
    SELECT product_id, arrival, coalesce(p[1], 'Unknown') AS level_1, coalesce(p[2], 'Unknown') AS level_2, coalesce(p[3], 'Unknown') AS level_3 FROM s""",
)
def category_levels(t: Tables):
    return clean.category_levels(clean.clean_product(t["v_product"])).select("product_id", "arrival", "level_1", "level_2", "level_3")


def decode_sql(col: str) -> str:
    return (
        rf"trim(regexp_replace(replace(replace(replace(replace(replace({col}, '&amp;', '&'), '&quot;', chr(34)), '&apos;', ''''), "
        r"'&lt;', '<'), '&gt;', '>'), '\s+', ' ', 'g'))"
    )


@register(
    "normalize_text",
    f"""WITH c AS ({CLEAN_PRODUCT}) SELECT product_id, arrival, {decode_sql('product_name')} AS normalized_name,
    {decode_sql('product_description')} AS normalized_description FROM c""",
)
def normalize_text(t: Tables):
    cleaned = clean.normalized_text(clean.clean_product(t["v_product"]))
    return cleaned.select("product_id", "arrival", "normalized_name", "normalized_description")


ATTR_NAME = f"""CASE WHEN lower(attribute_name) IN ('color', 'primarycolor') THEN 'Color'
    WHEN lower(attribute_name) IN ('material', 'primarymaterial', 'framematerial') THEN 'Material'
    WHEN lower(attribute_name) IN ('size', 'weight', 'capacity', 'dimensions', 'length', 'depth', 'width', 'height') THEN {initcap('attribute_name')}
    ELSE {initcap('attribute_name')} END"""


@register(
    "attr_vocab",
    f"""SELECT 'attribute' AS kind, attribute_id AS id, {ATTR_NAME} AS value FROM v_attributes
    UNION ALL SELECT 'status', sku, CASE lower(trim(product_status)) WHEN 'active' THEN 'Active' WHEN 'discontinued' THEN 'Discontinued'
      WHEN 'out of stock' THEN 'Out of Stock' END FROM v_master""",
)
def attr_vocab(t: Tables):
    """P5, P28."""
    names = clean.standard_attributes(t["v_attributes"]).select(
        F.lit("attribute").alias("kind"), F.col("attribute_id").alias("id"), F.col("attribute_name").alias("value")
    )
    status = clean.standard_status(t["v_master"]).select(
        F.lit("status").alias("kind"), F.col("sku").alias("id"), F.col("product_status").alias("value")
    )
    return names.unionByName(status)


CLEAN_REVIEWS = """SELECT review_summary_id, product_id, CASE WHEN coalesce(rating_count, 0) > 0 THEN average_rating END AS average_rating,
    CAST(coalesce(rating_count, 0) AS BIGINT) AS rating_count, coalesce(sentiment_score, 0.0)::DOUBLE AS sentiment_score FROM v_reviews"""


@register("clean_reviews", f"SELECT * REPLACE (round(sentiment_score, 6) AS sentiment_score) FROM ({CLEAN_REVIEWS})")
def clean_reviews(t: Tables):
    return clean.clean_reviews(t["v_reviews"]).withColumn("sentiment_score", F.round("sentiment_score", 6))


@register(
    "normalize_query",
    r"""SELECT item_id, text AS query, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS normalized_query FROM benchmark""",
)
def normalize_query(t: Tables):
    return t["benchmark"].select("item_id", F.col("text").alias("query"), text.normalize_query(F.col("text")).alias("normalized_query"))


@register(
    "sanitize_query",
    r"""SELECT item_id, replace(replace(replace(lower(trim(regexp_replace(regexp_replace(substring(regexp_replace(raw, '^\s+|\s+$', '', 'g'), 1, 200),
      '[\p{C}]', '', 'g'), ' +', ' ', 'g'))), '!', ''), '?', ''), '.', '') AS query
    FROM (SELECT item_id, '  ' || text || chr(7) || '!? ' AS raw FROM benchmark)""",
)
def sanitize_query(t: Tables):
    raw = F.concat(F.lit("  "), F.col("text"), F.lit("\x07!? "))
    return t["benchmark"].select("item_id", text.sanitize_query(raw).alias("query"))


RESOLVED = """SELECT asin AS product_id, title AS product_name, categories AS category, price AS discounted_price, mrp AS actual_price,
    discount AS discount_percentage, stars AS rating, num_ratings AS rating_count, description AS about_product, user_id, user_name,
    NULL::VARCHAR AS review_id, review_title, review_text AS review_content, image AS img_link, NULL::VARCHAR AS product_link, shelf, arrival FROM v_product_raw"""


@register("resolve_schema", RESOLVED)
def resolve_schema(t: Tables):
    """P10, P11."""
    return clean.resolve_schema(t["v_product_raw"])


def num_sql(col: str, noise: str, pattern: str, dtype: str) -> str:
    cleaned = f"regexp_replace({col}, '{noise}', '', 'g')"
    return f"CASE WHEN regexp_matches({cleaned}, '{pattern}') THEN try_cast({cleaned} AS {dtype}) END"


_DEC = r"^[0-9]*\.?[0-9]+$"
NUMERIC = f"""SELECT * REPLACE ({num_sql('discounted_price', '[₹$€,]', _DEC, 'DOUBLE')} AS discounted_price,
    {num_sql('actual_price', '[₹$€,]', _DEC, 'DOUBLE')} AS actual_price, {num_sql('rating', '[^0-9.]', _DEC, 'DOUBLE')} AS rating,
    {num_sql('rating_count', ',', '^[0-9]+$', 'INT')} AS rating_count, replace(category, '|', ' > ') AS category) FROM ({RESOLVED})"""


def numeric(t: Tables):
    return clean.clean_numeric(clean.resolve_schema(t["v_product_raw"]))


@register("clean_numeric", f"SELECT arrival, discounted_price, actual_price, rating, rating_count FROM ({NUMERIC})")
def clean_numeric(t: Tables):
    return numeric(t).select("arrival", "discounted_price", "actual_price", "rating", "rating_count")


@register(
    "category_path",
    rf"""SELECT 'arrow' AS style, arrival, category FROM ({NUMERIC})
    UNION ALL SELECT 'guillemet', arrival, regexp_replace(category_hierarchy, '\s+/\s+', ' › ', 'g') FROM v_product""",
)
def category_path(t: Tables):
    """P13."""
    arrow = numeric(t).select(F.lit("arrow").alias("style"), "arrival", "category")
    other = t["v_product"].select(F.lit("guillemet").alias("style"), "arrival", clean.guillemet_path(F.col("category_hierarchy")).alias("category"))
    return arrow.unionByName(other)


_PARTS = (("Title", "product_name"), ("Category", "category"), ("Description", "about_product"), ("Review Title", "review_title"), ("Review", "review_content"))
SEARCH_DOC = "concat_ws(' | ', " + ", ".join(f"CASE WHEN trim({c}) <> '' THEN '{label}: ' || {c} END" for label, c in _PARTS) + ")"


@register("search_document", f"SELECT arrival, {SEARCH_DOC} AS search_document FROM ({NUMERIC})")
def search_document(t: Tables):
    df = numeric(t)
    return df.select("arrival", clean.search_document(df).alias("search_document"))


@register(
    "embedding_document",
    "SELECT arrival, substring(concat_ws(' | ', " + ", ".join(f"CASE WHEN trim({c}) <> '' THEN {c} ELSE '' END" for _, c in _PARTS)
    + f"), 1, 8192) AS embedding_document FROM ({NUMERIC})",
)
def embedding_document(t: Tables):
    df = numeric(t)
    return df.select("arrival", clean.embedding_document(df).alias("embedding_document"))


@register(
    "review_sentence",
    f"""SELECT review_summary_id, CASE WHEN rating_count > 0 THEN 'Average rating: ' || CAST(average_rating AS VARCHAR) || ' out of 5 stars based on '
      || CAST(rating_count AS VARCHAR) || ' reviews. Customer sentiment score is ' || CAST(round(sentiment_score, 2) AS VARCHAR) || '.'
      ELSE 'No reviews yet.' END AS review_summary FROM ({CLEAN_REVIEWS})""",
)
def review_sentence(t: Tables):
    sentence = clean.review_sentence(F.col("average_rating"), F.col("rating_count"), F.round("sentiment_score", 2))
    return clean.clean_reviews(t["v_reviews"]).select("review_summary_id", sentence.alias("review_summary"))


TIERS = f"""SELECT arrival, discounted_price, rating, CASE WHEN discounted_price < 500 THEN 'Budget' WHEN discounted_price < 2000 THEN 'Mid-Range'
      WHEN discounted_price >= 2000 THEN 'Premium' ELSE 'Unknown' END AS price_tier,
      CASE WHEN rating >= 4.5 THEN 'Top Rated' WHEN rating >= 4 THEN 'Highly Rated' WHEN rating >= 3 THEN 'Average' ELSE 'Low Rating' END AS rating_tier,
      CAST(length({SEARCH_DOC}) AS INT) AS search_doc_length FROM ({NUMERIC})"""


def featured(t: Tables):
    df = numeric(t)
    return clean.gold_features(df.withColumn("search_document", clean.search_document(df)))


@register("tiers", TIERS)
def tiers(t: Tables):
    """P18, P19."""
    return featured(t).select("arrival", "discounted_price", "rating", "price_tier", "rating_tier", "search_doc_length")


@register("label_score", "SELECT query_id, product_id, label_score FROM v_grades")
def label_score(t: Tables):
    return t["v_labels"].select("query_id", "product_id", evaluate.label_score(F.col("label")).alias("label_score"))


@register("mask_pii", "SELECT arrival, sha256(user_id) AS user_id, '[REDACTED]' AS user_name FROM v_product_raw")
def mask_pii(t: Tables):
    return clean.mask_pii(t["v_product_raw"]).select("arrival", "user_id", "user_name")


def usable(col: str) -> str:
    return f"CASE WHEN trim({col}) <> '' AND lower(trim({col})) NOT IN ('null', 'none') THEN {col} END"


@register(
    "standardize_product",
    f"""SELECT arrival, coalesce({usable('sku')}, 'unknown') AS product_id,
      coalesce({usable('title')}, CASE WHEN {usable('sku')} IS NULL THEN 'Unnamed Product' ELSE 'Product ' || sku END) AS product_name,
      coalesce({usable('category')}, 'General') AS category_path, coalesce({usable('brand')}, '') AS brand_name,
      try_cast(coalesce({usable('price')}, {usable('list_price')}) AS DOUBLE) AS selling_price, try_cast({usable('rating')} AS DOUBLE) AS average_rating,
      coalesce(try_cast({usable('num_reviews')} AS INT), 0) AS review_count
    FROM (SELECT arrival, asin AS sku, title, CASE WHEN arrival % 5 = 0 THEN ' NONE' ELSE categories END AS category, CASE WHEN arrival % 4 = 0 THEN 'null' ELSE shelf END AS brand,
       CASE WHEN arrival % 3 = 0 THEN 'None' ELSE '12.5' END AS price, CASE WHEN arrival % 9 = 0 THEN 'abc' ELSE '15' END AS list_price, stars AS rating,
       CAST(arrival % 50 AS VARCHAR) AS num_reviews FROM v_product_raw)""",
)
def standardize_product(t: Tables):
    """P22, P23."""
    n = F.col("arrival")
    rows = t["v_product_raw"].select(
        "arrival", F.col("asin").alias("sku"), "title",
        F.when(n % 5 == 0, " NONE").otherwise(F.col("categories")).alias("category"),
        F.when(n % 4 == 0, "null").otherwise(F.col("shelf")).alias("brand"),
        F.when(n % 3 == 0, "None").otherwise("12.5").alias("price"),
        F.when(n % 9 == 0, "abc").otherwise("15").alias("list_price"),
        F.col("stars").alias("rating"), (n % 50).cast("string").alias("num_reviews"),
    )
    # the arrival number rides along as a summary to keep rows apart
    out = clean.standardize_product(rows.withColumn("review_summary", n.cast("string")))
    return out.select(
        F.col("review_summary").cast("long").alias("arrival"), "product_id", "product_name", "category_path", "brand_name",
        "selling_price", "average_rating", "review_count",
    )


@register(
    "category_leaf_parent",
    r"""WITH s AS (SELECT arrival, category_hierarchy AS path, list_filter(regexp_split_to_array(category_hierarchy, '\s*[>›/]\s*'), lambda p: p <> '') AS p FROM v_product)
    SELECT arrival, CASE WHEN len(p) > 0 THEN p[len(p)] ELSE path END AS leaf,
      CASE WHEN len(p) > 2 THEN p[1] || ' › ' || p[len(p) - 1] WHEN len(p) > 1 THEN p[1] END AS parent FROM s""",
)
def category_leaf_parent(t: Tables):
    leaf, parent = clean.leaf_and_parent(F.col("category_hierarchy"))
    return t["v_product"].select("arrival", leaf.alias("leaf"), parent.alias("parent"))


PARSED = """SELECT product_id, trim(split_part(pair, ':', 1)) AS attribute_name, trim(substring(pair, position(':' IN pair) + 1)) AS attribute_value
    FROM (SELECT product_id, unnest(string_split(product_features, '|')) AS pair FROM v_product) WHERE contains(pair, ':')"""


@register("parse_features", PARSED)
def parse_features(t: Tables):
    return clean.parse_features(t["v_product"])


KEYWORDS = r"""SELECT product_id, arrival, array_to_string(list_sort(list_distinct(list_filter(
      list_concat([lower(trim(string_split(coalesce(category_hierarchy, ''), '/')[-1]))], regexp_extract_all(lower(coalesce(product_name, '')), '[\p{L}\p{N}_]+')),
      lambda w: w <> '' AND w NOT IN ('and', 'or', 'the', 'a', 'an', 'by', 'for', 'with', 'to', 'of', 'in', 'on', 'at', 'from', 'browse', 'all', 'shop')))), ', ') AS keywords FROM v_product"""


@register("keywords", f"SELECT product_id, keywords FROM ({KEYWORDS})")
def keywords(t: Tables):
    return clean.keywords(t["v_product"])


@register(
    "rich_text",
    f"""WITH c AS ({CLEAN_PRODUCT}), a AS (SELECT product_id, string_agg(attribute_name || ': ' || attribute_value, ', ' ORDER BY pos) AS top_attributes
      FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY attribute_name, attribute_value, attribute_id) AS pos FROM v_attributes)
      WHERE pos <= 5 GROUP BY product_id)
    SELECT product_id, concat_ws(' | ', {decode_sql('product_name')}, product_class, trim(string_split(category_hierarchy, '/')[-1]),
      substring({decode_sql('product_description')}, 1, 200), top_attributes) AS rich_text FROM c LEFT JOIN a USING (product_id)""",
)
def rich_text(t: Tables):
    return clean.rich_text(clean.normalized_text(clean.clean_product(t["v_product"])), t["v_attributes"])


@register(
    "cache_key",
    "SELECT query_id, 'search:' || md5(query || ':1:page_size=20:threshold=0.58') AS cache_key FROM v_queries",
)
def cache_key(t: Tables):
    key = clean.cache_key("search", [F.col("query"), F.lit(1)], {"threshold": F.lit("0.58"), "page_size": F.lit(20)})
    return t["v_queries"].select("query_id", key.alias("cache_key"))
