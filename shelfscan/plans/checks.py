"""Data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfscan.functions.text import is_blank
from shelfscan.operators import clean, quality as q
from shelfscan.plans.cleaning import ATTR_NAME, CLEAN_PRODUCT, CLEAN_REVIEWS, KEYWORDS, NUMERIC, SEARCH_DOC, initcap, numeric
from shelfscan.plans.registry import register
from shelfscan.sources.fixtures import Tables

RUN = "run-1"
order = lambda *cols: [F.col(c) for c in cols]


def product(t: Tables):
    rows = clean.clean_product(t["v_product"])
    return q.check(q.deduplicate(rows, ["product_id"], order("arrival")), q.product_rules())


def pricing(t: Tables):
    rows = clean.clean_pricing(t["v_pricing"])
    one = q.deduplicate(rows, ["product_id", "effective_from"], order("price_id", "selling_price", "list_price"))
    return q.check(one, q.pricing_rules())


def attributes(t: Tables):
    rows = clean.standard_attributes(t["v_attributes"])
    return q.check(q.deduplicate(rows, ["product_id", "attribute_name"], order("attribute_id")), q.attribute_rules())


def reviews(t: Tables):
    rows = clean.clean_reviews(t["v_reviews"]).withColumn("sentiment_score", F.round("sentiment_score", 2))
    return q.check(q.deduplicate(rows, ["product_id"], order("review_summary_id")), q.review_rules())


def labels(t: Tables):
    rows = t["v_raw_labels"].withColumn("label", clean.standard_label(F.col("label")))
    return q.check(q.deduplicate(rows, ["query_id", "product_id"], order("arrival")), q.label_rules())


def brands(t: Tables):
    return q.check(q.deduplicate(clean.clean_brand(t["v_brand"]), ["brand_id"], order("brand_name")), q.named_rules("brand"))


def categories(t: Tables):
    return q.check(q.deduplicate(clean.clean_category(t["v_category"]), ["category_id"], order("category_name")), q.named_rules("category"))


def queries(t: Tables):
    rows = t["benchmark"].select(
        F.when(F.col("item_id") % 11 == 0, " ").otherwise(F.col("item_id").cast("string")).alias("query_id"),
        F.when(F.col("item_id") % 9 == 0, "").otherwise(F.col("text")).alias("query"), "item_id",
    )
    return q.check(q.deduplicate(rows, ["query_id"], order("item_id")), q.query_rules())


# Checking side: deduplicated tables with their first failed rule.
def first(name: str, source: str, keys: str, by: str, rules: list[tuple[str, str, str]], key: str) -> str:
    whens = " ".join(f"WHEN {cond} THEN {i}" for i, (_, cond, _) in enumerate(rules))
    names = " ".join(f"WHEN {cond} THEN '{rule}'" for rule, cond, _ in rules)
    reasons = " ".join(f"WHEN {cond} THEN {reason}" for _, cond, reason in rules)
    return f"""d_{name} AS (SELECT *, CASE {names} END AS rule_name, CASE {reasons} END AS violation_reason, coalesce(CAST({key} AS VARCHAR), '(unknown)') AS record_key
      FROM (SELECT *, count(*) OVER (PARTITION BY {keys}) AS copies FROM ({source})
            QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {by}) = 1))"""


S = lambda c: f"coalesce(CAST({c} AS VARCHAR), 'None')"
NB = lambda c: f"({c} IS NULL OR trim({c}) = '')"
D_PRODUCT = first(
    "product", CLEAN_PRODUCT, "product_id", "arrival",
    [
        ("null_product_id", NB("product_id"), "'product_id is null or empty'"),
        ("empty_product_name", NB("product_name"), "'product_name is null or empty'"),
        ("invalid_ratings_bounds", "rating_count < 0 OR average_rating < 0 OR average_rating > 5",
         f"'average_rating (' || {S('average_rating')} || ') or rating_count (' || {S('rating_count')} || ') out of valid bounds'"),
    ], "product_id",
)
CLEAN_PRICING = """SELECT * REPLACE (coalesce(trim(currency), 'INR') AS currency, coalesce(trim(price_bucket), 'Mid-range') AS price_bucket) FROM v_pricing"""
D_PRICING = first(
    "pricing", CLEAN_PRICING, "product_id, effective_from", "price_id NULLS FIRST, selling_price NULLS FIRST, list_price NULLS FIRST",
    [
        ("null_keys", "price_id IS NULL OR product_id IS NULL", "'price_id or product_id key is null'"),
        ("invalid_prices", "selling_price < 0 OR list_price < 0 OR selling_price > list_price",
         f"'selling_price (' || {S('selling_price')} || ') > list_price (' || {S('list_price')} || ') or negative value'"),
        ("invalid_currency", "currency <> 'INR'", "'currency ''' || currency || ''' is not INR'"),
    ], "price_id",
)
STD_ATTRIBUTES = f"SELECT * REPLACE ({ATTR_NAME} AS attribute_name) FROM v_attributes"
D_ATTRIBUTES = first(
    "attributes", STD_ATTRIBUTES, "product_id, attribute_name", "attribute_id",
    [
        ("null_keys", "attribute_id IS NULL OR product_id IS NULL", "'attribute_id or product_id key is null'"),
        ("empty_attribute_specs", f"{NB('attribute_name')} OR {NB('attribute_value')}", "'attribute_name or attribute_value is empty'"),
    ], "attribute_id",
)
D_REVIEWS = first(
    "reviews", f"SELECT * REPLACE (round(sentiment_score, 2) AS sentiment_score) FROM ({CLEAN_REVIEWS})", "product_id", "review_summary_id",
    [
        ("null_keys", "review_summary_id IS NULL OR product_id IS NULL", "'review_summary_id or product_id key is null'"),
        ("invalid_sentiment_score", "sentiment_score < -1 OR sentiment_score > 1",
         f"'sentiment_score (' || {S('sentiment_score')} || ') is out of valid bounds [-1, 1]'"),
    ], "review_summary_id",
)
D_LABELS = first(
    "labels", f"SELECT * REPLACE ({initcap('trim(label)')} AS label) FROM v_raw_labels", "query_id, product_id", "arrival",
    [
        ("null_keys", "id IS NULL OR query_id IS NULL OR product_id IS NULL", "'id, query_id or product_id key is null'"),
        ("invalid_label_value", "label IS NULL OR label NOT IN ('Exact', 'Partial', 'Irrelevant')",
         f"'label value ''' || {S('label')} || ''' is not one of [''Exact'', ''Partial'', ''Irrelevant'']'"),
    ], "id",
)
D_BRANDS = first(
    "brand", "SELECT brand_id, coalesce(trim(brand_name), 'Generic') AS brand_name FROM v_brand", "brand_id", "brand_name",
    [("null_keys", "brand_id IS NULL", "'brand_id key is null'"), ("blank_brand_name", NB("brand_name"), "'brand_name is blank or empty'")], "brand_id",
)
D_CATEGORIES = first(
    "category", "SELECT * REPLACE (coalesce(trim(category_name), 'Unknown') AS category_name) FROM v_category", "category_id", "category_name",
    [("null_keys", "category_id IS NULL", "'category_id key is null'"), ("blank_category_name", NB("category_name"), "'category_name is blank or empty'")],
    "category_id",
)
D_QUERIES = first(
    "queries", """SELECT CASE WHEN item_id % 11 = 0 THEN ' ' ELSE CAST(item_id AS VARCHAR) END AS query_id,
      CASE WHEN item_id % 9 = 0 THEN '' ELSE text END AS query, item_id FROM benchmark""", "query_id", "item_id",
    [("null_query_id", NB("query_id"), "'query_id is null or empty'"), ("empty_query_string", NB("query"), "'query string is empty or null'")], "query_id",
)
ENTITIES = {
    "product": (product, D_PRODUCT, "d_product", "product_id"),
    "product_pricing": (pricing, D_PRICING, "d_pricing", "price_id"),
    "product_attributes": (attributes, D_ATTRIBUTES, "d_attributes", "attribute_id"),
    "product_review_summary": (reviews, D_REVIEWS, "d_reviews", "review_summary_id"),
    "label": (labels, D_LABELS, "d_labels", "id"),
    "brand": (brands, D_BRANDS, "d_brand", "brand_id"),
    "category": (categories, D_CATEGORIES, "d_category", "category_id"),
    "query": (queries, D_QUERIES, "d_queries", "query_id"),
}


def union(frames):
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def rejects(t: Tables, *names: str):
    return union(q.quarantine(ENTITIES[n][0](t), n, F.col(ENTITIES[n][3]), RUN) for n in names)


def rejects_sql(*names: str, where: str = "rule_name IS NOT NULL") -> str:
    ctes = ", ".join(ENTITIES[n][1] for n in names)
    parts = " UNION ALL ".join(
        f"SELECT '{RUN}' AS run_id, '{n}' AS source_table, rule_name, violation_reason, record_key FROM {ENTITIES[n][2]} WHERE {where}" for n in names
    )
    return f"WITH {ctes} {parts}"


@register("quarantine", rejects_sql(*ENTITIES))
def quarantine(t: Tables):
    """All entities, first failed rule per row."""
    return rejects(t, *ENTITIES)


def _rules(key: str, names: list[str], rule_like: str):
    where = " OR ".join(f"rule_name LIKE '{r}'" for r in rule_like.split("|"))

    @register(key, rejects_sql(*names, where=f"({where})"))
    def build(t: Tables):
        cond = F.lit(False)
        for r in rule_like.split("|"):
            cond = cond | F.col("rule_name").like(r)
        return rejects(t, *names).filter(cond)

    return build


_rules("dq_null_keys", list(ENTITIES), "null%")
_rules("dq_blank_text", ["product", "query", "brand", "category", "product_attributes"], "empty%|blank%")
_rules("dq_rating_bounds", ["product"], "invalid%")
_rules("dq_sentiment_bounds", ["product_review_summary"], "invalid%")
_rules("dq_price", ["product_pricing"], "invalid%")


@register(
    "label_validate",
    f"""WITH {D_LABELS} SELECT query_id, product_id, id, label, rule_name IS NULL AS valid FROM d_labels""",
)
def label_validate(t: Tables):
    """P6, F6."""
    return labels(t).select("query_id", "product_id", "id", "label", (F.size(q.FAILED) == 0).alias("valid"))


@register(
    "split_valid_rejected",
    """SELECT arrival, product_id, CASE WHEN trim(product_id) <> '' AND trim(product_name) <> '' THEN NULL ELSE 'Missing product_id or product_name' END AS rejection_reason
    FROM (SELECT arrival, asin AS product_id, title AS product_name FROM v_product_raw)""",
)
def split_valid_rejected(t: Tables):
    """both sides together are the input."""
    checked = q.check(numeric(t), q.identified_rules())
    good = q.valid(checked).select("arrival", "product_id", F.lit(None).cast("string").alias("rejection_reason"))
    bad = q.rejected(checked).select("arrival", "product_id", F.get(q.FAILED, F.lit(0))["violation_reason"].alias("rejection_reason"))
    return good.unionByName(bad)


def report_sql(name: str) -> str:
    view = ENTITIES[name][2]
    return f"""SELECT '{name}' AS table_name, CAST(sum(copies) AS BIGINT) AS records_read, count(*) FILTER (rule_name IS NULL) AS records_written,
      CAST(sum(copies) - count(*) AS BIGINT) AS duplicates, count(*) FILTER (rule_name IS NOT NULL) AS invalid_records,
      round(count(*) FILTER (rule_name IS NULL) / sum(copies), 4) AS quality_score FROM {view}"""


REPORT_SQL = f"WITH {', '.join(e[1] for e in ENTITIES.values())} " + " UNION ALL ".join(report_sql(n) for n in ENTITIES)


@register("dq_report", REPORT_SQL)
def dq_report(t: Tables):
    """F9."""
    return union(q.dq_report(build(t), name) for name, (build, *_) in ENTITIES.items())


@register("dq_gate", f"SELECT table_name, quality_score, quality_score >= 0.8 AS passed FROM ({REPORT_SQL})")
def dq_gate(t: Tables):
    """the verdict as a table; ``quality.gate`` turns it into a stop."""
    return dq_report(t).select("table_name", "quality_score", (F.col("quality_score") >= 0.8).alias("passed"))


@register(
    "dq_score",
    """WITH f AS (SELECT 'product' AS table_name, count(*) AS row_count, count(*) FILTER (product_id IS NULL) AS null_product_id,
      count(*) FILTER (product_name IS NULL) AS null_product_name, count(*) FILTER (product_class IS NULL) AS null_product_class,
      count(*) - (SELECT count(*) FROM (SELECT DISTINCT product_id FROM v_product)) AS duplicate_keys, count(*) = 0 AS is_empty FROM v_product)
    SELECT *, round((CASE WHEN duplicate_keys > 0 THEN 0.8::DOUBLE ELSE 1 END) * pow(0.9::DOUBLE, (null_product_id > 0)::INT + (null_product_name > 0)::INT + (null_product_class > 0)::INT), 6) AS quality_score FROM f""",
)
def dq_score(t: Tables):
    """F10."""
    return q.dq_score(t["v_product"], "product", "product_id", ["product_id", "product_name", "product_class"])


@register(
    "contract_check",
    """WITH f AS (SELECT count(*) AS n, count(*) FILTER (price_id IS NULL) AS nk, count(*) FILTER (price_id IS NOT NULL) - count(DISTINCT price_id) AS dk,
        count(*) FILTER (selling_price IS NULL) AS ns, count(*) FILTER (list_price IS NULL) AS nl FROM v_pricing),
      l AS (SELECT unnest([{'a': 'min_rows', 's': '100', 'v': greatest(100 - n, 0)}, {'a': 'required_column', 's': 'price_id', 'v': 0},
        {'a': 'required_column', 's': 'warranty', 'v': 1}, {'a': 'null_key', 's': 'price_id', 'v': nk}, {'a': 'duplicate_key', 's': 'price_id', 'v': dk},
        {'a': 'not_null', 's': 'selling_price', 'v': ns}, {'a': 'not_null', 's': 'list_price', 'v': nl}, {'a': 'type', 's': 'list_price', 'v': 0},
        {'a': 'type', 's': 'effective_from', 'v': 1}]) AS x FROM f)
    SELECT 'pricing' AS table_name, x.a AS assertion, x.s AS subject, CAST(x.v AS BIGINT) AS violations, x.v = 0 AS passed FROM l""",
)
def contract_check(t: Tables):
    """F12."""
    return q.contract(
        t["v_pricing"], "pricing", required=["price_id", "warranty"], key="price_id", mandatory=["selling_price", "list_price"],
        types={"list_price": "decimal(10,2)", "effective_from": "string"}, min_rows=100,
    )


@register(
    "fk_check",
    """SELECT 'master_brand' AS check_name, count(*) AS orphan_rows, count(*) = 0 AS passed FROM v_master WHERE brand_id NOT IN (SELECT brand_id FROM v_brand WHERE brand_id IS NOT NULL)
    UNION ALL SELECT 'lineitem_part', count(*), count(*) = 0 FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)""",
)
def fk_check(t: Tables):
    """F13."""
    return q.fk_check(t["v_master"], "brand_id", t["v_brand"], "brand_id", "master_brand").unionByName(
        q.fk_check(t["lineitem"], "l_partkey", t["part"], "p_partkey", "lineitem_part")
    )


@register(
    "fk_repair",
    f"""WITH {D_PRODUCT}, p AS (SELECT product_id FROM d_product WHERE rule_name IS NULL),
      x AS (SELECT 'label_product' AS link, id AS record_key, product_id AS fk, product_id IN (SELECT product_id FROM p) AS ok FROM v_raw_labels
        UNION ALL SELECT 'label_query', id, query_id, query_id IN (SELECT query_id FROM v_queries) FROM v_raw_labels
        UNION ALL SELECT 'pricing_product', price_id, product_id, product_id IN (SELECT product_id FROM p) FROM v_pricing
        UNION ALL SELECT 'attributes_product', attribute_id, product_id, product_id IN (SELECT product_id FROM p) FROM v_attributes
        UNION ALL SELECT 'reviews_product', review_summary_id, product_id, product_id IN (SELECT product_id FROM p) FROM v_reviews
        UNION ALL SELECT 'master_product', sku, product_id, product_id IN (SELECT product_id FROM p) FROM v_master)
    SELECT link, record_key, fk, CASE WHEN ok THEN 'kept' ELSE 'orphan' END AS outcome FROM x WHERE fk IS NOT NULL""",
)
def fk_repair(t: Tables):
    """Matches kept, orphans reported."""
    products = q.valid(product(t)).select("product_id")
    links = [
        ("label_product", t["v_raw_labels"], "id", "product_id", products, "product_id"),
        ("label_query", t["v_raw_labels"], "id", "query_id", t["v_queries"], "query_id"),
        ("pricing_product", t["v_pricing"], "price_id", "product_id", products, "product_id"),
        ("attributes_product", t["v_attributes"], "attribute_id", "product_id", products, "product_id"),
        ("reviews_product", t["v_reviews"], "review_summary_id", "product_id", products, "product_id"),
        ("master_product", t["v_master"], "sku", "product_id", products, "product_id"),
    ]
    out = []
    for link, child, key, fk, parent, pk in links:
        rows = child.select(F.col(key).alias("record_key"), F.col(fk).alias("fk"))
        out.append(q.fk_outcomes(rows, "fk", parent, pk).select(F.lit(link).alias("link"), "record_key", "fk", "outcome"))
    return union(out)


@register(
    "category_parent_repair",
    """SELECT c.category_id, c.category_name, CASE WHEN p.category_id IS NOT NULL THEN c.parent_category_id END AS parent_category_id,
      CASE WHEN p.category_id IS NULL THEN c.parent_category_id END AS broken_parent FROM v_category c LEFT JOIN v_category p ON c.parent_category_id = p.category_id""",
)
def category_parent_repair(t: Tables):
    """F15, J5."""
    return q.parent_repair(t["v_category"])


@register(
    "text_readiness",
    f"""SELECT 'catalog' AS source, count(*) AS total, count(*) FILTER (trim(searchable_text) = '' OR searchable_text IS NULL) AS empty,
      count(*) > 0 AND count(*) FILTER (trim(searchable_text) = '' OR searchable_text IS NULL) = 0 AS ready FROM v_catalog
    UNION ALL SELECT 'titles', count(*), count(*) FILTER (trim(title) = ''), count(*) FILTER (trim(title) = '') = 0 FROM v_product_raw""",
)
def text_readiness(t: Tables):
    """F16, F17."""
    a = q.text_readiness(t["v_catalog"], "searchable_text").select(F.lit("catalog").alias("source"), "*")
    return a.unionByName(q.text_readiness(t["v_product_raw"], "title").select(F.lit("titles").alias("source"), "*"))


@register(
    "readiness_samples",
    """SELECT asin, categories, title FROM v_product_raw WHERE title IS NULL OR trim(title) = '' ORDER BY asin NULLS FIRST, categories NULLS FIRST, title NULLS FIRST LIMIT 5""",
)
def readiness_samples(t: Tables):
    """the rows that go with a failed readiness check."""
    return q.blank_samples(t["v_product_raw"], "title", "asin", "categories", "title")


@register(
    "query_policy",
    r"""WITH r AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS query_id, CASE WHEN turn % 5 = 3 THEN '  ' ELSE text END AS query FROM conversations),
    v AS (SELECT query_id, CASE WHEN query IS NULL OR regexp_replace(query, '\s', '', 'g') = '' THEN 'Empty search query is rejected.'
      WHEN length(query) > 512 THEN 'Query length (' || length(query) || ') exceeds maximum allowed limit (512 characters).'
      WHEN regexp_matches(query, '[^\p{L}\p{N}_\s\-.,?!''"]') THEN 'Query contains unsupported or anomalous characters.' END AS reason FROM r)
    SELECT query_id, reason IS NULL AS valid, reason FROM v""",
)
def query_policy(t: Tables):
    """F18, over every conversation turn."""
    rows = t["conversations"].select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("query_id"),
        F.when(F.col("turn") % 5 == 3, "  ").otherwise(F.col("text")).alias("query"),
    )
    return q.query_policy(rows)


@register("duplicate_keys", """WITH c AS (SELECT asin AS product_id, count(*) AS copies FROM v_product_raw GROUP BY 1)
    SELECT product_id, copies, (SELECT CAST(sum(copies) AS BIGINT) FROM c) AS total, (SELECT CAST(sum(copies) - count(*) AS BIGINT) FROM c) AS duplicates
    FROM c WHERE copies > 1 ORDER BY copies DESC, product_id LIMIT 5""")
def duplicate_keys(t: Tables):
    """F20."""
    return q.duplicate_keys(t["v_product_raw"].withColumnRenamed("asin", "product_id"), "product_id")


@register(
    "price_overlap",
    """SELECT price_id, product_id, effective_from, last.id AS previous_price_id, last.until AS previous_to FROM (
      SELECT *, arg_max({'id': price_id, 'until': effective_to}, (coalesce(effective_to, DATE '9999-12-31'), effective_from, price_id)) OVER w AS last,
        max(coalesce(effective_to, DATE '9999-12-31')) OVER w AS until FROM v_pricing WHERE price_id IS NOT NULL AND product_id IS NOT NULL
      WINDOW w AS (PARTITION BY product_id ORDER BY effective_from, price_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE until > effective_from""",
)
def price_overlap(t: Tables):
    """F21."""
    return q.price_overlap(t["v_pricing"].filter(F.col("price_id").isNotNull()))


GOOD_RAW = f"(SELECT * FROM ({NUMERIC}) WHERE trim(product_id) <> '' AND trim(product_name) <> '')"


def clean_rows(t: Tables):
    return q.valid(q.check(numeric(t), q.identified_rules()))


@register(
    "tier_drop_rate",
    f"""WITH n AS (SELECT (SELECT count(*) FROM v_product_raw) AS raw_records, (SELECT count(*) FROM {GOOD_RAW}) AS clean_records,
      (SELECT count(DISTINCT product_id) FROM {GOOD_RAW}) AS gold_records)
    SELECT *, round((raw_records - clean_records) / raw_records, 4) AS drop_rate, round(100.0 * gold_records / raw_records, 2)::DOUBLE AS survival_pct FROM n""",
)
def tier_drop_rate(t: Tables):
    """F22."""
    good = clean_rows(t)
    return q.drop_rate(t["v_product_raw"], good, q.best_record(good, "product_id", order("arrival")))


@register(
    "text_diversity",
    f"""SELECT round(count(DISTINCT {SEARCH_DOC}) / count(*), 6) AS uniqueness,
      CAST(sum(CASE WHEN regexp_matches(kw, '\\b(and|the|for|with)\\b') THEN 1 ELSE 0 END) AS BIGINT) AS stopword_rows,
      CAST(sum(CASE WHEN len(list_distinct(list_transform(string_split(kw, ','), lambda w: trim(w)))) < len(string_split(kw, ',')) THEN 1 ELSE 0 END) AS BIGINT) AS repeated_keyword_rows
    FROM (SELECT *, review_title || ', ' || about_product || ', the' AS kw FROM (SELECT * REPLACE (coalesce(review_title, '') AS review_title) FROM ({NUMERIC})))""",
)
def text_diversity(t: Tables):
    """F23."""
    rows = numeric(t).withColumn("review_title", F.coalesce("review_title", F.lit("")))
    rows = rows.withColumn("document", clean.search_document(rows)).withColumn(
        "kw", F.concat("review_title", F.lit(", "), "about_product", F.lit(", the"))
    )
    return q.text_diversity(rows, "document", "kw")


@register(
    "dedup_keys",
    """SELECT product_id, product_name, arrival, copies FROM (SELECT *, count(*) OVER (PARTITION BY product_id) AS copies FROM v_product
      QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY arrival) = 1)""",
)
def dedup_keys(t: Tables):
    """W1."""
    return q.deduplicate(t["v_product"].select("product_id", "product_name", "arrival"), ["product_id"], order("arrival"))


@register(
    "dedup_best",
    f"""SELECT product_id, product_name, rating, rating_count, arrival FROM ({NUMERIC})
    QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY arrival % 3 DESC, rating DESC NULLS LAST, rating_count DESC NULLS LAST, arrival DESC) = 1""",
)
def dedup_best(t: Tables):
    """The latest update wins, then rating and rating count; updates are of three days."""
    day = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(arrival % 3 as int))")
    rows = numeric(t).select("product_id", "product_name", "rating", "rating_count", "arrival", day.alias("updated_at"))
    return q.best_record(rows, "product_id", order("arrival")).drop("updated_at")
