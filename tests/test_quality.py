"""Golden rows of the rule engine and the cleaning rules."""

import pytest
from pyspark.sql import functions as F

from shelfscan.functions import text
from shelfscan.operators import clean, quality as q

PRODUCT = "product_id string, product_name string, rating_count long, average_rating double"


def test_unknown_rating_is_not_a_violation(spark):
    rows = spark.createDataFrame(
        [("1", "a", 0, None), ("2", "b", 3, 5.5), ("3", "c", -1, None), (None, "d", 1, 4.0), ("5", " ", 1, 4.0), ("6", "ok", 2, 5.0)], PRODUCT
    )
    checked = q.check(rows, q.product_rules())
    assert {r[0] for r in q.valid(checked).select("product_id").collect()} == {"1", "6"}
    bad = {r["record_key"]: r["rule_name"] for r in q.quarantine(checked, "product", F.col("product_id"), "r").collect()}
    assert bad == {
        "2": "invalid_ratings_bounds", "3": "invalid_ratings_bounds", "(unknown)": "null_product_id", "5": "empty_product_name",
    }


def test_first_failed_rule_wins_and_all_can_be_listed(spark):
    rows = spark.createDataFrame([(None, None, -1, None)], PRODUCT)
    checked = q.check(rows, q.product_rules())
    assert q.quarantine(checked, "product", F.col("product_id"), "r").count() == 1
    assert q.quarantine(checked, "product", F.col("product_id"), "r", every_rule=True).count() == 3


def test_empty_table(spark):
    rows = spark.createDataFrame([], PRODUCT)
    checked = q.check(q.deduplicate(rows, ["product_id"], [F.col("product_name")]), q.product_rules())
    report = q.dq_report(checked, "product").first()
    assert (report["records_read"], report["quality_score"]) == (0, 1.0)
    assert q.dq_score(rows, "product", "product_id", ["product_name"]).first()["is_empty"]
    assert q.contract(rows, "product", key="product_id").filter("NOT passed").count() == 1


def test_report_adds_up(spark):
    rows = spark.createDataFrame([("1", "a", 1, 1.0), ("1", "b", 1, 1.0), ("2", "", 1, 1.0), ("3", "c", 1, 9.0), ("4", "d", 1, 1.0)], PRODUCT)
    checked = q.check(q.deduplicate(rows, ["product_id"], [F.col("product_name")]), q.product_rules())
    r = q.dq_report(checked, "product").first()
    assert (r["records_read"], r["records_written"], r["duplicates"], r["invalid_records"], r["quality_score"]) == (5, 2, 1, 2, 0.4)
    with pytest.raises(ValueError, match="product=0.4"):
        q.gate(q.dq_report(checked, "product"))


def test_missing_label_and_currency_are_violations(spark):
    labels = spark.createDataFrame([("1", "q", "p", None), ("2", "q", "p2", "Exact")], "id string, query_id string, product_id string, label string")
    assert q.valid(q.check(labels, q.label_rules())).count() == 1
    prices = spark.createDataFrame(
        [("1", "p", None, 5.0, 10.0), ("2", "p", "INR", None, 10.0), ("3", "p", "INR", 11.0, 10.0)],
        "price_id string, product_id string, currency string, selling_price double, list_price double",
    )
    assert [r["price_id"] for r in q.valid(q.check(prices, q.pricing_rules())).collect()] == ["2"]


def test_survivor_does_not_depend_on_row_order(spark):
    rows = [(str(i % 3), f"n{i}", 1, float(i % 2)) for i in range(30)]
    pick = lambda rs: sorted(map(tuple, q.deduplicate(spark.createDataFrame(rs, PRODUCT), ["product_id"], [F.col("product_name")]).collect()))
    assert pick(rows) == pick(rows[::-1])


def test_best_record_prefers_known_rating(spark):
    rows = spark.createDataFrame([("1", None, 9), ("1", 4.0, 1), ("1", 4.0, 3), ("2", None, None)], "product_id string, rating double, rating_count int")
    best = {r["product_id"]: (r["rating"], r["rating_count"]) for r in q.best_record(rows, "product_id").collect()}
    assert best == {"1": (4.0, 3), "2": (None, None)}
    assert q.best_record(rows.union(rows), None).count() == 4


@pytest.mark.parametrize("query, ok", [("laptop", True), ("", False), (" " * 600, False), ("a" * 512, True), ("a" * 513, False), ("<b>", False), ("café 4k?", True)])
def test_query_policy(spark, query, ok):
    assert q.query_policy(spark.createDataFrame([("1", query)], "query_id string, query string")).first()["valid"] is ok


def test_blank_search_text_stops_the_job(spark):
    good = spark.createDataFrame([("1", "x")], "product_id string, searchable_text string")
    assert q.require_text(good).count() == 1
    bad = good.union(spark.createDataFrame([("2", "  ")], good.schema))
    with pytest.raises(Exception, match="blank in the search catalog"):
        q.require_text(bad).collect()


def test_overlap_across_months(spark):
    rows = spark.createDataFrame(
        [("a", "p", "2024-01-05", "2024-02-10"), ("b", "p", "2024-02-01", None), ("c", "p", "2024-05-01", "2024-06-01"), ("d", "z", "2024-01-01", "2024-01-02")],
        "price_id string, product_id string, f string, t string",
    ).selectExpr("price_id", "product_id", "date(f) AS effective_from", "date(t) AS effective_to")
    assert {(r["price_id"], r["previous_price_id"]) for r in q.price_overlap(rows).collect()} == {("b", "a"), ("c", "b")}


def test_overlap_with_a_longer_earlier_price(spark):
    rows = spark.createDataFrame(
        [("a", "2024-01-01", "2024-12-31"), ("b", "2024-02-01", "2024-02-10"), ("c", "2024-06-01", "2024-06-30"), ("d", "2025-01-01", None), ("e", None, None)],
        "price_id string, f string, t string",
    ).selectExpr("price_id", "'p' AS product_id", "date(f) AS effective_from", "date(t) AS effective_to")
    assert {(r["price_id"], r["previous_price_id"]) for r in q.price_overlap(rows).collect()} == {("b", "a"), ("c", "a")}


def test_headers_with_one_canonical_form(spark):
    rows = spark.createDataFrame([("1", "2", "3", "x")], "`list price` string, list_price string, price string, `My Note` string")
    out = clean.resolve_schema(rows, {"price": ("string", ("list_price", "price"))}).first().asDict()
    assert out == {"price": "2", "list price": "1", "price_other": "3", "My Note": "x"}


def test_broken_parent_is_unlinked(spark):
    rows = spark.createDataFrame([("a", None), ("b", "a"), ("c", "gone")], "category_id string, parent_category_id string")
    out = {r["category_id"]: (r["parent_category_id"], r["broken_parent"]) for r in q.parent_repair(rows).collect()}
    assert out == {"a": (None, None), "b": ("a", None), "c": (None, "gone")}


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "v string").select(col(F.col("v")).alias("o")).first()["o"]


def test_text_rules(spark):
    assert one(spark, text.decode_entities, " a &amp;lt;  b&quot; ") == 'a < b"'
    assert one(spark, text.sanitize_query, "  Red\tShoes!?  for  MEN. ") == "redshoes for men"
    assert one(spark, text.sanitize_query, "x" * 300) == "x" * 200
    assert one(spark, text.normalize_query, " A \n b ") == "a b"
    assert one(spark, lambda c: clean.guillemet_path(c), "a/b / c") == "a/b › c"


def test_levels_need_spaces_around_the_slash(spark):
    r = clean.category_levels(spark.createDataFrame([("a/b / c",)], "category_hierarchy string")).first()
    assert (r["level_1"], r["level_2"], r["level_3"]) == ("a/b", "c", "Unknown")


@pytest.mark.parametrize("price, tier", [(499.99, "Budget"), (500.0, "Mid-Range"), (2000.0, "Premium"), (None, "Unknown")])
def test_price_tier(spark, price, tier):
    assert spark.createDataFrame([(price,)], "p double").select(clean.price_tier(F.col("p")).alias("t")).first()["t"] == tier


@pytest.mark.parametrize("rating, tier", [(4.5, "Top Rated"), (4.0, "Highly Rated"), (3.0, "Average"), (2.9, "Low Rating"), (None, "Low Rating")])
def test_rating_tier(spark, rating, tier):
    assert spark.createDataFrame([(rating,)], "p double").select(clean.rating_tier(F.col("p")).alias("t")).first()["t"] == tier


def test_headers_resolve_and_numbers_do_not_overflow(spark):
    rows = spark.createDataFrame([("B1", "₹1,099.50", "99,999,999,999", "x")], ["ASIN", "Sale Price", "num-ratings", "shelf"])
    out = clean.clean_numeric(clean.resolve_schema(rows)).first()
    assert (out["product_id"], out["discounted_price"], out["rating_count"], out["rating"], out["shelf"]) == ("B1", 1099.5, None, None, "x")


def test_synonyms_join_keywords(spark):
    rows = spark.createDataFrame([("1", "The Oak Bed", "Home / Twin Beds")], "product_id string, product_name string, category_hierarchy string")
    synonyms = spark.createDataFrame([("bed", "bedstead")], "term string, synonym string")
    assert clean.keywords(rows, synonyms=synonyms).first()["keywords"] == "bed, bedstead, oak, twin beds"
