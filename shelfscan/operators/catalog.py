"""Gold assembly: prices in force, attribute roll-up, the search catalog."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscan.session import cut_lineage

from shelfscan.functions.ranking import ordered_text, top_k
from shelfscan.functions.text import is_blank
from shelfscan.operators.clean import guillemet_path, review_sentence, searchable_text


def active_price(prices: DataFrame, as_of: datetime.date | str) -> DataFrame:
    """One price per product: the latest in force on ``as_of``."""
    day = F.lit(str(as_of)).cast("date")
    live = prices.filter((F.col("effective_from") <= day) & (F.coalesce(F.col("effective_to") > day, F.lit(True))))
    latest = top_k(live, ["product_id"], [F.col("effective_from").desc(), F.col("price_id").desc_nulls_last()], 1, "_pos")
    return latest.drop("_pos")


def attribute_summary(attributes: DataFrame) -> DataFrame:
    """``name: value [unit]`` per product, sorted by name, value and id."""
    unit = F.when(~is_blank(F.col("attribute_unit")), F.concat(F.lit(" "), F.col("attribute_unit"))).otherwise("")
    text = F.concat(F.col("attribute_name"), F.lit(": "), F.col("attribute_value"), unit)
    rows = F.collect_list(F.when(text.isNotNull(), F.struct("attribute_name", "attribute_value", "attribute_id", text.alias("text"))))
    return attributes.groupBy("product_id").agg(ordered_text(rows, ", ", "text").alias("attribute_summary"))


def search_catalog(
    products: DataFrame, master: DataFrame, brands: DataFrame, prices: DataFrame, attributes: DataFrame, reviews: DataFrame
) -> DataFrame:
    """Denormalised search rows, one per product of the master.

    ``prices`` and ``reviews`` hold at most one row per product. No side is
    forced into a broadcast: Spark broadcasts brands when their size allows.
    """
    review_cols = reviews.select(
        "product_id", F.col("average_rating").alias("_r_rating"), F.col("rating_count").alias("_r_count"), "sentiment_score"
    )
    joined = (
        master.select("product_id", "brand_id")
        .join(products, "product_id")
        .join(brands.select("brand_id", "brand_name"), "brand_id", "left")
        .join(prices.select("product_id", "selling_price"), "product_id", "left")
        .join(attribute_summary(attributes), "product_id", "left")
        .join(review_cols, "product_id", "left")
        .withColumns(
            {
                "brand_name": F.coalesce("brand_name", F.lit("Generic")),
                "attribute_summary": F.coalesce("attribute_summary", F.lit("")),
                "review_summary": review_sentence(F.col("_r_rating"), F.col("_r_count"), F.col("sentiment_score")),
                "category_path": guillemet_path(F.col("category_hierarchy")),
            }
        )
        .withColumn("searchable_text", searchable_text())
    )
    return joined.select(
        "product_id", "product_name", "category_path", "attribute_summary", "review_summary", "searchable_text", "brand_name",
        F.col("selling_price").cast("double").alias("selling_price"),
        F.col("average_rating").cast("double").alias("average_rating"),
        F.col("review_count").cast("int").alias("review_count"),
    )


def showcase(
    products: DataFrame, master: DataFrame, categories: DataFrame, brands: DataFrame, prices: DataFrame, reviews: DataFrame, keywords: DataFrame,
    where: Column | None = None,
) -> DataFrame:
    """Star join of the product with its dimensions; keywords are optional."""
    joined = (
        master.select("product_id", "category_id", "brand_id")
        .join(products.select("product_id", "product_name", "product_class", "product_description"), "product_id")
        .join(categories.select("category_id", "category_name"), "category_id")
        .join(brands.select("brand_id", "brand_name"), "brand_id")
        .join(prices.select("product_id", "list_price", "selling_price", "price_bucket"), "product_id")
        .join(reviews.select("product_id", "average_rating", "sentiment_score"), "product_id")
        .join(keywords, "product_id", "left")
    )
    out = joined if where is None else joined.filter(where)
    return out.select(
        "product_id", "product_name", "product_class", "product_description", "category_name", "brand_name",
        "list_price", "selling_price", "price_bucket", "average_rating", "sentiment_score", "keywords",
    )


def category_paths(categories: DataFrame, sep: str = " > ") -> DataFrame:
    """(category_id, path, cyclic): full path of each category, by joins with the parents until none is left.

    A category whose ancestors form a cycle is reported as ``cyclic``, with
    the path up to where the cycle closes.
    """
    up = categories.select(F.col("category_id").alias("_id"), F.col("parent_category_id").alias("_next"), F.col("category_name").alias("_name"))
    paths = categories.select(
        "category_id", F.col("parent_category_id").alias("_up"), F.col("category_name").alias("path"), F.array("category_id").alias("_seen"), F.lit(False).alias("cyclic")
    )
    climbing = F.col("_up").isNotNull() & ~F.col("cyclic")
    while paths.where(climbing).take(1):
        closes = F.coalesce(F.array_contains("_seen", F.col("_up")), F.lit(False))
        joined = paths.withColumn("cyclic", F.col("cyclic") | closes).join(up, (F.col("_up") == F.col("_id")) & ~F.col("cyclic"), "left")
        paths = cut_lineage(
            joined.select(
                "category_id", F.when(F.col("cyclic"), F.col("_up")).otherwise(F.col("_next")).alias("_up"), F.concat_ws(sep, "_name", "path").alias("path"),
                F.when(F.col("_id").isNull(), F.col("_seen")).otherwise(F.concat("_seen", F.array("_id"))).alias("_seen"), "cyclic",
            )
        )
    return paths.select("category_id", "path", "cyclic")
