"""Profiles, distributions and facets, each in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscan.functions.ranking import top_k
from shelfscan.functions.text import is_blank

# Size of the distinct-value sketches: 2¹² registers, an error of about 1.6 %.
SKETCH_BITS = 12


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Non-blank count, blank count, blank percentage and distinct values per column.

    The rows are turned into (column, value) pairs, long values into their
    digests, and counted per pair in the map tasks, so exact distinct counts
    need one shuffle, no wide expand and no whole texts. ``exact=False`` uses
    sketches and shuffles no values at all.
    """
    pairs = _cells(df, columns)
    if not exact:
        return merged_profile(profile_sketches(df, columns))
    per_value = pairs.groupBy("column", _short(F.col("value")).alias("value"), is_blank(F.col("value")).alias("blank")).agg(F.count(F.lit(1)).alias("n"))
    blank = F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0))
    stats = per_value.groupBy("column").agg(F.sum("n").alias("total"), blank.alias("blank_count"), F.count(F.lit(1)).alias("distinct_values"))
    return _profiled(stats)


def _cells(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    columns = list(columns or df.columns)
    return df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    ).select("p.column", "p.value")


def _short(value: Column) -> Column:
    """The value, or its digest where that is shorter; the mark keeps digests apart from values."""
    return F.when(F.octet_length(value) > 33, F.concat(F.lit("#"), F.md5(value))).otherwise(value)


def profile_sketches(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, total, blank_count, sketch): what a part of a table leaves behind, to be stored and merged with other parts'.

    ``sketch`` is a HyperLogLog sketch of the values; a NULL is a value of its
    own, as in the exact profile.
    """
    value = F.coalesce(_short(F.col("value")), F.lit("#"))
    return _cells(df, columns).groupBy("column").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(is_blank(F.col("value"))).alias("blank_count"), F.hll_sketch_agg(value, F.lit(SKETCH_BITS)).alias("sketch")
    )


def merged_profile(sketches: DataFrame) -> DataFrame:
    """The profile of all parts together, from their sketches; counts are exact, distinct values within the sketch's error."""
    stats = sketches.groupBy("column").agg(
        F.sum("total").alias("total"), F.sum("blank_count").alias("blank_count"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values")
    )
    return _profiled(stats)


def _profiled(stats: DataFrame) -> DataFrame:
    return stats.select(
        "column", (F.col("total") - F.col("blank_count")).alias("non_blank"), "blank_count",
        F.round(100.0 * F.col("blank_count") / F.greatest("total", F.lit(1)), 2).alias("blank_pct"), "distinct_values",
    )


def number_stats(df: DataFrame, col: Column, digits: int = 2) -> DataFrame:
    """Count, mean, minimum, maximum and standard deviation."""
    v = col.cast("double")
    r = lambda c, name: F.round(c, digits).alias(name)
    return df.agg(
        F.count(v).alias("n"), r(F.avg(v), "avg_value"), r(F.min(v), "min_value"), r(F.max(v), "max_value"), r(F.stddev(v), "stddev_value")
    )


def distribution(df: DataFrame, bucket: str, value: Column) -> DataFrame:
    """Rows, mean value and share of all rows per bucket."""
    counts = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 2).alias("avg_value"))
    total = counts.agg(F.sum("n").alias("t")).select("t").scalar()
    return counts.select(F.col(bucket).alias("bucket"), "n", "avg_value", F.round(100.0 * F.col("n") / total, 1).alias("pct"))


def discount_stats(df: DataFrame, col: str = "discount_percentage", high: float = 50) -> DataFrame:
    """Discounts written as ``64%``: how many, mean, range, and how many are high."""
    v = F.replace(F.trim(F.col(col)), F.lit("%"), F.lit("")).try_cast("double")
    return df.agg(
        F.count(v).alias("with_discount"), F.round(F.avg(v), 6).alias("avg_discount"), F.min(v).alias("min_discount"),
        F.max(v).alias("max_discount"), F.count_if(v > high).alias("high_discount"),
    )


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation over the rows that have both values."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.corr(a, b), 6).alias("correlation"))


def facet(df: DataFrame, col: str, limit: int, where: Column | None = None) -> DataFrame:
    """Most frequent non-blank values; equal counts go by name."""
    rows = df if where is None else df.filter(where)
    rows = rows.filter(F.col(col).isNotNull() & (F.col(col) != ""))
    return (
        rows.groupBy(F.col(col).alias("name")).agg(F.count(F.lit(1)).alias("product_count"))
        .orderBy(F.col("product_count").desc(), "name").limit(limit)
    )


def facet_within(df: DataFrame, col: str, group: str, limit: int) -> DataFrame:
    """:func:`facet` for every group: (category, name, product_count, rank)."""
    rows = df.filter((F.col(col) != "") & (F.col(group) != ""))
    counts = rows.groupBy(F.col(group).alias("category"), F.col(col).alias("name")).agg(F.count(F.lit(1)).alias("product_count"))
    return top_k(counts, ["category"], [F.col("product_count").desc(), F.col("name")], limit)


def longest_documents(df: DataFrame, id_col: str, text: str, n: int = 5) -> DataFrame:
    return df.select(id_col, F.length(text).alias("n_chars")).orderBy(F.col("n_chars").desc(), id_col).limit(n)


def top_queries(log: DataFrame, until, days: int = 7, n: int = 10) -> DataFrame:
    """Most asked queries of the last ``days`` before ``until``."""
    end = F.lit(until).cast("timestamp_ntz")
    recent = log.filter((F.col("ts") > end - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col("ts") <= end))
    return (
        recent.groupBy("query")
        .agg(
            F.count(F.lit(1)).alias("searches"), F.round(F.avg("results"), 6).alias("avg_results"),
            F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"),
        )
        .orderBy(F.col("searches").desc(), "query").limit(n)
    )


def hit_rate(log: DataFrame) -> DataFrame:
    """Share of answers from the cache, in percent, 0 without traffic."""
    hits, total = F.count_if("cached"), F.count(F.lit(1))
    return log.agg(
        hits.alias("hits"), (total - hits).alias("misses"), F.round(F.coalesce(F.try_divide(100.0 * hits, total), F.lit(0.0)), 2).alias("hit_rate")
    )


def cart_totals(lines: DataFrame) -> DataFrame:
    """Quantity per product of each cart, at least 1, and the cart's item count."""
    per_product = lines.groupBy("session_id", "product_id").agg(F.greatest(F.sum("quantity"), F.lit(1)).alias("quantity"))
    totals = per_product.groupBy("session_id").agg(F.sum("quantity").alias("item_count"))
    return per_product.join(totals, "session_id")
