"""Ranking helpers with a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key with their rank.

    Written as ``row_number() <= k`` so that Spark keeps only ``k`` rows
    per key in every map task before the shuffle: a hot key stays cheap.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def top_hits(scored: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """Top ``k`` hits per query; the score is rounded before ties go to the id."""
    rounded = scored.withColumn("score", F.round("score", digits))
    return top_k(rounded, ["query_id"], [F.col("score").desc(), F.col("product_id")], k).select(
        "query_id", "product_id", "rank", "score"
    )


def ordered_text(rows: Column, sep: str, value: str) -> Column:
    """Join one field of an array of structs, sorted by the struct."""
    return F.array_join(F.transform(F.sort_array(rows), lambda r: r[value]), sep)
