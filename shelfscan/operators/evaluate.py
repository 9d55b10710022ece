"""Relevance metrics for all queries at once: one join, one conditional aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_score(label: Column) -> Column:
    """Exact 1.0, Partial 0.75, anything else 0.0; letter case and spaces ignored."""
    key = F.lower(F.trim(label))
    return F.when(key == "exact", 1.0).when(key == "partial", 0.75).otherwise(0.0)


def _gain(grade: Column, gain: str) -> Column:
    return grade if gain == "linear" else F.pow(F.lit(2.0), grade) - 1


def _relevant(grade: Column, min_grade: float) -> Column:
    return grade >= min_grade if min_grade > 0 else grade > 0


def _ideal_dcg(levels: Column, k: int, gain: str) -> Column:
    """Best reachable DCG at ``k`` from (grade, number of labels) pairs, best grade first."""

    def add(acc: Column, level: Column) -> Column:
        seen = acc["seen"]
        upto = F.least(seen + level["n"], F.lit(k).cast("long"))
        places = F.when(upto > seen, F.sequence(seen + 1, upto)).otherwise(F.array().cast("array<bigint>"))
        discount = F.aggregate(places, F.lit(0.0), lambda a, p: a + 1 / F.log2(p + 1))
        return F.struct((seen + level["n"]).alias("seen"), (acc["sum"] + _gain(level["grade"], gain) * discount).alias("sum"))

    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0.0).alias("sum"))
    return F.aggregate(levels, start, add, lambda acc: acc["sum"])


def per_query(
    hits: DataFrame,
    grades: DataFrame,
    queries: DataFrame,
    ks: Sequence[int] = (5, 10),
    min_grade: float = 0.5,
    empty_relevant: float = 1.0,
    gain: str = "linear",
) -> DataFrame:
    """Precision, recall, NDCG and hit rate per cut-off, MRR and counts.

    ``min_grade`` 0 means any positive grade counts as relevant.
    ``empty_relevant`` is the recall of a query without relevant labels.
    """
    # one full join holds hits and labels; counting per (query, grade) first
    # leaves a handful of rows per query, however many labels it has
    judged = hits.select("query_id", "product_id", "rank").join(
        grades.select("query_id", "product_id", "label_score"), ["query_id", "product_id"], "full_outer"
    )
    grade = F.coalesce("grade", F.lit(0.0))
    rel = F.coalesce(_relevant(F.col("grade"), min_grade), F.lit(False))
    rank = F.col("rank")
    per_grade = judged.groupBy("query_id", F.col("label_score").alias("grade")).agg(
        F.count("rank").alias("n_hits"),
        F.count("label_score").alias("n_labels"),
        F.min("rank").alias("first_rank"),
        *[F.count_if(rank <= k).alias(f"n_{k}") for k in ks],
        *[F.sum(F.when(rank <= k, 1 / F.log2(rank + 1)).otherwise(0.0)).alias(f"disc_{k}") for k in ks],
    )
    level = F.when(F.col("n_labels") > 0, F.struct("grade", F.col("n_labels").alias("n")))
    found = per_grade.groupBy("query_id").agg(
        F.sum("n_hits").alias("num_retrieved"),
        F.sum(F.when(rel, F.col("n_labels")).otherwise(0)).alias("num_relevant"),
        F.min(F.when(rel, F.col("first_rank"))).alias("first_rank"),
        F.sort_array(F.collect_list(level), asc=False).alias("levels"),
        *[F.sum(F.when(rel, F.col(f"n_{k}")).otherwise(0)).alias(f"hits_{k}") for k in ks],
        *[F.sum(_gain(grade, gain) * F.col(f"disc_{k}")).alias(f"dcg_{k}") for k in ks],
    )
    joined = (
        queries.select("query_id").distinct()
        .join(found, "query_id", "left")
        .withColumns({f"idcg_{k}": _ideal_dcg(F.col("levels"), k, gain) for k in ks})
    )
    n_rel = F.coalesce("num_relevant", F.lit(0))

    def or_zero(col: Column) -> Column:
        return F.coalesce(col, F.lit(0.0))

    cols = []
    for k in ks:
        h = F.coalesce(f"hits_{k}", F.lit(0))
        cols += [
            (h / F.lit(float(k))).alias(f"precision_{k}"),
            F.when(n_rel == 0, F.lit(float(empty_relevant))).otherwise(F.try_divide(h, n_rel)).alias(f"recall_{k}"),
            F.when(or_zero(F.col(f"idcg_{k}")) > 0, or_zero(F.col(f"dcg_{k}")) / F.col(f"idcg_{k}"))
            .otherwise(0.0).alias(f"ndcg_{k}"),
            F.when(h > 0, 1.0).otherwise(0.0).alias(f"hit_{k}"),
        ]
    return joined.select(
        "query_id", *cols,
        F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("mrr"),
        n_rel.alias("num_relevant"),
        F.coalesce("num_retrieved", F.lit(0)).alias("num_retrieved"),
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column."""
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def macro_average(report: DataFrame, digits: int = 4) -> DataFrame:
    """Mean of every metric over all queries, zeros included."""
    metrics = [c for c, t in report.dtypes if t == "double"]
    return report.agg(
        F.count(F.lit(1)).alias("num_queries"),
        *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), digits).alias(c) for c in metrics],
    )


def best_worst(report: DataFrame, metric: str, n: int = 10) -> DataFrame:
    """The ``n`` best and ``n`` worst queries by one metric: two bounded top lists."""
    best = report.orderBy(F.col(metric).desc(), "query_id").limit(n).withColumn("side", F.lit("best"))
    worst = report.orderBy(F.col(metric), F.col("query_id").desc()).limit(n).withColumn("side", F.lit("worst"))
    return best.unionByName(worst).select("side", "query_id", metric)


def keyword_relevance(hits: DataFrame, docs: DataFrame, suites: DataFrame, text: str = "searchable_text") -> DataFrame:
    """Share of a query's results whose text holds any of its keywords.

    ``suites``: (query_id, keywords array). A query without results scores 0.
    """
    rows = hits.join(docs.select("product_id", F.lower(text).alias("body")), "product_id").join(suites, "query_id")
    matched = F.exists("keywords", lambda w: F.contains(F.col("body"), F.lower(w)))
    share = rows.groupBy("query_id").agg(F.avg(F.when(matched, 1.0).otherwise(0.0)).alias("share"))
    return suites.select("query_id").join(share, "query_id", "left").select(
        "query_id", F.coalesce("share", F.lit(0.0)).alias("keyword_relevance")
    )


def run_stats(queries: DataFrame, hits: DataFrame, log: DataFrame) -> DataFrame:
    """#queries, mean results, mean latency, share of queries with results.

    ``log``: one row per answered query (query_id, latency_ms).
    """
    counts = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    rows = queries.select("query_id").distinct().join(counts, "query_id", "left").join(log, "query_id", "left")
    n = F.coalesce("n", F.lit(0))
    return rows.agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.round(F.avg(n), 2).alias("average_results"),
        F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 4).alias("average_latency_ms"),
        F.round(F.count_if(n > 0) / F.count(F.lit(1)), 4).alias("success_rate"),
    )


def compare(strategies: dict[str, DataFrame], grades: DataFrame, queries: DataFrame, **options) -> DataFrame:
    """Macro averages of several strategies side by side."""
    frames = [
        macro_average(per_query(hits, grades, queries, **options)).withColumn("strategy", F.lit(name))
        for name, hits in strategies.items()
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
