"""Metrics of ranked lists against graded labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfscan.operators import evaluate
from shelfscan.operators.retrieval import bm25_topk, dense_topk
from shelfscan.operators.search import fuse_ranks
from shelfscan.plans.registry import register
from shelfscan.session import cut_lineage
from shelfscan.sources.fixtures import Tables


def grades(t: Tables):
    return t["v_labels"].select("query_id", "product_id", evaluate.label_score(F.col("label")).alias("label_score"))


def bm25_hits(t: Tables, k: int = 20):
    return bm25_topk(t["v_queries"], t["v_catalog"], k)


def dense_hits(t: Tables, k: int = 20):
    return dense_topk(t["v_query_vectors"], t["v_vec_products"], k)


def report(t: Tables, **options):
    return evaluate.rounded(evaluate.per_query(bm25_hits(t), grades(t), t["v_queries"], **options))


# The same metrics written independently for DuckDB.
def metric_sql(hits: str = "v_bm25_hits", cut: str = ">= 0.5", gain: str = "label_score", empty: float = 1.0) -> str:
    return f"""
      j AS (SELECT h.query_id, h.rank, coalesce(g.label_score, 0) AS label_score FROM {hits} h LEFT JOIN v_grades g USING (query_id, product_id)),
      f AS (SELECT query_id, count(*) AS num_retrieved, min(rank) FILTER (label_score {cut}) AS first_rank,
              count(*) FILTER (label_score {cut} AND rank <= 5) AS h5, count(*) FILTER (label_score {cut} AND rank <= 10) AS h10,
              sum(CASE WHEN rank <= 5 THEN ({gain}) / log2(rank + 1) ELSE 0 END) AS d5,
              sum(CASE WHEN rank <= 10 THEN ({gain}) / log2(rank + 1) ELSE 0 END) AS d10 FROM j GROUP BY 1),
      i AS (SELECT query_id, count(*) FILTER (label_score {cut}) AS num_relevant,
              sum(CASE WHEN pos <= 5 THEN ({gain}) / log2(pos + 1) ELSE 0 END) AS i5,
              sum(CASE WHEN pos <= 10 THEN ({gain}) / log2(pos + 1) ELSE 0 END) AS i10
            FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY label_score DESC) AS pos FROM v_grades) GROUP BY 1),
      m AS (SELECT q.query_id, coalesce(h5, 0) / 5.0 AS precision_5, coalesce(h10, 0) / 10.0 AS precision_10,
              CASE WHEN coalesce(num_relevant, 0) = 0 THEN {empty}::DOUBLE ELSE coalesce(h5, 0) / num_relevant END AS recall_5,
              CASE WHEN coalesce(num_relevant, 0) = 0 THEN {empty}::DOUBLE ELSE coalesce(h10, 0) / num_relevant END AS recall_10,
              CASE WHEN i5 > 0 THEN coalesce(d5, 0) / i5 ELSE 0.0::DOUBLE END AS ndcg_5,
              CASE WHEN i10 > 0 THEN coalesce(d10, 0) / i10 ELSE 0.0::DOUBLE END AS ndcg_10,
              CASE WHEN h5 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_5, CASE WHEN h10 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_10,
              coalesce(1.0::DOUBLE / first_rank, 0) AS mrr, coalesce(num_relevant, 0) AS num_relevant,
              coalesce(num_retrieved, 0) AS num_retrieved
            FROM v_queries q LEFT JOIN f USING (query_id) LEFT JOIN i USING (query_id))"""


def _metric(key: str, cols: list[str], sql_options: dict | None = None, **options):
    picks = ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in cols)

    @register(key, f"WITH {metric_sql(**(sql_options or {}))} SELECT query_id, {picks} FROM m")
    def build(t: Tables):
        return report(t, **options).select("query_id", *cols)

    return build


_metric("eval_precision", ["precision_5", "precision_10"])
_metric("eval_recall", ["recall_5", "recall_10"], {"empty": 0.0}, empty_relevant=0.0)
_metric("eval_mrr", ["mrr"])
_metric("eval_ndcg", ["ndcg_5", "ndcg_10"])
_metric("eval_ndcg_exp", ["ndcg_5", "ndcg_10"], {"gain": "pow(2, label_score) - 1"}, gain="exponential")
_metric("eval_hit_rate", ["hit_5", "hit_10"], {"cut": "> 0"}, min_grade=0.0)

_ALL = "precision_5 precision_10 recall_5 recall_10 ndcg_5 ndcg_10 hit_5 hit_10 mrr".split()
_ROUNDED = ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in _ALL)


@register("eval_per_query", f"WITH {metric_sql()} SELECT query_id, {_ROUNDED}, num_relevant, num_retrieved FROM m")
def eval_per_query(t: Tables):
    return report(t)


MEANS = ", ".join(f"round(avg({c})::DOUBLE, 4) AS {c}" for c in _ALL)


@register("eval_macro", f"WITH {metric_sql()} SELECT count(*) AS num_queries, {MEANS} FROM m")
def eval_macro(t: Tables):
    return evaluate.macro_average(evaluate.per_query(bm25_hits(t), grades(t), t["v_queries"]))


@register(
    "eval_best_worst",
    f"""WITH {metric_sql()}, r AS (SELECT query_id, round(ndcg_10::DOUBLE, 6) AS ndcg_10 FROM m)
    SELECT * FROM (SELECT 'best' AS side, query_id, ndcg_10 FROM r ORDER BY ndcg_10 DESC, query_id LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'worst' AS side, query_id, ndcg_10 FROM r ORDER BY ndcg_10, query_id DESC LIMIT 10)""",
)
def eval_best_worst(t: Tables):
    return evaluate.best_worst(report(t).select("query_id", "ndcg_10"), "ndcg_10")


@register(
    "eval_keyword_relevance",
    r"""WITH s AS (SELECT query_id, list_filter(regexp_extract_all(lower(base_query), '[\p{L}\p{N}_]+'), lambda x: length(x) > 5) AS kw FROM v_queries),
    m AS (SELECT h.query_id, avg(CASE WHEN len(list_filter(kw, lambda w: contains(lower(searchable_text), w))) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS v
          FROM v_bm25_hits h JOIN v_catalog USING (product_id) JOIN s USING (query_id) GROUP BY 1)
    SELECT query_id, round(coalesce(v, 0), 6) AS keyword_relevance FROM v_queries LEFT JOIN m USING (query_id)""",
)
def eval_keyword_relevance(t: Tables):
    from shelfscan.functions.text import tokens

    suites = t["v_queries"].select(
        "query_id", F.filter(tokens(F.col("base_query")), lambda w: F.length(w) > 5).alias("keywords")
    )
    return evaluate.rounded(evaluate.keyword_relevance(bm25_hits(t), t["v_catalog"], suites))


@register(
    "eval_run_stats",
    """WITH l AS (SELECT CAST(user_id % 40 AS STRING) AS query_id, avg(value * 10) AS latency_ms FROM events GROUP BY 1),
    c AS (SELECT query_id, count(*) AS n FROM v_bm25_hits GROUP BY 1)
    SELECT count(*) AS total_queries, round(avg(coalesce(n, 0))::DOUBLE, 2) AS average_results,
           round(coalesce(avg(latency_ms), 0), 4) AS average_latency_ms,
           round(count(*) FILTER (n > 0) / count(*), 4) AS success_rate
    FROM v_queries LEFT JOIN c USING (query_id) LEFT JOIN l USING (query_id)""",
)
def eval_run_stats(t: Tables):
    log = (
        t["events"].groupBy((F.col("user_id") % 40).cast("string").alias("query_id"))
        .agg(F.avg(F.col("value") * 10).alias("latency_ms"))
    )
    return evaluate.run_stats(t["v_queries"], bm25_hits(t), log)


_COMPARE = " UNION ALL ".join(
    f"SELECT '{name}' AS strategy, num_queries, ndcg_10, mrr, recall_10 FROM (WITH {metric_sql(hits)} "
    "SELECT count(*) AS num_queries, round(avg(ndcg_10)::DOUBLE, 4) AS ndcg_10, round(avg(mrr)::DOUBLE, 4) AS mrr, round(avg(recall_10)::DOUBLE, 4) AS recall_10 FROM m)"
    for name, hits in (("bm25", "v_bm25_hits"), ("dense", "v_dense_hits"), ("hybrid", "v_hybrid_hits"))
)


@register("eval_compare", _COMPARE)
def eval_compare(t: Tables):
    # each list is read twice and the grades are by every strategy
    lexical, dense, graded = cut_lineage(bm25_hits(t)), cut_lineage(dense_hits(t)), cut_lineage(grades(t))
    lists = {"bm25": lexical, "dense": dense, "hybrid": fuse_ranks(dense, lexical, k=10)}
    return evaluate.compare(lists, graded, t["v_queries"]).select("strategy", "num_queries", "ndcg_10", "mrr", "recall_10")
