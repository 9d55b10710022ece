"""Sessions, windows, alerts; batch forms with SQL, plus one stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfscan.operators import events as ev
from shelfscan.operators.quality import Rule
from shelfscan.plans.registry import register
from shelfscan.session import scratch_path
from shelfscan.sources.fixtures import Tables
from shelfscan.streaming import jobs

SEARCHES = """SELECT session_id, CAST(row_number() OVER w AS INT) AS position, item FROM v_session_events WHERE kind = 'search'
    WINDOW w AS (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) QUALIFY row_number() OVER w <= 10"""
VIEWS = """SELECT session_id, CAST(row_number() OVER w AS INT) AS position, item FROM (SELECT session_id, item, max({'ts': ts, 'event_id': event_id}) AS last
      FROM v_session_events WHERE kind = 'view' GROUP BY ALL) WINDOW w AS (PARTITION BY session_id ORDER BY last DESC) QUALIFY row_number() OVER w <= 20"""
# the cart is replayed event by event, as the definition says
CART_CTES = """o AS (SELECT session_id, item, action, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS seq FROM v_session_events WHERE kind = 'cart'),
    r AS (SELECT session_id, 0::BIGINT AS seq, []::VARCHAR[] AS cart FROM o GROUP BY session_id
      UNION ALL SELECT r.session_id, o.seq, CASE WHEN action = 'remove' THEN list_filter(cart, lambda x: x <> item)
        WHEN list_contains(cart, item) OR len(cart) >= 20 THEN cart ELSE list_append(cart, item) END FROM r JOIN o ON o.session_id = r.session_id AND o.seq = r.seq + 1),
    c AS (SELECT session_id, unnest(cart) AS item, CAST(unnest(range(1, len(cart) + 1)) AS INT) AS position FROM r
      WHERE seq = (SELECT max(seq) FROM o WHERE o.session_id = r.session_id))"""


@register("recent_searches", SEARCHES)
def recent_searches(t: Tables):
    """T1."""
    return ev.recent_searches(t["v_session_events"]).select("session_id", "position", "item")


@register("recent_views", VIEWS)
def recent_views(t: Tables):
    """T2."""
    return ev.recent_views(t["v_session_events"]).select("session_id", "position", "item")


@register("cart_state", f"WITH RECURSIVE {CART_CTES} SELECT session_id, position, item FROM c")
def cart_state(t: Tables):
    """T3."""
    return ev.cart_state(t["v_session_events"])


@register(
    "session_context",
    f"""WITH RECURSIVE {CART_CTES}, s AS ({SEARCHES}), v AS ({VIEWS}), k AS (SELECT session_id, arg_max(item, {{'ts': ts, 'event_id': event_id}}) AS customer_id
      FROM v_session_events WHERE kind = 'customer' GROUP BY 1),
    l AS (SELECT DISTINCT session_id FROM v_session_events)
    SELECT session_id, customer_id, coalesce((SELECT string_agg(item, ',' ORDER BY position) FROM s WHERE s.session_id = l.session_id), '') AS recent_searches,
      coalesce((SELECT string_agg(item, ',' ORDER BY position) FROM v WHERE v.session_id = l.session_id), '') AS recent_views,
      coalesce((SELECT string_agg(item, ',' ORDER BY position) FROM c WHERE c.session_id = l.session_id), '') AS cart,
      (SELECT count(*) FROM c WHERE c.session_id = l.session_id) AS cart_count, (SELECT count(*) FROM s WHERE s.session_id = l.session_id) AS search_count,
      (SELECT count(*) FROM v WHERE v.session_id = l.session_id) AS view_count FROM l LEFT JOIN k USING (session_id)""",
)
def session_context(t: Tables):
    """T7, T8."""
    return ev.session_context(t["v_session_events"])


@register(
    "latency_windows",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS searches, round(CAST(sum(CAST(latency_ms AS DECIMAL(28,9))) AS DOUBLE) / count(latency_ms), 6) AS avg_ms,
      round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms, round(quantile_cont(latency_ms, 0.99), 6) AS p99_ms,
      round(count(*) FILTER (status = 'FAILED') / count(*), 6) AS error_rate, round(count(*) FILTER (latency_ms > 2000) / count(*), 6) AS slow_share
    FROM v_search_log GROUP BY 1""",
)
def latency_windows(t: Tables):
    """T4."""
    return ev.latency_windows(t["v_search_log"])


@register(
    "threshold_alerts",
    """WITH m AS (SELECT event_id, 'search_latency_ms' AS metric_name, latency_ms * 10 AS metric_value FROM v_search_log
      UNION ALL SELECT event_id, 'vector_index_sync_minutes', CAST(results AS DOUBLE) * 4 FROM v_search_log UNION ALL SELECT event_id, 'unknown', 1e6 FROM v_search_log),
    t AS (SELECT * FROM (VALUES ('search_latency_ms', 1500.0::DOUBLE, 3000.0::DOUBLE), ('vector_index_sync_minutes', 30.0, 60.0)) AS x(metric_name, warning, critical))
    SELECT event_id, metric_name, round(metric_value, 6) AS metric_value, CASE WHEN metric_value >= critical THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
      'threshold_breach_' || metric_name AS alert_type FROM m JOIN t USING (metric_name) WHERE metric_value >= warning""",
)
def threshold_alerts(t: Tables):
    """T5."""
    metric = lambda name, v: F.struct(F.lit(name).alias("metric_name"), v.alias("metric_value"))
    metrics = t["v_search_log"].select(
        "event_id",
        F.inline(
            F.array(
                metric("search_latency_ms", F.col("latency_ms") * 10), metric("vector_index_sync_minutes", F.col("results").cast("double") * 4),
                metric("unknown", F.lit(1e6)),
            )
        ),
    )
    limits = t.spark.createDataFrame(
        [("search_latency_ms", 1500.0, 3000.0, True), ("vector_index_sync_minutes", 30.0, 60.0, True), ("unknown", 1.0, 2.0, False)],
        "metric_name string, warning double, critical double, enabled boolean",
    )
    out = ev.threshold_alerts(metrics, limits)
    return out.select("event_id", "metric_name", F.round("metric_value", 6).alias("metric_value"), "severity", "alert_type")


@register(
    "failure_alerts",
    """SELECT * FROM (SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS failures,
      CASE WHEN count(*) >= 5 THEN 'CRITICAL' WHEN count(*) >= 2 THEN 'WARNING' END AS severity FROM v_search_log WHERE status = 'FAILED' GROUP BY 1) WHERE severity IS NOT NULL""",
)
def failure_alerts(t: Tables):
    """T6."""
    return ev.failure_alerts(t["v_search_log"])


@register(
    "event_sessions",
    """WITH f AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM f)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS n FROM g GROUP BY user_id, run""",
)
def event_sessions(t: Tables):
    """T10."""
    text = lambda c, name: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)
    return ev.event_sessions(t["events"], "user_id", 360).select("user_id", text("start", "started"), text("end", "ended"), "n")


@register(
    "sliding_counts",
    """SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM (
      SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY ALL""",
)
def sliding_counts(t: Tables):
    """T10."""
    return ev.sliding_counts(t["events"])


@register(
    "stream_dedup",
    "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type",
)
def stream_dedup(t: Tables):
    """A third of the events is delivered twice."""
    e = t["events"]
    twice = e.unionByName(e.filter(F.col("event_id") % 3 == 0))
    return ev.first_delivery(twice).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def event_rules() -> list[Rule]:
    return [
        Rule("failed_event", F.col("event_type") == "error", "event reports an error"),
        Rule("low_value", F.col("value") < 5, "value is below 5"),
    ]


@register(
    "stream_ingest",
    """SELECT outcome, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (
      SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed_event' WHEN value < 5 THEN 'low_value' ELSE 'valid' END AS outcome FROM events) GROUP BY outcome""",
)
def stream_ingest(t: Tables):
    """The events table as a stream, split into valid rows and quarantine."""
    spark = t.spark
    base = scratch_path(spark, "stream-ingest")
    stream = jobs.stream_parquet(spark, t.path("{events}"), t["events"].schema)
    target, rejects = f"{base}/valid", f"{base}/rejects"
    jobs.checked_ingest(stream, event_rules, "events", "event_id", target, rejects, f"{base}/checkpoint")
    good = spark.read.parquet(target).select(F.lit("valid").alias("outcome"), "event_id")
    bad = spark.read.parquet(rejects).select(F.col("rule_name").alias("outcome"), F.col("record_key").cast("long").alias("event_id"))
    return good.unionByName(bad).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
