"""Session state, windows and alerts over event tables (batch forms)."""

from __future__ import annotations

from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscan.functions.ranking import ordered_text, top_k

# How much a session remembers.
MAX_SEARCHES = 10
MAX_VIEWS = 20
MAX_CART = 20

SLOW_MS = 2000
NEWEST = ("ts", "event_id")


def _newest_first() -> list[Column]:
    return [F.col(c).desc() for c in NEWEST]


def recent_searches(events: DataFrame, n: int = MAX_SEARCHES) -> DataFrame:
    """Newest searches per session, repeats kept."""
    return top_k(events.filter(F.col("kind") == "search"), ["session_id"], _newest_first(), n, "position")


def recent_views(events: DataFrame, n: int = MAX_VIEWS) -> DataFrame:
    """Distinct items by their last view, newest first."""
    last = (
        events.filter(F.col("kind") == "view").groupBy("session_id", "item")
        .agg(F.max(F.struct(*NEWEST)).alias("last")).select("session_id", "item", "last.*")
    )
    return top_k(last, ["session_id"], _newest_first(), n, "position")


def cart_state(events: DataFrame, cap: int = MAX_CART) -> DataFrame:
    """(session_id, position, item): carts after replaying adds and removes.

    An add to a full cart is lost. A session that never added more than
    ``cap`` different items can never be full, so its cart follows from
    aggregates: items added after their last removal, by first such add. Only
    the other sessions are replayed in order, with one cart in memory.
    """
    cart = events.filter(F.col("kind") == "cart").select("session_id", "item", "action", F.struct(*NEWEST).alias("at"))
    is_add = F.col("action") == "add"
    per_item = cart.groupBy("session_id", "item").agg(
        F.max(F.when(F.col("action") == "remove", F.col("at"))).alias("gone"), F.count_if(is_add).alias("adds")
    )
    busy = per_item.filter(F.col("adds") > 0).groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap).select("session_id")

    calm = cart.filter(is_add).join(busy, "session_id", "left_anti")
    kept = (
        calm.join(per_item.select("session_id", "item", "gone"), ["session_id", "item"])
        .filter(F.col("gone").isNull() | (F.col("at") > F.col("gone")))
        .groupBy("session_id", "item").agg(F.min("at").alias("at"))
    )
    w = Window.partitionBy("session_id").orderBy("at")
    simple = kept.select("session_id", F.row_number().over(w).alias("position"), "item")

    def replay(batches):
        current, items = None, []
        for pdf in batches:
            out = []
            for session, item, action in zip(pdf["session_id"], pdf["item"], pdf["action"]):
                if session != current:
                    out += [(current, i + 1, x) for i, x in enumerate(items)]
                    current, items = session, []
                if action == "remove":
                    items = [x for x in items if x != item]
                elif item not in items and len(items) < cap:
                    items.append(item)
            yield pd.DataFrame(out, columns=["session_id", "position", "item"])
        yield pd.DataFrame([(current, i + 1, x) for i, x in enumerate(items)], columns=["session_id", "position", "item"])

    ordered = cart.join(busy, "session_id", "left_semi").repartition("session_id").sortWithinPartitions("session_id", "at")
    replayed = ordered.select("session_id", "item", "action").mapInPandas(replay, "session_id string, position int, item string")
    return simple.unionByName(replayed)


def session_customer(events: DataFrame) -> DataFrame:
    """The latest customer id told by each session."""
    told = events.filter(F.col("kind") == "customer")
    return told.groupBy("session_id").agg(F.max_by("item", F.struct(*NEWEST)).alias("customer_id"))


def _joined(rows: DataFrame, name: str) -> DataFrame:
    parts = F.collect_list(F.struct("position", "item"))
    return rows.groupBy("session_id").agg(ordered_text(parts, ",", "item").alias(name), F.count(F.lit(1)).alias(f"{name}_n"))


def session_context(events: DataFrame, default_customer: str | None = None) -> DataFrame:
    """Lists, counts and customer of every session."""
    lists = {"recent_searches": recent_searches(events), "recent_views": recent_views(events), "cart": cart_state(events)}
    out = events.select("session_id").distinct().join(session_customer(events), "session_id", "left")
    for name, rows in lists.items():
        out = out.join(_joined(rows, name), "session_id", "left")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    n = lambda c, name: F.coalesce(f"{c}_n", F.lit(0)).alias(name)
    return out.select(
        "session_id", F.coalesce("customer_id", F.lit(default_customer)).alias("customer_id"),
        text("recent_searches"), text("recent_views"), text("cart"),
        n("cart", "cart_count"), n("recent_searches", "search_count"), n("recent_views", "view_count"),
    )


# ── windows ──────────────────────────────────────────────────────────────


PERCENTILES = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}


def latency_counts(log: DataFrame, width: str = "1 day") -> DataFrame:
    """Searches, failures and slow ones per tumbling window and latency; of a table or a stream.

    Latencies are summed as decimals, so the mean does not depend on their order.
    """
    return log.groupBy(F.window("ts", width).alias("w"), "latency_ms").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "FAILED").alias("errors"),
        F.count_if(F.col("latency_ms") > SLOW_MS).alias("slow"), F.sum(F.col("latency_ms").try_cast("decimal(28,9)")).alias("ms"),
    )


def latency_report(counted: DataFrame) -> DataFrame:
    """Traffic, exact latency percentiles, errors and slow share per window, from :func:`latency_counts`.

    Each window's latencies are totalled in 64 ranges an octave. The ranges
    that hold a percentile's neighbours are found by cumulated totals, and only
    their latencies are put in order, range by range. Searches without a
    latency count as traffic only.
    """
    x = F.col("latency_ms")
    counted = counted.withColumn("range", F.floor(F.signum(x) * F.log2(1 + F.abs(x)) * 64))
    valued = F.when(F.col("range").isNotNull(), F.col("n")).otherwise(0)
    upto = Window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = counted.groupBy("w", "range").agg(
        F.sum("n").alias("all"), F.sum(valued).alias("valued"), F.sum("ms").alias("ms"),
        F.sum("errors").alias("errors"), F.sum("slow").alias("slow"),
    )
    total = F.sum("all")
    windows = ranges.groupBy("w").agg(
        total.alias("searches"), F.sum("valued").alias("size"), F.round(F.try_divide(F.sum("ms").cast("double"), F.sum("valued")), 6).alias("avg_ms"),
        F.round(F.sum("errors") / total, 6).alias("error_rate"), F.round(F.sum("slow") / total, 6).alias("slow_share"),
    )
    place = {name: F.lit(p) * (F.col("size") - 1) for name, p in PERCENTILES.items()}
    ends = [side(v) for v in place.values() for side in (F.floor, F.ceil)]

    def holds(end: Column, after: Column, n: Column) -> Column:
        return (end < after) & (end >= after - n)

    wanted = (
        ranges.filter("range IS NOT NULL")
        .withColumn("after", F.sum("valued").over(upto.partitionBy("w").orderBy("range")))
        .withColumn("size", F.sum("valued").over(Window.partitionBy("w")))
        .filter(reduce(or_, [holds(e, F.col("after"), F.col("valued")) for e in ends]))
        .select("w", "range", "size", (F.col("after") - F.col("valued")).alias("before"))
    )
    ordered = counted.join(wanted, ["w", "range"]).withColumn(
        "after", F.col("before") + F.sum("n").over(upto.partitionBy("w", "range").orderBy("latency_ms"))
    )
    at = lambda end: F.max(F.when(holds(end, F.col("after"), F.col("n")), x))
    found = ordered.groupBy("w").agg(*[at(side(v)).alias(f"{name}_{side.__name__}") for name, v in place.items() for side in (F.floor, F.ceil)])
    between = lambda name: F.round(
        F.col(f"{name}_floor") + (F.col(f"{name}_ceil") - F.col(f"{name}_floor")) * (place[name] - F.floor(place[name])), 6
    ).alias(name)
    return windows.join(found, "w", "left").select(
        start_text(), "searches", "avg_ms", *[between(name) for name in PERCENTILES], "error_rate", "slow_share"
    )


def latency_windows(log: DataFrame, width: str = "1 day") -> DataFrame:
    """Traffic, exact latency percentiles, errors and slow share per tumbling window."""
    return latency_report(latency_counts(log, width))


def start_text(window: str = "w") -> Column:
    return F.date_format(F.col(f"{window}.start"), "yyyy-MM-dd HH:mm:ss").alias("window_start")


def threshold_alerts(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """CRITICAL or WARNING per breached metric; unknown and disabled metrics raise nothing.

    ``thresholds``: (metric_name, warning, critical, enabled). Stateless, so
    it works on a stream as well.
    """
    v = F.col("metric_value")
    severity = F.when(v >= F.col("critical"), "CRITICAL").when(v >= F.col("warning"), "WARNING")
    limit = F.when(v >= F.col("critical"), F.col("critical")).otherwise(F.col("warning"))
    rows = metrics.join(thresholds.filter("enabled").drop("enabled"), "metric_name").withColumn("severity", severity)
    message = F.concat(
        F.lit("Metric '"), F.col("metric_name"), F.lit("' value "), v.cast("string"), F.lit(" breached "), F.col("severity"),
        F.lit(" threshold ("), limit.cast("string"), F.lit(")"),
    )
    return rows.filter(F.col("severity").isNotNull()).select(
        *metrics.columns, "severity", F.concat(F.lit("threshold_breach_"), F.col("metric_name")).alias("alert_type"), message.alias("message")
    )


def failure_alerts(log: DataFrame, width: str = "1 hour", warning: int = 2, critical: int = 5) -> DataFrame:
    """Windows with too many failures."""
    counts = log.filter(F.col("status") == "FAILED").groupBy(F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("failures"))
    severity = F.when(F.col("failures") >= critical, "CRITICAL").when(F.col("failures") >= warning, "WARNING")
    return counts.withColumn("severity", severity).filter(F.col("severity").isNotNull()).select(start_text(), "failures", "severity")


def event_sessions(events: DataFrame, key: str, gap_minutes: int = 30, bucket: str = "day") -> DataFrame:
    """Runs of events of one key with no pause longer than the gap.

    Events are first counted per key and minute in the map tasks; the gap is at
    least a minute, so a minute never parts. Runs are then found over these
    summaries per key and day, at most 1,440 rows, and only their ends are
    compared across days: no task sorts the events of one key.
    """
    if gap_minutes < 1:
        raise ValueError("the gap is at least one minute")
    gap = F.expr(f"INTERVAL {int(gap_minutes)} MINUTES")

    def runs(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("start", "end")
        new = F.coalesce(F.col("start") > F.lag("end").over(w) + gap, F.lit(True)).cast("int")
        marked = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return marked.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("_run")

    return runs(runs(minute_summaries(events, key).withColumn("_b", F.date_trunc(bucket, "start")), [key, "_b"]).drop("_b"), [key])


def minute_summaries(events: DataFrame, key: str) -> DataFrame:
    """(key, start, end, n) per key and minute, combined in the map tasks."""
    minute = F.date_trunc("minute", "ts").alias("_minute")
    return events.groupBy(key, minute).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n")).drop("_minute")


def sliding_counts(events: DataFrame, width: str = "1 hour", slide: str = "30 minutes") -> DataFrame:
    """Events per kind and sliding window."""
    return events.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(start_text(), "event_type", "n")


def first_delivery(events: DataFrame) -> DataFrame:
    """One row per event id, however often it was delivered."""
    return events.dropDuplicates(["event_id"])
