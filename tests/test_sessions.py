"""Session replay, windows, and streams equal to their batch forms."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfscan.operators import events as ev
from shelfscan.sources.fixtures import Tables
from shelfscan.streaming import jobs

EVENT = jobs.SessionState.SCHEMA
T0 = datetime.datetime(2024, 1, 1)


def made_events(n=400, sessions=4, items=9, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choice(["cart", "cart", "view", "search", "customer"])
        action = rng.choice(["add", "add", "remove"]) if kind == "cart" else None
        # session s0 holds most of the events, equal times occur
        session = "s0" if rng.random() < 0.6 else f"s{rng.randrange(1, sessions)}"
        out.append((i, T0 + datetime.timedelta(seconds=i // 2), session, kind, action, f"p{rng.randrange(items)}"))
    return out


def replay(events, cap):
    carts = {}
    for e in sorted(events, key=lambda e: (e[1], e[0])):
        if e[3] == "cart":
            cart = carts.setdefault(e[2], [])
            if e[4] == "remove":
                if e[5] in cart:
                    cart.remove(e[5])
            elif e[5] not in cart:
                cart.append(e[5])
                del cart[cap:]
    return sorted((s, i + 1, p) for s, c in carts.items() for i, p in enumerate(c))


@pytest.mark.parametrize("cap", [2, 4, 20])
def test_cart_replay(spark, cap):
    events = made_events()
    got = ev.cart_state(spark.createDataFrame(events, EVENT), cap)
    assert sorted((r["session_id"], r["position"], r["item"]) for r in got.collect()) == replay(events, cap)


def test_add_remove_add_goes_to_the_end(spark):
    steps = [("add", "a"), ("add", "b"), ("remove", "a"), ("add", "a")]
    events = [(i, T0, "s", "cart", a, p) for i, (a, p) in enumerate(steps)]
    got = ev.cart_state(spark.createDataFrame(events, EVENT)).orderBy("position").collect()
    assert [r["item"] for r in got] == ["b", "a"]


def test_21st_add_is_lost(spark):
    events = [(i, T0, "s", "cart", "add", f"p{i:02d}") for i in range(21)]
    got = ev.cart_state(spark.createDataFrame(events, EVENT)).orderBy("position").collect()
    assert [r["item"] for r in got] == [f"p{i:02d}" for i in range(20)]


def context(df):
    return sorted(tuple(r) for r in ev.session_context(df).collect())


def test_session_state_in_batches_equals_one_pass(spark, tmp_path):
    events = made_events(600, items=30)
    state = jobs.SessionState(spark, str(tmp_path / "state"))
    for batch_id in range(4):
        part = events[batch_id * 150 : (batch_id + 1) * 150]
        state.update(spark.createDataFrame(part, EVENT), batch_id)
    state.update(spark.createDataFrame(events[450:], EVENT), 3)  # the last batch is retried
    assert context(state.events()) == context(spark.createDataFrame(events, EVENT))


def test_session_state_as_a_stream(spark, tmp_path):
    events = made_events(200)
    for i in range(2):
        part = spark.createDataFrame(events[i * 100 : (i + 1) * 100], EVENT)
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"n={i}"))
    schema = spark.createDataFrame([], EVENT).schema
    state = jobs.SessionState(spark, str(tmp_path / "state"))
    jobs.run_available(jobs.stream_parquet(spark, str(tmp_path / "in" / "*"), schema, 1), state.update, str(tmp_path / "cp"))
    assert state.latest == 1
    assert context(state.events()) == context(spark.createDataFrame(events, EVENT))


def streamed(spark, sf, tmp_path, build):
    """Run a windowed stream over the events and return what was emitted."""
    t = Tables(spark, sf)
    stream = jobs.stream_parquet(spark, t.path("{events}"), t["events"].schema)
    jobs.append_to_folder(build(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    return spark.read.parquet(str(tmp_path / "out"))


def test_sliding_counts_stream_equals_batch_on_closed_windows(spark, sf, tmp_path):
    out = {tuple(r) for r in streamed(spark, sf, tmp_path, jobs.sliding_counts).collect()}
    batch = {tuple(r) for r in ev.sliding_counts(Tables(spark, sf)["events"]).collect()}
    assert out <= batch and len(batch - out) <= 20  # only the last windows are still open


def test_sessions_stream_equals_batch_on_closed_windows(spark, sf, tmp_path):
    cols = ("user_id", "start", "end", "n")
    out = streamed(spark, sf, tmp_path, lambda s: jobs.event_sessions(s, "user_id", 360)).select(
        "user_id", F.col("start").cast("timestamp_ntz"), F.col("end").cast("timestamp_ntz"), "n"
    )
    batch = {tuple(r) for r in ev.event_sessions(Tables(spark, sf)["events"], "user_id", 360).select(*cols).collect()}
    got = {tuple(r) for r in out.collect()}
    assert got <= batch and len(batch - got) <= 15


def test_first_delivery_stream(spark, sf, tmp_path):
    def build(stream):
        return jobs.first_delivery(stream.union(stream.filter("event_id % 3 = 0"))).select("event_id")

    ids = [r[0] for r in streamed(spark, sf, tmp_path, build).collect()]
    assert len(ids) == len(set(ids)) == spark.read.parquet(f"{sf}/events.parquet").count()


def test_latency_stream_equals_batch_on_closed_windows(spark, sf, tmp_path):
    t = Tables(spark, sf)
    pick = "event_id, ts, value * 10 AS latency_ms, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status"
    counts = streamed(spark, sf, tmp_path, lambda s: jobs.latency_counts(s.selectExpr(*pick.split(", "))))
    got = {tuple(r) for r in ev.latency_report(counts).collect()}
    batch = {tuple(r) for r in ev.latency_windows(t["v_search_log"]).collect()}
    assert got <= batch and len(batch - got) <= 1


def test_latency_percentiles_are_exact(spark):
    log = spark.createDataFrame([(0.04,), (0.04,), (0.04,), (2000.03,)], "latency_ms double").selectExpr(
        "timestamp_ntz'2024-01-01 10:00:00' AS ts", "latency_ms", "'SUCCESS' AS status"
    )
    r = ev.latency_windows(log).first()
    assert (r["p50_ms"], r["avg_ms"], r["slow_share"]) == (0.04, 500.0375, 0.25)
    rng = np.random.default_rng(3)
    values = np.round(np.concatenate([rng.lognormal(5, 2, 3000), np.full(1500, 7.5), [0.0, -1.0]]), 3)
    log = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "latency_ms double").selectExpr(
        "timestamp_ntz'2024-01-01 10:00:00' AS ts", "latency_ms", "'SUCCESS' AS status"
    )
    r = ev.latency_windows(log).first()
    assert r["searches"] == len(values) + 1
    for name, p in ev.PERCENTILES.items():
        assert r[name] == pytest.approx(np.quantile(values, p), abs=2e-6)


def test_event_sessions_across_days(spark):
    times = ["2024-01-01 23:50:00", "2024-01-02 00:10:00", "2024-01-02 00:40:00", "2024-01-02 01:10:01", "2024-01-05 00:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").selectExpr("'u' AS u", "CAST(t AS timestamp_ntz) AS ts")
    assert sorted(r["n"] for r in ev.event_sessions(df, "u", 30).collect()) == [1, 1, 3]


def test_disabled_threshold_is_silent(spark):
    metrics = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", 5.0)], "metric_name string, metric_value double")
    limits = spark.createDataFrame([("a", 5.0, 9.0, True), ("b", 1.0, 5.0, True), ("c", 1.0, 2.0, False)], "metric_name string, warning double, critical double, enabled boolean")
    got = {r["metric_name"]: (r["severity"], r["message"]) for r in ev.threshold_alerts(metrics, limits).collect()}
    assert got == {
        "a": ("WARNING", "Metric 'a' value 5.0 breached WARNING threshold (5.0)"),
        "b": ("CRITICAL", "Metric 'b' value 5.0 breached CRITICAL threshold (5.0)"),
    }
