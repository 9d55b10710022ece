"""Tables in buckets: the stored index, session state, profiles from sketches, suggestions, session summaries."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from shelfscan.operators import events as ev
from shelfscan.operators import clean, index, ops, profile, quality, search
from shelfscan.sources import sinks
from shelfscan.sources.bucketed import BucketedTable
from shelfscan.streaming import jobs
from tests.test_sessions import EVENT, T0, context, made_events


def files(folder):
    out = {}
    for where, _, names in os.walk(folder):
        for n in names:
            if n.endswith(".parquet"):
                path = os.path.join(where, n)
                out[path] = (os.path.getmtime(path), os.path.getsize(path))
    return out


def test_index_refresh_touches_only_changed_buckets(spark, tmp_path):
    docs = [(f"d{i}", f"text number {i} of many words {i % 7}") for i in range(300)]
    old = spark.createDataFrame(docs, "product_id string, searchable_text string")
    changed = [*docs[:3], ("d3", "rewritten"), *docs[5:], ("new", "a new text"), ("d4", None)]
    new = spark.createDataFrame(changed, old.schema)
    stored = index.StoredIndex(spark, str(tmp_path / "index"), 32)
    stored.build(old)
    before = files(str(tmp_path / "index" / "data"))
    touched = stored.refresh(new, index.snapshot_diff(old, new, "product_id"))
    assert 1 <= len(touched) <= 3
    after = files(str(tmp_path / "index" / "data"))
    assert {k: v for k, v in after.items() if k in before} == before and len(after) - len(before) == len(touched)
    again = index.StoredIndex(spark, str(tmp_path / "index"), 32)  # as another job finds it
    key = lambda df: sorted(map(tuple, df.select("product_id", "dl", "term", "tf").collect()))
    assert key(again.postings()) == key(index.postings(new))
    assert again.refresh(new, index.snapshot_diff(new, new, "product_id")) == []


def test_a_table_can_become_empty_and_full_again(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path), "k string, v int", "k", 4)
    assert table.latest() == -1 and table.read().count() == 0
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], table.schema)
    table.replace(rows, list(range(4)), 0)
    table.replace(rows.where("false"), list(range(4)), 1)
    assert table.latest() == 1 and table.read().count() == 0 and table.read(0).count() == 3
    table.replace(rows.where("k = 'b'"), table.touched(rows.where("k = 'b'")), 2)
    table.replace(rows.where("k = 'b'"), table.touched(rows.where("k = 'b'")), 2)  # written twice
    assert [tuple(r) for r in table.read().collect()] == [("b", 2)]


def test_session_state_is_found_again_and_writes_little(spark, tmp_path):
    events = made_events(600, sessions=40, items=30)
    folder = str(tmp_path / "state")
    for batch_id in range(3):  # every batch is a job of its own
        jobs.SessionState(spark, folder).update(spark.createDataFrame(events[batch_id * 150 : (batch_id + 1) * 150], EVENT), batch_id)
    before = files(folder + "/data")
    quiet = [(9000, T0 + datetime.timedelta(days=1), "s7", "search", None, "p1")]
    jobs.SessionState(spark, folder).update(spark.createDataFrame(quiet, EVENT), 3)
    after = files(folder + "/data")
    assert {k: v for k, v in after.items() if k in before} == before and len(after) == len(before) + 1
    jobs.SessionState(spark, folder).update(spark.createDataFrame(events[450:], EVENT), 4)
    state = jobs.SessionState(spark, folder)
    assert state.latest == 4
    assert context(state.events()) == context(spark.createDataFrame([*events[:450], *quiet, *events[450:]], EVENT))


def test_one_users_events_are_summed_before_they_are_sorted(spark):
    """One user has 80 % of the events; what is sorted is a row per minute."""
    table = spark.range(20_000).select(
        F.when(F.col("id") % 5 < 4, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 50)).alias("u"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id % 7200)").alias("ts"),
    )
    summaries = ev.minute_summaries(table, "u")
    assert summaries.where("u = 'hot'").count() <= 120 and summaries.agg(F.sum("n")).first()[0] == 20_000
    got = {(r["u"], r["n"]) for r in ev.event_sessions(table, "u", 30).collect()}
    assert ("hot", 16_000) in got
    with pytest.raises(ValueError):
        ev.event_sessions(table, "u", 0)


def test_profiles_merge_from_stored_sketches(spark, tmp_path):
    rows = [(i % 700, None if i % 9 == 0 else f"{'long ' * 20}{i % 400}", " " if i % 4 else str(i)) for i in range(5000)]
    table = spark.createDataFrame(rows, "a long, b string, c string")
    for k in range(2):
        profile.profile_sketches(table.where(f"a % 2 = {k}")).write.parquet(str(tmp_path / f"part={k}"))
    merged = {r["column"]: r for r in profile.merged_profile(spark.read.parquet(str(tmp_path))).collect()}
    whole = {r["column"]: r for r in profile.column_profile(table).collect()}
    direct = {r["column"]: r for r in profile.column_profile(table, exact=False).collect()}
    for c, r in whole.items():
        for other in (merged[c], direct[c]):
            assert (other["non_blank"], other["blank_count"], other["blank_pct"]) == (r["non_blank"], r["blank_count"], r["blank_pct"])
            assert abs(other["distinct_values"] - r["distinct_values"]) <= 0.05 * r["distinct_values"]
    assert whole["b"]["distinct_values"] == 401 and whole["c"]["distinct_values"] == 1251


def test_suggestions_in_three_parts(spark):
    log = spark.createDataFrame(
        [("s1", "Red lamp"), ("s1", "red  lamp"), ("s1", "desk"), ("s2", "red lamp"), ("s2", "desk"), ("s2", "chair"), ("s3", "red rug"), ("s3", " "), ("s4", None), ("s5", "x" * 20_000)],
        "session_id string, query string",
    )
    products = spark.createDataFrame([("Red things",), ("Red things",), ("Rugs",), (None,)], "category string")
    typed = spark.createDataFrame([("RED",), ("r",), ("zz",), ("",), ("x" * 15_000,)], "typed string")
    got = {}
    for r in search.suggest(typed, log, products, 2).orderBy("rank").collect():
        got.setdefault((r["typed"][:3], r["part"]), []).append((r["suggestion"][:10], r["uses"]))
    assert got == {
        ("red", "completions"): [("red lamp", 3), ("red rug", 1)], ("r", "completions"): [("red lamp", 3), ("red rug", 1)], ("xxx", "completions"): [("x" * 10, 1)],
        ("red", "categories"): [("red things", 2)], ("r", "categories"): [("red things", 2), ("rugs", 1)],
        ("red", "related"): [("desk", 2), ("chair", 1)], ("r", "related"): [("desk", 2), ("chair", 1)],
    }
    rows = search.suggest_prefixes(log)
    assert rows.where("n_chars > 10").count() == 19_990  # a row of numbers for each prefix of the long query
    assert rows.columns == ["prefix_key", "n_chars", "rank", "completion_key", "uses"]


def test_small_rules(spark, tmp_path):
    rows = spark.createDataFrame([("a", ""), ("b", "x"), (None, None), ("c", " ")], "k string, t string")
    assert [r["k"] for r in quality.blank_samples(rows, "t", "k", n=2).collect()] == [None, "a"]
    child = spark.createDataFrame([(1, "p"), (2, "q"), (3, None)], "id int, fk string")
    parent = spark.createDataFrame([("p",), ("p",)], "pk string")
    assert sorted(map(tuple, quality.fk_outcomes(child, "fk", parent, "pk").collect())) == [(1, "p", "kept"), (2, "q", "orphan")]
    source, target = str(tmp_path / "small"), str(tmp_path / "few")
    child.repartition(3).write.parquet(source)
    assert len(sinks.compact(spark, source, target).inputFiles()) < len(files(source)) and spark.read.parquet(target).count() == 3


def test_a_failed_write_is_told_as_one(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "t").write_text("a file in the way")
    spec = ops.TableSpec("src", "t/x", key="id")
    audit = ops.ingest_tables(spark, [spec], lambda n: spark.range(3), str(tmp_path / "out"), strict=False).first()
    assert audit["status"] == "FAILED" and audit["message"] == "cannot write t/x"


def test_statistics_are_kept_with_the_table(spark, tmp_path):
    spark.range(50).selectExpr("id", "id % 7 AS k").write.parquet(str(tmp_path / "t"))
    spark.sql(f"CREATE TABLE counted_rows USING parquet LOCATION '{tmp_path}/t'")
    try:
        sinks.compute_statistics(spark, "counted_rows")
        told = {r["col_name"]: r["data_type"] for r in spark.sql("DESCRIBE EXTENDED counted_rows").collect()}
        assert "50 rows" in told["Statistics"]
        column = {r["info_name"]: r["info_value"] for r in spark.sql("DESCRIBE EXTENDED counted_rows k").collect()}
        assert column["distinct_count"] == "7"
    finally:
        spark.sql("DROP TABLE counted_rows")


def test_the_latest_update_wins(spark):
    rows = spark.createDataFrame([("a", 1.0, 1), ("a", 5.0, 0), ("b", 2.0, 0)], "id string, rating double, run int")
    first = clean.stamped(rows.where("run = 0"))
    later = clean.stamped(rows.where("run = 1")).withColumns({c: F.col(c) + F.expr("INTERVAL 1 HOUR") for c in ("processed_at", "updated_at")})
    best = {r["id"]: r["rating"] for r in quality.best_record(first.unionByName(later), "id").collect()}
    assert best == {"a": 1.0, "b": 2.0}
