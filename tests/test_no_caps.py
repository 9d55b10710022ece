"""Nothing is cut by depth, length or number of words; wrong inputs are reported, not swallowed."""

from pyspark.sql import functions as F

from shelfscan.functions.text import clean_value
from shelfscan.operators.catalog import category_paths
from shelfscan.operators.index import snapshot_diff
from shelfscan.operators.ops import table_health
from shelfscan.operators.search import parse_intent_json, query_intent, suggest_prefixes


def test_phrase_of_any_length(spark):
    queries = spark.createDataFrame([("q", "cheap twin size platform bed under 500")], "query_id string, query string")
    words = spark.createDataFrame([("category", "twin size platform bed", "Beds")], "kind string, phrase string, value string")
    row = query_intent(queries, words).first()
    assert (row["category"], row["rewritten_query"], row["price_max"]) == ("Beds", "cheap", 500.0)


def test_prefix_of_any_length(spark):
    log = spark.createDataFrame([("a very long query that goes on",)], "query string")
    assert suggest_prefixes(log).where("n_chars = 25").count() == 1


def test_paths_of_any_depth_and_cycles(spark):
    rows = [(str(i), str(i - 1) if i else None, f"L{i}") for i in range(9)] + [("x", "y", "X"), ("y", "x", "Y"), ("z", "x", "Z"), ("o", "gone", "O")]
    got = {r["category_id"]: r for r in category_paths(spark.createDataFrame(rows, "category_id string, parent_category_id string, category_name string")).collect()}
    assert got["8"]["path"] == " > ".join(f"L{i}" for i in range(9)) and not got["8"]["cyclic"]
    assert got["x"]["cyclic"] and got["y"]["cyclic"] and got["z"]["cyclic"] and got["o"]["path"] == "O" and len(got) == len(rows)


def test_reply_with_text_after_the_object(spark):
    rows = spark.createDataFrame(
        [("a", "q", '{"rewritten_query": "r"} hope this helps'), ("b", "q", '```json\n{"rewritten_query": "r"}\n```'), ("c", "q", '{"rewritten_query": "r"}, {}')],
        "query_id string, query string, response string",
    )
    assert {r["query_id"]: r["rewritten_query"] for r in parse_intent_json(rows).collect()} == {"a": "q", "b": "r", "c": "q"}


def test_white_space_is_no_value(spark):
    df = spark.createDataFrame([("\t",), ("\n ",), (" None\t",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(clean_value(F.col("v"))).collect()] == [None, None, None, "x", None]


def test_added_and_removed_columns_are_changes(spark):
    old = spark.createDataFrame([("1", "a", "k"), ("2", "b", None)], "id string, v string, gone string")
    new = spark.createDataFrame([("1", "a", None), ("2", "b", "n")], "id string, v string, added string")
    assert {(r["id"], r["change_type"]) for r in snapshot_diff(old, new, "id").collect()} == {("1", "update"), ("2", "update")}


def test_damaged_table_is_one_row(spark, tmp_path):
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    spark.range(3).write.parquet(good)
    spark.range(3).coalesce(1).write.parquet(bad)
    for f in (tmp_path / "bad").glob("part-*"):
        f.write_bytes(f.read_bytes()[:40])
    for f in (tmp_path / "bad").glob(".*.crc"):
        f.unlink()
    got = {r["table_name"]: r for r in table_health(spark, [good, bad], lambda p: spark.read.schema("id long").parquet(p)).collect()}
    assert got[good]["status"] == "HEALTHY" and got[good]["record_count"] == 3 and got[bad]["status"] == "UNHEALTHY"
