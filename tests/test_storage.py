"""Sources, sinks and operational tables."""

import pytest
from pyspark.sql import functions as F

from shelfscan.operators import catalog, ops
from shelfscan.session import cut_lineage, scratch_path, shared_dir
from shelfscan.sources import readers, sinks


def test_jdbc_scan_needs_bounds():
    with pytest.raises(ValueError):
        readers.jdbc_options("jdbc:x", "t")
    with pytest.raises(ValueError):
        readers.jdbc_options("jdbc:x", "t", column="id", lower=0)
    o = readers.jdbc_options("jdbc:x", "t", "id", 0, 1000, 8)
    assert (o["partitionColumn"], o["numPartitions"], o["upperBound"]) == ("id", "8", "1000")
    assert "password" not in o and "user" not in o


def test_csv_is_all_strings(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"a ""b""\nc"\n2,\n', encoding="utf-8")
    df = readers.read_csv_strings(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", 'a "b"\nc'), ("2", "")]
    assert {t for _, t in df.dtypes} == {"string"}


def test_failing_tables_do_not_stop_the_others(spark, tmp_path):
    frames = {"good": spark.range(5), "empty": spark.range(0), "dup": spark.range(3).union(spark.range(1)), "null": spark.sql("SELECT CAST(NULL AS bigint) AS id")}
    specs = [ops.TableSpec(n, n, "id") for n in ("empty", "dup", "null", "good")]
    audit = {r["source_table"]: r for r in ops.ingest_tables(spark, specs, frames.__getitem__, str(tmp_path), strict=False).collect()}
    assert [audit[n]["status"] for n in ("good", "empty", "dup", "null")] == ["SUCCESS", "FAILED", "FAILED", "FAILED"]
    assert (audit["good"]["rows_read"], audit["good"]["rows_written"]) == (5, 5)
    with pytest.raises(ops.IngestError, match="empty, dup, null"):
        ops.ingest_tables(spark, specs, frames.__getitem__, str(tmp_path / "again"))


def test_failed_telemetry_is_only_logged(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    rows = spark.createDataFrame([("a", "Healthy")], "component string, status string")
    assert ops.append_ops(rows, "health_status", str(tmp_path / "file")) is False
    assert ops.append_ops(rows, "health_status", str(tmp_path / "ops")) is True


@pytest.mark.parametrize("table", sorted(ops.OPS_TABLES))
def test_every_ops_table_takes_rows(spark, table):
    rows = ops.typed_rows(spark.range(2).select(F.lit("x").alias("status"), F.lit("run").alias("run_id")), table)
    assert rows.count() == 2 and rows.columns == [c.split()[0] for c in ops.OPS_TABLES[table].split(", ")]


def test_types_are_rewritten_only_when_needed(spark):
    same = spark.range(1)
    assert sinks.normalize_types(same) is same
    assert dict(sinks.normalize_types(spark.sql("SELECT CAST(1 AS decimal(5,2)) AS a, 'x' AS b")).dtypes) == {"a": "double", "b": "string"}


def test_table_helpers(spark):
    assert not ops.table_exists(spark, "no_such_table") and ops.row_count(spark, "no_such_table") == 0
    spark.range(4).createOrReplaceTempView("four")
    assert ops.row_count(spark, "four") == 4


def test_rollup(spark):
    rows = spark.createDataFrame([("Healthy", "PASSED"), ("Warning", None)], "status string, result string")
    r = ops.health_rollup(rows).first()
    assert (r["final_status"], r["validation_status"]) == ("Warning", "PASSED")


def test_lineage_is_cut_in_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    df = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.count() == 10


def test_category_paths(spark):
    rows = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C")], "category_id string, parent_category_id string, category_name string")
    assert {r[0]: r[1] for r in catalog.category_paths(rows).collect()} == {"a": "A", "b": "A > B", "c": "A > B > C"}


def test_one_price_per_product(spark):
    rows = spark.createDataFrame(
        [("1", "p", "2024-01-01", None), ("2", "p", "2024-02-01", None), ("3", "p", "2024-03-01", None), ("4", "q", "2024-01-01", "2024-02-15")],
        "price_id string, product_id string, f string, t string",
    ).selectExpr("price_id", "product_id", "date(f) AS effective_from", "date(t) AS effective_to")
    assert [(r["product_id"], r["price_id"]) for r in catalog.active_price(rows, "2024-02-15").collect()] == [("p", "2")]
