"""Sources, sinks, operational tables, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfscan.operators import evaluate, ops
from shelfscan.plans.registry import register
from shelfscan.plans.relevance import MEANS, bm25_hits, grades, metric_sql
from shelfscan.session import cut_lineage, scratch_path
from shelfscan.sources import readers, sinks
from shelfscan.sources.fixtures import Tables

_CSV = ["asin", "title", "categories", "price", "mrp", "discount", "stars", "num_ratings", "description", "review_title", "review_text", "image"]


@register("src_csv_strings", "SELECT " + ", ".join(f"coalesce({c}, '') AS {c}" for c in _CSV) + ", CAST(arrival AS VARCHAR) AS arrival FROM v_product_raw")
def src_csv_strings(t: Tables):
    """S3: the raw catalog written as CSV and read back as strings."""
    path = scratch_path(t.spark, "csv")
    t["v_product_raw"].select(*_CSV, "arrival").write.options(
        header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return readers.read_csv_strings(t.spark, path)


@register(
    "ingest_tables_audit",
    """SELECT 'part' AS source_table, 'SUCCESS' AS status, count(*) AS rows_read, count(*) AS rows_written, '' AS message FROM part
    UNION ALL SELECT 'orders', 'SUCCESS', count(*), count(*), '' FROM orders UNION ALL SELECT 'documents', 'SUCCESS', count(*), count(*), '' FROM documents
    UNION ALL SELECT 'lineitem', 'FAILED', 0, 0, 'lineitem has ' || (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)) || ' duplicate keys in l_orderkey'
    UNION ALL SELECT 'warranty', 'FAILED', 0, 0, 'cannot read warranty'""",
)
def ingest_tables_audit(t: Tables):
    """Three tables arrive, one has a repeated key, one does not exist."""
    keys = {"part": "p_partkey", "orders": "o_orderkey", "documents": "doc_id", "lineitem": "l_orderkey", "warranty": "id"}
    specs = [ops.TableSpec(name, f"raw_{name}", key) for name, key in keys.items()]
    audit = ops.ingest_tables(t.spark, specs, lambda s: t.spark.read.parquet(t.path(s)), scratch_path(t.spark, "bronze"), strict=False)
    return audit.drop("table_name")


@register(
    "ingest_lineage",
    "SELECT doc_id, 'batch-7' AS batch_id, 'documents.parquet' AS source_file, true AS stamped FROM documents",
)
def ingest_lineage(t: Tables):
    """S6."""
    rows = readers.with_lineage(t.spark.read.parquet(t.path("documents")), "batch-7")
    return rows.select("doc_id", "batch_id", "source_file", F.col("ingested_at").isNotNull().alias("stamped"))


@register(
    "sink_overwrite_append",
    """SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (
      SELECT o_orderstatus, o_orderkey FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderstatus, o_orderkey FROM orders WHERE o_orderstatus = 'F'
      UNION ALL SELECT 'P', o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 2 = 0) GROUP BY 1""",
)
def sink_overwrite_append(t: Tables):
    """Full refresh, then an append, then one partition replaced."""
    path = scratch_path(t.spark, "orders")
    orders = t["orders"].select("o_orderkey", "o_orderstatus")
    sinks.write_table(orders, path, "overwrite", ["o_orderstatus"])
    sinks.write_table(orders.filter("o_orderstatus = 'F'"), path, "append", ["o_orderstatus"])
    sinks.refresh_partitions(orders.filter("o_orderstatus = 'P' AND o_orderkey % 2 = 0"), path, ["o_orderstatus"])
    back = t.spark.read.parquet(path)
    return back.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@register(
    "sink_merge_schema",
    """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer
    UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""",
)
def sink_merge_schema(t: Tables):
    """S8, U5."""
    path = scratch_path(t.spark, "parties")
    sinks.append_evolving(t["customer"].selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment"), path)
    sinks.append_evolving(t["supplier"].selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS balance"), path)
    return sinks.read_evolving(t.spark, path).select("id", "name", "segment", "balance")


@register(
    "normalize_types",
    "SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS price, CAST(CAST(p_size AS DECIMAL(5,1)) AS DOUBLE) AS size, p_brand AS brand FROM part",
)
def normalize_types(t: Tables):
    """S12."""
    rows = t["part"].selectExpr(
        "p_partkey", "CAST(p_retailprice AS DECIMAL(12,2)) AS price", "CAST(p_size AS DECIMAL(5,1)) AS size", "p_brand AS brand"
    )
    return sinks.normalize_types(rows)


@register(
    "compact_table",
    "SELECT * FROM lineitem",
)
def compact_table(t: Tables):
    """The whole table in small files becomes few files; all rows and columns stay."""
    source, target = scratch_path(t.spark, "small"), scratch_path(t.spark, "compact")
    t["lineitem"].repartition(16).write.parquet(source)
    return sinks.compact(t.spark, source, target)


@register(
    "ops_append",
    """SELECT 'Silver' AS pipeline_stage, m AS metric_name, v AS metric_value, 'rows' AS unit, 'SUCCESS' AS status, n FROM (
      SELECT unnest(['orders_read', 'customers', 'open_orders']) AS m, unnest([count(*)::DOUBLE, count(DISTINCT o_custkey)::DOUBLE, (count(*) FILTER (o_orderstatus = 'O'))::DOUBLE]) AS v FROM orders), (SELECT 2::BIGINT AS n)""",
)
def ops_append(t: Tables):
    """A run's metrics in one append; two runs, two rows each."""
    folder = scratch_path(t.spark, "operations")
    per_customer = t["orders"].groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("o"))
    facts = per_customer.agg(F.sum("n").alias("orders_read"), F.count(F.lit(1)).alias("customers"), F.sum("o").alias("open_orders"))
    rows = ops.metric_rows(facts, "Silver", "rows")
    for _ in range(2):
        ops.append_ops(rows, "monitoring_metrics", folder)
    table = t.spark.read.parquet(f"{folder}/monitoring_metrics")
    return table.groupBy("pipeline_stage", "metric_name", "metric_value", "unit", "status").agg(F.count("timestamp").alias("n"))


@register(
    "eval_report_export",
    f"""WITH {metric_sql()}, a AS (SELECT {MEANS} FROM m)
    SELECT metric, average_value::DOUBLE AS average_value FROM a UNPIVOT (average_value FOR metric IN (COLUMNS(*)))""",
)
def eval_report_export(t: Tables):
    """Written by Spark and read back; the numbers are those of the metric queries."""
    folder = scratch_path(t.spark, "report")
    # three outputs, one evaluation
    report = cut_lineage(evaluate.per_query(bm25_hits(t), grades(t), t["v_queries"]))
    paths = sinks.write_report(evaluate.macro_average(report), evaluate.rounded(report, 4), folder)
    return t.spark.read.csv(paths["evaluation_summary"], header=True, schema="metric string, average_value double")


@register(
    "health_tables",
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, 'HEALTHY' AS status, count(*) AS record_count, {c} AS column_count FROM {n}"
        for n, c in (("part", 6), ("orders", 6), ("lineitem", 11), ("documents", 5), ("events", 6))
    )
    + " UNION ALL SELECT 'warranty', 'UNHEALTHY', 0, 0",
)
def health_tables(t: Tables):
    """H1, S14."""
    names = ["part", "orders", "lineitem", "documents", "events", "warranty"]
    return ops.table_health(t.spark, names, lambda n: t.spark.read.parquet(t.path(n))).drop("error")


_CHECKS = """SELECT o_orderpriority AS component_group, CASE WHEN o_totalprice > 499900 THEN 'Critical' WHEN o_totalprice > 480000 THEN 'Warning' ELSE 'Healthy' END AS status,
      CASE WHEN o_orderkey % 6001 = 17 THEN 'FAILED' WHEN o_orderkey % 5 = 0 THEN 'WARNING' ELSE 'PASSED' END AS result FROM {orders}"""


@register(
    "health_rollup",
    f"""SELECT component_group, count(*) AS components, CASE max(CASE status WHEN 'Critical' THEN 3 WHEN 'Warning' THEN 2 ELSE 1 END) WHEN 3 THEN 'Critical' WHEN 2 THEN 'Warning' ELSE 'Healthy' END AS final_status,
      CASE WHEN bool_or(result = 'FAILED') THEN 'FAILED' ELSE 'PASSED' END AS validation_status FROM ({_CHECKS.replace('{orders}', 'orders')}) GROUP BY 1""",
)
def health_rollup(t: Tables):
    """H2, H4, one check per order."""
    return ops.health_rollup(t.spark.sql(_CHECKS, orders=t["orders"]), ["component_group"])
