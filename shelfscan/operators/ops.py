"""Operational tables, ingestion audit and health."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

# Columns of the append-only operational tables. Fields a
# writer has beyond these go into the map column ``extra``.
OPS_TABLES = {
    "pipeline_execution_log": "log_id string, run_id string, run_date date, task_name string, table_name string, status string, "
    "rows_processed long, duration_seconds double, message string, created_at timestamp, extra map<string,string>",
    "data_ingestion_audit": "audit_id string, run_id string, table_name string, source_table string, status string, rows_read long, "
    "rows_written long, duration_seconds double, message string, created_at timestamp",
    "rejected_records": "rejection_id string, run_id string, run_date date, source_table string, rule_name string, "
    "violation_reason string, record_key string, created_at timestamp, extra map<string,string>",
    "data_quality_report": "report_id string, run_id string, run_date date, table_name string, stage string, execution_time timestamp, "
    "status string, records_read long, records_written long, duplicates long, invalid_records long, quality_score double, "
    "error_message string, created_at timestamp",
    "monitoring_metrics": "timestamp timestamp, pipeline_stage string, metric_name string, metric_value double, unit string, status string",
    "health_status": "component string, status string, checked_at timestamp, message string",
    "alert_log": "severity string, component string, alert_type string, message string, timestamp timestamp, resolved string",
    "audit_log": "timestamp timestamp, run_id string, pipeline_stage string, action string, status string, message string",
    "security_validation": "validation_type string, component string, result string, details string, checked_at timestamp",
    "pipeline_events": "event_id string, event_type string, pipeline_stage string, status string, records_processed long, "
    "duration_seconds double, error_message string, metadata string, logged_at timestamp",
}

_ID = ("log_id", "audit_id", "rejection_id", "report_id", "event_id")
_NOW = ("created_at", "timestamp", "checked_at", "logged_at", "execution_time")


def typed_rows(rows: DataFrame, table: str) -> DataFrame:
    """Rows in the table's schema: ids and times are filled in, missing columns are NULL."""
    schema = rows.sparkSession.createDataFrame([], OPS_TABLES[table]).schema

    def column(field) -> Column:
        if field.name in rows.columns:
            return F.col(field.name).cast(field.dataType)
        if field.name in _ID:
            return F.uuid()
        if field.name in _NOW:
            return F.current_timestamp().cast(field.dataType)
        if field.name == "run_date":
            return F.current_date()
        return F.lit(None).cast(field.dataType)

    return rows.select(*[column(f).alias(f.name) for f in schema.fields])


def append_ops(rows: DataFrame, table: str, folder: str) -> bool:
    """Append a run's rows in one write; a failed write becomes a log line."""
    try:
        typed_rows(rows, table).write.mode("append").parquet(os.path.join(folder, table))
        return True
    except Exception as error:  # telemetry must never stop the work it describes
        log.warning("could not append to %s: %s", table, error)
        return False


def metric_rows(facts: DataFrame, stage: str, unit: str) -> DataFrame:
    """One typed metric row per numeric column of a one-row frame."""
    numeric = [c for c, t in facts.dtypes if t in ("int", "bigint", "double", "float") or t.startswith("decimal")]
    lines = F.explode(F.array(*[F.struct(F.lit(c).alias("metric_name"), F.col(c).cast("double").alias("metric_value")) for c in numeric]))
    return facts.select(lines.alias("m")).select(
        F.lit(stage).alias("pipeline_stage"), "m.metric_name", "m.metric_value", F.lit(unit).alias("unit"), F.lit("SUCCESS").alias("status")
    )


# ── ingestion ────────────────────────────────────────────────────────────


@dataclass(frozen=True)
class TableSpec:
    source: str
    target: str
    key: str | None = None


class IngestError(RuntimeError):
    """At least one table failed; the audit rows are attached."""

    def __init__(self, failed: Sequence[str], audit: DataFrame):
        super().__init__("ingestion failed for: " + ", ".join(failed))
        self.audit = audit


def _require_sound(df: DataFrame, spec: TableSpec) -> int:
    """Row count of a table that is not empty and whose key is set and unique."""
    if spec.key is None:
        n = df.count()
        nulls = dups = 0
    else:
        per_key = df.groupBy(spec.key).agg(F.count(F.lit(1)).alias("n"))
        key = F.col(spec.key)
        n, nulls, dups = per_key.agg(
            F.coalesce(F.sum("n"), F.lit(0)),
            F.coalesce(F.sum(F.when(key.isNull(), F.col("n"))), F.lit(0)),
            F.count_if(key.isNotNull() & (F.col("n") > 1)),
        ).first()
    if n == 0:
        raise ValueError(f"{spec.source} is empty")
    if nulls:
        raise ValueError(f"{spec.source} has {nulls} null keys in {spec.key}")
    if dups:
        raise ValueError(f"{spec.source} has {dups} duplicate keys in {spec.key}")
    return n


def ingest_tables(
    spark: SparkSession, specs: Sequence[TableSpec], read: Callable[[str], DataFrame], folder: str, mode: str = "overwrite", strict: bool = True
) -> DataFrame:
    """Check and write each listed table; one failing table does not stop the others.

    Per table: one aggregate for all checks, and a write that counts its rows
    while writing. With ``strict`` the job fails at the end.
    """
    rows, failed = [], []
    for spec in specs:
        doing = "read"
        try:
            df = read(spec.source)
            n = _require_sound(df, spec)
            doing = "write"
            written = Observation()
            df.observe(written, F.count(F.lit(1)).alias("n")).write.mode(mode).parquet(os.path.join(folder, spec.target))
            rows.append((spec.source, spec.target, "SUCCESS", n, int(written.get["n"]), ""))
        except (PySparkException, Py4JJavaError, ValueError) as error:  # some failed writes come as they are from the JVM
            failed.append(spec.source)
            text = str(error) if isinstance(error, ValueError) else f"cannot {doing} {spec.source if doing == 'read' else spec.target}"
            rows.append((spec.source, spec.target, "FAILED", 0, 0, text))
    audit = spark.createDataFrame(
        rows, "source_table string, table_name string, status string, rows_read long, rows_written long, message string"
    )
    if failed and strict:
        raise IngestError(failed, audit)
    return audit


# ── health ───────────────────────────────────────────────────────────────


def table_health(spark: SparkSession, names: Sequence[str], read: Callable[[str], DataFrame]) -> DataFrame:
    """Status, rows and columns of each listed table; unreadable ones are unhealthy."""
    shape = "table_name string, status string, record_count long, column_count int, error string"
    rows = []
    for name in names:
        try:
            df = read(name)
            rows.append((name, "HEALTHY", df.count(), len(df.columns), None))  # counted here: a damaged file is found by reading
        except PySparkException as error:
            rows.append((name, "UNHEALTHY", 0, 0, error.getCondition() or "unreadable"))
        except Py4JJavaError:  # a task failed on the table's files
            rows.append((name, "UNHEALTHY", 0, 0, "unreadable"))
    return spark.createDataFrame(rows, shape)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def row_count(spark: SparkSession, name: str) -> int:
    """Rows of a table, 0 when it cannot be read."""
    try:
        return spark.table(name).count()
    except PySparkException:
        return 0


def health_rollup(checks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Worst component status, and FAILED when any validation failed.

    ``checks``: component status in ``status`` (Healthy, Warning, Critical)
    and validation result in ``result`` (PASSED, WARNING, FAILED).
    """
    severity = F.when(F.col("status") == "Critical", 3).when(F.col("status") == "Warning", 2).otherwise(1)
    worst = checks.groupBy(*keys).agg(
        F.max(severity).alias("_s"), F.coalesce(F.bool_or(F.col("result") == "FAILED"), F.lit(False)).alias("_f"), F.count(F.lit(1)).alias("components")
    )
    return worst.select(
        *keys, "components", F.when(F.col("_s") == 3, "Critical").when(F.col("_s") == 2, "Warning").otherwise("Healthy").alias("final_status"),
        F.when(F.col("_f"), "FAILED").otherwise("PASSED").alias("validation_status"),
    )
