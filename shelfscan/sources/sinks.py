"""Sinks: full refresh, append, partition refresh, growing schemas, compaction, reports."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Full refresh or append."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def refresh_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def append_evolving(df: DataFrame, path: str) -> None:
    """Append rows whose columns may differ from the table's."""
    df.write.mode("append").parquet(path)


def read_evolving(spark: SparkSession, path: str) -> DataFrame:
    """All columns any part of the table has; absent ones are NULL."""
    return spark.read.option("mergeSchema", True).parquet(path)


def normalize_types(df: DataFrame) -> DataFrame:
    """Decimals as double, char and varchar as string; the frame itself when nothing differs."""

    def target(dtype: T.DataType) -> T.DataType | None:
        if isinstance(dtype, T.DecimalType):
            return T.DoubleType()
        if isinstance(dtype, (T.CharType, T.VarcharType)):
            return T.StringType()
        return None

    changes = {f.name: target(f.dataType) for f in df.schema.fields}
    if not any(changes.values()):
        return df
    return df.select(*[F.col(c).cast(t).alias(c) if t else F.col(c) for c, t in changes.items()])


def compact(spark: SparkSession, source: str, target: str, target_bytes: int = 128 * 1024 * 1024) -> DataFrame:
    """Rewrite small files into files of about ``target_bytes`` at a new path.

    The size comes from the file listing, not from the data; the rows are
    rebalanced by Spark, which also splits oversized partitions.
    """
    df = spark.read.parquet(source)
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(source)
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    files = max(1, -(-size // target_bytes))
    df.hint("rebalance", int(files)).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def compute_statistics(spark: SparkSession, table: str) -> None:
    """Table and column statistics for the optimizer."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")


def write_report(summary: DataFrame, per_query: DataFrame, folder: str) -> dict[str, str]:
    """Evaluation report: one JSON and two CSV outputs, written by Spark."""
    paths = {name: os.path.join(folder, name) for name in ("evaluation_report", "evaluation_summary", "per_query_results")}
    summary.write.mode("overwrite").json(paths["evaluation_report"])
    metrics = [c for c, t in summary.dtypes if t == "double"]
    lines = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("average_value")) for c in metrics]))
    summary.select(lines.alias("l")).select("l.*").write.mode("overwrite").csv(paths["evaluation_summary"], header=True)
    per_query.write.mode("overwrite").csv(paths["per_query_results"], header=True)
    return paths
