"""Scans: tables, all-string CSV, partitioned JDBC."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscan.session import ship_package


def read_table(spark: SparkSession, source: str) -> DataFrame:
    """A catalog table by name, or parquet by path."""
    ship_package(spark)
    return spark.read.parquet(source) if "/" in source else spark.table(source)


def read_csv_strings(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CSV with a header, every column a string, no inference, NULL as ''.

    A quoted line break makes a file one task; where the texts hold none,
    ``multi_line=False`` lets Spark split large files.
    """
    options = {"header": True, "inferSchema": False, "multiLine": multi_line, "quote": '"', "escape": '"'}
    return spark.read.options(**options).csv(path).fillna("")


def jdbc_options(
    url: str, table: str, column: str | None = None, lower: int | None = None, upper: int | None = None, partitions: int = 4
) -> dict[str, str]:
    """Reader options of a scan split into ``partitions`` ranges of ``column``.

    Connection properties come from the caller; there are no defaults. A
    partition count without bounds would still be one task, so it is refused.
    """
    options = {"url": url, "dbtable": table, "fetchsize": "10000"}
    if column is None:
        if partitions != 1:
            raise ValueError("a parallel scan needs a partition column and its bounds")
        return options
    if lower is None or upper is None:
        raise ValueError("a partition column needs a lower and an upper bound")
    return options | {
        "partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions),
    }


def read_jdbc(spark: SparkSession, properties: Mapping[str, str], **where) -> DataFrame:
    """Range-partitioned JDBC scan; see :func:`jdbc_options`."""
    return spark.read.format("jdbc").options(**dict(properties), **jdbc_options(**where)).load()


def with_lineage(df: DataFrame, batch_id: str) -> DataFrame:
    """Add ingestion time, batch id and the source file of every row."""
    return df.select(
        "*",
        F.current_timestamp().alias("ingested_at"),
        F.lit(batch_id).alias("batch_id"),
        F.col("_metadata.file_name").alias("source_file"),
    )
