"""Tables written in passing, below the shared folder, and small helpers for Arrow tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfscan.session import in_small_batches, scratch_path, tidied

__all__ = ["in_small_batches", "other_columns", "rows_again", "tidied", "utf8", "written"]


def other_columns(docs: DataFrame) -> tuple[Column, str]:
    """All columns but ``text`` as one struct, and its type: no helper's name can clash with them, and no text is carried twice."""
    others = StructType([f for f in docs.schema if f.name != "text"])
    if not len(others):
        return F.lit(None).cast("boolean"), "boolean"
    return F.struct(*[F.col(f"`{f.name}`") for f in others]), others.simpleString()


def rows_again(carried: DataFrame, columns: list[str], row: str = "row", **changed: Column) -> DataFrame:
    """The rows that ``other_columns`` packed as ``row``, with ``text`` and whatever else is ``changed``."""
    return carried.select(*[changed[c].alias(c) if c in changed else F.col(f"{row}.`{c}`").alias(c) for c in columns])


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the rows written.

    The folder is the one of ``spark.checkpoint.dir``, so the rows outlive
    the executors that made them and nothing above is computed twice.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8; null is empty."""
    return [x or b"" for x in column.cast("binary").to_pylist()]
