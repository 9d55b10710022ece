"""Tables kept in buckets of a key's hash, of which an update rewrites only those it touches.

Below the folder, ``data/version=n/bucket=b`` holds what version n wrote and
``manifest/version=n`` says for every bucket in which version its rows lie.
The newest manifest is looked up on disk, so a restarted job goes on from it,
and a version that is written again replaces itself. Everything is read and
written by Spark; the driver sees bucket numbers only.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class BucketedTable:
    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder, schema, key, buckets

    def bucket_of(self, key: Column | None = None) -> Column:
        """The hash by which Spark deals rows out, so rows that ``dealt`` has dealt by the key lie with their bucket's."""
        return F.pmod(F.hash(F.col(self.key) if key is None else key), F.lit(self.buckets)).cast("int")

    def dealt(self, rows: DataFrame, shares: int = 1) -> DataFrame:
        """``rows`` by the key in ``shares`` partitions a bucket, none of which holds rows of two buckets."""
        return rows.repartition(self.buckets * shares, self.key)

    def data_path(self, version: int) -> str:
        return os.path.join(self.folder, "data", f"version={version}")

    def _manifests(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("bucket int, lies_in int, version int").parquet(os.path.join(self.folder, "manifest"))
        except AnalysisException:  # nothing has been written yet
            return None

    def latest(self, before: int | None = None) -> int:
        """Newest version (older than ``before``), -1 where there is none."""
        manifests = self._manifests()
        if manifests is None:
            return -1
        rows = manifests if before is None else manifests.where(F.col("version") < before)
        found = rows.agg(F.max("version")).first()[0]
        return -1 if found is None else found

    def live(self, version: int) -> dict[int, int]:
        """Bucket → version that holds its rows; buckets without rows are left out."""
        if version < 0:
            return {}
        rows = self._manifests().where((F.col("version") == version) & (F.col("bucket") >= 0)).select("bucket", "lies_in")
        return {r["bucket"]: r["lies_in"] for r in rows.collect()}

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of the listed keys, at most ``buckets`` numbers."""
        return sorted(r["b"] for r in keys.select(self.bucket_of().alias("b")).distinct().collect())

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """Rows of a version, by default the newest; ``only`` names the buckets to read."""
        version = self.latest() if version is None else version
        paths = [os.path.join(self.data_path(v), f"bucket={b}") for b, v in self.live(version).items() if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def replace(self, rows: DataFrame, touched: list[int], version: int, in_place: bool = False) -> None:
        """Version ``version``: ``rows`` in place of the touched buckets' rows, everything else as it lies.

        ``in_place`` says that the rows lie as ``dealt`` has dealt them; they are written without another shuffle.
        """
        live = {b: v for b, v in self.live(self.latest(before=version)).items() if b not in touched}
        path = self.data_path(version)
        own = rows.withColumn("bucket", self.bucket_of())
        # else a bucket's rows meet in one task, so it is one file
        (own if in_place else own.repartition("bucket")).write.partitionBy("bucket").mode("overwrite").parquet(path)
        written = self.spark.read.schema(f"{self.schema}, bucket int").parquet(path).select("bucket").distinct().collect()
        live |= {r["bucket"]: version for r in written}
        # a row of bucket -1 keeps the version of a table that has become empty
        manifest = self.spark.createDataFrame([(-1, version), *live.items()], "bucket int, lies_in int")
        manifest.coalesce(1).write.mode("overwrite").parquet(os.path.join(self.folder, "manifest", f"version={version}"))
