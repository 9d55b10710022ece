"""Streaming forms: sources, windows with watermarks, session state, checked ingest.

Sinks write one folder per micro-batch and overwrite it on a retry, so a
restarted query leaves the same rows behind.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscan.operators import events as ev
from shelfscan.operators import quality
from shelfscan.session import scratch_path
from shelfscan.sources.bucketed import BUCKETS, BucketedTable


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """Files of a folder, or of a glob, as a stream (a single file is given as a glob)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def event_time(stream: DataFrame, delay: str = "10 minutes", col: str = "ts") -> DataFrame:
    """A zone-less time as event time with a watermark."""
    return stream.withColumn(col, F.col(col).cast("timestamp")).withWatermark(col, delay)


def latency_counts(log: DataFrame, width: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """Counts per window and latency; late rows within the delay still count.

    ``events.latency_report`` makes the windows of what the stream has written.
    """
    return ev.latency_counts(event_time(log, delay), width)


def failure_alerts(log: DataFrame, delay: str = "10 minutes", **limits) -> DataFrame:
    return ev.failure_alerts(event_time(log, delay), **limits)


def sliding_counts(events: DataFrame, delay: str = "10 minutes", **sizes) -> DataFrame:
    return ev.sliding_counts(event_time(events, delay), **sizes)


def event_sessions(events: DataFrame, key: str, gap_minutes: int = 30, delay: str = "10 minutes") -> DataFrame:
    """Session windows of the stream; the end is the last event, as in the batch form."""
    w = F.session_window("ts", f"{gap_minutes} minutes").alias("w")
    return event_time(events, delay).groupBy(key, w).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n")).drop("w")


def first_delivery(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    return event_time(events, delay).dropDuplicatesWithinWatermark(["event_id"])


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what has arrived, in micro-batches, then stop."""
    query = (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def append_to_folder(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Closed windows as parquet, exactly once."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


# ── session state ────────────────────────────────────────────────────────


class SessionState:
    """What sessions remember, as a table in buckets of their ids.

    A batch's new state is the batch operator over (old state as events) and
    the new events, for the buckets the batch touches; the others stay as they
    lie, so what is written follows the sessions that did something. Batch n
    reads the newest version before n and writes version n: replaying a batch
    after a failure gives the same table, and a restarted job finds its state
    on disk. Replaced files stay until the owner of the folder removes them.
    """

    SCHEMA = "event_id long, ts timestamp_ntz, session_id string, kind string, action string, item string"

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.table = BucketedTable(spark, folder, self.SCHEMA, "session_id", buckets)

    @property
    def latest(self) -> int:
        return self.table.latest()

    def events(self, batch_id: int | None = None) -> DataFrame:
        """The remembered state in the shape of events."""
        return self.table.read(batch_id)

    def update(self, batch: DataFrame, batch_id: int) -> None:
        columns = [f.split()[0] for f in self.SCHEMA.split(", ")]
        new = batch.select(*columns).persist()
        touched = self.table.touched(new)
        # four lists are derived from the same rows
        everything = self.table.read(self.table.latest(before=batch_id), touched).unionByName(new).persist()
        searches = ev.recent_searches(everything)
        views = ev.recent_views(everything).withColumn("kind", F.lit("view")).withColumn("action", F.lit(None).cast("string"))
        # a cart item re-enters as an add before all later events, in cart order
        carts = ev.cart_state(everything).select(
            F.col("position").cast("long").alias("event_id"), F.lit("1970-01-01").cast("timestamp_ntz").alias("ts"),
            "session_id", F.lit("cart").alias("kind"), F.lit("add").alias("action"), "item",
        )
        told = everything.filter(F.col("kind") == "customer").groupBy("session_id").agg(
            F.max_by(F.struct("event_id", "ts", "kind", "action", "item"), F.struct("ts", "event_id")).alias("r")
        ).select("session_id", "r.*")
        out = carts.select(*columns)
        for part in (searches, views, told):
            out = out.unionByName(part.select(*columns))
        self.table.replace(out, touched, batch_id)
        everything.unpersist()
        new.unpersist()


# ── ingest ───────────────────────────────────────────────────────────────


def checked_ingest(
    stream: DataFrame, rules: Callable[[], list], table: str, key: str, target: str, rejects: str, checkpoint: str, run_id: str = "stream"
) -> None:
    """Valid rows to ``target``, the first failed rule of the others to ``rejects``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        checked = quality.check(batch, rules()).persist()
        folder = f"batch={batch_id}"
        quality.valid(checked).write.mode("overwrite").parquet(os.path.join(target, folder))
        bad = quality.quarantine(checked, table, F.col(key), run_id)
        bad.write.mode("overwrite").parquet(os.path.join(rejects, folder))
        checked.unpersist()

    run_available(stream, handle, checkpoint)


def checkpoint_path(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"stream-{name}")
