"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # one hot key is split over several tasks at run time
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def build_session(app: str = "shelfscan", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators were planned for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once per context: Python tasks import it by name."""
    sc = spark.sparkContext
    if getattr(sc, "_shelfscan_shipped", False):
        return
    package = Path(__file__).resolve().parent
    if package.parent.is_dir():  # a package that came as an archive is on the workers' path already
        folder = tempfile.mkdtemp(prefix="shelfscan-ship-")  # the driver serves the file from here until it ends
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.addPyFile(shutil.make_archive(f"{folder}/shelfscan", "zip", package.parent, package.name))
    sc._shelfscan_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    existing = sc.getCheckpointDir()
    if existing:
        return existing
    folder = tempfile.mkdtemp(prefix="shelfscan-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written rows."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


# Bytes of one Arrow batch, where the session does not say: a worker holds a batch several times over
BATCH_BYTES = "8m"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, whose session hands rows to Python tasks in batches of ``BATCH_BYTES``, unless it sets a size itself."""
    conf = docs.sparkSession.conf
    if _BATCH_BYTES not in conf.getAll:
        conf.set(_BATCH_BYTES, BATCH_BYTES)
    return docs


def _give_back() -> None:
    """Return freed memory to the system, where the allocator has a call for it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError, TypeError):
        pass


def tidied(run):
    """``run``, a function for ``mapInArrow`` or ``mapInPandas``, after which the reused worker holds no more than it needs.

    An executor's workers go from stage to stage; without this each would keep
    what its largest task has needed.
    """

    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return tidy
