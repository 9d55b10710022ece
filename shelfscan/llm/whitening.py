"""Embedding whitening: principal directions scaled to unit variance.

Entries are put on an integer grid, so counts and sums are exact. Centred rows
are reduced to their triangle by blockwise QR: each task folds its rows, block
by block, into one triangle, and a tree of merges stacks triangles and reduces
them again. The last one, of the dimension squared, goes to the driver, which
finds singular values and directions from it (``bidiagonal``). The covariance
of the whitened rows is then measured over all of them.

Defined results: rows whose vector is null or holds null or non-finite entries
are left out; a shorter vector is read as ending in zeros; repeated rows all
count; directions without variance (and those lost in rounding beside the
largest) have no component, so a table of equal vectors gives no rows, and so
does an empty one; a deviation too large for a long is null; other columns are
not read. Entries must stay below 2⁵⁶ in size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan.llm.bidiagonal import right_singular
from shelfscan.llm.scratch import in_small_batches

GRID = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: rows of a block that is folded into a triangle, and triangles that one merge takes
BLOCK_ROWS = 4096
FAN_IN = 16


@dataclass
class Whitening:
    """What is learned: row count, sums per dimension, directions as columns, their variances, and the total variance."""

    n: int
    sums: list[int]
    directions: np.ndarray
    variances: np.ndarray
    trace: float


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, vector): the rows whose vector is whole, entries as doubles."""
    rows = in_small_batches(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(F.col("vector").isNotNull() & ~bad)


def _grid(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """The batch's vectors as whole numbers, one per row; shorter ones end in zeros."""
    lists = batch.column("vector")
    entries = np.floor(GRID * lists.flatten().to_numpy()).astype(np.int64)
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((batch.num_rows, size), np.int64)
    if (lengths == size).all():
        out = entries.reshape(batch.num_rows, size)
    else:
        out[np.arange(size)[None, :] < lengths[:, None]] = entries
    return out + SHIFT


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, n, total) of one task, with n under dimension -1; whole numbers without the shift."""
    n, sums = 0, np.zeros(0, np.int64)
    for batch in batches:
        lengths = np.diff(batch.column("vector").offsets.to_numpy())
        size = max(len(sums), int(lengths.max(initial=0)))
        sums = np.concatenate([sums, np.zeros(size - len(sums), np.int64)]) + (_grid(batch, size) - SHIFT).sum(axis=0)
        n += batch.num_rows
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[-1, np.arange(len(sums))].astype(np.int32)), pa.array(np.r_[n, sums].astype(np.int64))], names=["dim", "total"]
        )


def count_and_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Exact row count and sums of every dimension; what reaches the driver is as long as a vector."""
    parts = rows.select("vector").mapInArrow(_partial_sums, "dim int, total long")
    sums = {r["dim"]: int(r["total"]) for r in parts.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    n = sums.pop(-1, 0)
    return n, [sums[k] + SHIFT * n for k in range(len(sums))]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n; the whole parts are taken off before anything is rounded."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole) - np.array([(s % n) / n for s in sums])


def _stacked(triangle: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    size = rows.shape[1]
    both = rows if triangle is None else np.vstack([triangle, rows])
    r = np.linalg.qr(both, mode="r")
    return r if len(r) == size else np.vstack([r, np.zeros((size - len(r), size))])


def _triangle_batch(r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.ravel()], pa.list_(pa.float64()))], names=["r"])


def _reduce_rows(n: int, sums: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                r = _stacked(r, _centred(_grid(batch.slice(at, BLOCK_ROWS), len(sums)), n, sums))
        if r is not None:
            yield _triangle_batch(r)

    return run


def _merge_triangles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for own in batch.column("r"):
                r = _stacked(r, own.values.to_numpy().reshape(size, size))
        if r is not None:
            yield _triangle_batch(r)

    return run


def triangle(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred rows' QR: one triangle per task, merged in a tree of ``FAN_IN``."""
    size = len(sums)
    parts = rows.select("vector").mapInArrow(_reduce_rows(n, sums), "r array<double>")
    tasks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    while True:
        parts = parts.repartition(tasks).mapInArrow(_merge_triangles(size), "r array<double>")
        if tasks == 1:
            break
        tasks = -(-tasks // FAN_IN)
    (row,) = parts.collect()
    return np.array(row["r"]).reshape(size, size)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of usable rows, with at most ``components`` directions; None where there is no row.

    Reads the rows twice while the result is planned.
    """
    n, sums = count_and_sums(rows)
    if not n or not sums:
        return None
    squares, directions = right_singular(triangle(rows, n, sums))
    return Whitening(n, sums, directions[:, :components], squares[: min(components, directions.shape[1])] / n, float(squares.sum()) / n)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum of (n x - S)² per row, exactly: in longs where all fits, else in Python's whole numbers."""
    largest = max(n * abs(int(e)) + abs(s) for e, s in zip(np.abs(x).max(axis=0), sums)) if len(x) else 0
    if largest < 1 << 62:
        apart = n * x - np.array(sums, np.int64)
        if x.shape[1] * int(np.abs(apart).max(initial=0)) ** 2 < 1 << 63:
            return pa.array((apart * apart).sum(axis=1))
    exact = [sum((n * e - s) ** 2 for e, s in zip(row, sums)) for row in x.tolist()]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def _whiten(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scaled = model.directions / np.sqrt(model.variances)
        k = scaled.shape[1]
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(at, BLOCK_ROWS)
                x = _grid(some, len(model.sums))
                out = _centred(x, model.n, model.sums) @ scaled
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(x) + 1, k, dtype=np.int32)), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), _deviations(x, model.n, model.sums), lists], names=["vec_id", "deviation", "whitened"])

    return run


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened) of usable rows; ``whitened`` has one entry per component, largest variance first."""
    return rows.mapInArrow(_whiten(model), "vec_id long, deviation long, whitened array<double>")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, total): sums of one task's whitened entries and of their products."""
    total = None
    for batch in batches:
        if batch.num_rows:
            w = batch.column("whitened").flatten().to_numpy().reshape(batch.num_rows, -1)
            own = np.r_[w.sum(axis=0), (w.T @ w).ravel()]
            total = own if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["cell", "total"])


def identity_error(white: DataFrame, n: int, components: int) -> float:
    """Largest entry of |cov(whitened) - I|, divisor n; components squared numbers reach the driver."""
    sums = white.select("whitened").mapInArrow(_moments, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total"))
    total = np.zeros(components + components**2)
    for r in sums.collect():
        total[r["cell"]] = r["total"]
    mean = total[:components] / n
    covariance = total[components:].reshape(components, components) / n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(components)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), one row per usable row and component.

    Components count from 1. Fits and measures while the result is planned.
    """
    rows = usable(vectors, column)
    model = fit(rows, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not model.directions.shape[1]:
        return vectors.sparkSession.createDataFrame([], schema)
    white = whitened(rows, model)
    k = len(model.variances)
    error = identity_error(white, model.n, k)
    share = F.element_at(F.array(*[F.lit(float(v / model.trace)) for v in model.variances]), F.col("component"))
    long = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "value")).withColumn("component", F.col("at") + 1)
    return long.select(
        "vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", F.col("value").alias("whitened"),
        share.alias("explained"), F.lit(error).alias("identity_error"),
    )
