"""Cells of vectors: an inverted file whose centres are whole-number vectors.

Vectors are put on an integer grid, so centres are exact sums and a vector's
cell is the same wherever it is computed. Centres are fitted on a bounded
sample; every vector is assigned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from shelfscan.session import in_small_batches, tidied

# Steps of the grid per unit.
GRID = 1024
# Most vectors that the centres are fitted on, and rounds of fitting.
SAMPLE = 65_536
ROUNDS = 2
# Pairs of a vector and a centre that a task holds at once.
BLOCK = 1_000_000


def cell_count(n: int) -> int:
    """Cells for ``n`` vectors: their square root, so that centres and a cell's members grow alike."""
    return max(1, math.ceil(math.sqrt(n)))


def probe_count(cells: int, share: float) -> int:
    """Cells looked into per query; a falling part of all as they become more."""
    return min(cells, max(1, math.ceil(share * cells ** 0.75)))


def flat(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an Arrow list column in their own type; a missing value is NaN, rows of different lengths are an error."""
    lengths = pc.min_max(pc.list_value_length(column)).as_py()
    if not len(column):
        return np.zeros((0, 1))
    if lengths["min"] != lengths["max"]:
        raise ValueError(f"vectors of different lengths: {lengths['min']} and {lengths['max']}")
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(column), lengths["min"])


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows as unit vectors; a zero vector stays zero."""
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1.0, norms)


def on_grid(rows: np.ndarray) -> np.ndarray:
    """Whole numbers, held as doubles: their dot products are exact below 2⁵³."""
    return np.floor(rows * GRID)


def closeness(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Dot product over the centre's length: orders a row's centres by angle. Every step is correctly rounded."""
    return (rows @ centres.T) / np.maximum(np.sqrt((centres * centres).sum(axis=1)), 1.0)


def fit_centres(vectors: DataFrame, id_col: str, cells: int | None = None, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Centres from a sample in the order of the ids' MD5: its first rows, then sums of their members, round by round.

    Counts the vectors and collects at most ``sample`` of them.
    """
    usable = vectors.where(F.col("embedding").isNotNull())
    cells = cells or cell_count(usable.count())
    chosen = usable.select(F.md5(F.col(id_col)).alias("order"), id_col, "embedding").orderBy("order", id_col).limit(max(sample, cells)).select("embedding").toArrow()
    if not chosen.num_rows:
        return np.zeros((0, 1))
    rows = on_grid(flat(chosen["embedding"]).astype(np.float64))
    centres = rows[:cells].copy()
    for _ in range(rounds):
        own = np.concatenate([closeness(rows[at : at + 4096], centres).argmax(axis=1) for at in range(0, len(rows), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        held = np.bincount(own, minlength=len(centres)) > 0
        centres[held] = sums[held]
    return centres


def in_line(centres: np.ndarray) -> list[int]:
    """All cells, each followed by the nearest that has not come yet."""
    directions, left, order = unit(centres), np.ones(len(centres), bool), []
    at = 0
    while len(order) < len(centres):
        order.append(at)
        left[at] = False
        at = int(np.where(left, directions @ directions[at], -np.inf).argmax())
    return order


def nearest_cells(df: DataFrame, centres: np.ndarray, n: int = 1) -> DataFrame:
    """``df`` with (cell, cosine) of each row's ``n`` nearest cells, one row per cell; rows without a vector are left out.

    ``cosine`` is that of the vector and the cell's centre.
    """
    near = ArrayType(StructType([StructField("cell", IntegerType()), StructField("cosine", DoubleType())]))
    shared = df.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        directions = unit(c)
        step = max(1, BLOCK // max(1, len(c)))
        for batch in batches if len(c) else ():
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                raw = flat(some.column("embedding")).astype(np.float64)
                close = closeness(on_grid(raw), c)
                if n == 1 and not np.isnan(close).any():
                    order = close.argmax(axis=1)[:, None]
                    cosines = np.clip(np.einsum("ij,ij->i", unit(raw), directions[order[:, 0]])[:, None], -1, 1)
                else:
                    order = np.argsort(-close, axis=1, kind="stable")[:, :n]
                    cosines = np.clip(np.take_along_axis(unit(raw) @ directions.T, order, axis=1), -1, 1)
                cells = pa.StructArray.from_arrays([pa.array(order.ravel().astype(np.int32)), pa.array(cosines.ravel())], names=["cell", "cosine"])
                lists = pa.ListArray.from_arrays(np.arange(len(order) + 1, dtype=np.int32) * order.shape[1], cells)
                yield pa.RecordBatch.from_arrays([*some.columns, lists], names=[*some.schema.names, "_near"])

    rows = in_small_batches(df).where(F.col("embedding").isNotNull())
    found = rows.mapInArrow(tidied(run), StructType([*rows.schema.fields, StructField("_near", near)]))
    return found.select(*df.columns, F.inline("_near"))


def comparisons(probes: DataFrame, assigned: DataFrame) -> int:
    """Pairs of a query and a vector that lie in a probed cell."""
    per_cell = probes.groupBy("cell").agg(F.count(F.lit(1)).alias("q")).join(assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("d")), "cell")
    return per_cell.agg(F.sum(F.col("q") * F.col("d"))).first()[0] or 0
