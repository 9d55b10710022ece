"""Exact deduplication by sorting contents.

Rows are range-partitioned by splitters that Spark samples from the normalised
texts (their first code points, then SHA-256 of the whole), sorted within each
partition (Spark's sort spills to disk), and equal texts then lie next to each
other: each row is compared in full with its neighbour. The sort goes on by
length and id, so the row that stays is the first of its run, and a group that
fills a third of the table is cut over many partitions. Groups are these runs;
those at the ends of a partition, which can be parts of one group, meet by
their digest.

Defined results: null text is an empty text; all empty texts are one group; a
null id sorts after every other; of rows equal in text, length and id one
stays; an empty table gives no rows; other columns, whatever their names, are
carried in one struct and never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan.llm.scratch import in_small_batches, other_columns, rows_again, tidied, utf8, written

#: fixed value: the code points that normalisation deletes
SPACE = " \t\n\x0b\x0c\r"
_SPACE = SPACE.encode()
#: code points of a text that the splitters see before its digest decides
LEAD = 32


def normalised(text):
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each run of equal texts; rows come sorted."""
    last_digest, last_text = None, b""
    for batch in batches:
        first = []
        for digest, text in zip(batch.column("digest").to_pylist(), utf8(batch.column("text"))):
            if digest != last_digest:
                first.append(True)
                last_digest, last_text = digest, text
            else:
                first.append(last_text.translate(None, _SPACE) != text.translate(None, _SPACE))
        yield batch.filter(pa.array(first, pa.bool_()))


_RUN_ROWS = "doc_id long, digest string, n_chars long, first boolean, head_id long, head_chars long, size long, edge boolean"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row with what its run says: the run's first row, which stays, and its size; rows come sorted.

    ``edge`` marks the first and the last run of the partition, which may go on
    in another. Ids and lengths of one run are held until it ends.
    """
    names = [f.split()[0] for f in _RUN_ROWS.split(", ")]
    out: list[list] = [[] for _ in names]
    ids: list = []
    chars: list = []
    digest, text, number = None, b"", -1

    def end_run(last: bool) -> None:
        n = len(ids)
        columns = (ids, [digest] * n, chars, [True] + [False] * (n - 1), ids[:1] * n, chars[:1] * n, [n] * n, [last or number == 0] * n)
        for to, own in zip(out, columns):
            to.extend(own)

    def batch_of() -> pa.RecordBatch:
        types = (pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    for batch in batches:
        texts = utf8(batch.column("text"))
        for i, (doc, own, n) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist(), batch.column("n_chars").to_pylist())):
            if own != digest or text.translate(None, _SPACE) != texts[i].translate(None, _SPACE):
                if ids:
                    end_run(False)
                ids, chars, digest, text = [], [], own, texts[i]
                number += 1
            ids.append(doc)
            chars.append(n)
        if len(out[0]) >= 10_000:
            yield batch_of()
            out = [[] for _ in names]
    if ids:
        end_run(True)
    yield batch_of()


def _ordered(docs: DataFrame, row) -> DataFrame:
    """(row, doc_id, digest, n_chars, text) in content order: of equal texts the one that stays comes first."""
    norm = normalised(F.col("text"))
    order = ["lead", "digest", F.desc("n_chars"), F.asc_nulls_last("doc_id")]
    rows = in_small_batches(docs).select(
        row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.sha2(norm, 256).alias("digest"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.substring(norm, 1, LEAD).alias("lead"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("row", "doc_id", "digest", "n_chars", "text")


def _sorted_runs(docs: DataFrame, row, row_type: str) -> DataFrame:
    """(row, doc_id, digest, n_chars, text) of the first row of each run."""
    return _ordered(docs, row).mapInArrow(tidied(_firsts), f"row {row_type}, doc_id long, digest string, n_chars long, text string")


def _groups(runs: DataFrame) -> DataFrame:
    """(digest, group_size, keep_id, keep_chars) from rows or runs."""
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("last"), "doc_id"))
    return runs.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")).select(
        "digest", "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.n")).alias("keep_chars")
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per document.

    ``docs`` has ``doc_id`` and ``text``. A group is a run of the sorted rows.
    Only runs at the ends of a partition can be parts of a larger group; they
    meet by digest, at most two of them per partition, so that table is
    broadcast and no other row is looked at again.
    """
    marked = written(_ordered(docs, F.lit(None).cast("boolean")).drop("row").mapInArrow(tidied(_runs), _RUN_ROWS), "content-sort")
    edges = _groups(marked.where("edge")).withColumnRenamed("digest", "edge_digest").withColumnRenamed("group_size", "edge_size")
    joined = marked.join(F.broadcast(edges), F.col("edge") & (F.col("digest") == F.col("edge_digest")), "left")
    keep_id = F.when(F.col("edge"), F.col("keep_id")).otherwise(F.col("head_id"))
    keep_chars = F.when(F.col("edge"), F.col("keep_chars")).otherwise(F.col("head_chars"))
    kept = F.col("first") & (F.col("n_chars") == keep_chars) & F.col("doc_id").eqNullSafe(keep_id)
    return joined.select(
        "doc_id", keep_id.alias("keep_id"), F.when(F.col("edge"), F.col("edge_size")).otherwise(F.col("size")).alias("group_size"),
        kept.alias("kept"), F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged.

    One row of each run is written; a group cut over partitions has a run in
    each, of which all but one go. Those are at most one per partition, so the
    list of them is broadcast.
    """
    row, kind = other_columns(docs)
    firsts = written(_sorted_runs(docs, row, kind), "content-firsts")
    heads = firsts.select("digest", "n_chars", "doc_id")
    again = heads.groupBy("digest").agg(F.count(F.lit(1)).alias("runs")).where("runs > 1")
    beaten = heads.join(F.broadcast(again), "digest").join(F.broadcast(_groups(heads.join(F.broadcast(again), "digest", "left_semi"))), "digest").where(
        ~((F.col("n_chars") == F.col("keep_chars")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    )
    beaten = beaten.select(F.col("digest").alias("d"), F.col("n_chars").alias("n"), F.col("doc_id").alias("i"))
    same = (F.col("digest") == F.col("d")) & (F.col("n_chars") == F.col("n")) & F.col("doc_id").eqNullSafe(F.col("i"))
    return firsts.join(F.broadcast(beaten), same, "left_anti").transform(rows_again, docs.columns, text=F.col("text"))
