"""Source divergence audit: how far each source's term distribution is from every other of its language.

Every (lang, source) group is a column over the language's kept terms. The
vocabulary is put in an order that brings equal counts together: by the counts
in the language's largest sources, then by a hash of the whole row of counts.
It is cut into blocks, and a group's column is run-length encoded in each: a
zero run costs one entry, however many terms it covers. Two groups meet block
by block; their run boundaries are intersected, and the distance of the two
values counts once per run, times its length. All arithmetic is on integers:
``p`` is a share of 10⁹, taken from exact decimal quotients.

Columns are never held whole: a block has at most ``BLOCK`` terms, so a source
with a third of all words is as many small columns. Rows per pair of groups
grow with the vocabulary over ``BLOCK``; the pairs themselves are the result.

Defined results: null text, lang and source are empty; documents without terms
still make their group; a language without kept terms has all its pairs with
value 0 and no term rows; repeated rows are documents of their own; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscan.llm.scratch import in_small_batches, tidied, utf8, written

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: documents of a language that hold a kept term
LEAST_DOCS = 30
#: smoothing count of every kept term, and the shares' unit
PRIOR = 5
UNIT = 1_000_000_000
#: terms reported per group
TOP_TERMS = 50
#: positions of a block; a power of two
BLOCK_BITS = 10
BLOCK = 1 << BLOCK_BITS
#: sources of a language whose counts lead the order of its vocabulary
HEADS = 6

#: bytes of a text that are split at once, and terms that a task counts before it hands them on
PIECE = 1 << 20
HELD = 300_000

#: a text's bytes as ``TERM`` sees them: A-Z lower-cased, what no term holds as a space
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _named(docs: DataFrame, *more) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", *more)])


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in pieces of its order, so that no list grows with a long text."""
    folded = text.translate(_FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of the task's rows; a term comes again each time ``HELD`` terms were counted."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            if n:
                terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
                rows = np.fromiter(map(docs.__getitem__, n), np.int64, len(n))
                columns = [pa.repeat(lang, len(n)), pa.repeat(source, len(n)), terms, pa.array(np.fromiter(n.values(), np.int64, len(n))), pa.array(rows)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        groups.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), utf8(batch.column("text"))):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), set()
            for words in _words(text.decode("utf-8", "replace").encode()):  # broken UTF-8 reads as Spark reads it
                n.update(words)
                seen.update(words)
            docs.update(seen)
            held += 1 + len(n) - before
            if held > HELD:
                yield from out()
                held = 0
    yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and rows that hold the term.

    Words are counted where they are read, so a task hands Spark a row per term
    of a group and not one per word.
    """
    rows = in_small_batches(_named(docs, "text"))
    counted = rows.mapInArrow(tidied(_counted), "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def ordered_vocabulary(counts: DataFrame, least_docs: int = LEAST_DOCS, heads: int = HEADS) -> DataFrame:
    """(lang, term, total, block, pos): kept terms, terms of equal counts side by side.

    ``block`` and ``pos`` number the terms of each range partition; written, so
    that a lost task cannot deal them anew.
    """
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    largest = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("size"), "source"))
    led = sizes.select("lang", "source", largest.alias("head")).where(F.col("head") <= heads)
    columns = [f"h{i}" for i in range(heads, 0, -1)]
    own = [F.coalesce(F.sum(F.when(F.col("head") == int(c[1:]), F.col("n"))), F.lit(0)).alias(c) for c in columns]
    kept = (
        counts.join(led, ["lang", "source"], "left")
        .groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("source", "n")).alias("signature"), *own)
        .where(F.col("docs") >= least_docs)
    )
    order = ["lang", *columns, "signature", "term"]
    at = F.monotonically_increasing_id()
    placed = kept.repartitionByRange(*order).sortWithinPartitions(*order).select("lang", "term", "total", at.alias("at"))
    block, pos = F.shiftrightunsigned("at", BLOCK_BITS).alias("block"), F.col("at").bitwiseAND(BLOCK - 1).cast("int").alias("pos")
    return written(placed.select("lang", "term", "total", block, pos), "divergence-vocabulary")


def _share(n, size, terms):
    """1 + floor(UNIT * (n + PRIOR) / (size + PRIOR * terms)), exactly."""
    top = f"(cast({n} as decimal(20,0)) + {PRIOR}) * cast({UNIT} as decimal(10,0))"
    return F.expr(f"1 + (({top}) div (cast({size} as decimal(25,0)) + {PRIOR} * cast({terms} as decimal(20,0))))").cast("long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, block, high, starts, p): the block's column as runs of equal p; absent positions have the group's p of zero."""
    for batch in batches:
        starts, values = [], []
        cells = batch.column("cells").to_pylist()
        lows, highs, zeros = (batch.column(c).to_pylist() for c in ("low", "high", "zero"))
        for low, high, zero, own in zip(lows, highs, zeros, cells):
            column = np.full(high - low, zero, np.int64)
            if own:
                column[np.array([c["pos"] for c in own]) - low] = [c["p"] for c in own]
            first = np.flatnonzero(np.r_[True, column[1:] != column[:-1]]) if len(column) else np.zeros(0, np.int64)
            starts.append((first + low).astype(np.int32))
            values.append(column[first])
        names = ["lang", "source", "block", "high"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array(starts, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int64()))], names=[*names, "starts", "p"]
        )


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, value): the block's share of a pair's distance, one product per run of both columns."""
    for batch in batches:
        columns = [batch.column(c) for c in ("high", "starts_a", "p_a", "starts_b", "p_b")]
        out = np.zeros(batch.num_rows, np.int64)
        for i in range(batch.num_rows):
            high, starts_a, p_a, starts_b, p_b = (c[i].as_py() if k == 0 else c[i].values.to_numpy() for k, c in enumerate(columns))
            if len(starts_a):
                cuts = np.union1d(starts_a, starts_b)
                f = np.abs(p_a[np.searchsorted(starts_a, cuts, "right") - 1] - p_b[np.searchsorted(starts_b, cuts, "right") - 1])
                out[i] = int(f @ np.diff(np.r_[cuts, high]))
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("lang", "a", "b")), pa.array(out)], names=["lang", "a", "b", "value"])


def run_columns(entries: DataFrame, groups: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(lang, source, block, high, starts, p) of every group in every block of its language."""
    blocks = vocabulary.groupBy("lang", "block").agg(F.min("pos").alias("low"), (F.max("pos") + 1).alias("high"))
    empty = groups.select("lang").distinct().join(blocks.select("lang").distinct(), "lang", "left_anti")
    blocks = blocks.unionByName(empty.select("lang", F.lit(0).cast("long").alias("block"), F.lit(0).alias("low"), F.lit(0).alias("high")))
    cells = entries.groupBy("lang", "source", "block").agg(F.collect_list(F.struct("pos", "p")).alias("cells"))
    # a language without terms divides by nothing: its one block is empty
    zero = F.when(F.col("terms") > 0, _share("0", "size", "greatest(terms, 1)")).otherwise(F.lit(0))
    table = groups.select("lang", "source", zero.alias("zero")).join(blocks, "lang").join(cells, ["lang", "source", "block"], "left")
    schema = "lang string, source string, block long, high int, starts array<int>, p array<long>"
    return table.select("lang", "source", "block", "low", "high", "zero", "cells").mapInArrow(_runs, schema)


def pair_distances(columns: DataFrame) -> DataFrame:
    """(lang, a, b, value), a < b: sum of |p_a - p_b| over the language's kept terms."""
    left = columns.select("lang", "block", "high", F.col("source").alias("a"), F.col("starts").alias("starts_a"), F.col("p").alias("p_a"))
    right = columns.select("lang", "block", F.col("source").alias("b"), F.col("starts").alias("starts_b"), F.col("p").alias("p_b"))
    met = left.join(right, ["lang", "block"]).where("a < b").select("lang", "a", "b", "high", "starts_a", "p_a", "starts_b", "p_b")
    parts = met.mapInArrow(_distances, "lang string, a string, b string, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to every other source, and the terms a source has more of than its language.

    Part ``pair`` ranks all other sources of the language by distance, part
    ``term`` the ``top_terms`` terms whose share exceeds the language's. Tables
    in passing are written to the shared folder, so the jobs run while the
    result is planned.
    """
    counts = written(term_counts(docs), "divergence-counts")
    vocabulary = ordered_vocabulary(counts, least_docs)
    cells = written(counts.select("lang", "source", "term", "n").join(vocabulary, ["lang", "term"]), "divergence-cells")
    held = cells.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    languages = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_size"))
    groups = _named(docs).distinct().join(held, ["lang", "source"], "left").join(languages, "lang", "left").fillna(0, ["size", "terms", "lang_size"])
    groups = written(groups, "divergence-groups")
    shared = cells.join(groups, ["lang", "source"]).withColumn("p", _share("n", "size", "terms")).withColumn("q", _share("total", "lang_size", "terms"))
    columns = written(run_columns(shared.select("lang", "source", "block", "pos", "p"), groups, vocabulary), "divergence-runs")
    pairs = pair_distances(columns)
    pairs = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(pairs.select("lang", "b", "a", "value"))
    terms = shared.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top_terms))
