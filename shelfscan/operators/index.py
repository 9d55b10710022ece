"""Keyword and vector indexes as ordinary tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from shelfscan.functions.text import tokens
from shelfscan.session import cut_lineage, in_small_batches, tidied
from shelfscan.sources.bucketed import BUCKETS, BucketedTable

Encoder = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def document_frequency(postings: DataFrame) -> DataFrame:
    """Documents per term, combined in the map tasks before the shuffle."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def tokenized(docs: DataFrame, text: str = "searchable_text", id_col: str = "product_id") -> DataFrame:
    """(product_id, toks, dl): whole texts, never a prefix."""
    return docs.select(F.col(id_col).alias("product_id"), tokens(F.col(text)).alias("toks")).withColumn(
        "dl", F.size("toks")
    )


# A term no text can hold: its posting stands for the document itself.
DOCUMENT = ""


def token_rows(docs: DataFrame, text: str = "searchable_text", distinct: bool = False, document_rows: bool = False) -> DataFrame:
    """(product_id, dl, term), one row per token or per distinct token.

    The outer explode keeps Spark from inferring a "has tokens" filter below
    the scan, which would tokenise every text again; the NULL rows of empty
    texts are dropped here.
    """
    toks = F.array_distinct("toks") if distinct else F.col("toks")
    if document_rows:
        toks = F.array_append(toks, F.lit(DOCUMENT))
    rows = tokenized(docs, text).select("product_id", "dl", F.explode_outer(toks).alias("term"))
    return rows.filter(F.col("term").isNotNull())


def postings(docs: DataFrame, text: str = "searchable_text") -> DataFrame:
    """(product_id, dl, term, tf): repeats are combined in the map tasks before the shuffle."""
    return _counted(token_rows(docs, text))


def term_counts(docs: DataFrame, terms: DataFrame, text: str = "searchable_text") -> DataFrame:
    """(term, df, length) of the listed terms: documents that hold each; the row of ``DOCUMENT`` counts all, with their tokens.

    Counted in the map tasks; the texts are not shuffled.
    """
    doc_row = terms.sparkSession.range(1).select(F.lit(DOCUMENT).alias("term"))
    wanted = terms.select("term").distinct().union(doc_row)
    rows = token_rows(docs.where(F.col(text).isNotNull()), text, distinct=True, document_rows=True).join(wanted, "term", "left_semi")
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("length"))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("product_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_stats(docs: DataFrame, text: str = "searchable_text") -> DataFrame:
    """(product_id, dl): what length normalisation needs."""
    return tokenized(docs, text).select("product_id", "dl")


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: number of documents and their average length."""
    return lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def index_stats(index: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row: documents, terms, postings, average and longest document."""
    per_term = document_frequency(index)
    terms = per_term.agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings"))
    docs = lengths.agg(
        F.count(F.lit(1)).alias("documents"),
        F.round(F.avg("dl"), 6).alias("avg_length"),
        F.max("dl").alias("max_length"),
    )
    counted = terms.select(F.struct("terms", "postings")).scalar()
    return docs.select("*", counted["terms"].alias("terms"), counted["postings"].alias("postings"))


def vector_stats(vectors: DataFrame) -> DataFrame:
    """One row: vectors, vectors that are NULL, and their least and largest dimension."""
    size = F.when(F.col("embedding").isNotNull(), F.size("embedding"))
    return vectors.agg(
        F.count(F.lit(1)).alias("vectors"), F.count_if(F.col("embedding").isNull()).alias("missing"),
        F.min(size).alias("least_dimension"), F.max(size).alias("largest_dimension"),
    )


def snapshot_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows that differ between two snapshots, as insert / update / delete.

    Both sides are reduced to (key, payload hash) before the full join, so
    only narrow rows are shuffled.
    """
    payload = sorted({*old.columns, *new.columns} - {key})  # a column that one side lacks is NULL there

    def hashed(df: DataFrame, name: str) -> DataFrame:
        # Spark's hashes skip NULLs, so each cell goes in with its NULL flag;
        # two different hashes make a missed update practically impossible
        own = [F.col(c) if c in df.columns else F.lit(None).cast("string") for c in payload]
        cells = [x for c in own for x in (c, c.isNull())]
        return df.select(key, F.struct(F.xxhash64(*cells), F.hash(*cells)).alias(name))

    change = (
        F.when(F.col("_old").isNull(), "insert")
        .when(F.col("_new").isNull(), "delete")
        .when(F.col("_old") != F.col("_new"), "update")
    )
    return (
        hashed(old, "_old")
        .join(hashed(new, "_new"), key, "full_outer")
        .select(key, change.alias("change_type"))
        .filter(F.col("change_type").isNotNull())
    )


# Characters of the texts that become postings in one task.
SHARE_CHARS = 16_000_000
_STORED = "product_id string, dl int, term string, tf long"


class StoredIndex:
    """Postings kept as a table in buckets of the document ids; a refresh rewrites the buckets it touches.

    Raw counts and lengths are stored, never idf, so an index that was
    refreshed equals one that was built anew.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.table = BucketedTable(spark, folder, _STORED, "product_id", buckets)

    def _shares(self, docs: DataFrame, text: str) -> int:
        """Partitions a bucket, for texts of about ``SHARE_CHARS`` characters in each; counts the characters."""
        chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
        return max(1, -(-chars // (self.table.buckets * SHARE_CHARS)))

    def build(self, docs: DataFrame, text: str = "searchable_text") -> None:
        """The first version, from all documents."""
        # the texts are dealt, not their postings, which are several times as large
        dealt = self.table.dealt(docs.select("product_id", text), self._shares(docs, text))
        self.table.replace(postings(dealt, text).select("product_id", "dl", "term", "tf"), list(range(self.table.buckets)), self.table.latest() + 1, in_place=True)

    def refresh(self, new_docs: DataFrame, changes: DataFrame, text: str = "searchable_text") -> list[int]:
        """The next version after ``changes`` (product_id, change_type); returns the buckets that were written."""
        changes = cut_lineage(changes.select("product_id", "change_type"))
        touched = self.table.touched(changes)
        if touched:
            version, shares = self.table.latest(), self._shares(new_docs, text)
            deal = lambda rows: self.table.dealt(rows, shares)
            old = deal(self.table.read(version, touched))
            rows = refresh_postings(old, new_docs, changes, text, deal)
            self.table.replace(rows.select("product_id", "dl", "term", "tf"), touched, version + 1, in_place=True)
        return touched

    def postings(self) -> DataFrame:
        return self.table.read()


def refresh_postings(
    old_index: DataFrame, new_docs: DataFrame, changes: DataFrame, text: str = "searchable_text", deal: Callable[[DataFrame], DataFrame] = lambda rows: rows
) -> DataFrame:
    """Index after a change set: touched documents are tokenised again, the rest kept.

    Raw tf and lengths are stored, never idf, so the result equals a rebuild.
    ``deal`` partitions the changed texts by their id before they become postings.
    """
    touched = changes.select("product_id", "change_type")
    kept = old_index.join(touched.select("product_id"), "product_id", "left_anti")
    live = touched.filter(F.col("change_type") != "delete").select("product_id")
    rebuilt = postings(deal(new_docs.select("product_id", text).join(live, "product_id", "left_semi")), text)
    return kept.unionByName(rebuilt)


# Vectors of one batch that a task returns.
BLOCK_VECTORS = 2048


def _hashed(dim: int):
    """Unit vectors of signed counts of the words in ``_terms``: MD5 gives each term its place (first four bytes) and its sign (the fifth)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places: dict[str, tuple[int, int]] = {}
            for at in range(0, batch.num_rows, BLOCK_VECTORS):
                some = batch.slice(at, BLOCK_VECTORS)
                vectors = np.zeros((some.num_rows, dim), np.float32)
                for i, own in enumerate(some.column("_terms").to_pylist()):
                    counts = np.zeros(dim)
                    for term in own.split() if own is not None else ():
                        place = places.get(term)
                        if place is None:
                            digest = hashlib.md5(term.encode()).digest()
                            place = places[term] = int.from_bytes(digest[:4], "big") % dim, -1 if digest[4] & 1 else 1
                        counts[place[0]] += place[1]
                    vectors[i] = counts / (np.sqrt(counts @ counts) or 1.0)
                lists = pa.ListArray.from_arrays(np.arange(len(vectors) + 1, dtype=np.int32) * dim, pa.array(vectors.ravel()))
                kept = some.drop_columns(["_terms"])
                yield pa.RecordBatch.from_arrays([*kept.columns, lists], names=[*kept.schema.names, "embedding"])

    return run


def embed(
    docs: DataFrame, text: str = "searchable_text", id_col: str = "product_id", dim: int = 256, encoder: Encoder | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """(id, embedding) and the columns to ``keep``: unit-length vectors of whole texts.

    Default: signed feature hashing of a text's distinct terms. Nothing is
    fitted, so queries and documents can be encoded apart, in any batch. A text
    without terms has the zero vector. ``encoder`` is a function for
    ``mapInPandas`` from (product_id, text) batches to (product_id, embedding).
    """
    if encoder is not None:
        rows = in_small_batches(docs).select(F.col(id_col).alias("product_id"), F.col(text).alias("text"))
        encoded = rows.mapInPandas(encoder, "product_id string, embedding array<float>").withColumnRenamed("product_id", id_col)
        return encoded.join(docs.select(id_col, *keep), id_col) if keep else encoded
    # the terms as one string, taken apart text by text: lists of words would fill the workers
    terms = F.array_join(F.array_distinct(tokens(F.col(text))), " ")
    rows = in_small_batches(docs).select(id_col, *keep, terms.alias("_terms"))
    schema = StructType([*rows.drop("_terms").schema.fields, StructField("embedding", ArrayType(FloatType()))])
    return rows.mapInArrow(tidied(_hashed(dim)), schema).select(id_col, "embedding", *keep)


def l2_norm(vec: Column) -> Column:
    """Euclidean length of an array column."""
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
