"""The corpus pipeline: documents in, packed training sequences out.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir) and
returns what stays. All but the last return the columns of ``documents``.
``run`` writes each stage's result as Parquet below the shared folder and reads
it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfscan.llm import decontaminate, exact, packing, simhash, toxicity
from shelfscan.llm.queries import tokenizer_path
from shelfscan.llm.scratch import written
from shelfscan.sources.readers import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon does not reject."""
    return toxicity.drop_toxic(docs, read_table(spark, f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word Jaccard similarity of 0.8."""
    return simhash.drop_similar(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of the test items."""
    return decontaminate.decontaminate(docs, read_table(spark, f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", cut_benchmark),
    ("best-fit packing", pack_sequences),
]

#: the lexicon, the fingerprints' hash and the tokenizer are out of SQL's reach; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-').lower()}")
    return docs
