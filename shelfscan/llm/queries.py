"""The operators' registered queries: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscan.llm import bpe, chat, decontaminate, divergence, exact, html_text, licenses, lines, packing, simhash, toxicity, urls, whitening
from shelfscan.sources.readers import read_table

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words hit in every document."""
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def licence_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source / language / thousand of the id, some of them higher up.

    The table has no paths. A document that closes with a licence line stands
    for the licence file of its directory.
    """
    ones = F.pmod(F.col("doc_id"), F.lit(10))
    language, thousand = F.when(ones > 0, F.col("lang")), F.when(ones > 1, F.floor(F.col("doc_id") / 1000).cast("string"))
    path = F.concat_ws("/", "source", language, thousand, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    closing = F.element_at(F.split("text", "\n"), -1).rlike(licenses.STATEMENT) & F.contains("text", F.lit("\n"))
    return docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text", closing.alias("is_licence_file"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's licence, its own or its directories'."""
    return licenses.scan(licence_files(_table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts and the document that stays."""
    return exact.exact_groups(_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_groups(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted conversations, read back from the output."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), says.alias("text")
    )
    parsed = chat.parse_conversations(chat.format_conversations(rows.union(extra)))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.col("masked")
    return chat.with_masked_text(parsed).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def page_outcomes(labels: DataFrame) -> DataFrame:
    """(page_id, bad): the label row that carries a page's id; toxic or of low quality is bad."""
    return labels.select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return urls.judge(_table(spark, sf_dir, "pages"), page_outcomes(_table(spark, sf_dir, "labels")))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier one has."""
    out = lines.drop_repeated_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, and the text they decode to."""
    out = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), tokenizer_path()), tokenizer_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between sources of a language, and the terms each has more of."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on up to 32 whitened components."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_licenses, op3_html_text, op4_exact_dedup, op5_simhash, op6_chat, op7_urls, op8_pack, op9_toxicity, op10_lines,
        op11_bpe, op12_divergence, op13_whitening,
    )
}
