"""Retrieval queries: lexical, dense, fused, related, substring."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfscan.operators import cells, index, retrieval, search
from shelfscan.plans.registry import register
from shelfscan.plans.relevance import bm25_hits, dense_hits
from shelfscan.session import scratch_path
from shelfscan.sources.fixtures import Tables


@register("bm25_topk", "SELECT query_id, product_id, rank, score FROM v_bm25_hits")
def bm25_topk(t: Tables):
    """R3."""
    return bm25_hits(t)


@register("dense_topk", "SELECT query_id, product_id, rank, score FROM v_dense_hits")
def dense_topk(t: Tables):
    """R1."""
    return dense_hits(t)


def fitted_cells(rounds: int = cells.ROUNDS) -> str:
    """Checking side of the inverted file: centres as whole-number vectors, fitted in rounds of exact sums."""
    near = "list_dot_product(q, centre) / greatest(sqrt(list_dot_product(centre, centre)), 1)"
    out = f"""v AS (SELECT product_id AS id, embedding, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {cells.GRID})) AS q FROM v_vec_products WHERE embedding IS NOT NULL),
    size AS (SELECT CAST(greatest(1, ceil(sqrt(count(*)))) AS INT) AS c FROM v),
    sample AS (SELECT id, q, row_number() OVER (ORDER BY md5(id), id) AS r FROM v QUALIFY r <= greatest({cells.SAMPLE}, (SELECT c FROM size))),
    c0 AS (SELECT CAST(r - 1 AS INT) AS cell, q AS centre FROM sample WHERE r <= (SELECT c FROM size)),"""
    for i in range(rounds):
        out += f"""
    a{i} AS (SELECT id, q, cell FROM sample, c{i} QUALIFY row_number() OVER (PARTITION BY id ORDER BY {near} DESC, cell) = 1),
    s{i} AS (SELECT cell, d, sum(q[d]) AS s FROM (SELECT cell, q, unnest(range(1, len(q) + 1)) AS d FROM a{i}) GROUP BY ALL),
    c{i + 1} AS (SELECT cell, list(s ORDER BY d) AS centre FROM s{i} GROUP BY cell UNION ALL SELECT cell, centre FROM c{i} WHERE cell NOT IN (SELECT cell FROM s{i})),"""
    return out + f"""
    placed AS (SELECT id, embedding, cell FROM v, c{rounds} QUALIFY row_number() OVER (PARTITION BY id ORDER BY {near} DESC, cell) = 1),
    probes AS (SELECT query_id, embedding, cell FROM (SELECT query_id, embedding, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {cells.GRID})) AS q FROM v_query_vectors), c{rounds}
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {near} DESC, cell) <= (SELECT least(c, greatest(1, ceil({retrieval.PROBE_SHARE}::DOUBLE * pow(c, 0.75)))) FROM size))"""


@register(
    "dense_ann",
    f"""WITH {fitted_cells()}
    SELECT query_id, product_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS INT) AS rank, score
    FROM (SELECT query_id, id AS product_id, round(list_cosine_similarity(CAST(p.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS score FROM probes p JOIN placed d USING (cell))
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) <= 10""",
)
def dense_ann(t: Tables):
    """R2: inverted file over all product vectors."""
    return retrieval.dense_ann(t["v_query_vectors"], t["v_vec_products"], 10)


@register("hybrid_fusion", "SELECT query_id, product_id, rank, score FROM v_hybrid_hits")
def hybrid_fusion(t: Tables):
    """R5, J10, U2."""
    return search.fuse_ranks(dense_hits(t), bm25_hits(t), k=10)


@register(
    "related_items",
    """SELECT * FROM (SELECT query_id, product_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS INT) AS rank, score
      FROM (SELECT CAST(a.vec_id AS STRING) AS query_id, CAST(b.vec_id AS STRING) AS product_id,
              round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
            FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE rank <= 4""",
)
def related_items(t: Tables):
    """Every product against every other, four each."""
    items = t["v_vec_products"]
    return retrieval.dense_topk(items.withColumnRenamed("product_id", "query_id"), items, 4, skip_self=True)


@register(
    "keyword_contains",
    """SELECT query_id, product_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY product_id) AS INT) AS rank, 1.0::DOUBLE AS score
    FROM v_queries JOIN v_catalog ON contains(searchable_text, base_query)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY product_id) <= 20""",
)
def keyword_contains(t: Tables):
    """R4."""
    return retrieval.keyword_contains(t["v_queries"], t["v_catalog"], 20, query="base_query")


@register(
    "rank_hits",
    """SELECT query_id, product_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS INT) AS rank
    FROM v_bm25_hits""",
)
def rank_hits(t: Tables):
    """W3."""
    return search.rank_hits(bm25_hits(t).select("query_id", "product_id", "score"))


@register(
    "index_stats",
    """SELECT (SELECT count(*) FROM v_doc_tokens) AS documents, (SELECT round(avg(len(toks)), 6) FROM v_doc_tokens) AS avg_length,
      (SELECT CAST(max(len(toks)) AS INT) FROM v_doc_tokens) AS max_length, count(DISTINCT term) AS terms, count(*) AS postings FROM v_postings""",
)
def index_stats(t: Tables):
    """R19."""
    docs = t["v_catalog"]
    return index.index_stats(index.postings(docs), index.document_stats(docs))


@register(
    "vector_stats",
    """SELECT count(*) AS vectors, count(*) FILTER (embedding IS NULL) AS missing, CAST(min(len(embedding)) AS INT) AS least_dimension,
      CAST(max(len(embedding)) AS INT) AS largest_dimension FROM embeddings""",
)
def vector_stats(t: Tables):
    """The vector index."""
    return index.vector_stats(t["v_vec_products"])


def hashed_vectors(rows: str, dim: int = 256) -> str:
    """Checking side of the encoder over rows of (id, body): (id, dim, weight) of every place that is not zero."""
    return rf"""SELECT id, dim, CAST(s / sqrt(sum(s * s) OVER (PARTITION BY id)) AS FLOAT) AS weight FROM (
      SELECT id, CAST(CAST('0x' || substr(h, 1, 8) AS BIGINT) % {dim} AS INT) AS dim, sum(CASE WHEN substr(h, 10, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) AS s
      FROM (SELECT id, md5(unnest(list_distinct(regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}_]+')))) AS h FROM {rows}) GROUP BY ALL) WHERE s <> 0"""


@register(
    "embed_corpus",
    f"""SELECT id AS product_id, dim, round(CAST(weight AS DOUBLE), 6) AS weight FROM ({hashed_vectors("(SELECT product_id AS id, searchable_text AS body FROM v_catalog)")})""",
)
def embed_corpus(t: Tables):
    """Unit vectors of all documents, one row per place that is not zero."""
    places = index.embed(t["v_catalog"]).select("product_id", F.posexplode("embedding").alias("dim", "weight"))
    return places.where("weight <> 0").select("product_id", "dim", F.round(F.col("weight").cast("double"), 6).alias("weight"))


@register(
    "index_refresh",
    """WITH new_docs AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN text || ' refreshed edition' ELSE text END AS text FROM documents WHERE doc_id % 13 <> 0
       UNION ALL SELECT doc_id + 1000000, text FROM documents WHERE doc_id % 13 = 0)
    SELECT product_id, dl, term, CAST(count(*) AS BIGINT) AS tf FROM (
      SELECT CAST(doc_id AS STRING) AS product_id, CAST(len(toks) AS INT) AS dl, unnest(toks) AS term
      FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS toks FROM new_docs)) GROUP BY ALL""".replace("\\\\", "\\"),
)
def index_refresh(t: Tables):
    """A stored index, refreshed by the changes, equals a rebuild from the new documents."""
    old = t["documents"].select(F.col("doc_id").cast("string").alias("product_id"), F.col("text").alias("searchable_text"), "doc_id")
    text = F.when(F.col("doc_id") % 11 == 0, F.concat("searchable_text", F.lit(" refreshed edition"))).otherwise(F.col("searchable_text"))
    kept = old.filter(F.col("doc_id") % 13 != 0).withColumn("searchable_text", text)
    added = old.filter(F.col("doc_id") % 13 == 0).withColumn("product_id", (F.col("doc_id") + 1000000).cast("string"))
    old, new = old.drop("doc_id"), kept.unionByName(added).drop("doc_id")
    stored = index.StoredIndex(t.spark, scratch_path(t.spark, "index"))
    stored.build(old)
    stored.refresh(new, index.snapshot_diff(old, new, "product_id"))
    return stored.postings()
