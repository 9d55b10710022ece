"""Candidate retrieval for whole batches of queries: lexical, dense, substring."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cached_property, reduce

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan.functions.ranking import top_hits
from shelfscan.functions.text import tokens
from shelfscan.operators.cells import fit_centres, flat, in_line, nearest_cells, probe_count, unit
from shelfscan.operators.index import DOCUMENT, term_counts
from shelfscan.session import cut_lineage, in_small_batches, tidied

# Similarities held at once: a block of documents times this many queries.
QUERY_SLICE = 256
# Rows of one side that meet in one task of the grid.
BLOCK_DOCS = 8192
BLOCK_QUERIES = 2048
# Most queries that are sent to the documents instead of meeting them block by block.
CHUNK_QUERIES = 4096
# Bytes of a packed block's vectors as doubles, and the rows below which a block is not made smaller for the sake of more tasks.
PACKED_BYTES = 8 << 20
PACKED_LEAST = 2048
# Pairs whose exact scores are made at once.
EXACT_PAIRS = 65_536
# Sums of gains or similarities that are held at once, and (query, term) rows of one lexical pass.
BLOCK_SUMS = 1_000_000
CHUNK_TERMS = 2_000_000
# Cells that the approximate search looks into, as a share of a power of all cells.
PROBE_SHARE = 1.6
# Substring search: characters of a needle's anchor, and of the needles of one pass.
ANCHOR_CHARS = 24
CHUNK_CHARS = 4_000_000


_HIT_SCHEMA = "query_id string, product_id string, score double"

# Which of a block's documents a query may retrieve, from the query's wishes and the documents' facts.
Allow = Callable[[tuple, pd.DataFrame], np.ndarray]


def _allowed(allow: Allow | None, wants: Sequence[str], asked: Sequence[tuple], facts: pd.DataFrame) -> list | None:
    """Per query, which of a block's documents it may retrieve; equal wishes are looked at once."""
    if allow is None:
        return None
    known: dict[str, np.ndarray] = {}
    return [known[a] if (a := repr(w)) in known else known.setdefault(a, allow(w, facts)) for w in asked]


class _TopK:
    """Best ``k`` of what one task has seen, per query; equal scores by smaller id. ``floor`` is what a newcomer must reach."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.k, self.floor = k, np.full(queries, -np.inf) if floor is None else floor.copy()
        self._parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._held, self._limit = 0, 4 * k * max(queries, 1) + 50_000

    def add(self, scores: np.ndarray, ids: np.ndarray, ok: np.ndarray) -> None:
        """``scores`` and ``ok`` have a row per document of ``ids`` and a column per query."""
        ok = ok & (scores >= self.floor)
        if len(ids) > self.k:  # more than k of one block can only come in through ties
            ranked = np.where(ok, scores, -np.inf)
            ok &= scores >= np.partition(ranked, len(ids) - self.k, axis=0)[len(ids) - self.k]
        at, query = np.nonzero(ok)
        self.add_pairs(query, ids[at], scores[at, query])

    def add_pairs(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(query):
            self._parts.append((query, ids, scores))
            self._held += len(query)
            if self._held > self._limit:
                self.cut()

    def cut(self) -> None:
        """Let go of what is not among the best, and raise the floors."""
        if not self._parts:
            return
        rows = pd.DataFrame(dict(zip(("q", "product_id", "score"), map(np.concatenate, zip(*self._parts)))))
        rows = rows.sort_values(["q", "score", "product_id"], ascending=[True, False, True])
        rows = rows[rows.groupby("q", sort=False).cumcount() < self.k]
        least = rows.groupby("q")["score"].agg(["min", "size"])
        full = least[least["size"] == self.k]
        self.floor[full.index.to_numpy()] = full["min"].to_numpy()
        self._parts, self._held = [tuple(rows[c].to_numpy() for c in ("q", "product_id", "score"))], len(rows)

    def hits(self, query_ids: np.ndarray) -> Iterator[pd.DataFrame]:
        if self._parts:
            self.cut()
            query, ids, scores = self._parts[0]
            yield pd.DataFrame({"query_id": query_ids[query], "product_id": ids, "score": scores})


# ── lexical ──────────────────────────────────────────────────────────────


def query_terms(queries: DataFrame, text: str = "query") -> DataFrame:
    """Distinct (query_id, term)."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))


class _Batch:
    """What a task needs to score documents for a batch of queries: which queries hold a term, and the term's weight."""

    def __init__(self, rows: list, counts: dict[str, int], n: int, total: int, wants: Sequence[str], k1: float, b: float):
        self.ids = np.array([r["query_id"] for r in rows], dtype=object)
        self.asked = [tuple(r[w] for w in wants) for r in rows]
        places: dict[str, list[int]] = {}
        for i, r in enumerate(rows):
            for term in r["terms"] or ():
                if term in counts:
                    places.setdefault(term, []).append(i)
        self.term = {t: i for i, t in enumerate(places)}
        df = np.array([counts[t] for t in places], float)
        self.idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        self.holders = np.array([q for own in places.values() for q in own], np.int64)
        self.first = np.cumsum([0, *map(len, places.values())])
        self.mean, self.k1, self.b = (total / n if n else 1.0), k1, b

    def entries(self, texts: Iterable[Sequence[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, gain) of the batch's terms in tokenised texts."""
        doc, term, tf, length = [], [], [], []
        for i, words in enumerate(texts):
            own = [t for w in words if (t := self.term.get(w)) is not None]
            if own:
                found, n = np.unique(own, return_counts=True)
                doc.append(np.full(len(found), i))
                term.append(found)
                tf.append(n)
                length.append(np.full(len(found), len(words)))
        if not doc:
            return (np.zeros(0, np.int64),) * 3
        doc, term, tf, length = map(np.concatenate, (doc, term, tf, length))
        gain = self.idf[term] * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.mean))
        return doc, term, gain

    def blocks(self, n_docs: int, doc: np.ndarray, term: np.ndarray, gain: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first document, scores) of blocks of documents, a column per query; the size follows from the sums to be made."""
        held = self.first[term + 1] - self.first[term]
        per_doc = np.bincount(doc, held, minlength=n_docs) + len(self.ids)
        block = (np.cumsum(per_doc) // BLOCK_SUMS).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if n_docs else np.zeros(0, np.int64)
        for first, last in zip(starts.tolist(), [*starts[1:].tolist(), n_docs]):
            a, z = np.searchsorted(doc, first), np.searchsorted(doc, last)
            n = held[a:z]
            at = np.repeat(self.first[term[a:z]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if z > a else np.zeros(0, np.int64)
            cell = np.repeat(doc[a:z] - first, n) * len(self.ids) + self.holders[at]
            yield first, np.bincount(cell, np.repeat(gain[a:z], n), minlength=(last - first) * len(self.ids)).reshape(last - first, len(self.ids))


def _lexical_scan(shared, k: int, wants: Sequence[str], allow: Allow | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch = shared.value
        best = _TopK(len(batch.ids), k)
        for pdf in batches:
            ids = pdf["product_id"].to_numpy(dtype=object)
            allowed = _allowed(allow, wants, batch.asked, pdf)
            for first, scores in batch.blocks(len(pdf), *batch.entries(t.split() for t in pdf["toks"])):
                last = first + len(scores)
                ok = scores > 0
                if allowed is not None:
                    ok &= np.array([a[first:last] for a in allowed], bool).T
                best.add(np.round(scores, 6), ids[first:last], ok)
        yield from best.hits(batch.ids)

    return run


def bm25_topk(
    queries: DataFrame, docs: DataFrame, k: int = 20, query: str = "query", text: str = "searchable_text", k1: float = 1.2, b: float = 0.75,
    wants: Sequence[str] = (), facts: Sequence[str] = (), allow: Allow | None = None, chunk_terms: int = CHUNK_TERMS,
) -> DataFrame:
    """Okapi BM25 top ``k`` per query, straight from the documents: (query_id, product_id, rank, score).

    The documents stay where they are. One pass counts the queries' terms in
    them; a second sums each document's gains for all queries at once and lets
    go on only what reaches the query's floor, the ``k``-th score of the task
    so far. So a term that every document and every query holds makes no row of
    its own, and a task emits at most ``k`` rows per query. Queries come in
    chunks of bounded size; ``allow`` says before the cut which documents a
    query may retrieve, as in :func:`dense_topk`. Looks at the queries and
    counts terms while the result is planned.
    """
    rows = queries.select("query_id", F.array_distinct(tokens(F.col(query))).alias("terms"), *wants).where(F.size("terms") > 0)
    total = rows.agg(F.sum(F.size("terms"))).first()[0] or 0
    n_chunks = max(1, -(-total // chunk_terms))
    dealt = rows.withColumn("_chunk", F.pmod(F.xxhash64("query_id"), F.lit(n_chunks)))
    # as one string, taken apart text by text: lists of words would fill the workers
    toks = in_small_batches(docs).where(F.col(text).isNotNull()).select("product_id", F.array_join(tokens(F.col(text)), " ").alias("toks"), *facts)
    parts = []
    for chunk in range(n_chunks):
        own = dealt.where(F.col("_chunk") == chunk).drop("_chunk")
        asked = own.collect()
        counts = {r["term"]: r for r in term_counts(docs, own.select(F.explode("terms").alias("term")), text).collect()}
        corpus = counts.pop(DOCUMENT, None)
        if asked and corpus:
            batch = _Batch(asked, {t: r["df"] for t, r in counts.items()}, corpus["df"], corpus["length"] or 0, wants, k1, b)
            shared = docs.sparkSession.sparkContext.broadcast(batch)
            parts.append(toks.mapInPandas(tidied(_lexical_scan(shared, k, wants, allow)), _HIT_SCHEMA))
    scores = reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], _HIT_SCHEMA)
    return top_hits(scores, k)


# ── dense ────────────────────────────────────────────────────────────────


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    """Rows of a list column as unit vectors; a zero vector stays zero."""
    rows = np.vstack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 1))
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1.0, norms)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best scores, equal scores by smaller id."""
    if len(scores) <= k:
        return np.arange(len(scores))
    cut = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > cut)
    ties = np.flatnonzero(scores == cut)
    need = k - len(above)
    if len(ties) > need:
        ties = ties[np.argsort(ids[ties], kind="stable")[:need]]
    return np.concatenate([above, ties])


def _block_hits(q_ids, q_mat, d_ids, d_mat, k, skip_self, allowed=None):
    """Best ``k`` of a block of documents for each query of a block.

    ``allowed``: per query, which of the documents it may retrieve.
    """
    out_q, out_d, out_s = [], [], []
    for first in range(0, len(q_ids), QUERY_SLICE):
        sims = np.round(q_mat[first : first + QUERY_SLICE] @ d_mat.T, 6)
        for at, row in enumerate(sims, first):
            qid, ids = q_ids[at], d_ids
            keep = allowed[at] if allowed else None
            if skip_self:
                keep = d_ids != qid if keep is None else keep & (d_ids != qid)
            if keep is not None:
                row, ids = row[keep], d_ids[keep]
            best = _best(row, ids, k)
            out_q.append(np.full(len(best), qid, dtype=object))
            out_d.append(ids[best])
            out_s.append(row[best])
    if not out_q:
        return pd.DataFrame({"query_id": [], "product_id": [], "score": []})
    return pd.DataFrame(
        {"query_id": np.concatenate(out_q), "product_id": np.concatenate(out_d), "score": np.concatenate(out_s)}
    )


def _grid(
    queries: DataFrame, docs: DataFrame, cell: str, k: int, skip_self: bool,
    wants: Sequence[str] = (), facts: Sequence[str] = (), allow: Allow | None = None,
) -> DataFrame:
    """Blocks of documents meet blocks of queries of the same cell.

    The number of blocks of a cell follows from its counted size, so a cell
    with a third of all rows is spread over many tasks and no task holds more
    than about one block of each side. Each pair of blocks emits at most ``k``
    rows per query, never its pairs.
    """

    def blocks(df: DataFrame, rows: int, name: str) -> DataFrame:
        return df.groupBy(cell).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))

    sizes = blocks(docs, BLOCK_DOCS, "n_d").join(blocks(queries, BLOCK_QUERIES, "n_q"), cell)

    def spread(df: DataFrame, id_col: str, extra: Sequence[str], own: str, other: str, own_block: str, other_block: str) -> DataFrame:
        return (
            df.join(sizes, cell)
            .withColumn(own_block, F.pmod(F.xxhash64(id_col), F.col(own)).cast("int"))
            .withColumn(other_block, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            .select(cell, "block_d", "block_q", id_col, "embedding", *extra)
        )

    d = spread(docs, "product_id", facts, "n_d", "n_q", "block_d", "block_q")
    q = spread(queries, "query_id", wants, "n_q", "n_d", "block_q", "block_d")
    # queries may be the products themselves: fresh columns keep the two sides apart
    q = q.select(*[F.col(c).alias(c) for c in q.columns])

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "product_id": [], "score": []})
        allowed = _allowed(allow, wants, list(left[list(wants)].itertuples(index=False, name=None)) if allow else (), right)
        return _block_hits(
            left["query_id"].to_numpy(dtype=object), _matrix(left["embedding"]),
            right["product_id"].to_numpy(dtype=object), _matrix(right["embedding"]), k, skip_self, allowed,
        )

    keys = [cell, "block_d", "block_q"]
    return q.groupBy(*keys).cogroup(d.groupBy(*keys)).applyInPandas(meet, _HIT_SCHEMA)


def _scan(queries: list, docs: DataFrame, k: int, skip_self: bool, wants: Sequence[str], facts: Sequence[str], allow: Allow | None) -> DataFrame:
    """Best ``k`` of every task's documents per query; the documents stay where they are, the queries go to them."""
    asked = [tuple(q[w] for w in wants) for q in queries]
    shared = docs.sparkSession.sparkContext.broadcast(
        (np.array([q["query_id"] for q in queries], dtype=object), _matrix([q["embedding"] for q in queries]), asked)
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q_mat, wishes = shared.value
        best = _TopK(len(q_ids), k)
        column = {q: i for i, q in enumerate(q_ids)} if skip_self else {}
        step = max(1, BLOCK_SUMS // max(1, len(q_ids)))
        for pdf in batches:
            ids, mat = pdf["product_id"].to_numpy(dtype=object), _matrix(pdf["embedding"])
            allowed = _allowed(allow, wants, wishes, pdf)
            for first in range(0, len(pdf), step):
                last = min(first + step, len(pdf))
                ok = np.ones((last - first, len(q_ids)), bool) if allowed is None else np.array([a[first:last] for a in allowed], bool).T.copy()
                for at in range(first, last) if column else ():
                    if ids[at] in column:
                        ok[at - first, column[ids[at]]] = False
                best.add(np.round(mat[first:last] @ q_mat.T, 6), ids[first:last], ok)
        yield from best.hits(q_ids)

    rows = in_small_batches(docs).where(F.col("embedding").isNotNull()).select("product_id", "embedding", *facts)
    return rows.mapInPandas(tidied(run), _HIT_SCHEMA)


def visits(queries: DataFrame, docs: DataFrame, floors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(query_id, cell): cells that can hold a document as good as the query's floor.

    No member of a cell is nearer to a query than the angle to the centre less
    the widest angle of a member. Scores are compared after rounding, so the
    bound has a margin of two digits of it. ``dense_topk`` asks the same of
    every block of queries and cell (``_Docs.bounds``) and makes no such rows.
    """
    reach = docs.groupBy("cell").agg(F.acos(F.min("cosine")).alias("reach"))
    angles = nearest_cells(queries.select("query_id", "embedding"), centres, len(centres)).select("query_id", "cell", F.acos("cosine").alias("angle"))
    bound = F.cos(F.greatest(F.lit(0.0), F.col("angle") - F.col("reach"))) + 2e-6
    return (
        angles.join(reach, "cell").join(floors, "query_id", "left").where(F.col("floor").isNull() | (bound >= F.col("floor"))).select("query_id", "cell")
    )


def _to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _of_bytes(blob: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(blob.as_buffer()).read_all()


def _struct_rows(table: pa.Table, column: str) -> pd.DataFrame | None:
    return pa.Table.from_struct_array(table[column]).to_pandas() if column in table.column_names else None


class _Vectors:
    """Ids and vectors of a packed block: unit vectors, and near ones in single precision that tell what cannot be among the best."""

    def __init__(self, table: pa.Table):
        self.ids = table["id"].to_numpy(zero_copy_only=False)
        self.unit = unit(flat(table["embedding"]).astype(np.float64))
        self.near = self.unit.astype(np.float32)


class _Asked(_Vectors):
    """Queries of a packed block, with the floors of their lists and their wishes."""

    def __init__(self, table: pa.Table):
        super().__init__(table)
        self.floor = table["floor"].to_numpy() if "floor" in table.column_names else None
        wishes = _struct_rows(table, "wants")
        self.wishes = list(wishes.itertuples(index=False, name=None)) if wishes is not None else [()] * len(self.ids)


class _Docs(_Vectors):
    """Documents of a packed block, in the order of their cells."""

    def __init__(self, table: pa.Table):
        super().__init__(table)
        cell = table["cell"].to_numpy()
        self.starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        self.ends = np.r_[self.starts[1:], len(cell)]
        self.cells = cell[self.starts]
        self.reach = np.arccos(np.clip(np.minimum.reduceat(table["cosine"].to_numpy(), self.starts), -1, 1))
        facts = _struct_rows(table, "facts")
        self.facts = pd.DataFrame(index=range(len(self.ids))) if facts is None else facts

    @cached_property
    def most_of_an_id(self) -> int:
        return int(pd.Series(self.ids).value_counts(dropna=False).max())

    def bounds(self, asked: _Asked, directions: np.ndarray) -> np.ndarray:
        """What no member's score exceeds: a row per query, a column per cell; as in :func:`visits`."""
        angle = np.arccos(np.clip(asked.unit @ directions[self.cells].T, -1, 1))
        return np.cos(np.maximum(0.0, angle - self.reach)) + 2e-6


def _exact(asked: _Asked, docs: _Docs, query: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Scores of pairs, rounded."""
    parts = [np.einsum("ij,ij->i", asked.unit[query[at : at + EXACT_PAIRS]], docs.unit[doc[at : at + EXACT_PAIRS]]) for at in range(0, len(query), EXACT_PAIRS)]
    return np.round(np.concatenate(parts), 6)


def _meet(best: _TopK, asked: _Asked, docs: _Docs, need: np.ndarray, skip_self: bool, allowed: list | None) -> None:
    """Compare queries with the cells of a block of documents that ``need`` names, a row per query and a column per cell.

    Products in single precision leave out what is below the floor by more
    than their error; the others get their exact scores.
    """
    slack = 6e-7 + (asked.unit.shape[1] + 8) * 2.0**-24
    for column, (first, last) in enumerate(zip(docs.starts.tolist(), docs.ends.tolist())):
        rows = np.flatnonzero(need[:, column])
        step = max(1, BLOCK_SUMS // (last - first))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            sims = asked.near[some] @ docs.near[first:last].T
            if allowed is not None:
                sims[~np.array([allowed[q][first:last] for q in some], bool)] = -np.inf
            least = np.maximum(best.floor[some] - slack, -2.0)
            with_some = np.flatnonzero(sims.max(axis=1) >= least)  # mostly few, and a row's largest is found sooner than its places
            if not len(with_some):
                continue
            some, sims, least = some[with_some], sims[with_some], least[with_some]
            close = np.flatnonzero(sims >= least[:, None].astype(np.float32))
            enough = best.k + (docs.most_of_an_id if skip_self else 0)
            if len(close) > 4 * enough * len(some) and last - first > enough:  # floors are low or missing: the cell's own best are one
                ranked = np.partition(sims, last - first - enough, axis=1)[:, last - first - enough]
                close = np.flatnonzero(sims >= np.maximum(least, ranked - 2 * slack)[:, None].astype(np.float32))
            query, doc = np.divmod(close, last - first)
            query, doc = some[query], doc + first
            if skip_self:
                other = docs.ids[doc] != asked.ids[query]
                query, doc = query[other], doc[other]
            if len(query):
                scores = _exact(asked, docs, query, doc)
                kept = scores >= best.floor[query]
                best.add_pairs(query[kept], docs.ids[doc[kept]], scores[kept])


def _first_of_equals(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that can be among a query's best ``k`` with the query itself left out: of equal vectors, those with the smallest ids."""
    if not vectors.shape[1]:
        return np.arange(len(ids))
    rows = pd.DataFrame({"id": ids, "v": np.unique(np.ascontiguousarray(vectors).view(f"V{vectors.shape[1] * vectors.itemsize}").ravel(), return_inverse=True)[1]})
    rows = rows.sort_values(["v", "id"], kind="stable")
    most = rows.groupby(["v", "id"], sort=False, dropna=False)["id"].transform("size").groupby(rows["v"]).transform("max")
    return np.sort(rows.index[(rows.groupby("v", sort=False).cumcount() < k + most).to_numpy()].to_numpy())


def _pack(shared, k: int, skip_self: bool, allow: Allow | None, wants: Sequence[str]):
    """First round: a block's queries meet its own documents, which gives their floors; both go on as one row."""

    def packed(own: pa.Table, directions: np.ndarray) -> tuple[bytes | None, bytes | None]:
        vectors = flat(own["embedding"])
        own = own.filter(pa.array(~np.isnan(unit(vectors.astype(np.float64))).any(axis=1)))  # such rows have no score
        asked, docs = (own.filter(pc.equal(own["asks"], x)).select([c for c in own.column_names if c not in {"block", "asks", "facts" if x else "wants"}]) for x in (True, False))
        docs = docs.sort_by("cell")
        if allow is None and docs.num_rows:
            docs = docs.take(_first_of_equals(docs["id"].to_numpy(zero_copy_only=False), flat(docs["embedding"]), k))
        if asked.num_rows:
            cells, queries = asked["cell"].to_numpy(), _Asked(asked)
            best = _TopK(len(cells), k)
            if docs.num_rows:
                block = _Docs(docs)
                allowed = _allowed(allow, wants, queries.wishes, block.facts)
                at_home = cells[:, None] == block.cells
                _meet(best, queries, block, at_home, skip_self, allowed)
                best.cut()
                _meet(best, queries, block, ~at_home & (block.bounds(queries, directions) >= best.floor[:, None]), skip_self, allowed)
                best.cut()
            asked = asked.drop_columns(["cell", "cosine"]).append_column("floor", pa.array(best.floor))
        return _to_bytes(docs) if docs.num_rows else None, _to_bytes(asked) if asked.num_rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = unit(shared.value)
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            for block in pc.unique(table["block"]):
                blobs = packed(table.filter(pc.equal(table["block"], block)), directions)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in blobs], names=["docs", "asked"])

    return run


def _merged(most: int):
    """Neighbouring small blocks as one of about ``most`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for blob in batch.column(0):
                held.append(_of_bytes(blob))
                if sum(t.num_rows for t in held) >= most:
                    yield pa.RecordBatch.from_arrays([pa.array([_to_bytes(pa.concat_tables(held))], pa.binary())], names=batch.schema.names)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([_to_bytes(pa.concat_tables(held))], pa.binary())], names=batch.schema.names)

    return run


def _second_round(shared, k: int, skip_self: bool, allow: Allow | None, wants: Sequence[str]):
    """Packed queries meet the packed documents that come one by one; what reaches a query's floor comes out at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = unit(shared.value)
        met: dict[int, tuple[_Asked, _TopK]] = {}
        for batch in batches:
            for blob, number, asked in zip(*(batch.column(c) for c in ("docs", "number", "asked"))):
                docs, number = _Docs(_of_bytes(blob)), number.as_py()
                if number not in met:
                    queries = _Asked(_of_bytes(asked))
                    met[number] = queries, _TopK(len(queries.ids), k, queries.floor)
                queries, best = met[number]
                need = docs.bounds(queries, directions) >= best.floor[:, None]
                if need.any():
                    _meet(best, queries, docs, need, skip_self, _allowed(allow, wants, queries.wishes, docs.facts))
        for queries, best in met.values():
            for hits in best.hits(queries.ids):
                yield pa.RecordBatch.from_pandas(hits, pa.schema([("query_id", pa.string()), ("product_id", pa.string()), ("score", pa.float64())]), preserve_index=False)

    return run


def _block_plan(centres: np.ndarray, docs: dict[int, int], asked: dict[int, int], most_docs: int, most_asked: int) -> tuple[list[tuple], int]:
    """(cell, first block, blocks of its documents, blocks of its queries), and the number of blocks.

    Neighbouring cells share a block; a cell with more rows than a block has several of its own.
    """
    plan, blocks, opened, d, q = [], 0, 0, most_docs, most_asked
    for cell in in_line(centres):
        n_d, n_q = docs.get(cell, 0), asked.get(cell, 0)
        parts = max(1, -(-n_d // most_docs)), max(1, -(-n_q // most_asked))
        if max(parts) > 1:
            plan.append((cell, blocks, *parts))
            blocks += max(parts)
        elif n_d or n_q:
            if d + n_d > most_docs or q + n_q > most_asked:
                opened, blocks, d, q = blocks, blocks + 1, 0, 0
            plan.append((cell, opened, 1, 1))
            d, q = d + n_d, q + n_q
    return plan, blocks


def _block_by_block(
    queries: DataFrame, docs: DataFrame, k: int, skip_self: bool, wants: Sequence[str], facts: Sequence[str], allow: Allow | None, block: int | None = None,
) -> DataFrame | None:
    """Best ``k`` of a task's documents per query, for any number of queries; ``None`` if there is nothing to compare.

    Queries and documents are shuffled once, to blocks of neighbouring cells,
    and written once, a row per block. Then every block of queries reads the
    written blocks of documents one after the other, and compares a query with
    the cells that can hold something as good as its floor. So disk grows as
    the rows do, although in data without clusters every pair is compared.
    """
    spark, tasks = docs.sparkSession, 4 * docs.sparkSession.sparkContext.defaultParallelism
    centres = fit_centres(docs, "product_id")
    sides = [nearest_cells(docs.select("product_id", "embedding", *facts), centres), nearest_cells(queries.select("query_id", "embedding", *wants), centres)]
    held = [{r["cell"]: r["count"] for r in side.groupBy("cell").count().collect()} for side in sides]
    rows = [sum(h.values()) for h in held]
    if not all(rows):
        return None
    most = max(1, PACKED_BYTES // (8 * max(1, centres.shape[1])))
    most_docs, most_asked = (block or min(most, max(PACKED_LEAST, -(-n // tasks))) for n in rows)
    plan, blocks = _block_plan(centres, *held, most_docs, most_asked)
    places = F.broadcast(spark.createDataFrame(plan, "cell int, first int, n_docs int, n_asked int"))

    def dealt(side: DataFrame, id_col: str, parts: str, asks: bool) -> DataFrame:
        struct = lambda own, here: F.struct(*own) if here else F.lit(None)
        extra = [struct(own, asks == (name == "wants")).alias(name) for name, own in (("wants", wants), ("facts", facts)) if own]
        number = (F.col("first") + F.pmod(F.xxhash64(id_col), F.col(parts))).cast("int")
        return side.join(places, "cell").select(number.alias("block"), F.lit(asks).alias("asks"), F.col(id_col).alias("id"), "cell", "cosine", "embedding", *extra)

    both = dealt(sides[0], "product_id", "n_docs", False).unionByName(dealt(sides[1], "query_id", "n_asked", True))
    shared = spark.sparkContext.broadcast(centres)
    packed = cut_lineage(both.repartitionById(blocks, "block").mapInArrow(tidied(_pack(shared, k, skip_self, allow, wants)), "docs binary, asked binary"))

    # blocks that the other side has made many are put together again
    full = [-(-n // own) for n, own in zip(rows, (most_docs, most_asked))]
    groups = full[1] if 2 * full[1] < blocks else blocks

    def side(name: str, parts: int, most: int, few: bool) -> DataFrame:
        own = packed.where(F.col(name).isNotNull()).select(F.col(name).alias(name)).coalesce(parts)
        return own.mapInArrow(tidied(_merged(most)), own.schema) if few else own

    asked = side("asked", groups, most_asked, groups < blocks).withColumn("number", F.monotonically_increasing_id())
    read = side("docs", min(blocks, -(-tasks // groups)), most_docs, 2 * full[0] < blocks)
    pairs = read.crossJoin(asked.hint("shuffle_replicate_nl"))
    return pairs.mapInArrow(tidied(_second_round(shared, k, skip_self, allow, wants)), _HIT_SCHEMA)


def dense_topk(
    queries: DataFrame, docs: DataFrame, k: int = 20, skip_self: bool = False,
    wants: Sequence[str] = (), facts: Sequence[str] = (), allow: Allow | None = None, chunk: int = CHUNK_QUERIES, block: int | None = None,
) -> DataFrame:
    """Exact cosine top ``k`` per query: (query_id, product_id, rank, score).

    ``allow`` says before the cut which of a block's documents a query may
    retrieve, from the query's columns ``wants`` and the documents' columns
    ``facts``. A batch of at most ``chunk`` queries is sent to the documents.
    A larger one meets them block by block (of ``block`` rows, if given): each
    query first looks into its nearest cell, which gives a floor for its list,
    and then only into the cells that can still hold something as good. Looks
    at the queries, and makes the first round, while the result is planned.
    """
    rows = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding", *wants)
    few = rows.limit(chunk + 1).collect()
    if few and len(few) <= chunk:
        return top_hits(_scan(few, docs, k, skip_self, wants, facts, allow), k)
    found = _block_by_block(rows, docs, k, skip_self, wants, facts, allow, block) if few else None
    if found is None:
        return docs.sparkSession.createDataFrame([], "query_id string, product_id string, rank int, score double")
    return top_hits(found, k)


def ann_plan(queries: DataFrame, docs: DataFrame, share: float = PROBE_SHARE, **fit) -> tuple[DataFrame, DataFrame]:
    """(probes, assigned): the cells each query looks into, and every document's cell."""
    centres = fit_centres(docs, "product_id", **fit)
    assigned = nearest_cells(docs.select("product_id", "embedding"), centres)
    return nearest_cells(queries.select("query_id", "embedding"), centres, probe_count(len(centres), share)), assigned


def dense_ann(queries: DataFrame, docs: DataFrame, k: int = 20, skip_self: bool = False, share: float = PROBE_SHARE, **fit) -> DataFrame:
    """Approximate cosine top ``k`` by an inverted file: a query is compared with the documents of its nearest cells.

    There are about as many cells as a cell has documents, and the part of them
    that is looked into falls as they become more. Scores are exact and no
    cell is cut short; crowded cells are split by the grid. ``fit`` goes to
    ``fit_centres``.
    """
    probes, assigned = ann_plan(queries, docs, share, **fit)
    return top_hits(_grid(probes, assigned, "cell", k, skip_self), k)


# ── substring ────────────────────────────────────────────────────────────


def _anchor(needle: str) -> str:
    """A gram of the needle that is looked for: all of it, or its middle. A long gram is rarer than any part of it."""
    if len(needle) <= ANCHOR_CHARS:
        return needle
    first = (len(needle) - ANCHOR_CHARS) // 2
    return needle[first : first + ANCHOR_CHARS]


def _needle_chunks(queries: DataFrame, query: str, chunk_chars: int) -> Iterator[list[tuple[str, str]]]:
    """(query_id, needle) in chunks of about ``chunk_chars`` characters, by a hash of the id."""
    rows = queries.filter(F.trim(F.col(query)) != "").select("query_id", F.col(query).alias("needle"))
    total = rows.agg(F.sum(F.length("needle"))).first()[0] or 0
    n = -(-total // chunk_chars)
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(max(n, 1))))
    for k in range(n):
        yield [(r["query_id"], r["needle"]) for r in dealt.where(F.col("chunk") == k).select("query_id", "needle").collect()]


def _find(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        needles = shared.value
        by_anchor: dict[str, list[int]] = {}
        for i, (_, needle) in enumerate(needles):
            by_anchor.setdefault(_anchor(needle), []).append(i)
        automaton = ahocorasick.Automaton()
        for anchor, own in by_anchor.items():
            automaton.add_word(anchor, own)
        automaton.make_automaton()
        for pdf in batches:
            out_q, out_d = [], []
            for product, body in zip(pdf["product_id"], pdf["body"]):
                candidates = {i for _, own in automaton.iter(body) for i in own}
                found = [needles[i][0] for i in candidates if needles[i][1] in body]
                out_q += found
                out_d += [product] * len(found)
            yield pd.DataFrame({"query_id": out_q, "product_id": out_d}, dtype=object)

    return run


def keyword_contains(
    queries: DataFrame, docs: DataFrame, k: int = 20, query: str = "query", text: str = "searchable_text", chunk_chars: int = CHUNK_CHARS
) -> DataFrame:
    """Documents holding the query text as a case-sensitive substring, by id.

    The texts stay where they are. One Aho-Corasick pass over a text finds all
    needles' anchors, grams of up to ``ANCHOR_CHARS`` characters, and a needle whose
    anchor is there is looked for in the same text. Needles come in chunks of
    bounded size, each one pass over the texts. Blank queries match nothing
    (the query policy rejects them). Looks at the queries while the result is
    planned.
    """
    bodies = docs.where(F.col(text).isNotNull()).select("product_id", F.col(text).alias("body"))
    context = docs.sparkSession.sparkContext
    parts = [
        bodies.mapInPandas(_find(context.broadcast(chunk)), "query_id string, product_id string")
        for chunk in _needle_chunks(queries, query, chunk_chars) if chunk
    ]
    found = reduce(DataFrame.union, parts) if parts else bodies.sparkSession.createDataFrame([], "query_id string, product_id string")
    return top_hits(found.withColumn("score", F.lit(1.0)), k)
