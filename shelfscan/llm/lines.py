"""Line deduplication with two Bloom filters.

1. Lines' hashes are dealt into shards; a map task sends each hash once per
   batch, with a mark if several documents of the batch hold it, so a line of
   every page stays small. A shard keeps two Bloom filters: hashes seen once,
   and hashes seen again. Those that hit the second are suspected. The number
   of shards comes from the counted lines, so a filter has a fixed size.
2. Suspected hashes meet their documents by (hash, doc_id). Only suspected
   lines are written with their text.
3. The exact confirmation compares whole keys: the smallest and largest
   document of each key, aggregated in the map tasks first.
4. Lines to drop meet their documents by id.

No join has a hot key on both sides; nothing is broadcast or collected.

Defined results: null or empty text is one empty line; rows with the same id
are one document (each keeps its own lines); a null id counts as larger than
any other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan.llm.scratch import in_small_batches, utf8, written

LEAST = 10
#: lines of one shard, and slots of each of its filters (a power of two)
SHARD_LINES = 2_000_000
SLOTS = 1 << 24
PROBES = 3
#: lines whose equal hashes a map task merges
DEALT = 500_000
_SPACE = b" \t\n\x0b\x0c\r"
#: a document is its id and whether it has none; those without are one document, after all others
_DOC = ["lone", "doc_id"]


def key_of(line: bytes) -> bytes:
    """A line stripped of white space at both ends, A-Z in lower case (bytes know no other letters)."""
    return line.strip(_SPACE).lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode()) >= least)


def _keys(text: bytes, least: int) -> dict[bytes, None]:
    return {k: None for k in map(key_of, text.split(b"\n")) if _long_enough(k, least)}


def _hash(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key)


def _slots(hashes: np.ndarray) -> list[np.ndarray]:
    """The slots of each hash, from its two halves."""
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32) | np.uint64(1)
    return [((low + np.uint64(i) * high) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(PROBES)]


def _dealt(hashes: np.ndarray, lone: np.ndarray, docs: np.ndarray, shards: int) -> pa.RecordBatch:
    order = np.lexsort((docs, lone, hashes))
    hashes, lone, docs = hashes[order], lone[order], docs[order]
    starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
    lasts = np.r_[starts[1:], len(hashes)] - 1 if len(starts) else starts
    several = (docs[starts] != docs[lasts]) | (lone[starts] != lone[lasts])
    hashes = hashes[starts]
    shard = (hashes >> np.uint64(20)) % np.uint64(shards)
    rows = [(int(s), hashes[shard == s].tobytes(), np.packbits(several[shard == s]).tobytes()) for s in np.unique(shard)]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
        names=["shard", "hashes", "several"],
    )


def _deal(shards: int, least: int):
    """Hashes by shard, each once per ``DEALT`` lines, marked if several documents hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64))
        held = [[x] for x in none]
        for batch in batches:
            own = [np.fromiter(map(_hash, _keys(t, least)), np.uint64) for t in utf8(batch.column("text"))]
            held[0].extend(own)
            for to, c in zip(held[1:], _DOC):
                to.append(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), [len(h) for h in own]))
            if sum(map(len, held[2])) >= DEALT:
                yield _dealt(*map(np.concatenate, held), shards)
                held = [[x] for x in none]
        yield _dealt(*map(np.concatenate, held), shards)

    return run


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suspected hashes of each shard; rows come sorted by shard, so one pair of filters is open at a time."""
    once, twice, seen, open_shard = None, None, [], None

    def close() -> pa.RecordBatch:
        again = [h[np.logical_and.reduce([twice[s] for s in _slots(h)])] for h in seen]
        return pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(again)).view(np.int64))], names=["hash"])

    for batch in batches:
        for shard, raw, marks in zip(*(batch.column(n).to_pylist() for n in ("shard", "hashes", "several"))):
            if shard != open_shard:
                if seen:
                    yield close()
                once, twice, seen, open_shard = np.zeros(SLOTS, bool), np.zeros(SLOTS, bool), [], shard
            hashes = np.frombuffer(raw, np.uint64)
            slots = _slots(hashes)
            again = np.logical_and.reduce([once[s] for s in slots])
            again |= np.unpackbits(np.frombuffer(marks, np.uint8), count=len(hashes)).astype(bool)
            for s in slots:
                twice[s[again]] = True
                once[s] = True
            seen.append(hashes)
    if seen:
        yield close()


def _pairs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.fromiter(map(_hash, _keys(t, least)), np.uint64) for t in utf8(batch.column("text"))]
            at = pa.array(np.repeat(np.arange(len(own)), [len(h) for h in own]))
            hashes = np.concatenate([*own, np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in _DOC), pa.array(hashes.view(np.int64))], names=[*_DOC, "hash"])

    return run


def _suspected_lines(least: int):
    """(lone, doc_id, key) of the lines whose hash is suspected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys = [], []
            for i, text, hashes in zip(range(batch.num_rows), utf8(batch.column("text")), batch.column("hashes").to_pylist()):
                if hashes:
                    suspected = set(hashes)
                    found = [k for k in _keys(text, least) if np.uint64(_hash(k)).view(np.int64).item() in suspected]
                    at.extend([i] * len(found))
                    keys.extend(k.decode() for k in found)
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in _DOC), pa.array(keys, pa.string())], names=[*_DOC, "key"])

    return run


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        totals, dropped, kept = [], [], []
        for text, gone in zip(utf8(batch.column("text")), batch.column("gone").to_pylist()):
            lines = text.split(b"\n")
            totals.append(len(lines))
            if gone:
                keys = {k.encode() for k in gone}
                stay = [x for x in lines if key_of(x) not in keys]
                text = b"\n".join(stay)
                lines = stay
            dropped.append(totals[-1] - len(lines))
            kept.append(text.decode())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in _DOC), pa.array(totals, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())],
            names=[*_DOC, "n_lines", "n_dropped", "kept"],
        )


def repeated_lines(docs: DataFrame, least: int = LEAST, shard_lines: int = SHARD_LINES) -> DataFrame:
    """(lone, doc_id, key): lines that a document (lone, doc_id) loses, as keys."""
    rows = docs.select(*_DOC, "text")
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    lines = rows.agg(F.sum(n_lines)).first()[0] or 0
    shards = max(1, -(-lines // shard_lines))
    dealt = rows.mapInArrow(_deal(shards, least), "shard int, hashes binary, several binary")
    suspects = dealt.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_suspects, "hash long")
    pairs = rows.mapInArrow(_pairs(least), "lone boolean, doc_id long, hash long")
    suspected = pairs.join(suspects, "hash", "left_semi").groupBy(*_DOC).agg(F.collect_set("hash").alias("hashes"))
    texts = rows.join(suspected, _DOC)
    found = written(texts.mapInArrow(_suspected_lines(least), "lone boolean, doc_id long, key string"), "suspected-lines")
    doc = F.struct(*_DOC)
    repeated = found.groupBy("key").agg(F.min(doc).alias("keeper"), F.max(doc).alias("last")).where("last > keeper")
    # a written side is a plain exchange for the join, so Spark can split a line that fills a task
    return found.join(written(repeated, "repeated-lines"), "key").where(doc > F.col("keeper")).select(*_DOC, "key")


def drop_repeated_lines(docs: DataFrame, least: int = LEAST, shard_lines: int = SHARD_LINES) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept), one row per row of ``docs``."""
    doc = F.col("doc_id").cast("long")
    rows = in_small_batches(docs).select(doc.isNull().alias("lone"), F.coalesce(doc, F.lit(0)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    gone = repeated_lines(rows, least, shard_lines).groupBy(*_DOC).agg(F.collect_set("key").alias("gone"))
    out = rows.join(gone, _DOC, "left").mapInArrow(_drop, "lone boolean, doc_id long, n_lines long, n_dropped long, kept string")
    return out.select(F.when(~F.col("lone"), F.col("doc_id")).alias("doc_id"), "n_lines", "n_dropped", "kept")
