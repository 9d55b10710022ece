"""SimHash near-deduplication by deletion variants.

A 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints
that differ in at most two bits have a segment that differs in at most one, so
they share a variant of it: the segment with one bit taken out. Every distinct
fingerprint is indexed under its 2 x 32 variants, equal variants meet by their
key, and each bucket is verified on the whole fingerprint.

A bucket never gives its pairs. It is reduced in its task to links that
connect what is connected (a star per component), found by neighbouring rows
in small buckets and by looking up the few masks that two members can differ
in where it is large; both are linear in the bucket. Segments shared by more
than ``hot`` fingerprints are not indexed: their fingerprints' neighbours are
written out and joined by equality on whole fingerprints, which are unique.

Defined results: null text has no words; a text without words has fingerprint
zero; a null id counts as larger than any other and is returned as null; rows
with one id are one document; an empty table gives no rows.

``similar_links`` is for a similarity instead of two bits. Fingerprints are
candidates when they share a variant of one of several segments. A segment is
as wide as the counted rows need for buckets of a constant size, and wider
segments are more of them, so that the recall stays. Inside a bucket a row meets
another only if the sizes of their word sets, their fingerprints and their
sketches (one bit of the least hash in each of 64 classes) allow the
similarity, and if the parities of 256 classes of the sets do: these differ in
no more bits than the sets in members, so they never part similar rows. A pair
that meets in several buckets counts in the first of them. First, by half of the
segments, each row goes on with the one that most rows of a bucket meet (in a
crowded bucket with the head of its crowd), over all its buckets with the
greatest of these and the nearest, and the pair is verified on the whole sets.
What this connects needs no more comparing: a second round does the same by all
segments with rows of other components only. In the last round whatever still
meets across components is verified, every pair: no candidate is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan.llm.graph import components
from shelfscan.llm.scratch import in_small_batches, tidied, utf8, written

SEED = 42
SHINGLE = 3
BITS = 2
SEGMENT = 32
#: a segment value with more fingerprints than this is joined by whole neighbours
HOT = 65_536
#: buckets up to this size are compared row by row, larger ones by masks
SMALL = 48


def _shingle_hashes(text: bytes, shingle: int) -> list[int]:
    """XXH64 of every run of ``shingle`` words; of the whole line where there are no more words than that."""
    words = text.lower().split()
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(line, SEED)]
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-shingle])]
    return [digest(line[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :])]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the shingles' XXH64; 0 for a text without words."""
    if not text.split():
        return 0
    hashes = _shingle_hashes(text, shingle)
    ones = np.zeros(64, np.int64)
    packed = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(packed), 8192):
        ones += np.unpackbits(packed[at : at + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(shingle: int):
    def prints_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, shingle) for t in utf8(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return prints_of


def _segments_of(fp: np.ndarray, part: int) -> np.ndarray:
    return (fp >> np.uint64(SEGMENT * part)) & np.uint64(0xFFFFFFFF)


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp) for the indexed segments of each fingerprint: part, bit taken out, other bits."""
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        parts = batch.column("part").to_numpy()
        for part in (0, 1):
            own = fp[parts == part]
            for at in range(0, len(own), 8192):
                some = own[at : at + 8192]
                seg = _segments_of(some, part)
                keys = np.concatenate([(seg & ~np.uint64(1 << b)) | np.uint64((part << 5 | b) << 32) for b in range(SEGMENT)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(np.tile(some, SEGMENT).view(np.int64))], names=["key", "fp"]
                )


def _masks(part: int, bit: int | None = None) -> np.ndarray:
    """Differences of at most two bits, at most one of them in ``part``; zero is left out.

    With ``bit``, those that two members of the bucket without that bit can
    have. Members with equal segments share all 32 buckets of it, so they are
    looked at in the one of bit 0 only.
    """
    inside = set(range(SEGMENT * part, SEGMENT * (part + 1)))
    out = []
    for bits in [(b,) for b in range(64)] + list(combinations(range(64), BITS)):
        own = inside.intersection(bits)
        if len(own) <= 1 and (bit is None or own == {SEGMENT * part + bit} or (bit == 0 and not own)):
            out.append(sum(1 << b for b in bits))
    return np.array(out, np.uint64)


_MASKS = {part: _masks(part) for part in (0, 1)}
_MASKS_AT = {(part, bit): _masks(part, bit) for part in (0, 1) for bit in range(SEGMENT)}


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same components: each node with its component's smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        np.minimum.at(new, label, new)  # a root follows the smallest label its members have seen
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _linked(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links inside buckets; rows are sorted by (key, fp)."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    size_of = np.repeat(sizes, sizes)
    left, right = [], []
    small = size_of <= SMALL
    for step in range(1, SMALL):
        i = np.flatnonzero(small[:-step] & (size_of[:-step] > step) & (key[:-step] == key[step:]))
        if not len(i):
            break
        close = np.bitwise_count(fp[i] ^ fp[i + step]) <= BITS
        left.append(fp[i[close]])
        right.append(fp[i[close] + step])
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        own = np.unique(fp[s : s + n])
        for mask in _MASKS_AT[int(key[s]) >> 37, int(key[s]) >> 32 & 31]:
            there = own ^ mask
            at = np.minimum(np.searchsorted(own, there), len(own) - 1)
            hit = (own[at] == there) & (there > own)
            left.append(own[hit])
            right.append(there[hit])
    if not left:
        return fp[:0], fp[:0]
    return _stars(np.concatenate(left), np.concatenate(right))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of whole buckets; rows come sorted by key, a bucket may span batches."""
    key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def out(k, f):
        order = np.lexsort((f, k))
        a, b = _linked(k[order], f[order])
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        key = np.concatenate([key, batch.column("key").to_numpy()])
        fp = np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
        if not len(key):
            continue
        done = int(np.searchsorted(key, key[-1], "left"))
        if done:
            yield out(key[:done], fp[:done])
            key, fp = key[done:], fp[done:]
    if len(key):
        yield out(key, fp)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, other) for every fingerprint within reach of a hot segment's."""
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        parts = batch.column("part").to_numpy()
        for part in (0, 1):
            own = fp[parts == part]
            for at in range(0, len(own), 512):
                some = own[at : at + 512]
                other = (some[:, None] ^ _MASKS[part][None, :]).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(some, len(_MASKS[part])).view(np.int64)), pa.array(other.view(np.int64))], names=["fp", "other"]
                )


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every document; fp is the fingerprint as a signed long."""
    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) that connect every pair within two bits."""
    part = F.explode(F.array(F.lit(0), F.lit(1))).alias("part")
    halves = prints.select("fp", part).withColumn("half", F.expr(f"shiftright(fp, {SEGMENT} * part) & 4294967295"))
    crowded = halves.groupBy("part", "half").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot)
    marked = halves.join(crowded, ["part", "half"], "left")
    indexed = marked.where("n is null").select("fp", "part").mapInArrow(_variants, "key long, fp long")
    found = indexed.repartition("key").sortWithinPartitions("key").mapInArrow(_verify, "a long, b long")
    spread = marked.where("n is not null").select("fp", "part").mapInArrow(_neighbours, "fp long, other long")
    direct = spread.join(prints.select(F.col("fp").alias("other")), "other").select(F.col("fp").alias("a"), F.col("other").alias("b"))
    return found.union(direct)


def near_groups(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id) per document; component_id is the smallest doc_id reachable over links."""
    prints = written(fingerprints(docs), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints-distinct")
    roots = components(links(distinct.select("fp"), hot))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """The rows of ``docs`` that are their group's smallest id, columns unchanged; rows without an id stay."""
    gone = near_groups(docs, hot).where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


#: shingles of the similarity, and its least value
WORDS = 5
LEAST = 0.8
#: most bits in which fingerprints and sketches of candidates differ
NEAR_BITS = 12
SKETCH_BITS = 18
#: rows of a bucket that chance alone brings together, the least width of a segment, and what the segments are planned for:
#: the share of pairs found that differ in ``PLANNED_BITS`` of 64
CHANCE_ROWS = 128
LEAST_WIDTH = 12
PLANNED_BITS = 8
RECALL = 0.985
#: rows of a bucket beyond which rows meet heads instead of each other
CROWD = 2048

#: parity words of 64 classes each
ODDS = ("odd0", "odd1", "odd2", "odd3")

_NEAR_COLUMNS = ("doc_id", "fp", "sketch", "size", "label", *ODDS)
_NEAR_SCHEMA = "doc_id long, fp long, sketch long, size int, label long, " + ", ".join(f"{c} long" for c in ODDS)


def planned_segments(rows: int) -> tuple[int, int]:
    """(width, number) of segments for so many rows; a pair ``PLANNED_BITS`` apart shares a variant with a chance of ``RECALL``."""
    width = min(32, max(LEAST_WIDTH, 1 + math.ceil(math.log2(max(rows, 1) / CHANCE_ROWS))))
    apart = PLANNED_BITS / 64
    one = (1 - apart) ** width + width * apart * (1 - apart) ** (width - 1)
    return width, math.ceil(math.log(1 - RECALL) / math.log(1 - one))


def _segment(fp: np.ndarray, part: int, width: int, segments: int) -> np.ndarray:
    """``width`` bits of each fingerprint; the parts start at even distances and go round the end."""
    at = np.uint64(part * 64 // segments)
    turned = (fp >> at) | (fp << ((np.uint64(64) - at) & np.uint64(63))) if at else fp
    return turned & np.uint64((1 << width) - 1)


def _spread(width: int, segments: int, parts: range):
    """(key, ...) of every variant of the segments in ``parts``."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                some = batch.slice(at, 8192)
                fp = some.column("fp").to_numpy().view(np.uint64)
                for part in parts:
                    seg = _segment(fp, part, width, segments)
                    for b in range(width):
                        key = (seg & ~np.uint64(1 << b)) | np.uint64((part << 6 | b) << 48)
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(some.column(n) for n in _NEAR_COLUMNS)], names=["key", *_NEAR_COLUMNS])

    return spread


class _Rows:
    """Columns of whole buckets' rows, and how far rows are from each other."""

    def __init__(self, key: np.ndarray, columns: list[np.ndarray], width: int, segments: int, bits: int, least: float):
        self.doc, fp, sketch, self.size, self.label, *odds = columns
        self.fp, self.sketch, self.odds = fp.view(np.uint64), sketch.view(np.uint64), [o.view(np.uint64) for o in odds]
        self.part, self.bit = key >> 54, key >> 48 & 63
        self.width, self.segments, self.bits, self.least = width, segments, bits, least

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bits in which the sketches differ, 255 where the rows cannot be similar or are of one component; x and y broadcast."""
        far = np.bitwise_count(self.sketch[x] ^ self.sketch[y])
        size_x, size_y = self.size[x], self.size[y]
        ok = (np.bitwise_count(self.fp[x] ^ self.fp[y]) <= self.bits) & (far <= SKETCH_BITS) & (self.label[x] != self.label[y])
        ok &= np.minimum(size_x, size_y) >= self.least * np.maximum(size_x, size_y)
        far = np.where(ok, far, np.uint8(255))
        at = np.nonzero(ok)
        x, y = (np.broadcast_to(rows, ok.shape)[at] for rows in (x, y))
        unlike = sum(np.bitwise_count(o[x] ^ o[y]).astype(np.int64) for o in self.odds)
        # of so many members in all, similar sets differ in no more than this many
        allowed = (1 - self.least) / (1 + self.least) * (self.size[x].astype(np.int64) + self.size[y]) + 1e-6
        far[at] = np.where(unlike <= allowed, far[at], np.uint8(255))
        return far

    def first(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the rows of a pair, both in one bucket, meet in no earlier one."""
        unlike = self.fp[x] ^ self.fp[y]
        part = self.part[x]
        out = np.ones(len(x), bool)
        for p in range(self.segments):
            own = _segment(unlike, p, self.width, self.segments)
            out &= ~((part > p) & (np.bitwise_count(own) <= 1)) & ~((part == p) & (own == 0) & (self.bit[x] > 0))
        return out


def _best_of(rows: _Rows, own: np.ndarray, all_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, neighbour, rows that the neighbour meets, its mean distance to them) for each row of ``own`` that meets any of ``all_rows``; then (row, one of ``own``) for the others that are met.

    A row's neighbour is the one that meets the most, of these the nearest to
    its own neighbours: the text that copies were made from is similar to all
    of them, when they are hardly similar to each other.
    """
    step = max(1, 1_000_000 // len(all_rows))
    parts = [own[at : at + step] for at in range(0, len(own), step)]
    sums, counts = np.zeros(len(all_rows)), np.zeros(len(all_rows), np.int64)
    met_by = np.full(len(all_rows), -1)
    for some in parts:
        far = rows.apart(some[:, None], all_rows[None, :])
        near = far < 255
        sums += np.where(near, far, 0).sum(axis=0)
        counts += near.sum(axis=0)
        new = (met_by < 0) & near.any(axis=0)
        met_by[new] = some[near[:, new].argmax(axis=0)]
    mean = sums / np.maximum(counts, 1)
    central = np.empty(len(all_rows), np.int64)
    central[np.lexsort((rows.doc[all_rows], mean, -counts))] = np.arange(len(all_rows))
    none = len(all_rows)
    left, at = [], []
    for some in parts:
        order = np.where(rows.apart(some[:, None], all_rows[None, :]) < 255, central[None, :], none)
        best = order.argmin(axis=1)
        meets = order[np.arange(len(some)), best] < none
        left.append(some[meets])
        at.append(best[meets])
    left, at = np.concatenate(left), np.concatenate(at)
    others = (met_by >= 0) & ~np.isin(all_rows, own)
    return left, all_rows[at], counts[at], mean[at], all_rows[others], met_by[others]


def _to_heads(rows: _Rows, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, head, rows of the head, mean distance to it) of a crowded bucket: the row in the middle of a crowd heads all that can be similar to it, then the rest goes on; then the rows that found no head."""
    found = [[own[:0]], [own[:0]], [own[:0]], [np.zeros(0)]]
    whole = own
    while len(own) > CROWD:
        near = own[rows.apart(own[:1], own) < 255]
        if not len(near):
            own = own[1:]
            continue
        ones = np.unpackbits(rows.sketch[near].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0)
        middle = np.frombuffer(np.packbits(2 * ones > len(near)).tobytes(), ">u8").astype(np.uint64)[0]
        head = near[np.bitwise_count(rows.sketch[near] ^ middle).argmin()]
        far = rows.apart(np.array([head]), own)
        members, far = own[far < 255], far[far < 255]
        for to, part in zip(found, (members, np.full(len(members), head), np.full(len(members), len(members)), np.full(len(members), far.mean() if len(members) else 0.0))):
            to.append(part)
        gone = np.isin(own, members) | (own == head)
        gone[0] = True
        own = own[~gone]
    if len(own):
        for to, part in zip(found, _best_of(rows, own, own)):
            to.append(part)
    left, right, counts, means = map(np.concatenate, found)
    return left, right, counts, means, whole[~np.isin(whole, left)]


#: what a row goes on with in a bucket: its neighbour, its neighbour in another component, or all in others
_HUB, _OTHER, _REST = "hub", "other", "rest"


def _candidates(width: int, segments: int, bits: int, least: float, how: str):
    """(a, b, met, far, mean): candidates of row a inside whole buckets; rows come sorted by key, a bucket may span batches.

    ``met`` counts the rows that b meets in the bucket, ``far`` is the distance,
    ``mean`` b's own mean distance. A pair is given in the first bucket of its
    rows, so every row that meets any gives one. b is a for a row that meets
    others and goes on with none.
    """

    def batch_of(rows: _Rows, x, y, met, means) -> pa.RecordBatch:
        far = np.bitwise_count(rows.sketch[x] ^ rows.sketch[y]).astype(np.int32)
        columns = [rows.doc[x], rows.doc[y], met.astype(np.int64), far, means.astype(np.float64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "met", "far", "mean"])

    def small_pairs(key: np.ndarray, rows: _Rows, small: np.ndarray, size_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y, far = [key[:0]], [key[:0]], [np.zeros(0, np.uint8)]
        for step in range(1, SMALL):
            i = np.flatnonzero(small[:-step] & (size_of[:-step] > step) & (key[:-step] == key[step:]))
            if not len(i):
                break
            own = rows.apart(i, i + step)
            x.append(i[own < 255])
            y.append(x[-1] + step)
            far.append(own[own < 255])
        return np.concatenate(x), np.concatenate(y), np.concatenate(far)

    def rest_of(rows: _Rows, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Every pair of a large bucket, each once."""
        names, place, counts = np.unique(rows.label[own], return_inverse=True, return_counts=True)
        largest = place == counts.argmax()
        order = np.concatenate([own[~largest], own[largest]])
        asking = len(own) - counts.max()
        step = max(1, 1_000_000 // len(own))
        for at in range(0, asking, step):
            some = order[at : min(at + step, asking)]
            i, j = np.nonzero(rows.apart(some[:, None], order[None, at:]) < 255)
            i, j = i[j > i], j[j > i]
            yield some[i], order[at + j]

    def out(key, columns):
        rows = _Rows(key, columns, width, segments, bits, least)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        size_of = np.repeat(sizes, sizes)
        x, y, far = small_pairs(key, rows, size_of <= SMALL, size_of)
        large = [np.arange(s, s + n) for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist())]
        if how == _REST:
            for x, y in chain([(x, y)], *(rest_of(rows, own) for own in large)):
                new = rows.first(x, y)
                if new.any():
                    yield batch_of(rows, x[new], y[new], np.zeros(new.sum()), np.zeros(new.sum()))
            return
        x, y, far = np.r_[x, y], np.r_[y, x], np.r_[far, far]
        met = np.bincount(y, minlength=len(key))
        mean = np.bincount(y, far, minlength=len(key)) / np.maximum(met, 1)
        order = np.lexsort((rows.doc[y], mean[y], -met[y], x))
        picked = order[np.r_[True, x[order][1:] != x[order][:-1]]] if len(x) else order
        found = [[x[picked]], [y[picked]], [met[y[picked]]], [mean[y[picked]]]]
        alone = []
        for own in large:
            if how == _HUB and len(own) > CROWD:
                *best, marked = _to_heads(rows, own)
                alone.append(marked)
            elif how == _HUB:
                best = _best_of(rows, own, own)[:4]
            else:
                names, place, counts = np.unique(rows.label[own], return_inverse=True, return_counts=True)
                if len(names) == 1:
                    continue
                *best, marked, by = _best_of(rows, own[place != counts.argmax()], own)
                alone.append(marked[rows.first(marked, by)])
            for to, part in zip(found, best):
                to.append(part)
        x, y, met, means = map(np.concatenate, found)
        new = rows.first(x, y)
        yield batch_of(rows, x[new], y[new], met[new], means[new])
        if alone:
            alone = np.unique(np.concatenate(alone))
            yield batch_of(rows, alone, alone, np.zeros(len(alone)), np.zeros(len(alone)))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            new = [batch.column(n).to_numpy() for n in ("key", *_NEAR_COLUMNS)]
            held = new if held is None else [np.concatenate(c) for c in zip(held, new)]
            done = int(np.searchsorted(held[0], held[0][-1], "left")) if len(held[0]) else 0
            if done:
                yield from out(held[0][:done], [c[:done] for c in held[1:]])
                held = [c[done:] for c in held]
        if held is not None and len(held[0]):
            yield from out(held[0], held[1:])

    return candidates


def _close(rows: list[tuple[DataFrame, range]], width: int, segments: int, bits: int, least: float, how: str) -> DataFrame:
    """(a, b) of candidates; ``rows`` are tables of rows, each with the parts by which they are to meet. b is a for a row that meets others and goes on with none."""
    schema = f"key long, {_NEAR_SCHEMA}"
    spread = reduce(DataFrame.union, [r.select(*_NEAR_COLUMNS).mapInArrow(tidied(_spread(width, segments, parts)), schema) for r, parts in rows])
    sorted_rows = spread.repartition("key").sortWithinPartitions("key")
    pairs = sorted_rows.mapInArrow(tidied(_candidates(width, segments, bits, least, how)), "a long, b long, met long, far int, mean double")
    if how != _REST:  # over all its buckets a row goes on with the one that meets the most, and with the nearest
        alone = F.col("a") == F.col("b")
        most, near = F.min_by("b", F.struct(alone, -F.col("met"), "mean", "b")), F.min_by("b", F.struct(alone, "far", "mean", "b"))
        pairs = pairs.groupBy("a").agg(F.array(most, near).alias("both")).select("a", F.explode("both").alias("b"))
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def word_set(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of a text's runs of ``words`` words."""
    return np.unique(np.array(_shingle_hashes(text, words), np.uint64))


def sketch(own: np.ndarray) -> int:
    """One bit of the least hash in each of 64 classes of the set; 0 for a class without any."""
    mixed = own * np.uint64(0x9E3779B97F4A7C15)
    least = np.full(64, np.uint64(0), np.uint64)
    order = np.argsort(mixed, kind="stable")[::-1]
    least[(own[order] & np.uint64(63)).astype(np.int64)] = mixed[order]  # the last written is the least
    return int.from_bytes(np.packbits((least >> np.uint64(20) & np.uint64(1)).astype(np.uint8)).tobytes(), "big")


def parities(own: np.ndarray) -> np.ndarray:
    """For each of 256 classes of the set whether its members are odd in number; sets differ in at least as many members as these in bits."""
    counts = np.bincount((own * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(56)).astype(np.int64), minlength=64 * len(ODDS))
    return np.packbits(counts & 1 > 0).view(np.uint64)


def _near_prints(shingle: int, words: int):
    def prints_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in utf8(batch.column("text")):
                own = word_set(text, words)
                rows.append((fingerprint(text, shingle), sketch(own), len(own), parities(own)))
            fp, sketches, sizes, odds = zip(*rows) if rows else ((), (), (), ())
            odds = np.array(odds, np.uint64).reshape(-1, len(ODDS)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(np.array(sketches, np.uint64).view(np.int64)),
                    pa.array(np.array(sizes, np.int32)), batch.column("doc_id"), *(pa.array(odds[:, k]) for k in range(len(ODDS))),
                ],
                names=list(_NEAR_COLUMNS),
            )

    return prints_of


def _sets(words: int):
    """(doc_id, own) of each row: its set of word runs."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                own = [word_set(t, words).view(np.int64) for t in utf8(some.column("text"))]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(own, pa.list_(pa.int64()))], names=["doc_id", "own"])

    return sets


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    joined = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("own").alias("y")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("own").alias("x")), "a")
    both = F.size(F.array_intersect("x", "y"))
    return joined.where(both >= least * (F.size("x") + F.size("y") - both)).select("a", "b").distinct()


def similar_links(docs: DataFrame, words: int = WORDS, least: float = LEAST, bits: int = NEAR_BITS, shingle: int = SHINGLE) -> DataFrame:
    """(a, b): ids of similar documents that connect what the candidates connect. Runs jobs while the result is planned."""
    texts = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    prints = written(texts.mapInArrow(tidied(_near_prints(shingle, words)), _NEAR_SCHEMA).distinct(), "near-prints")
    width, segments = planned_segments(prints.count())
    early, late = range(0, -(-segments // 2)), range(-(-segments // 2), segments)

    def sets_of(pairs: DataFrame) -> DataFrame:
        # written, so that Spark knows its size and shuffles no texts for a short list
        ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "near-ids")
        return written(texts.join(ids, "doc_id", "left_semi").mapInArrow(tidied(_sets(words)), "doc_id long, own array<long>"), "near-sets")

    def labelled(met: DataFrame, links: DataFrame) -> DataFrame:
        roots = components(links).withColumnRenamed("node", "doc_id")
        ids = met.select(F.col("a").alias("doc_id")).union(met.select("b")).distinct().withColumn("met", F.lit(True))
        joined = prints.drop("label").join(roots, "doc_id", "left").withColumn("label", F.coalesce("root", "doc_id")).join(ids, "doc_id", "left")
        return written(joined.select(*_NEAR_COLUMNS, F.coalesce("met", F.lit(False)).alias("met")), "near-labelled")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where("a <> b")
        return written(_similar(pairs, sets_of(pairs), least), "near-found")

    first = written(_close([(prints, early)], width, segments, bits, least, _HUB), "near-first")
    found = verified(first)
    rows = labelled(first, found)
    # who met nobody by the early parts has nobody there
    second = written(_close([(rows, late), (rows.where("met"), early)], width, segments, bits, least, _OTHER), "near-second")
    found = found.union(verified(second.join(first, ["a", "b"], "left_anti")))
    # nor has who met nobody of another component by all parts
    rows = labelled(second, found).where("met")
    rest = written(_close([(rows, range(segments))], width, segments, bits, least, _REST), "near-rest")
    return found.union(verified(rest.join(first.union(second), ["a", "b"], "left_anti")))


def drop_similar(docs: DataFrame, words: int = WORDS, least: float = LEAST, bits: int = NEAR_BITS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of those connected by similarity, columns unchanged; rows without an id stay."""
    gone = components(similar_links(docs, words, least, bits, shingle)).where("node <> root").select(F.col("node").alias("gone_id"))
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
