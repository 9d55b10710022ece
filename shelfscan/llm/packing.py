"""Best-fit packing of tokenised documents into sequences, by hierarchical residuals.

Each partition of documents is tokenised and packed on its own, longest piece
first into the fullest bin that takes it. Nearly full bins are finished.
The others go on as single items: their partitions merge in a tree, and each
merged partition packs them again. A round has at most ``bins_per_task`` items
in a task; when a round hardly saves a bin any more, what is left is finished
as it is. Bins carry their pieces, so no join puts the result together.

Defined results: null text is an empty text, whose ids are the end id alone;
only documents longer than a sequence are cut; repeated documents are packed
each for itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan.llm.scratch import in_small_batches, tidied, written

LENGTH = 4096
END_ID = 1
#: a bin with at most this many free places is finished
SLACK = 8
#: bins of one task in the merge rounds
BINS_PER_TASK = 200_000
FAN_IN = 8
#: parts of words that a task keeps with their ids
CACHE_PARTS = 100_000
CACHE_LENGTH = 40

_MEMBER = pa.struct(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())]
)
_BIN_SCHEMA = (
    "bin long, fill int, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"
)


#: characters for which the tokenizer's normalising and splitting are restated below; words with others go through the tokenizer whole
_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
#: fixed value: the tokenizer's own pattern, for those characters in lower case
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


def _byte_letters() -> list[str]:
    """Byte-level BPE's letter of each byte: itself where it prints, else the next code point from 256."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in prints else next(others)) for b in range(256)]


class Words:
    """Ids of texts, part by part: the tokenizer never joins what its pattern parts.

    Most distinct parts are rare, so the BPE model is asked once for each that
    is new, and parts that were seen are looked up.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text."""
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return self._plain(text)
        return b"".join([self._plain(w) if _PLAIN.fullmatch(w) and "<|" not in w else self._other(w) for w in text.replace("\n", " ").split(" ")])

    def _plain(self, text: str) -> bytes:
        parts = _PARTS.findall(text.lower())
        known = self.known
        if len(known) > CACHE_PARTS:
            self.known = known = {}
        new = set(parts).difference(known)
        if not new:
            return b"".join([known[p] for p in parts])
        own = {p: self._part(p) for p in new}
        known.update((p, b) for p, b in own.items() if len(p) <= CACHE_LENGTH)
        return b"".join([known[p] if p in known else own[p] for p in parts])

    def _part(self, part: str) -> bytes:
        letters = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _other(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()


_words: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """The tokenizer of a worker process; what an earlier task kept of its texts is gone."""
    if path not in _words:
        _words[path] = Words(path)
    _words[path].known = {}
    return _words[path]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every item, and the number of bins: longest first, into the fullest bin with room.

    Open bins lie in one stack per free room; a bit set of the stacks in use
    gives the smallest room that is enough.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = n = 0
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fits = used >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                used ^= 1 << room
        else:
            room, b = capacity, n
            n += 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - size:
            stacks[left].append(b)
            used |= 1 << left
    return bins, offsets, n


def _packed(sizes: np.ndarray, members: pa.StructArray, counts: np.ndarray, prefix: int) -> pa.RecordBatch:
    """Pack items of ``sizes``, of which item i has the next ``counts[i]`` members; offsets move with their item."""
    bins, offsets, n = best_fit(sizes, LENGTH)
    item = np.repeat(np.arange(len(sizes)), counts)
    at = members.field("offset").to_numpy() + offsets[item]
    order = np.lexsort((at, bins[item]))
    columns = [members.field(f.name) for f in _MEMBER][:-1]
    moved = pa.StructArray.from_arrays([*(c.take(pa.array(order)) for c in columns), pa.array(at[order])], fields=list(_MEMBER))
    per_bin = np.bincount(bins[item], minlength=n)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per_bin)].astype(np.int32)), moved)
    fill = np.bincount(bins, weights=sizes, minlength=n).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(prefix + np.arange(n, dtype=np.int64)), pa.array(fill), lists], names=["bin", "fill", "members"])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, 2000):
        yield batch.slice(at, 2000)


def _pack_documents(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        ids, numbers = [], {k: [] for k in ("piece", "start", "length", "crc")}
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            words = words or words_of(path)
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                own = words.ids(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(own), 4 * LENGTH)):
                    part = own[at : at + 4 * LENGTH]
                    ids.append(doc)
                    numbers["piece"].append(piece)
                    numbers["start"].append(at // 4)
                    numbers["length"].append(len(part) // 4)
                    numbers["crc"].append(zlib.crc32(part))
        if ids:
            sizes = np.array(numbers["length"], np.int64)
            members = pa.StructArray.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(numbers["piece"], pa.int32()), pa.array(numbers["start"], pa.int64()),
                    pa.array(sizes), pa.array(numbers["crc"], pa.int64()), pa.array(np.zeros(len(ids), np.int64)),
                ],
                fields=list(_MEMBER),
            )
            yield from _slices(_packed(sizes, members, np.ones(len(ids), np.int64), TaskContext.get().partitionId() << 32))

    return run


def _pack_bins(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = [b for b in batches if b.num_rows]
        if taken:
            table = pa.Table.from_batches(taken).combine_chunks()
            lists = table.column("members").chunk(0) if table.column("members").num_chunks else None
            counts = pc.list_value_length(lists).to_numpy()
            prefix = (level << 56) + (TaskContext.get().partitionId() << 32)
            yield from _slices(_packed(table.column("fill").to_numpy().astype(np.int64), lists.flatten(), counts, prefix))

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, bins_per_task: int = BINS_PER_TASK) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    ``tokenizer`` is the path of a tokenizer file that every executor has.
    """
    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bins = written(rows.mapInArrow(tidied(_pack_documents(tokenizer, end_id)), _BIN_SCHEMA), "packed")
    finished, level, tasks = [], 0, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        full = F.col("fill") >= LENGTH - SLACK
        finished.append(bins.where(full))
        open_bins = bins.where(~full)
        left = open_bins.count()
        if left == 0:
            break
        level += 1
        least = -(-left // bins_per_task)
        tasks = max(least, -(-tasks // FAN_IN))
        bins = written(open_bins.repartition(tasks).mapInArrow(tidied(_pack_bins(level)), _BIN_SCHEMA), f"packed-{level}")
        after = bins.count()
        if tasks == 1 or (tasks == least and after > 0.99 * left):
            finished.append(bins)
            break
    out = finished[0]
    for f in finished[1:]:
        out = out.union(f)
    pieces = out.select(F.col("bin").alias("sequence_id"), F.explode("members").alias("m"))
    return pieces.select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")
