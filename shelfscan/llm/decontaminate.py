"""Benchmark decontamination with a generalised suffix automaton over words.

The test items' words form one automaton. Each document's words are streamed
through it; the state and the length of the longest match that ends at each
word tell whether a window (``window`` item words, or a whole shorter item)
ends there. Items are dealt into blocks of about ``block_bytes`` of text, so
the automaton in a task has a bound however large the test set is; documents
pass one block after another, and what the earlier blocks hit is kept.

Defined results: null text, of a document or an item, has no words; items with
the same id are one; an item without id hits words but is listed nowhere; an
empty document or item table gives no hits; repeated documents each give their
row; other columns are carried unread.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan.llm.scratch import in_small_batches, other_columns, rows_again, tidied, utf8, written

WINDOW = 10
#: UTF-8 bytes of item texts in one automaton
BLOCK_BYTES = 1 << 20
#: a document that consists of hit words to more than this share goes as a whole
MAX_COVERAGE = 0.5

#: A-Z to a-z; digits, letters and all bytes of other characters stay; the rest parts words
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton of items' words, with the windows that end in each state."""

    def __init__(self, items: Iterable[tuple[object, bytes]], window: int):
        self.window = window
        self.code: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[str, list[int]]] = []
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            last, path = 0, []
            for w in words:
                last = self._extend(last, self.code.setdefault(w, len(self.code)))
                path.append(last)
            ends.append(("" if item is None else str(item), path))
        self._windows(ends)

    def _split(self, state: int, through: int, length: int, code: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[through]))
        self.link.append(self.link[through])
        self.length.append(length)
        self.link[through] = clone
        while state >= 0 and self.next[state].get(code) == through:
            self.next[state][code] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, code: int) -> int:
        there = self.next[last].get(code)
        if there is not None:  # the item goes on as an earlier one did
            if self.length[there] == self.length[last] + 1:
                return there
            return self._split(last, there, self.length[last] + 1, code)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        state = last
        while state >= 0 and code not in self.next[state]:
            self.next[state][code] = new
            state = self.link[state]
        if state >= 0:
            there = self.next[state][code]
            if self.length[there] == self.length[state] + 1:
                self.link[new] = there
            else:
                self.link[new] = self._split(state, there, self.length[state] + 1, code)
        return new

    def _windows(self, ends: list[tuple[str, list[int]]]) -> None:
        """What ends in each state: the full window (its state), and short items with the nearest state that has some."""
        n, window = len(self.next), self.window
        by_length = sorted(range(1, n), key=self.length.__getitem__)
        self.full = [0] * n
        short_at: dict[int, dict[int, set[str]]] = {}
        owners: dict[int, set[str]] = {}
        for s in by_length:
            if self.length[s] >= window:
                self.full[s] = s if self.length[self.link[s]] < window else self.full[self.link[s]]
        for item, path in ends:
            if len(path) < window:
                short_at.setdefault(path[-1], {}).setdefault(len(path), set()).add(item)
            for s in path:
                if self.full[s]:
                    owners.setdefault(self.full[s], set()).add(item)
        self.owners, self.short_at = owners, short_at
        self.short = [0] * n  # nearest state on the way to the root, itself included, where a short item ends
        for s in by_length:
            self.short[s] = s if s in short_at else self.short[self.link[s]]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(first word, last word) of each hit, and the items with occurring windows."""
        spans, items = [], set()
        code, nexts, link, length = self.code.get, self.next, self.link, self.length
        full, short, window = self.full, self.short, self.window
        state = matched = 0
        for i, word in enumerate(words):
            c = code(word)
            if c is None:
                state = matched = 0
                continue
            there = nexts[state].get(c)
            if there is None:
                while state and there is None:
                    state = link[state]
                    there = nexts[state].get(c)
                matched = length[state]
                if there is None:
                    matched = 0
                    continue
            state = there
            matched += 1
            if matched >= window:
                spans.append((i - window + 1, i))
                items |= self.owners[full[state]]
            s = short[state]
            while s:
                for n, own in self.short_at[s].items():
                    if n <= matched:
                        spans.append((i - n + 1, i))
                        items |= own
                s = short[link[s]]
        return spans, items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Hit words as maximal runs."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def _automaton(block) -> Automaton:
    """The block's automaton, built once per task and gone with it."""
    window, items = block.value
    return Automaton(items, window)


def _blocks(items: DataFrame, window: int, block_bytes: int) -> Iterator[tuple]:
    """Item texts in blocks of bounded size, by a hash of the row; no block is larger but for one item's size."""
    rows = items.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    for k in range(n):
        own = [(r["item"], r["text"].encode()) for r in dealt.where(F.col("block") == k).select("item", "text").distinct().collect()]
        yield window, own


_HITS = "n_words long, spans array<struct<first:long,last:long>>, items array<string>"


def _hit_arrays(rows: list[tuple[int, list, list]]) -> list[pa.Array]:
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    return [
        pa.array([r[0] for r in rows], pa.int64()),
        pa.array([[{"first": a, "last": b} for a, b in r[1]] for r in rows], span),
        pa.array([r[2] for r in rows], pa.list_(pa.string())),
    ]


def _mark(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(block)
        for batch in batches:
            rows = []
            before = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())
            for text, (spans, items) in zip(utf8(batch.column("text")), before):
                words = words_of(text)
                hit, found = automaton.scan(words)
                if hit:
                    spans = merged([*hit, *((s["first"], s["last"]) for s in spans)])
                    items = sorted(found.union(items) - {""})
                else:
                    spans = [(s["first"], s["last"]) for s in spans]
                rows.append((len(words), spans, items))
            keep = [n for n in batch.schema.names if n not in ("n_words", "spans", "items")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *_hit_arrays(rows)], names=[*keep, "n_words", "spans", "items"])

    return run


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: bool = False
) -> DataFrame:
    """(doc_id, n_words, spans, items) per document: hit words as runs, and the items with occurring windows.

    With ``carry``, ``text`` comes along, and the other columns as ``row``.
    """
    row, kind = other_columns(docs) if carry else (F.lit(None).cast("boolean"), "boolean")
    marked = in_small_batches(docs).select(
        row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<first:long,last:long>>)").alias("spans"),
        F.expr("cast(array() as array<string>)").alias("items"),
    )
    context = docs.sparkSession.sparkContext
    for k, block in enumerate(_blocks(items, window, block_bytes)):
        if k:
            marked = written(marked, "decontaminated-block")
        marked = marked.mapInArrow(tidied(_mark(context.broadcast(block))), f"row {kind}, doc_id long, text string, {_HITS}")
    return marked if carry else marked.drop("row", "text")


def _cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans``; what lay between the first and last of a run goes too."""
    raw = text.encode()
    folded = raw.translate(_FOLD)
    starts, ends, at = [], [], 0
    for word in folded.split():
        at = folded.index(word, at)
        starts.append(at)
        at += len(word)
        ends.append(at)
    out, done = [], 0
    for first, last in spans:
        out.append(raw[done : starts[first]])
        done = ends[last]
    out.append(raw[done:])
    return b"".join(out).decode()


def _clean(max_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            dropped = []
            for i, (n, spans) in enumerate(zip(batch.column("n_words").to_pylist(), batch.column("spans").to_pylist())):
                hit = sum(s["last"] - s["first"] + 1 for s in spans)
                dropped.append(bool(hit) and hit > max_coverage * n)
                if hit and not dropped[-1]:
                    texts[i] = _cut_text(texts[i], [(s["first"], s["last"]) for s in spans])
            cut = [not d and bool(s) for d, s in zip(dropped, batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(texts, pa.string()), pa.array(cut, pa.bool_()), pa.array(dropped, pa.bool_())], names=["row", "text", "cut", "dropped"]
            )

    return run


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` without the hit spans; documents hit beyond ``max_coverage`` of their words go.

    Cutting can bring words together that form a window anew, so cut texts are
    marked and cut again until a pass finds nothing. ``n_chars``, where there
    is one, follows the text. Texts without a hit stay as they are.
    """
    columns, (_, kind) = docs.columns, other_columns(docs)

    def cut(rows: DataFrame) -> DataFrame:
        """(row, text, cut) of the documents that stay; the helpers lie beside the packed row, so no column clashes with them."""
        found = contamination(rows, items, window, block_bytes, carry=True)
        cleaned = found.select("row", "text", "n_words", "spans").mapInArrow(tidied(_clean(max_coverage)), f"row {kind}, text string, cut boolean, dropped boolean")
        return written(cleaned.where("not dropped").drop("dropped"), "decontaminated")

    def whole(rows: DataFrame, was_cut: bool) -> DataFrame:
        changed = {"text": F.col("text").cast(docs.schema["text"].dataType)}
        if "n_chars" in columns and was_cut:
            changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
        return rows_again(rows.where("cut" if was_cut else "not cut"), columns, **changed)

    once = cut(docs)
    parts, again = [whole(once, False)], whole(once, True)
    while again.take(1):
        more = cut(again)
        parts.append(whole(more, False))
        again = whole(more, True)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
