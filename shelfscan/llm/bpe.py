"""Byte-pair encoding by backtracking, and decoding by an offset table.

Merging a word again and again costs its length squared. Here a word's tokens
are taken from left to right instead. An Aho-Corasick automaton over all
tokens, run once over the reversed word, gives the longest token that starts
at every position. A token may follow another only if the pair is compatible:
no merge across their border comes before the merges that made them. A token
that is not compatible is replaced by the next shorter one that begins it; if
there is none, the position is marked as leading nowhere and the token before
is taken back. The sequence of compatible tokens over a word is unique and is
what the merges give, and no position is left twice, so the time is linear.

A word's last letter carries the vocabulary's end-of-word suffix and counts as
a letter of its own, so tokens that end a word match only there. Tokens that
their own merges cannot make are left out, as no word can hold them.

Decoding looks up every id in a table of offsets into the tokens' joined bytes.

Defined results: null text is an empty text and has no ids; repeated rows are
encoded each for itself; an empty table gives no rows; ids outside the
vocabulary decode to nothing; other columns are not read.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfscan.llm.packing import Words
from shelfscan.llm.scratch import in_small_batches, utf8

#: a word's last letter is shifted by this, past all letters of byte-level BPE
LAST = 0x1000


class Tables:
    """What a tokenizer file says about its tokens: letters, the pair that makes each, and its next shorter beginning."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model = config["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path}: not a BPE model of whole letters")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocabulary: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = self.vocabulary
        #: rank of a pair's merge, and the pair of a token
        self.rank: dict[tuple[int, int], int] = {}
        self.made_of: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.rank.setdefault((left, right), rank)
            self.made_of.setdefault(whole, (left, right, rank))
        self.letters = {self.spelt(t): i for t, i in ids.items()}
        usable = self._usable()
        self.length = {i: len(s) for s, i in self.letters.items()}
        self.shorter: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        for spelling, i in self.letters.items():
            if i not in usable:
                continue
            self.automaton.add_word(spelling[::-1], i)
            for n in range(len(spelling) - 1, 0, -1):
                beginning = self.letters.get(spelling[:n])
                if beginning in usable:
                    self.shorter[i] = beginning
                    break
        self.automaton.make_automaton()
        self._seen: dict[tuple[int, int], bool] = {}

    def spelt(self, token: str) -> str:
        """The token's letters; with the suffix, the last is the shifted one."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + LAST)
        return token

    def word(self, letters: str) -> str:
        return letters[:-1] + chr(ord(letters[-1]) + LAST) if self.suffix else letters

    def _usable(self) -> set[int]:
        """Tokens that their own letters are merged to: single letters, and pairs of usable tokens that nothing splits before."""
        usable = {i for i in self.vocabulary.values() if i not in self.made_of}
        for i, (left, right, rank) in sorted(self.made_of.items(), key=lambda x: x[1][2]):
            if left in usable and right in usable and self._apart(left, right, rank):
                usable.add(i)
        return usable

    def _apart(self, left: int, right: int, until: int) -> bool:
        """No merge across the border of two tokens comes before rank ``until``.

        The later of the two merges next to the border is undone, step by
        step; at each step the tokens at the border were there until that
        merge. Equal merges run from left to right, so one across the border
        comes before an equal one on its right, but after one on its left.
        """
        while True:
            across = self.rank.get((left, right))
            if across is not None and across < until:
                return False
            a, b = self.made_of.get(left), self.made_of.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[2] > b[2]):
                left, until = a[1], a[2]
            else:
                right, until = b[0], b[2] + 1

    def compatible(self, left: int, right: int) -> bool:
        known = self._seen.get((left, right))
        if known is None:
            if len(self._seen) >= 200_000:  # bounds a worker's memory, not the result
                self._seen.clear()
            known = self._seen[left, right] = self._apart(left, right, 1 << 62)
        return known

    def encode(self, letters: str) -> list[int]:
        """Ids of one word of byte-level letters."""
        if not letters:
            return []
        word = self.word(letters)
        n = len(word)
        length, shorter = self.length, self.shorter
        longest = [-1] * n
        for at, token in self.automaton.iter(word[::-1]):
            start = n - 1 - at
            if longest[start] < 0 or length[token] > length[longest[start]]:
                longest[start] = token
        out: list[int] = []
        leads_nowhere = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            while token is not None and token >= 0:
                if not leads_nowhere[at + length[token]] and (not out or self.compatible(out[-1], token)):
                    break
                token = shorter.get(token)
            if token is not None and token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else None
            else:
                if not out:
                    raise ValueError(f"no tokens spell {letters[:40]!r}")
                leads_nowhere[at] = 1
                token = out.pop()
                at -= length[token]
        return out


_tables: dict[str, Tables] = {}


def tables_of(path: str) -> Tables:
    """The tables of a worker process; their size is that of the vocabulary."""
    if path not in _tables:
        _tables[path] = Tables(path)
    return _tables[path]


class Encoder(Words):
    """Texts to ids: the tokenizer's own normalising and splitting, and the backtracking encoder for each part."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tables = tables_of(path)

    def _part(self, part: str) -> bytes:
        letters = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
        return array("I", self.tables.encode(letters)).tobytes()

    def _other(self, word: str) -> bytes:
        out, at = [], 0
        while at < len(word):
            where, special = min(((i, s) for s in self.tables.special if (i := word.find(s, at)) >= 0), default=(len(word), ""), key=lambda x: (x[0], -len(x[1])))
            plain = self.tokenizer.normalizer.normalize_str(word[at:where])
            for letters, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain) if plain else ():
                out += self.tables.encode(letters)
            if special:
                out.append(self.tables.special[special])
            at = where + len(special)
        return array("I", out).tobytes()


class Decoder:
    """Ids to text: every token's bytes, with the space that parts tokens, in one string with a table of offsets."""

    def __init__(self, path: str):
        tokens = {i: t for t, i in Tokenizer.from_file(path).get_vocab(with_added_tokens=True).items()}
        size = max(tokens) + 1
        texts = [(tokens[i] + " ").encode() if i in tokens else b"" for i in range(size)]
        self.joined = np.frombuffer(b"".join(texts), np.uint8)
        self.offsets = np.zeros(size + 2, np.int64)
        np.cumsum([*map(len, texts), 0], out=self.offsets[1:])

    def bytes_of(self, ids: np.ndarray) -> bytes:
        ids = np.minimum(ids.astype(np.int64), len(self.offsets) - 2)
        first, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        at = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) if len(ids) else first
        return self.joined[at + np.arange(len(at))].tobytes()[:-1]


_decoders: dict[str, Decoder] = {}


def decoder_of(path: str) -> Decoder:
    if path not in _decoders:
        _decoders[path] = Decoder(path)
    return _decoders[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(path)
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                ids = [encoder.ids((t.as_py() or b"").decode()) for t in some.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"]
                )

    return run


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers.

    ``tokenizer`` is the path of a tokenizer file that every executor has.
    """
    text = F.col("text").cast("string").cast("binary").alias("text")
    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text)
    return rows.mapInArrow(_encode(tokenizer), "doc_id long, n_tokens long, ids binary")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            decoder = decoder_of(path)
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                texts = [decoder.bytes_of(np.frombuffer(x, "<u4")) for x in utf8(some.column("ids"))]
                decoded = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(some.column(n) for n in ("doc_id", "n_tokens", "ids")), decoded], names=["doc_id", "n_tokens", "ids", "decoded"])

    return run


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of rows with ``ids`` as ``encode`` makes them."""
    rows = in_small_batches(encoded).select("doc_id", "n_tokens", "ids")
    return rows.mapInArrow(_decode(tokenizer), "doc_id long, n_tokens long, ids binary, decoded string")
