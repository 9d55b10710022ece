"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: letters of other scripts that look like Latin ones,
full-width letters, and digits and signs written for letters (a sign that
closes a word is punctuation). The lexicon is
learned from labelled documents: whole words and word beginnings, each weighed
by the log-odds of toxic documents among those that hold it; an entry must be
strong and significant (likelihood ratio), and a beginning no weaker than the
entries that go on from it, else it would only add clean words. A document's evidence is the sum of
the weights of its distinct matched words, the weight per thousand words, and
its largest weight; a logistic function fitted to the labelled documents makes
them the score. Matches inside an exception phrase don't count.

Defined results: null text is empty; an empty text scores like any text
without a match; conflicting labels of one id count as toxic; labels without
an id or a value are left out; without usable labels every score is 0, with
labels of one kind only every score is that kind's share; repeated documents
each give their row; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscan.llm.scratch import in_small_batches, other_columns, rows_again, tidied, written

THRESHOLD = 0.3
#: labelled documents the lexicon is learned from, at most; those with the smallest hash of their id
SAMPLE = 40_000
#: an entry needs this likelihood ratio statistic (one degree of freedom), and this log-odds
SIGNIFICANCE = 14.0
LEAST_WEIGHT = 3.0
STEMS = range(4, 8)
#: distinct terms that a task counts before it sends them on
TERMS = 300_000
HELD_OUT = 2

#: fixed values: look-alikes and substitutes, by the letter they stand for
LOOK_ALIKES = {
    "a": "аαɑ4@", "b": "вβ8", "c": "сϲ", "d": "ԁ", "e": "еεє3", "g": "ɡ9", "h": "һн", "i": "іιı1!|", "j": "ј", "k": "кκ",
    "l": "ӏ", "m": "м", "n": "ո", "o": "оοօ0", "p": "рρ", "q": "ԛ", "s": "ѕ5$", "t": "тτ7", "u": "υս", "v": "ν", "w": "ԝω",
    "x": "хχ", "y": "уγ", "z": "ᴢ2",
}
#: fixed values: phrases in which a word of abuse is none
EXCEPTIONS = ("clown fish", "trash can", "white trash bag", "pond scum", "class clown fish", "stupid simple")

_TABLE = {ord(c): latin for latin, others in LOOK_ALIKES.items() for c in others}
_TABLE |= {0xFF41 + i: chr(97 + i) for i in range(26)}
_TABLE |= {c: " " for c in range(128) if not chr(c).isalnum() and c not in _TABLE}
_TABLE |= {c: " " for c in (0xA0, 0x2018, 0x2019, 0x201C, 0x201D, 0x2013, 0x2014, 0x2026, 0xAB, 0xBB, 0xBF, 0xA1)}


#: signs that stand for letters only where a word goes on behind them
_CLOSING = re.compile(r"[!|$@]+(?!\w)")


def folded(text: str) -> list[str]:
    """The words of a text, folded."""
    return _CLOSING.sub(" ", text.lower()).translate(_TABLE).split()


def _terms(word: str) -> list[str]:
    """A word as a whole ("word ") and its beginnings."""
    return [word + " ", *(word[:n] for n in STEMS if n <= len(word))]


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    #: of the features of a text; None without labels
    coefficients: tuple[float, ...] | None = None
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            out.add_word(" " + term, (len(term) + 1, weight))
        for phrase in self.exceptions:
            line = f" {' '.join(folded(phrase))} "
            out.add_word(line, (len(line), None))
        out.make_automaton()
        return out


def _matches(automaton, line: str) -> list[tuple[str, float]]:
    """Matched words, repeats included, with their largest weight; ``line`` has a space at both ends."""
    best: dict[int, float] = {}
    excepted: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(line):
        start = end - size + 1
        if weight is None:
            excepted.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    return [
        (line[start + 1 : line.index(" ", start + 1)], weight) for start, weight in best.items() if not any(a <= start < b for a, b in excepted)
    ]


def features(automaton, text: str) -> tuple[float, float, float, float]:
    """1, evidence, weight per thousand words, largest weight; each on a log scale."""
    words = folded(text)
    found = _matches(automaton, f" {' '.join(words)} ") if words else []
    if not found:
        return 1.0, 0.0, 0.0, 0.0
    distinct = dict(found)
    density = 1000 * sum(w for _, w in found) / len(words)
    return 1.0, math.log1p(sum(distinct.values())), math.log1p(density) / 2, math.log1p(max(distinct.values()))


def score_text(lexicon: Lexicon, automaton, text: str) -> float:
    if lexicon.coefficients is None:
        return 0.0
    logit = sum(b * x for b, x in zip(lexicon.coefficients, features(automaton, text)))
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, logit))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method with a ridge on all but the constant."""
    b = np.zeros(x.shape[1])
    penalty = np.diag([1e-3, *[ridge] * (len(b) - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def without_loose_stems(weights: dict[str, float]) -> dict[str, float]:
    """Whole words, and those beginnings that tell no less than every entry that goes on from them."""
    best: dict[str, float] = {}
    for term, weight in weights.items():
        for n in STEMS:
            if n < len(term):
                best[term[:n]] = max(best.get(term[:n], 0.0), weight)
    return {t: w for t, w in weights.items() if t.endswith(" ") or w >= best.get(t, 0.0)}


def _counted(counts: dict[int, Counter]) -> pa.RecordBatch:
    keys = list({*counts[0], *counts[1]})
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())],
        names=["term", "n_toxic", "n_clean"],
    )


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic, clean): documents with each term, summed as far as ``TERMS`` allows."""
    counts = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            counts[label].update({t for word in set(folded(text or "")) if len(word) >= 3 for t in _terms(word)})
            if len(counts[0]) + len(counts[1]) > TERMS:
                yield _counted(counts)
                counts = {0: Counter(), 1: Counter()}
    yield _counted(counts)


def _features(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.value.automaton()
        for batch in batches:
            rows = [features(automaton, t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"])

    return run


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled documents, none of them held out."""
    usable = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where(
        "label_id is not null and toxic in (0, 1)"
    )
    usable = usable.where(F.crc32(F.col("label_id").cast("string")) % 4 != HELD_OUT)
    chosen = usable.groupBy("label_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    return in_small_batches(docs).join(F.broadcast(chosen), F.col("doc_id").cast("long") == F.col("label_id")).select(F.col("text").cast("string").alias("text"), "toxic")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """A lexicon from the labelled documents. Runs at once; the driver gets the significant entries and the features of the sample."""
    train = written(training_rows(docs, labels, sample), "toxicity-training")
    counts = train.mapInArrow(tidied(_count_terms), "term string, n_toxic long, n_clean long")
    counts = counts.groupBy("term").agg(F.sum("n_toxic").alias("a"), F.sum("n_clean").alias("c"))
    totals = train.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = totals["t"] or 0, totals["n"] - (totals["t"] or 0)
    if not toxic or not clean:
        return Lexicon(coefficients=None if not totals["n"] else (math.log((toxic + 0.5) / (clean + 0.5)), 0.0, 0.0, 0.0))
    a, c, n = F.col("a"), F.col("c"), toxic + clean
    weight = F.log((a + 0.5) / (F.lit(toxic + 0.5) - a)) - F.log((c + 0.5) / (F.lit(clean + 0.5) - c))

    def part(observed: Column, expected: Column) -> Column:
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    held = a + c
    ratio = 2 * (
        part(a, held * toxic / n) + part(c, held * clean / n) + part(F.lit(toxic) - a, (F.lit(n) - held) * toxic / n) + part(F.lit(clean) - c, (F.lit(n) - held) * clean / n)
    )
    best = counts.where(a >= 2).select("term", weight.alias("weight"), ratio.alias("ratio"))
    best = best.where((F.col("ratio") >= SIGNIFICANCE) & (F.col("weight") >= LEAST_WEIGHT))
    lexicon = Lexicon(without_loose_stems({r["term"]: r["weight"] for r in best.collect()}))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    rows = train.mapInArrow(tidied(_features(shared)), "x array<double>, toxic int").collect()  # at most ``sample`` rows of four numbers
    lexicon = Lexicon(lexicon.weights, tuple(fit_logistic(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float)).tolist()))
    return lexicon


def _score(lexicon, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.value.automaton()
        for batch in batches:
            scores = np.array([score_text(lexicon.value, automaton, t or "") for t in batch.column("text").to_pylist()], float)
            keep = batch.schema.names
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in keep), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"]
            )

    return run


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD, carry: bool = False) -> DataFrame:
    """(doc_id, score, predicted) per document; with ``carry`` also ``text``, and the other columns as ``row``."""
    row, kind = other_columns(docs) if carry else (F.lit(None).cast("boolean"), "boolean")
    rows = in_small_batches(docs).select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    out = rows.mapInArrow(tidied(_score(shared, threshold)), f"row {kind}, doc_id long, text string, score double, predicted int")
    return out if carry else out.drop("row", "text")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == HELD_OUT, F.lit(False))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` below the threshold, columns unchanged."""
    return score(docs, learn(docs, labels), threshold, carry=True).where("predicted = 0").transform(rows_again, docs.columns, text=F.col("text"))
