"""Toxicity from a weighted lexicon matched by an Aho-Corasick automaton.

Folding: lower case, compatibility decomposition without combining marks,
look-alike letters of other alphabets and digits or signs that stand for
letters, invisible characters dropped, the rest to single spaces. The lexicon holds
whole folded words and word beginnings, weighted by a cautious estimate of their
log odds among toxic and other training texts; exception phrases are neighbouring words around an entry
that are mostly seen in texts without the label, and matches inside them do not
count. A text's density is the weight matched per 100 words on a log scale; a
logistic curve turns it into a score.

Labels are learned on at most ``max_rows`` labelled rows (equal texts count
once), which bounds the lexicon and the exceptions; every text is scored whole. A null text counts as empty: density 0.
Training rows of one class, or none: every score is the share of label 1 (0
without rows). Repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from reviewlens.llm.common import id_fold, labelled_sample, stored

MAX_TRAIN_ROWS = 40_000
TRAIN_PARTS = 48             # parts of the stored training texts
ENTRIES_AT_ONCE = 200_000    # candidates that a training task counts before it passes them on
STEMS = (4, 5, 6, 7, 8)      # lengths of word beginnings that may be entries
MIN_TEXTS = 3                # toxic training texts that must hold an entry
MIN_WEIGHT = 1.5             # weight that an entry must reach
CAUTION = 1.64               # standard errors taken off the log odds: rare words need clearer evidence

# Letters of other alphabets that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i",
    "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h",
    "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ɡ": "g", "ɑ": "a", "ɩ": "i",
}
# Digits and signs written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"


class _Folding(dict):
    """Translation of one character; asked once for each new one."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        if ch in INVISIBLE or unicodedata.combining(ch):
            out = ""
        else:
            base = "".join(c for c in unicodedata.normalize("NFKD", ch.lower()) if not unicodedata.combining(c)).lower()
            out = "".join(LOOKALIKES.get(c, c) for c in base)
            out = "".join(SUBSTITUTES.get(c, c if c.isalnum() else " ") for c in out)
        self[code] = out
        return out


_FOLDING = _Folding()


def fold(text: str) -> list[str]:
    """Folded words of a text."""
    return text.translate(_FOLDING).split()


def entries_of(words: list[str]) -> set[str]:
    """Candidates of a text: words (`` word ``) and word beginnings (`` beg``)."""
    distinct = set(words)
    return {f" {w} " for w in distinct} | {f" {w[:n]}" for w in distinct for n in STEMS if len(w) >= n}


@dataclass(frozen=True)
class ToxicModel:
    weights: dict[str, float]
    exceptions: tuple[str, ...]
    slope: float
    bias: float

    def automaton(self):
        machine = ahocorasick.Automaton()
        for phrase in self.exceptions:
            machine.add_word(phrase, (len(phrase), None))
        for entry, weight in self.weights.items():
            machine.add_word(entry, (len(entry), weight))
        machine.make_automaton()
        return machine

    def score(self, text: str, machine) -> float:
        x = self.bias + self.slope * density(fold(text), machine)
        return 1.0 / (1.0 + math.exp(-min(max(x, -50.0), 50.0)))


def density(words: list[str], machine) -> float:
    """log1p of the weight matched per 100 words; a word counts by its heaviest entry."""
    if not words or not len(machine):
        return 0.0
    by_word: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (size, weight) in machine.iter(" " + " ".join(words) + " "):
        start = end - size + 1
        if weight is None:
            excused.append((start, end))
        elif weight > by_word.get(start, 0.0):
            by_word[start] = weight
    total, reach = 0.0, 0
    waiting = sorted(excused, reverse=True)
    for start in sorted(by_word):  # both lists once: how far the exceptions met so far reach
        while waiting and waiting[-1][0] <= start:
            reach = max(reach, waiting.pop()[1])
        if start >= reach:
            total += by_word[start]
    return math.log1p(100.0 * total / len(words))


def scores(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``doc_id``, ``score`` for every row; one narrow pass over the texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # short strings, bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = sent.value.automaton()
        for batch in batches:
            score = [sent.value.score(t.as_py() or "", machine) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, score double"))


def _found(sample: DataFrame, make) -> DataFrame:
    """``entry, pos, neg``: training texts with and without the label that hold each candidate."""

    def rows(counts: dict[str, list[int]]) -> pa.RecordBatch:
        pos, neg = zip(*counts.values()) if counts else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(pos, pa.int64()),
                                           pa.array(neg, pa.int64())], names=["entry", "pos", "neg"])

    def run(batches):
        counts: dict[str, list[int]] = {}  # combined in the task, a bounded number at a time
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                for entry in make(fold(text.as_py())):
                    counts.setdefault(entry, [0, 0])[1 - y] += 1
                if len(counts) >= ENTRIES_AT_ONCE:
                    yield rows(counts)
                    counts = {}
        yield rows(counts)

    return (sample.select("text", F.col("y").cast("int")).mapInArrow(run, "entry string, pos long, neg long")
            .groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))


def phrases_of(weights: dict[str, float]):
    """For a text: each pair of neighbours of which one matches an entry."""
    def matches(word: str) -> bool:
        return f" {word} " in weights or any(f" {word[:n]}" in weights for n in STEMS if len(word) >= n)

    def make(words: list[str]) -> set[str]:
        return {f" {a} {b} " for a, b in zip(words, words[1:]) if matches(a) or matches(b)}
    return make


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0,
          max_rows: int = MAX_TRAIN_ROWS) -> ToxicModel:
    """Lexicon, exceptions and curve from the labelled rows outside fold ``held_out``."""
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, label, lambda i: id_fold(i, folds) != held_out, max_rows)
    sample = stored(spark, sample.groupBy("text").agg(F.max("y").alias("y")).repartition(TRAIN_PARTS), "toxic-training")
    n, pos = sample.agg(F.count("y"), F.coalesce(F.sum("y"), F.lit(0))).first()
    neg = n - pos
    if not pos or not neg:
        return ToxicModel({}, (), 0.0, 50.0 if pos else -50.0)
    has, lacks = F.col("pos") + 0.5, F.col("neg") + 0.5
    odds = F.log(has / (pos + 1.0)) - F.log(lacks / (neg + 1.0))
    lexicon = (_found(sample, entries_of).filter(F.col("pos") >= MIN_TEXTS)
               .withColumn("weight", odds - CAUTION * F.sqrt(1 / has + 1 / lacks)).filter(F.col("weight") >= MIN_WEIGHT))
    weights = {row.entry: row.weight for row in lexicon.collect()}
    excused = _found(sample, phrases_of(weights)).filter((F.col("neg") >= 2) & (F.col("neg") > F.col("pos")))
    model = ToxicModel(weights, tuple(sorted(r.entry for r in excused.select("entry").collect())), 0.0, 0.0)
    curve = LogisticRegression(featuresCol="x", labelCol="y", regParam=1e-4, maxIter=100).fit(densities(sample, model))
    return ToxicModel(weights, model.exceptions, float(curve.coefficients[0]), float(curve.intercept))


def densities(sample: DataFrame, model: ToxicModel) -> DataFrame:
    """``y, x`` for fitting the curve: the label and the density of each training text."""

    def run(batches):
        machine = model.automaton()
        for batch in batches:
            x = [density(fold(t.as_py()), machine) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.float64())], names=["y", "d"])

    rows = sample.select("text", F.col("y").cast("double")).mapInArrow(run, "y double, d double")
    return stored(sample.sparkSession, rows, "toxic-curve").select("y", array_to_vector(F.array("d")).alias("x"))


def clean(docs: DataFrame, model: ToxicModel, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score below the threshold, with their columns as they were; texts are not shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def below(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = sent.value.automaton()
        for texts in batches:
            yield pd.Series([sent.value.score(text or "", machine) < threshold for text in texts], dtype=bool)

    return docs.filter(below(F.col("text").cast("string")))
