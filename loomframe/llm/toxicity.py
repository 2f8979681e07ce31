"""Toxicity scores: boosted trees over dense features, with isotonic calibration.

The lexicons come from the labels: words, and beginnings of words, that toxic
training documents hold far more often than others. They are counted in the
tasks and only what passes is collected. The features of a text are densities of
lexicon words, how near they are to words of the second person, capitals,
punctuation and obfuscation. A worker keeps a table from raw word to flags, so a text
costs one look-up a word.

Lexicon and trees are fitted on a bounded sample of labelled rows (``max_rows``,
chosen by hash of the id) on two folds, the calibration on a third; the fourth is
never looked at. Every document is scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import stored, whole

#: Insults that any corpus in these languages may hold, and words of the second person.
INSULTS = frozenset("idiot idiots stupid moron dumb loser trash scum pathetic worthless disgusting clown fool imbecile idiota imbécil estúpido basura dummkopf trottel abschaum crétin imbécile ordure".split())
SECOND_PERSON = frozenset("you your yours yourself youre u ur du dich dir dein deine deinen euch euer ihr sie tu toi te ton ta tes vous votre vos tú ti tus vosotros usted ustedes su".split())
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_EDGE = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
_MIXED = regex.compile(r"\p{L}+[\p{N}@$*!_.\-]+\p{L}")
_NOT_LETTER = regex.compile(r"[^\p{L}]+")
WORD, STEM, INSULT, SECOND, SHOUT, MIXED, HIDDEN = 1, 2, 4, 8, 16, 32, 64
STEM_LETTERS = (4, 5)
VOCABULARY = 300_000
FEATURES = ("words", "stems", "insults", "any_per_word", "any_log", "distinct_log", "second", "near_second", "densest", "shout", "capitals", "bangs", "punctuation", "mixed", "hidden", "length_log", "word_length")


def bare(word: str) -> str:
    return _EDGE.sub("", word).lower()


@dataclass(frozen=True)
class Lexicon:
    words: frozenset[str]
    stems: frozenset[str]


class _Flags(dict):
    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __missing__(self, raw: str) -> int:
        if len(self) > VOCABULARY:
            self.clear()
        word, lexicon = bare(raw), self.lexicon
        flag = 0
        if word in lexicon.words:
            flag |= WORD
        if len(word) > STEM_LETTERS[0] and any(word[:k] in lexicon.stems for k in STEM_LETTERS if len(word) > k):
            flag |= STEM
        if word in INSULTS:
            flag |= INSULT
        if word in SECOND_PERSON:
            flag |= SECOND
        if len(word) > 2 and raw.isupper():
            flag |= SHOUT
        if _MIXED.search(raw):
            flag |= MIXED
            clear = {_NOT_LETTER.sub("", x) for x in (word, word.translate(_LEET))} - {word}
            if any(c in lexicon.words or c in INSULTS for c in clear):
                flag |= HIDDEN
        self[raw] = flag
        return flag


def features(text: str, flags: _Flags, near: int = 6, span: int = 50) -> list[float]:
    raw = text.split()
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    f = np.fromiter(map(flags.__getitem__, raw), np.int64, n)
    any_hit = (f & (WORD | STEM | INSULT | HIDDEN)) != 0
    hits = np.flatnonzero(any_hit)
    you = np.flatnonzero(f & SECOND)
    beside = 0.0
    if len(hits) and len(you):
        place = np.searchsorted(you, hits)
        gap = np.minimum(np.abs(you[np.minimum(place, len(you) - 1)] - hits), np.abs(hits - you[np.maximum(place - 1, 0)]))
        beside = float((gap <= near).sum()) / n
    run = np.concatenate([[0], np.cumsum(any_hit)])
    densest = float((run[min(span, n) :] - run[: n - min(span, n) + 1]).max()) / min(span, n)
    letters = text.encode()
    upper = len(letters) - len(letters.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    share = lambda bit: float(np.count_nonzero(f & bit)) / n
    return [
        share(WORD), share(STEM), share(INSULT), len(hits) / n, math.log1p(len(hits)), math.log1p(len({bare(raw[i]) for i in hits.tolist()})),
        share(SECOND), beside, densest, share(SHOUT), upper / max(1, len(letters)), (text.count("!") + text.count("?")) / n,
        sum(map(text.count, ".,;:-\"'()")) / n, share(MIXED), share(HIDDEN), math.log1p(n), len(text) / n,
    ]


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    trees: boosting.Boosted
    calibration: boosting.Isotonic

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = self.trees.raw(x)
        # a little of the raw score keeps the order within the flat parts of the calibration
        return np.clip(0.999 * self.calibration(raw) + 0.001 / (1 + np.exp(-raw)), 0, 1)


def fold_of(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4, F.lit(0))


def learn_lexicon(rows: DataFrame, least: int = 3, ratio: float = 8.0) -> Lexicon:
    """rows (text, y). Words and stems in at least ``least`` toxic texts and ``ratio`` times as often there as elsewhere: all of them, at most a word for each ``least`` words of the toxic rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(sums, pa.string()), *(pa.array([v[i] for v in sums.values()], pa.int64()) for i in (0, 1))], names=["item", "n0", "n1"])

        known: dict[str, str] = {}
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(known) > VOCABULARY:
                    known.clear()
                words = {known.get(w) or known.setdefault(w, bare(w)) for w in set(text.split())} - {""}
                items = words | {f"{w[:k]}\0" for w in words for k in STEM_LETTERS if len(w) > k}
                for item in items:
                    sums.setdefault(item, [0, 0])[y] += 1
            if len(sums) > 500_000:
                yield out()
                sums.clear()
        yield out()

    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        return Lexicon(frozenset(), frozenset())
    counted = rows.select("text", "y").mapInArrow(count, "item string, n0 long, n1 long").groupBy("item").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    odds = F.log((F.col("n1") + 0.5) / n1) - F.log((F.col("n0") + 0.5) / n0)
    best = counted.where(F.col("n1") >= least).withColumn("odds", odds).where(F.col("odds") >= math.log(ratio))
    items = [r["item"] for r in best.collect()]
    return Lexicon(frozenset(i for i in items if "\0" not in i), frozenset(i[:-1] for i in items if "\0" in i))


def _featurise(rows: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """The columns of ``keep`` and x (array of doubles) from the column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = _Flags(lexicon)
        for batch in batches:
            found = [features(t.as_py(), flags) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.list_(pa.float64()))], names=[*keep, "x"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    return rows.select(*keep, "text").mapInArrow(run, f"{fields}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: int = 2, calibrate: int = 3, max_rows: int = 40_000) -> Model:
    """Fit on labelled rows outside the fold held_out. At most about max_rows of them, whatever the corpus's size."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold_of(id_col) != held_out))
    marked = marked.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("y"))
    n = marked.count()
    if n > max_rows:
        marked = marked.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * max_rows / n)))
    # max_rows bounds what is broadcast
    sample = docs.select(F.col(id_col), whole(text_col).cast("string").alias("text")).join(F.broadcast(marked), F.col(id_col) == F.col("_id")).withColumn("fold", fold_of("_id").cast("int"))
    sample = stored(sample.select("_id", "text", "y", "fold"), "labelled")  # read three times: bounded by max_rows
    lexicon = learn_lexicon(sample.where(F.col("fold") != calibrate))
    rows = _featurise(sample, lexicon, ["_id", "y", "fold"]).orderBy("_id").collect()
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES))
    y, own = np.array([r["y"] for r in rows], float), np.array([r["fold"] != calibrate for r in rows], bool)
    trees = boosting.fit(x[own], y[own])
    return Model(lexicon, trees, boosting.fit_isotonic(trees.raw(x[~own]), y[~own]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): one row a document. Null text counts as empty; an empty text has all features 0 and is scored like any other."""
    rows = docs.select(F.col(id_col).alias("_id"), whole(text_col).cast("string").alias("text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = _Flags(model.lexicon)
        for batch in batches:
            x = np.array([features(t.as_py(), flags) for t in batch.column(1)]).reshape(len(batch), len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x), pa.float64())], names=["_id", "score"])

    return rows.mapInArrow(run, f"_id {kind}, score double").withColumnRenamed("_id", id_col)


def rate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted): train on labels, score all docs. Other columns are not read.

    Repeated rows are scored alike; a null id is not held out; without labels of
    both kinds every document gets one score. Empty docs give no rows.
    """
    scored = score(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    return scored.select(id_col, (fold_of(id_col) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
