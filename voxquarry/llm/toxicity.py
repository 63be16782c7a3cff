"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, look-alike letters of other scripts and full-width forms become Latin ones, invisible
characters go, and digits and signs between letters stand for the letters they imitate.  An Aho-Corasick
automaton finds the lexicon's entries (whole words and word beginnings) in one pass; a word counts with its
heaviest entry, and words inside an exception phrase do not count.  The sum of weights and the sum by length of the text go
through a logistic function.

Learning: the lexicon's weights are log odds of document frequencies over labelled rows, kept where a likelihood-ratio test is clear;
the logistic function is fitted to scores from lexicons learnt on the other half of the rows.  Labelled rows are a
bounded sample (`max_rows`, those with the smallest hashes of doc_id), so candidates (all entries of three toxic rows of the sample
or more) and the model are bounded by what the sample's texts hold, whatever the corpus; candidates and models are all that is broadcast.  Scoring maps rows where they are read and shuffles nothing.

Defined cases: a null or empty text has no words and gets the score of a sum of zero; without labels of both classes every score is 0;
labels that repeat a doc_id count once (the largest), null labels not at all; repeated documents are scored each;
very long texts are scored whole; an empty table gives no rows; extra columns, whatever their names, are ignored by `scores` and kept by `reject`.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import text_of, tidy

ALIKE = str.maketrans(
    dict(zip("аеорсухіјѕԁһӏкмтвнгɑοαρετνυκιβ", "aeopcyxijsdhlkmtbhraoapetvukib"))
    | {c: None for c in "­​‌‍⁠﻿"}
)
DIGITS = str.maketrans("01345789@$!", "oieastbqasi")
AMID = re.compile(r"(?<=[^\W\d_])[0-9@$!]+(?=[^\W\d_])|(?<![\w@$!])[0-9@$!]{1,2}(?=[^\W\d_]{2})")
WORD = re.compile(r"[^\W_]+")
PREFIXES = (4, 5, 6, 7)
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum", "scum line", "stupid fresh", "sore loser")
CLEAR = 25.0


def folded(text: str) -> list[str]:
    """The words of a text as the lexicon sees them."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower().translate(ALIKE)
    else:
        text = text.lower()
    text = AMID.sub(lambda m: m[0].translate(DIGITS), text)
    return WORD.findall(text)


def entries(words: list[str]) -> set[str]:
    """Lexicon entries that a text has: ' word ' for a whole word, ' beg' for a beginning."""
    found = set()
    for w in set(words):
        found.add(f" {w} ")
        found.update(f" {w[:n]}" for n in PREFIXES if len(w) >= n)
    return found


@dataclass
class Model:
    lexicon: dict[str, float]
    exceptions: tuple[str, ...]
    weights: tuple[float, float, float] | None

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for e, w in self.lexicon.items():
            a.add_word(e, (len(e), w))
        for p in self.exceptions:
            a.add_word(e := f" {' '.join(folded(p))} ", (len(e), None))
        if len(a):
            a.make_automaton()
        return a


def weight_of(automaton, text: str) -> tuple[float, int]:
    """Sum of the weights of the words found, and the number of words."""
    words = folded(text)
    if not words or not len(automaton):
        return 0.0, len(words)
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (n, w) in automaton.iter(f" {' '.join(words)} "):
        start = end - n + 1
        if w is None:
            spared.append((start, end))
        elif w > best.get(start, 0.0):
            best[start] = w
    for a, z in spared:
        for s in [s for s in best if a <= s < z]:
            del best[s]
    return math.fsum(best.values()), len(words)


def inputs(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(100 * total / np.maximum(words, 20))], axis=1)


def _counts(rows: DataFrame, wanted) -> DataFrame:
    """(entry, fold, n) of rows (text, fold), of entries in the broadcast `wanted` only, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for text, fold in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = entries(folded(text))
                counts.update((e, fold) for e in (found if wanted is None else found & wanted.value))
        if counts:
            e, f = zip(*counts)
            yield pa.RecordBatch.from_arrays([pa.array(e), pa.array(f, pa.int32()), pa.array(list(counts.values()), pa.int64())], ["entry", "fold", "n"])

    return rows.mapInArrow(tidy(run), "entry string, fold int, n long").groupBy("entry", "fold").agg(F.sum("n").alias("n"))


def _lexicon(pos: dict[str, float], neg: dict[str, float], p: float, q: float) -> dict[str, float]:
    """Entries whose share of toxic documents is clearly above their share of the others, with their log odds."""
    found = {}
    for e, a in sorted(pos.items()):
        b = neg.get(e, 0)
        expected = (a + b) * p / (p + q)
        test = 2 * (a * math.log(a / expected) + (b * math.log(b / (a + b - expected)) if b else 0))
        weight = math.log((a + 0.5) / (p + 1)) - math.log((b + 0.5) / (q + 1))
        if test >= CLEAR and weight >= 2:
            found[e] = weight
    return found


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """A model from at most max_rows labelled rows; rows to leave out of learning must be filtered from labels before."""
    spark = docs.sparkSession
    sample = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("s_id")).agg(F.max(label_col).cast("int").alias("y"))
    sample = sample.orderBy(F.xxhash64("s_id"), "s_id").limit(max_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("d_id"), text_of(text_col).alias("text"))
    rows = texts.join(F.broadcast(sample), F.col("d_id") == F.col("s_id")).select("text", F.pmod(F.crc32(F.col("s_id").cast("string").cast("binary")), F.lit(2)).cast("int").alias("fold"), "y")
    sizes = {(r.y, r.fold): r.n for r in rows.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = lambda y, f: sizes.get((y, f), 0)
    if not (size(1, 0) + size(1, 1) and size(0, 0) + size(0, 1)):
        return Model({}, exceptions, None)
    # entries of toxic rows first; only those are counted in the others
    least = 3
    toxic = _counts(rows.filter("y = 1").select("text", "fold"), None).groupBy("entry").pivot("fold", [0, 1]).agg(F.first("n")).na.fill(0).filter(F.col("0") + F.col("1") >= least)
    pos = {r[0]: (r[1], r[2]) for r in toxic.collect()}
    wanted = spark.sparkContext.broadcast(frozenset(pos))
    neg: dict[str, list[int]] = {}
    for r in _counts(rows.filter("y = 0").select("text", "fold"), wanted).collect():
        neg.setdefault(r.entry, [0, 0])[r.fold] = r.n

    def learnt(folds: tuple[int, ...]) -> dict[str, float]:
        add = lambda d: {e: n for e, v in d.items() if (n := sum(v[f] for f in folds))}
        return _lexicon(add(pos), add(neg), sum(size(1, f) for f in folds), sum(size(0, f) for f in folds))

    halves = spark.sparkContext.broadcast([Model(learnt((1,)), exceptions, None), Model(learnt((0,)), exceptions, None)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [m.automaton() for m in halves.value]
        for b in batches:
            out = [weight_of(own[f], t) for t, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.int64()), b.column(2)], ["total", "words", "y"])

    seen = rows.select("text", "fold", F.col("y").cast("int").alias("y")).mapInArrow(tidy(run), "total double, words long, y int").toPandas().sort_values(["total", "words", "y"])
    return Model(learnt((0, 1)), exceptions, fitted(inputs(seen["total"].to_numpy(), seen["words"].to_numpy()), seen["y"].to_numpy(float)))


def fitted(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton's method with a light penalty; slopes below zero are left out."""
    use = [0, 1, 2]
    while True:
        w, xs = np.zeros(len(use)), x[:, use]
        ridge = np.diag([1e-6] + [0.05] * (len(use) - 1))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(xs @ w, -30, 30)))
            grad = xs.T @ (p - y) + ridge @ w
            step = np.linalg.solve(xs.T @ (xs * (p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(len(use)), grad)
            step *= min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        bad = [u for u, v in zip(use[1:], w[1:]) if v < 0]
        if not bad:
            out = dict(zip(use, map(float, w)))
            return out.get(0, 0.0), out.get(1, 0.0), out.get(2, 0.0)
        use.remove(bad[0])


def score(model: Model, text: Column, spark) -> Column:
    """The score of a text, from 0 to 1."""
    if model.weights is None:
        return F.lit(0.0)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        a = m.automaton()
        for texts in batches:
            found = [weight_of(a, t) for t in texts]
            x = inputs(np.array([f[0] for f in found], float), np.array([f[1] for f in found], float)) if found else np.zeros((0, 3))
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ np.array(m.weights), -30, 30))))

    return scored(text)


def held_out(column: str) -> Column:
    """True for the fifth of doc_ids that learning never sees."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; learns from labels of rows that are not held out."""
    model = train(docs, labels.filter(~held_out(id_col)), id_col=id_col, text_col=text_col, **options)
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), score(model, text_of(text_col), docs.sparkSession).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """docs without the rows that the model calls toxic."""
    return docs.filter(score(model, text_of(text_col), docs.sparkSession) < 0.5)
