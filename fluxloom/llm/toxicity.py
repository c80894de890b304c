"""Operator 7: toxicity by cumulative-link ordinal regression on sparse text features.

Grades are ordered: 0 clean, 1 and up toxic by severity. One weight vector w serves all ordered
thresholds: P(grade > k) = 1 / (1 + exp(theta_k - w.x)), theta_0 < theta_1 < .... The output is the
expected severity, the sum of P(grade > k) over k, and the probability that the grade is over 0.

Features of a document are whether it has each of a chosen list of words and word starts. They
are chosen and fitted on a bounded sample of labelled rows; scoring reads whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"\w+")
#: Lengths of the word starts that are features beside whole words.
STARTS = (5, 6, 7, 8)
#: Bounds of the training sample: labelled rows, characters of a text that may be in it, features.
SAMPLE_ROWS, SAMPLE_CHARS, FEATURES = 6000, 50_000, 4000
#: Words kept with their features in each worker before the dictionary is emptied.
KEPT_WORDS = 100_000


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in STARTS if len(word) >= n)]


@dataclass
class Model:
    """weights: by feature; thresholds: ascending, one fewer than grades."""

    weights: dict[str, float]
    thresholds: list[float]

    def probabilities(self, score: float) -> list[float]:
        """P(grade > k) for each threshold."""
        return [float(1 / (1 + np.exp(np.clip(t - score, -60, 60)))) for t in self.thresholds]


def fit(texts: list[str], grades: list[int], features: int = FEATURES, rounds: int = 400, rate: float = 0.1, ridge: float = 1e-3, seen: int = 4, ratio: float = 8.0) -> Model:
    """Cumulative-link regression by full-batch Adam; fewer than two grades give a model that rejects nothing.

    Texts that repeat count once. The list of features: those in at least ``seen`` documents of a
    grade over 0 and in those ``ratio`` times as often as in clean ones, by log odds and number.
    """
    once = {t or "": g for t, g in sorted(zip(texts, grades, strict=True), key=lambda x: (x[0] or "", x[1]))}
    texts, grades = list(once), list(once.values())
    y = np.array(grades, np.int64)
    if len(y) == 0 or y.max() == 0 or y.min() > 0:
        return Model({}, [60.0])
    bad, clean = counts(texts, [g > 0 for g in grades], lambda words: {f for w in words for f in features_of(w)}, seen)
    n_bad, n_clean = int((y > 0).sum()), int((y == 0).sum())
    odds = {f: np.log((c + 0.5) / (n_bad - c + 0.5)) - np.log((clean[f] + 0.5) / (n_clean - clean[f] + 0.5)) for f, c in bad.items() if c / n_bad >= ratio * (clean[f] + 0.5) / n_clean}
    chosen = sorted(odds, key=lambda f: (-odds[f] * np.sqrt(bad[f]), f))[:features]
    index = {f: k for k, f in enumerate(chosen)}
    rows = [sorted({index[f] for w in set(WORD.findall(t.lower())) for f in features_of(w) if f in index}) for t in texts]
    col, row = np.array([c for r in rows for c in r], np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    steps = int(y.max())
    w, base, gaps = np.zeros(len(chosen)), np.array([1.0]), np.full(steps - 1, 0.0)
    moments = [np.zeros(2 * len(chosen)), np.zeros(2), np.zeros(2 * (steps - 1))]
    for i in range(1, rounds + 1):
        theta = np.concatenate([base, base + np.cumsum(np.exp(gaps))])
        score = np.bincount(row, w[col], len(y)) if len(col) else np.zeros(len(y))
        over = 1 / (1 + np.exp(np.clip(theta - score[:, None], -60, 60)))
        # likelihood of grade g: P(> g-1) - P(> g)
        full = np.concatenate([np.ones((len(y), 1)), over, np.zeros((len(y), 1))], axis=1)
        at = np.arange(len(y))
        like = np.maximum(full[at, y] - full[at, y + 1], 1e-9)
        slope = full * (1 - full)
        d_score = (slope[at, y] - slope[at, y + 1]) / like
        d_theta = np.zeros((len(y), steps))
        lower, upper = y > 0, y < steps
        d_theta[at[lower], y[lower] - 1] -= slope[at[lower], y[lower]] / like[lower]
        d_theta[at[upper], y[upper]] += slope[at[upper], y[upper] + 1] / like[upper]
        g_theta = d_theta.mean(axis=0)
        g_w = (np.bincount(col, d_score[row], len(w)) / len(y) if len(col) else np.zeros(len(w))) - ridge * w / np.sqrt(len(y))
        tail = np.cumsum(g_theta[::-1])[::-1]
        g_gaps = tail[1:] * np.exp(gaps)
        for value, grad, m in zip((w, base, gaps), (g_w, np.array([g_theta.sum()]), g_gaps), moments, strict=True):
            half = len(value)
            m[:half] = 0.9 * m[:half] + 0.1 * grad
            m[half:] = 0.999 * m[half:] + 0.001 * grad**2
            value += rate * (m[:half] / (1 - 0.9**i)) / (np.sqrt(m[half:] / (1 - 0.999**i)) + 1e-8)
    theta = np.concatenate([base, base + np.cumsum(np.exp(gaps))])
    return Model({f: float(x) for f, x in zip(chosen, w, strict=True) if abs(x) > 1e-4}, theta.tolist())


def counts(texts: list[str], toxic: list, of, seen: int) -> tuple[Counter, Counter]:
    """Toxic and clean texts with each feature, of features in at least ``seen`` toxic ones.

    Clean texts are counted after the others, so that only what toxic texts hold is ever kept.
    """
    bad, clean = Counter(), Counter()
    for t, g in zip(texts, toxic, strict=True):
        if g:
            bad.update(of(set(WORD.findall((t or "").lower()))))
    bad = Counter({f: c for f, c in bad.items() if c >= seen})
    for t, g in zip(texts, toxic, strict=True):
        if not g:
            clean.update(f for f in of(set(WORD.findall((t or "").lower()))) if f in bad)
    return bad, clean


def severity_grades(texts: list[str], toxic: list[int]) -> list[int]:
    """Grades 0, 1, 2 from a 0/1 label: toxic texts are split at the median number of different marker words.

    Marker words are in at least three toxic texts and forty times as often in toxic ones as in clean ones.
    """
    bad, clean = counts(texts, toxic, set, 3)
    n_bad, n_clean = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    marks = {w for w, c in bad.items() if c / n_bad >= 40 * (clean[w] + 0.1) / n_clean}
    found = [len(marks.intersection(WORD.findall((t or "").lower()))) if toxic[k] else 0 for k, t in enumerate(texts)]
    middle = float(np.median([d for d, t in zip(found, toxic, strict=True) if t])) if any(toxic) else 0.0
    return [0 if not t else 1 + (d > middle) for d, t in zip(found, toxic, strict=True)]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on the labelled rows with the smallest hashes of doc_id, at most ``sample_rows`` of them.

    Rows with a null label, id or text, and texts of over ``sample_chars`` characters are no
    training rows. A document with labels that differ counts as toxic. No rows: nothing is rejected.
    """
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    one = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select("doc_id", "text").where(F.length("text") <= sample_chars).join(F.broadcast(one), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = sorted(texts.collect())  # at most sample_rows rows of sample_chars characters
    words, toxic = [r["text"] for r in rows], [int(r["toxic"] > 0) for r in rows]
    return fit(words, severity_grades(words, toxic))


def scorer(model: Model) -> Callable[[list], list[list[float]]]:
    """A function from a list of texts to P(grade > k) of each, with the features of words remembered."""
    weights, known = model.weights, {}

    def run(texts: list) -> list[list[float]]:
        if len(known) > KEPT_WORDS:
            known.clear()
        out = []
        for text in texts:
            hit: set[str] = set()
            for word in set(WORD.findall((text or "").lower())):
                found = known.get(word)
                if found is None:
                    found = known[word] = tuple(f for f in features_of(word) if f in weights)
                if found:
                    hit.update(found)
            out.append(model.probabilities(sum(weights[f] for f in sorted(hit))))
        return out

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, severity, p_toxic, grade) for each row; grade counts the thresholds passed at 0.5.

    Whole texts are read. A null or empty text has no features: its score is zero. Repeated rows
    stay repeated; a null doc_id is kept; other columns are ignored; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(model)
        for batch in batches:
            p = of(common.column(batch, "text"))
            severity, p_toxic, grade = [sum(x) for x in p], [x[0] for x in p], [sum(y >= 0.5 for y in x) for x in p]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(severity, pa.float64()), pa.array(p_toxic, pa.float64()), pa.array(grade, pa.int32())], names=["doc_id", "severity", "p_toxic", "grade"])

    return common.map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")), run, "doc_id long, severity double, p_toxic double, grade int")


def drop_toxic(docs: DataFrame, model: Model, most: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with their columns, whose text has P(grade > 0) of at most ``most``.

    Each row is judged by its whole text: rows that share an id, or have none, are judged apart, and
    repeated rows stay or go together. A null or empty text has a score of zero. Other columns, of any
    name, are returned as they are; an empty table gives an empty one.
    """
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([x[0] <= most for x in of(batch.column(place).to_pylist())], pa.bool_()))

    return common.map_batches(docs, run, docs.schema)
