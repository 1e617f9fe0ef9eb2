"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, from document labels.

A document is toxic if any of its sentences is: P = 1 - prod(1 - p_s), with p_s a logistic score of
the sentence's hashed words and word stems. Only documents carry labels; the gradient of the document's likelihood
reaches the sentences by way of the noisy-or. Scoring also returns the worst sentence, as a range of words.

The fit takes at most ``LABELLED`` rows of each class, those of least id hash; every document is
scored, whole. Defined results: null and empty texts score 0; sentences end at a word that ends in a full stop,
question or exclamation mark or ellipsis, and after ``LONGEST`` words at the latest; labels other than
0 and 1 teach nothing; without both classes the score is 0 throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams
from .common import lean

LONGEST = 40
LABELLED = 2500
WIDTH = 1 + len(grams.STEMS)
#: Chosen by four-fold cross-validation within the rows that may teach: the least logarithmic loss, with BIAS and TRUST as they were.
EPOCHS = 40
RATE = 0.01
SHRINK = 0.003
MOMENTUM = 0.5
CLEAN_WEIGHT = 1.0
LEAST_DOCS = 5
TRUST = 8.0
BIAS = -8.0
#: How many features are worked on at once in the fit, to bound the driver's memory.
PART = 1 << 19


def sentences(text: str | None, words: grams.Words) -> tuple[np.ndarray, np.ndarray]:
    """Per word of a text its hashed features (the word and its stems; 0 for none) and the number of its sentence."""
    split = (text or "").split()
    if not split:
        return np.zeros((0, WIDTH), np.int64), np.zeros(0, np.int64)
    n = words.numbers(split)
    ids = (np.column_stack([words.plain[n], words.stems[n]]) >> np.uint64(64 - grams.BITS)).astype(np.int64)
    new = np.zeros(len(n), bool)
    new[1:] = words.last[n[:-1]]
    first = np.flatnonzero(np.concatenate([[True], new[1:]]))
    place = np.arange(len(n))
    since = place - first[np.searchsorted(first, place, "right") - 1]
    return ids, np.cumsum(new | ((since % LONGEST == 0) & (since > 0)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = grams.words_here()
    for batch in batches:
        got = [sentences(t.as_py(), words) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array([a.astype("<u4").tobytes() for a, _ in got], pa.binary()), pa.array([b.astype("<u4").tobytes() for _, b in got], pa.binary())],
            names=["doc_id", "label", "ids", "sentence"],
        )


def _log_none(z: np.ndarray) -> np.ndarray:
    """log(1 - sigmoid(z))."""
    return -np.logaddexp(0, z)


class Model:
    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight.astype(np.float32), bias

    def sentence_scores(self, ids: np.ndarray, sentence: np.ndarray) -> np.ndarray:
        return np.bincount(sentence, weights=self.weight[ids].sum(1)) + self.bias

    def score(self, ids: np.ndarray, sentence: np.ndarray) -> tuple[float, int, float]:
        """Score of the document, number and score of its worst sentence."""
        if not len(ids):
            return 0.0, -1, 0.0
        z = self.sentence_scores(ids, sentence)
        worst = int(z.argmax())
        return float(-np.expm1(_log_none(z).sum())), worst, float(np.exp(-np.logaddexp(0, -z[worst])))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray) -> Model:
    """Gradient ascent with momentum on the likelihood of the document labels.

    ``rows`` is emptied, to hold each feature once. Copies of a text teach once; clean documents weigh ``CLEAN_WEIGHT`` times. The bias is fixed, so that the many
    sentences of a long clean document don't add up. It starts at the words' log-odds, less so for rare ones.
    """
    size = 1 << grams.BITS
    first = {ids.tobytes(): k for k, (ids, _) in reversed(list(enumerate(rows))) if len(ids)}
    use = sorted(first.values())
    every, rows, label = rows, [rows[k] for k in use], label[use]
    every.clear()
    if not rows or label.min() == label.max():
        return Model(np.zeros(size), -50.0)
    found = np.zeros((2, size))
    for (ids, _), k in zip(rows, label, strict=True):
        found[k, np.unique(ids)] += 1
    number = np.bincount(label, minlength=2)
    live = np.flatnonzero(found.sum(0) >= LEAST_DOCS)
    place = np.full(size, len(live), np.int32)
    place[live] = np.arange(len(live), dtype=np.int32)
    place[0] = len(live)
    ids = place[np.concatenate([r[0].ravel() for r in rows])]
    counts = np.array([int(r[1][-1]) + 1 for r in rows])
    begin = np.cumsum(counts) - counts
    sentence = np.concatenate([(r[1] + s).astype(np.int32) for r, s in zip(rows, begin, strict=True)])
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), counts)
    sentence = np.repeat(sentence, WIDTH)
    share = (found[:, live] + 0.5) / (number[:, None] + 1)
    seen = found[:, live].sum(0)
    w = np.append(2 * np.maximum(np.log(share[1] / share[0]) - 1, 0) * seen / (seen + TRUST), 0.0)
    weight = np.where(label == 1, 1.0, CLEAN_WEIGHT)
    speed = np.zeros(len(w))
    rows.clear()
    parts = [slice(k, k + PART) for k in range(0, len(ids), PART)]
    for _ in range(EPOCHS):
        z = np.full(len(doc), BIAS)
        for part in parts:
            z += np.bincount(sentence[part], weights=w[ids[part]], minlength=len(doc))
        none = np.bincount(doc, weights=_log_none(z))
        p = -np.expm1(none)
        pull = np.where(label == 1, np.exp(none) / np.maximum(p, 1e-9), -1.0) * weight
        by_sentence = pull[doc] / (1 + np.exp(-np.clip(z, -50, 50)))
        g = np.zeros(len(w))
        for part in parts:
            g += np.bincount(ids[part], weights=by_sentence[sentence[part]], minlength=len(w))
        speed = MOMENTUM * speed + np.clip(RATE * g - SHRINK * w, -1, 1)
        w += speed
        w[-1] = 0.0
    full = np.zeros(size)
    full[live] = w[:-1]
    full[0] = 0.0
    return Model(full, BIAS)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0) -> Model:
    """Learns from labels whose id's crc32 modulo ``folds`` is not ``held``."""
    got = grams.labelled(docs, labels, label, grams.mod("doc_id", folds) != held, _features, "doc_id long, label int, ids binary, sentence binary", LABELLED)
    rows = [(np.frombuffer(r["ids"], "<i4").reshape(-1, WIDTH), np.frombuffer(r["sentence"], "<i4")) for r in got]
    label = np.array([r["label"] for r in got], np.int64)
    del got
    return fit(rows, label)


SCORED = "doc_id long, score double, worst_sentence int, worst_score double, worst_first_word int, worst_words int"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document row: its score and its worst sentence (-1 without words) as a range of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = grams.words_here()
        for batch in batches:
            rows = []
            for t in batch.column("text"):
                ids, sentence = sentences(t.as_py(), words)
                p, worst, high = model.score(ids, sentence)
                at = np.searchsorted(sentence, [worst, worst + 1]) if worst >= 0 else (0, 0)
                rows.append((p, worst, high, int(at[0]), int(at[1] - at[0])))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.float64(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in SCORED.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCORED)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    out = score(docs, train(docs, labels, "toxic", folds, held))
    return out.select("doc_id", (grams.mod("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_sentence", "worst_score")


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The documents whose score is under ``limit``, with their own columns; judged row by row, no join."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = grams.words_here()
        for batch in batches:
            good = [model.score(*sentences(t.as_py(), words))[0] < limit for t in batch.column("text")]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(lean(run, keep=True), schema)
