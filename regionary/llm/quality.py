"""Quality classifier: a support vector machine on n-gram indicators scaled by naive Bayes log-count ratios.

Features are indicators of hashed word unigrams and of unigrams, bigrams and trigrams of word
shapes (case, marks and their repetition). Each is scaled by its class log-count ratio; a linear hinge-loss
model is then fitted by dual coordinate descent, mixed with the mean ratio, and its margin is
turned into a probability on rows kept out of the fit.

The fit takes at most ``grams.LABELLED`` rows of each class, those of least id hash; every document is
scored, whole. Defined results: null and empty texts are scored by the intercept; labels other than 0 and 1, and
null ones, teach nothing; repeated rows are scored alike; without both classes the score is the share of
label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams

SMOOTH = 1.0
PENALTY = 1.0
SWEEPS = 8
BLEND = 0.5
SHAPES = np.uint64(0x9E3779B97F4A7C15)


def indicators(text: str | None, words: grams.Words) -> np.ndarray:
    """Distinct hashed features of a text."""
    split = (text or "").split()
    if not split:
        return np.zeros(0, np.int64)
    n = words.numbers(split)
    s = words.shape[n]
    parts = [words.plain[np.unique(n)], s]
    with np.errstate(over="ignore"):
        if len(s) > 1:
            two = s[:-1] * SHAPES + s[1:]
            two ^= two >> np.uint64(29)
            parts.append(two * SHAPES)
            if len(s) > 2:
                three = two[:-1] * SHAPES + s[2:]
                three ^= three >> np.uint64(31)
                parts.append(three * SHAPES)
    ids = np.concatenate([np.unique(x) for x in parts]) >> np.uint64(64 - grams.BITS)
    return np.unique(ids).astype(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = grams.words_here()
    for batch in batches:
        ids = [indicators(t.as_py(), words).astype("<u4").tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(ids, pa.binary())], names=["doc_id", "label", "ids"])


def hinge(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, penalty: float = PENALTY, sweeps: int = SWEEPS) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; each class weighs the same. Returns weights and intercept."""
    rng = np.random.default_rng(7)
    w, b = np.zeros(len(scale)), 0.0
    dual = np.zeros(len(rows))
    value = [scale[r] / max(1.0, np.sqrt(len(r))) for r in rows]
    square = np.array([v @ v + 1.0 for v in value])
    bound = np.where(y > 0, penalty * len(y) / (2 * (y > 0).sum()), penalty * len(y) / (2 * (y < 0).sum()))
    for _ in range(sweeps):
        for i in rng.permutation(len(rows)):
            r, v = rows[i], value[i]
            gap = y[i] * (w[r] @ v + b) - 1
            new = min(max(dual[i] - gap / square[i], 0.0), bound[i])
            if new != dual[i]:
                step = (new - dual[i]) * y[i]
                w[r] += step * v
                b += step
                dual[i] = new
    return w, b


def sigmoid_fit(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic link by Newton steps, with a little shrinkage."""
    a, c = 1.0, 0.0
    x = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ [a, c], -30, 30)))
        grad = x.T @ (p - label) + 1e-2 * np.array([a - 1, c])
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a, c = a - step[0], c - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(c)


class Model:
    """Dense weights over hashed features; ``score`` is a probability of label 1."""

    def __init__(self, weight: np.ndarray, bias: float, slope: float, offset: float):
        self.weight, self.bias, self.slope, self.offset = weight.astype(np.float32), bias, slope, offset

    def margin(self, ids: np.ndarray) -> float:
        return float(self.weight[ids].sum(dtype=np.float64)) / max(1.0, float(np.sqrt(len(ids)))) + self.bias

    def score(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(ids) + self.offset, -30, 30))))


def fit(rows: list[np.ndarray], label: np.ndarray) -> Model:
    size = 1 << grams.BITS
    if len(rows) == 0 or label.min() == label.max():
        p = float(np.clip(label.mean() if len(label) else 0.5, 0.01, 0.99))
        return Model(np.zeros(size), 0.0, 1.0, float(np.log(p / (1 - p))))
    kept = np.arange(len(rows)) % 5 != 0 if len(rows) >= 50 else np.ones(len(rows), bool)
    if len(set(label[kept])) < 2:
        kept[:] = True
    count = np.full((2, size), SMOOTH)
    for r, k in zip((r for r, use in zip(rows, kept, strict=True) if use), label[kept], strict=True):
        count[k, r] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    ratio[(count.sum(0) - 2 * SMOOTH) < 2] = 0.0
    y = np.where(label == 1, 1.0, -1.0)
    w, b = hinge([r for r, use in zip(rows, kept, strict=True) if use], y[kept], ratio)
    w = BLEND * w + (1 - BLEND) * np.abs(w).mean()
    model = Model(w * ratio, b, 1.0, 0.0)
    test = ~kept if (~kept).any() and len(set(label[~kept])) == 2 else kept
    margin = np.array([model.margin(r) for r, use in zip(rows, test, strict=True) if use])
    model.slope, model.offset = sigmoid_fit(margin, label[test].astype(float))
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1) -> Model:
    """Learns from labels whose id's crc32 modulo ``folds`` is not ``held``."""
    got = grams.labelled(docs, labels, label, grams.mod("doc_id", folds) != held, _features, "doc_id long, label int, ids binary")
    return fit([np.frombuffer(r["ids"], "<u4").astype(np.int64) for r in got], np.array([r["label"] for r in got], np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document row: doc_id and score, from the text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = grams.words_here()
        for batch in batches:
            got = [model.score(indicators(t.as_py(), words)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(got, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    out = score(docs, train(docs, labels, "quality", folds, held))
    return out.select("doc_id", (grams.mod("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
