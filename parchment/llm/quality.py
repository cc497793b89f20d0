"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.labels import fold, training_rows
from parchment.llm.text import buffers, letter_classes, mix, pieces, segment_sum, words

CLASSES = letter_classes(punctuation=True)


def features(texts: pa.Array, bits: int, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of words and punctuation runs (A-Z in lower case), and where each text's begin.

    Orders lie one after the other within a text. An n-gram that would reach into the next text isn't made.
    """
    found = words(*buffers(texts), CLASSES, lower=True)
    n, h = found.counts, found.hashes
    shift = np.uint64(64 - bits)
    if not len(h):
        return np.zeros(0, np.int64), found.first
    keys, rows = [], []
    key, row = h, found.row
    for k in range(ngram):
        if k:
            ok = row[k:] == row[:-k] if len(row) > k else np.zeros(0, bool)
            key = mix(key[: len(h) - k] * np.uint64(3) + h[k:])
            keys.append((key >> shift)[ok])
            rows.append(row[: len(h) - k][ok])
        else:
            keys.append(key >> shift)
            rows.append(row)
    order = np.argsort(np.concatenate(rows), kind="stable")
    counts = sum(np.maximum(n - k, 0) for k in range(ngram))
    return np.concatenate(keys)[order].astype(np.int64), np.concatenate([[0], np.cumsum(counts)])


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    bits: int
    ngram: int

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1: a sparse dot product of weights and n-gram frequencies; the bias for empty texts."""
        keys, first = features(texts, self.bits, self.ngram)
        total = segment_sum(self.weights[keys].astype(np.float64), first)
        return 1 / (1 + np.exp(-np.clip(self.bias + total * scale(np.diff(first)), -30, 30)))


def scale(n: np.ndarray) -> np.ndarray:
    """Frequencies are counts over the number of n-grams, times a constant that suits the step size."""
    return 40.0 / np.maximum(n, 1)


def fit(
    texts: pa.Array,
    labels: np.ndarray,
    bits: int = 18,
    ngram: int = 2,
    epochs: int = 6,
    alpha: float = 0.15,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.5,
    seed: int = 7,
) -> Model:
    """FTRL-Proximal over rows in a seeded order; both labels weigh alike in sum."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = 0.0
    share = max(labels.mean(), 1e-9) if len(labels) else 0.5
    weight = np.where(labels == 1, 0.5 / share, 0.5 / max(1 - share, 1e-9))

    def solved(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    sparse = []
    for part in pieces(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
        keys, first = features(part.column(0), bits, ngram)
        for a, b in zip(first[:-1], first[1:], strict=True):
            index, count = np.unique(keys[a:b], return_counts=True)
            sparse.append((index, count * scale(b - a)))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(labels)):
            index, x = sparse[k]
            w, b = solved(z[index], n[index], l1), float(solved(np.float64(bias_z), np.float64(bias_n), 0.0))
            p = 1 / (1 + np.exp(-np.clip(b + w @ x, -30, 30)))
            slope = (p - labels[k]) * weight[k]
            g = slope * x
            sigma = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / alpha
            z[index] += g - sigma * w
            n[index] += g * g
            bias_z += slope - (np.sqrt(bias_n + slope**2) - np.sqrt(bias_n)) / alpha * b
            bias_n += slope**2
    weights = solved(z, n, l1)
    return Model(weights.astype(np.float32), float(solved(np.float64(bias_z), np.float64(bias_n), 0.0)), bits, ngram)


def trained(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, most: int = 4000) -> Model:
    """Fit on at most ``most`` labelled rows outside the held-out fold; only their texts reach the driver."""
    rows = training_rows(docs, labels, "quality", folds, held_out, most).toArrow().sort_by("id")
    return fit(rows["text"].combine_chunks(), rows["label"].to_numpy())


def scored(docs: DataFrame, model: Model, folds: int, held_out: int) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row.

    Null and empty texts score the bias. Rows that repeat are scored alike; rows with a null id score with a null
    held_out. Nothing but the text enters a score. One pass, no shuffle; the model is 1 MB at 18 bits.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sent.value.score(part.column(1)))], names=["doc_id", "score"]
                )

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select(
        "doc_id",
        (fold(F.col("doc_id"), folds) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def classified(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, most: int = 4000) -> DataFrame:
    """Train on the labels outside the held-out fold and score every row of ``docs``; see ``scored`` for the columns. Without
    labels of both kinds all rows score alike."""
    return scored(docs, trained(docs, labels, folds, held_out, most), folds, held_out)
