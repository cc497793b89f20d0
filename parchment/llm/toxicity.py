"""Toxicity: a convolutional text classifier in numpy.

Words are hashed to embedding rows; filters of several widths slide over them, each filter keeps its maximum, and a
logistic layer adds these up. A filter of width m is a sum of m products of an embedding with a slice of the
filter; the products of every known word are taken once, so that scoring a text is adding up rows of small tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.labels import fold, training_rows
from parchment.llm.text import letter_classes, pieces, word_hashes

CLASSES = letter_classes(punctuation=False)
WIDTHS = (1, 2, 3)


def hashed(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word (A-Z in lower case, punctuation apart), and where each text's words begin."""
    hashes, first = word_hashes(texts, CLASSES, lower=True)
    return (hashes >> np.uint64(64 - bits)).astype(np.int64), first


def padded(ids: np.ndarray, first: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Put ``pad`` zeros (the row of unknown words) after each text, so no filter reaches into the next one."""
    n = np.diff(first)
    out = np.zeros(len(ids) + pad * len(n), ids.dtype)
    out[np.arange(len(ids)) + pad * np.repeat(np.arange(len(n)), n)] = ids
    return out, first + pad * np.arange(len(first))


@dataclass
class Model:
    rows: np.ndarray  # bucket -> embedding row; 0: unknown, a zero vector
    embedding: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width, dimensions, filters)
    biases: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    bits: int
    platt: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)

    def tables(self) -> dict[int, np.ndarray]:
        """Products of each embedding with each slice: width -> (width, rows, filters)."""
        return {m: np.einsum("rd,mdf->mrf", self.embedding, f).astype(np.float32) for m, f in self.filters.items()}

    def pooled(self, ids: np.ndarray, first: np.ndarray, tables: dict[int, np.ndarray]) -> np.ndarray:
        """Maximum of every filter over each text, negative ones cut off."""
        pad = max(WIDTHS)
        ids, first = padded(ids, first, pad)
        beyond = (first[1:, None] - np.arange(1, pad)).ravel()  # places after a text's end whose filters reach into the next text
        parts = []
        for m, table in tables.items():
            s = table[0][ids]
            for j in range(1, m):
                s[:-j] += table[j][ids[j:]]
            s[beyond] = -np.inf
            parts.append(np.maximum(np.maximum.reduceat(s, first[:-1], axis=0) + self.biases[m], 0))
        return np.concatenate(parts, axis=1)

    def margins(self, texts: pa.Array, tables: dict[int, np.ndarray]) -> np.ndarray:
        parts = [np.zeros(0)]
        for part in pieces(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
            ids, first = hashed(part.column(0), self.bits)
            parts.append(self.pooled(self.rows[ids], first, tables) @ self.out + self.out_bias)
        return np.concatenate(parts)

    def score(self, texts: pa.Array, tables: dict[int, np.ndarray]) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * self.margins(texts, tables) + b, -30, 30)))


def _adam(state: dict, key: str, value: np.ndarray, grad: np.ndarray, rate: float, step: int) -> None:
    m, v = state.setdefault(key, (np.zeros_like(value), np.zeros_like(value)))
    m += 0.1 * (grad - m)
    v += 0.001 * (grad * grad - v)
    value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def loss_and_gradients(
    emb: np.ndarray, filters: dict[int, np.ndarray], biases: dict[int, np.ndarray], out: np.ndarray, out_bias: float,
    x: np.ndarray, start: np.ndarray, pad: int, y: np.ndarray, weight: np.ndarray,
) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted logistic loss of texts of embedding rows ``x``, which begin at ``start`` and end in ``pad`` zeros, and its slopes."""
    n, n_filters, dims = len(start) - 1, len(biases[WIDTHS[0]]), emb.shape[1]
    vectors = emb[x]
    pooled, places = [], []
    for m in WIDTHS:
        s = np.zeros((len(x), n_filters))
        for j in range(m):
            s[: len(x) - j] += vectors[j:] @ filters[m][j]
        top = np.empty((n, n_filters), np.int64)
        for k in range(n):
            top[k] = start[k] + s[start[k] : start[k + 1] - pad + 1].argmax(0)
        places.append(top)
        pooled.append(np.maximum(np.take_along_axis(s, top, 0) + biases[m], 0))
    features = np.concatenate(pooled, 1)
    margin = np.clip(features @ out + out_bias, -30, 30)
    p = 1 / (1 + np.exp(-margin))
    loss = float((weight * (np.logaddexp(0, margin) - y * margin)).sum())
    slope = (p - y) * weight
    back = slope[:, None] * out[None, :] * (features > 0)
    grads = {"emb": np.zeros_like(emb), "out": features.T @ slope, "bias": slope.sum()}
    for i, m in enumerate(WIDTHS):
        g, top = back[:, i * n_filters : (i + 1) * n_filters], places[i]
        grads[f"f{m}"], grads[f"b{m}"] = np.empty_like(filters[m]), g.sum(0)
        for j in range(m):
            at = np.minimum(top + j, len(x) - 1)
            grads[f"f{m}"][j] = np.einsum("tf,tfd->df", g, vectors[at])  # text, filter, dimension
            np.add.at(grads["emb"], x[at].ravel(), (g[:, :, None] * filters[m][j].T[None]).reshape(-1, dims))
    return loss, grads


def fit(
    texts: pa.Array,
    labels: np.ndarray,
    langs: list[str | None],
    bits: int = 20,
    dims: int = 8,
    n_filters: int = 8,
    least_docs: int = 3,
    epochs: int = 12,
    batch: int = 64,
    rate: float = 0.02,
    decay: float = 1e-3,
    seed: int = 11,
    restarts: int = 3,
) -> Model:
    """Train with Adam on four fifths of the rows, from several beginnings; keep the model that is best by F1 on the last fifth, and
    scale margins and set language thresholds there.

    Only buckets that occur in ``least_docs`` training texts get an embedding; the rest share the zero row. Maximum
    pooling sends a filter's gradient to one place of each text.
    """
    ids, first = hashed(texts, bits)
    n = len(labels)
    doc = np.repeat(np.arange(n), np.diff(first))
    pairs = np.unique(ids * np.int64(max(n, 1)) + doc)
    bucket, docs_with = np.unique(pairs // max(n, 1), return_counts=True)
    known = bucket[docs_with >= least_docs]
    rows = np.zeros(1 << bits, np.int32)
    rows[known] = np.arange(1, len(known) + 1)
    if n == 0 or labels.min() == labels.max():
        sure = -3.0 if n == 0 or labels[0] == 0 else 3.0
        flat = {m: np.zeros((m, dims, n_filters)) for m in WIDTHS}
        return Model(rows, np.zeros((len(known) + 1, dims)), flat, {m: np.zeros(n_filters) for m in WIDTHS}, np.zeros(n_filters * len(WIDTHS)), sure, bits)
    local = rows[ids].astype(np.int64)
    order = np.random.default_rng(seed).permutation(n)
    train, check = order[: max(1, n * 4 // 5)], order[max(1, n * 4 // 5) :]
    check = check if len(check) else train
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    held, best, chosen = texts.take(pa.array(check)), -1.0, None
    for k in range(restarts):
        model = _trained_once(rows, len(known), local, first, labels, train, weight, bits, dims, n_filters, epochs, batch, rate, decay, seed + k)
        found = best_f1(model.margins(held, model.tables()), labels[check])
        if found > best:
            best, chosen = found, model
    calibrate(chosen, texts, labels, langs, check)
    return chosen


def _trained_once(
    rows: np.ndarray, n_known: int, local: np.ndarray, first: np.ndarray, labels: np.ndarray, train: np.ndarray, weight: np.ndarray,
    bits: int, dims: int, n_filters: int, epochs: int, batch: int, rate: float, decay: float, seed: int,
) -> Model:
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.3, (n_known + 1, dims))
    emb[0] = 0
    filters = {m: rng.normal(0, 0.5 / np.sqrt(m), (m, dims, n_filters)) for m in WIDTHS}
    biases = {m: np.zeros(n_filters) for m in WIDTHS}
    model = Model(rows, emb, filters, biases, rng.normal(0, 0.3, n_filters * len(WIDTHS)), 0.0, bits)
    out_bias, pad, state, step = np.zeros(1), max(WIDTHS), {}, 0
    for _ in range(epochs):
        for at in range(0, len(train), batch):
            step += 1
            chosen = train[at : at + batch]
            sizes = first[chosen + 1] - first[chosen]
            begin = np.concatenate([[0], np.cumsum(sizes)])
            take = np.arange(begin[-1]) - np.repeat(begin[:-1], sizes) + np.repeat(first[chosen], sizes)
            x, start = padded(local[take], begin, pad)
            y, w = labels[chosen], weight[chosen] / len(chosen)
            _, grads = loss_and_gradients(emb, filters, biases, model.out, out_bias[0], x, start, pad, y, w)
            for m in WIDTHS:
                _adam(state, f"f{m}", filters[m], grads[f"f{m}"] + decay * filters[m], rate, step)
                _adam(state, f"b{m}", biases[m], grads[f"b{m}"], rate, step)
            grad_emb = grads["emb"]
            grad_emb[0] = 0
            _adam(state, "emb", emb, grad_emb + decay * emb, rate, step)
            emb[0] = 0
            _adam(state, "out", model.out, grads["out"] + decay * model.out, rate, step)
            _adam(state, "bias", out_bias, np.array([grads["bias"]]), rate, step)
    model.out_bias = float(out_bias[0])
    return model


#: Positive rows that the common cut counts for beside a language's own.
PRIOR = 20


def best_cut(score: np.ndarray, y: np.ndarray) -> float | None:
    """The cut with the best F1, half way to the next lower score; None unless both labels occur."""
    if not len(y) or y.min() == y.max():
        return None
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    top = np.flatnonzero(f1 == f1.max())[-1]
    return float((s[top] + s[top + 1]) / 2) if top + 1 < len(s) else float(s[top])


def best_f1(score: np.ndarray, y: np.ndarray) -> float:
    """The F1 of the best cut; 0 unless both labels occur."""
    cut = best_cut(score, y)
    if cut is None:
        return 0.0
    hit = score >= cut
    return float(2 * (hit & (y == 1)).sum() / (hit.sum() + (y == 1).sum()))


def fitted_slope(margin: np.ndarray, y: np.ndarray, start: float) -> float:
    """The slope of a logistic curve through 0.5 at margin 0 with the least loss, by Newton's method. Labels are drawn a little towards
    each other, by their numbers, so that the slope is finite where a cut parts them."""
    positive = y.sum()
    target = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (len(y) - positive + 2))
    slope = start
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margin, -30, 30)))
        curve = (margin * margin * p * (1 - p)).sum()
        step = ((p - target) * margin).sum() / max(curve, 1e-12)
        new = min(max(slope - step, slope / 4), slope * 4)
        if abs(new - slope) < 1e-10 * slope:
            break
        slope = new
    return float(slope)


def calibrate(model: Model, texts: pa.Array, labels: np.ndarray, langs: list[str | None], check: np.ndarray) -> None:
    """Put 0.5 at the best cut by F1, fit the slope of the scores, and give each language a cut of its own.

    A language's cut is its best, drawn towards the common one as if that came from PRIOR positive rows more; so languages with few rows
    stay near it, and those without rows of both labels keep it.
    """
    margin = model.margins(texts.take(pa.array(check)), model.tables())
    y = labels[check]
    cut = best_cut(margin, y)
    cut = 0.0 if cut is None else cut
    slope = fitted_slope(margin - cut, y, 2.0 / max(float(np.std(margin)), 1e-6))
    model.platt = (slope, -slope * cut)
    names = np.array([x or "" for x in langs], object)[check]
    for lang in sorted(set(names)):
        own = names == lang
        best, n = best_cut(margin[own] - cut, y[own]), float(y[own].sum())
        drawn = 0.0 if best is None else best * n / (n + PRIOR)
        model.thresholds[lang] = float(1 / (1 + np.exp(-np.clip(slope * drawn, -30, 30))))


def trained(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, most: int = 6000) -> Model:
    """Fit on at most ``most`` labelled rows outside the held-out fold; only their texts reach the driver."""
    rows = training_rows(docs, labels, "toxic", folds, held_out, most, carry=("lang",)).toArrow().sort_by("id")
    return fit(rows["text"].combine_chunks(), rows["label"].to_numpy(), rows["lang"].to_pylist())


def scored(docs: DataFrame, model: Model, folds: int, held_out: int) -> DataFrame:
    """``(doc_id, held_out, score, predicted, threshold, toxic_by_language)`` for each row.

    The score is of the text alone. predicted cuts it at 0.5; toxic_by_language cuts it at the threshold calibrated
    for the row's lang (0.5 for a null or new one). Null and empty texts score as a text of unknown words. Rows that
    repeat are scored alike; a row with a null id has a null held_out. One pass, no shuffle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value.tables()
        for batch in batches:
            for part in pieces(batch, "text"):
                score = sent.value.score(part.column(2), tables)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(score, pa.float64())], names=["doc_id", "lang", "score"]
                )

    out = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").mapInArrow(
        run, f"doc_id {kind}, lang string, score double"
    )
    cuts = F.create_map(*[F.lit(x) for pair in sorted(model.thresholds.items()) for x in pair] or [F.lit(""), F.lit(0.5)])
    threshold = F.coalesce(F.try_element_at(cuts, F.coalesce("lang", F.lit(""))), F.lit(0.5))
    return out.select(
        "doc_id",
        (fold(F.col("doc_id"), folds) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        threshold.alias("threshold"),
        (F.col("score") >= threshold).alias("toxic_by_language"),
    )


def classified(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, most: int = 6000) -> DataFrame:
    """Train on the labels outside the held-out fold and score every row of ``docs``; see ``scored`` for the columns. Without
    labels of both kinds all rows get one score."""
    return scored(docs, trained(docs, labels, folds, held_out, most), folds, held_out)
