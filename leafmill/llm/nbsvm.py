"""Quality scores by naive Bayes support vectors.

A text's features are indicators of hashed n-grams of its words and of its words' shapes (upper, lower, digit, other;
punctuation kept), one and two long. Each indicator is scaled by its log-count ratio between the classes, the vector has
unit length, and a linear hinge-loss model is fitted by dual coordinate descent. Margins of left-out texts calibrate a
probability.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import annotated, fitted, labelled_sample, logistic, mix, raw_texts, sigmoid, words

BITS = 20
#: About so many label rows of each label are fitted on, by a hash of the id.
SAMPLE = {0: 4_000, 1: 4_000}
SHAPES = bytes(65 if 65 <= i <= 90 else 97 if 97 <= i <= 122 else 48 if 48 <= i <= 57 else 117 if i >= 128 else 10 if i == 10 else i if i > 32 else 32 for i in range(256))


def shapes(raw: bytes) -> list[bytes]:
    """Word shapes, with runs of one class or mark cut to one: `Hello,` is `Aa,`; a line's end is a token of its own."""
    a = np.frombuffer(raw.translate(SHAPES).replace(b"\n", b" \x01 "), np.uint8)
    return a[np.concatenate([[True], a[1:] != a[:-1]])].tobytes().split() if len(a) else []


def features(raw: bytes | None) -> np.ndarray:
    """The numbers of the distinct hashed n-grams of a text."""
    out = []
    for seed, tokens in ((1, words(raw)), (2, shapes(raw or b""))):
        one = mix(np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens)), seed)
        out += [one, mix(one[:-1] * np.uint64(3) + one[1:], seed + 2)]
    return np.unique(np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64)


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = 1.0, epochs: int = 12) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised hinge-loss model; rows are unit vectors of scaled indicators."""
    rng = np.random.default_rng(7)
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    values = [unit(scale[r]) for r in rows]
    square = np.array([float(v @ v) + 1 for v in values])
    upper = cost * np.where(y > 0, 0.5 * len(y) / max(1, (y > 0).sum()), 0.5 * len(y) / max(1, (y < 0).sum()))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            slope = y[i] * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), upper[i])
            if new != alpha[i]:
                move = (new - alpha[i]) * y[i]
                w[r] += move * v
                bias += move
                alpha[i] = new
    return w, bias


def unit(v: np.ndarray) -> np.ndarray:
    return v / (np.sqrt(v @ v) + 1e-9)


def ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The log-count ratio of each feature, with one added to each count."""
    counts = [np.bincount(np.concatenate([np.zeros(0, np.int64), *[r for r, v in zip(rows, y, strict=True) if v == k]]), minlength=1 << BITS) + 1.0 for k in (1, -1)]
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def fit(texts: list[tuple[bytes, int]]) -> dict:
    """A model of both classes; with one class only, its share."""
    texts = sorted(texts, key=lambda t: zlib.crc32(t[0]))
    rows, y = [features(raw) for raw, _ in texts], np.array([1.0 if k == 1 else -1.0 for _, k in texts])
    if len(set(y[::2])) < 2 or len(set(y[1::2])) < 2:
        return {"share": float((y > 0).mean()) if len(y) else 0.5}
    margins = np.zeros(len(y))
    for k in (0, 1):
        own, other = np.arange(len(y)) % 2 != k, np.nonzero(np.arange(len(y)) % 2 == k)[0]
        part = [rows[i] for i in np.nonzero(own)[0]]
        scale = ratios(part, y[own])
        w, bias = descend(part, y[own], scale)
        margins[other] = [w[rows[i]] @ unit(scale[rows[i]]) + bias for i in other]
    scale = ratios(rows, y)
    w, bias = descend(rows, y, scale)
    return {"scale": scale.astype(np.float32), "w": w.astype(np.float32), "bias": bias, "line": logistic(margins[:, None], (y + 1) / 2)}


def scored(docs: DataFrame, model: dict, text: str = "text", out: str = "quality_score") -> DataFrame:
    """docs with the probability that the whole text is of quality 1; null and empty texts are scored as empty.

    Rows of one text, repeated ones included, score alike; texts of any length are read whole; a column named as `out`
    is replaced; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value

        def one(raw: bytes | None) -> float:
            r = features(raw)
            return float(model["w"][r] @ unit(model["scale"][r]) + model["bias"]) if len(r) else model["bias"]

        def of(texts: pa.Array) -> list:
            raws = raw_texts(texts)
            if "share" in model:
                return [pa.array([model["share"]] * len(raws), pa.float64())]
            return [pa.array(sigmoid(np.array([one(raw) for raw in raws]) * model["line"][0] + model["line"][1]), pa.float64())]

        return of

    return annotated(docs, [T.StructField(out, T.DoubleType())], make, (text,))


def learn(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, label: str = "quality") -> dict:
    """The model from the labelled documents outside the held-out fold, about SAMPLE rows of each label."""
    return fitted(labelled_sample(docs, labels, label, SAMPLE, parts, held), fit)
