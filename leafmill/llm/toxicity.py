"""Toxicity by compression distance: one zstandard dictionary of toxic text, one of ordinary text.

Text is recoded before it is compressed: each byte becomes a three-byte code of the five bytes that end there, so a
match with a dictionary stands for at least a whole 5-gram and not for a chance syllable. A code's bytes hold six bits, so
that every window shrinks by a quarter and none is stored raw, which would hide small differences. The dictionaries are
trained on those runs of labelled texts whose 5-grams stand in far more documents of one class than of the other. A
window's two compressed lengths give its distance; thresholds on a document's distances, calibrated on labelled texts that
the dictionaries have not seen, give a probability.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import annotated, fitted, labelled_sample, logistic, raw_texts, sigmoid

GRAM = 5
WINDOW = 256
#: Bytes of distance: what chance matches reach, and what tells.
NEAR, FAR = 4, 6
DICTIONARY_BYTES = 65_536
LEVEL = 3
#: About so many label rows of each label are fitted on, by a hash of the id.
SAMPLE = {0: 6_000, 1: 3_000}
TABLE = 22
_ODD = np.uint64(0x9E3779B97F4A7C15)


def grams(raw: bytes) -> np.ndarray:
    """A 64-bit hash of the five bytes that end at each place of the lower-case, evenly spaced text."""
    even = b" " + b" ".join(raw.lower().split()) + b" "
    a = np.frombuffer(even, np.uint8).astype(np.uint64)
    n = len(a) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(GRAM):
        h = h * np.uint64(257) + a[j : j + n]
    return h * _ODD


def coded(h: np.ndarray) -> bytes:
    a = (h >> np.uint64(40)).astype(np.uint32)
    return np.stack([a & 63, (a >> 6) & 63, (a >> 12) & 63], 1).astype(np.uint8).tobytes()


def slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - TABLE)).astype(np.int64)


def telling_runs(raw: bytes, telling: np.ndarray) -> list[bytes]:
    """The coded runs of places whose 5-gram tells the class."""
    h = grams(raw)
    edge = np.diff(np.concatenate([[0], telling[slots(h)].view(np.int8), [0]]))
    return [coded(h[a:b]) for a, b in zip(np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0], strict=True)]


def dictionaries(texts: list[tuple[bytes, int]]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary; texts are hashed one by one, twice, so that little is held."""
    seen = np.zeros((2, 1 << TABLE), np.int32)
    for raw, y in texts:
        seen[y, np.unique(slots(grams(raw)))] += 1
    size = [sum(1 for _, y in texts if y == k) for k in (0, 1)]
    ratio = np.log((seen[1] + np.float32(0.5)) / (size[1] + 1)) - np.log((seen[0] + np.float32(0.5)) / (size[0] + 1))
    least = [max(2, min(6, n // 50)) for n in size]
    telling = [(ratio < -np.log(3)) & (seen[0] >= least[0]), (ratio > np.log(6)) & (seen[1] >= least[1])]
    ordinary, toxic = (trained([run for raw, y in texts if y == k for run in telling_runs(raw, telling[k])]) for k in (0, 1))
    return ordinary, toxic


def trained(runs: list[bytes]) -> bytes:
    """A zstandard dictionary of the runs; few or short runs make a dictionary of their own bytes."""
    size = min(DICTIONARY_BYTES, sum(map(len, runs)) // 8)
    if size >= 1_024:
        try:
            return zstandard.train_dictionary(size, runs, k=32, d=6).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(dict.fromkeys(runs))[-DICTIONARY_BYTES:] or bytes(8)


class Meter:
    """Distances of a text's windows: how much shorter the toxic dictionary makes them."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        plain = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
        self.ordinary, self.toxic = plain(ordinary).compress, plain(toxic).compress

    def features(self, raw: bytes | None) -> tuple[float, ...]:
        """Of the windows' distances: the sum above NEAR, the top three, the mean, the share of FAR ones, the number."""
        code = coded(grams(raw or b""))
        step = 3 * WINDOW
        d = np.array([len(self.ordinary(w)) - len(self.toxic(w)) for w in (code[i : i + step] for i in range(0, len(code), step))] or [0], float)
        top = np.sort(d)[::-1][:3].clip(0).mean()
        return np.log1p((d - NEAR).clip(0).sum()), np.log1p(top), np.clip(d.mean(), -5, 10), (d >= FAR).mean(), np.log(len(d))


def fit(texts: list[tuple[bytes, int]]) -> dict:
    """Dictionaries of two thirds of the texts and the calibration of their distances on the other third."""
    texts = sorted(texts, key=lambda t: zlib.crc32(t[0]))
    rest, apart = [t for i, t in enumerate(texts) if i % 3], texts[::3]
    ys = np.array([y for _, y in apart], float)
    if len({y for _, y in rest}) < 2 or len(set(ys)) < 2:
        return {"share": float(np.mean([y for _, y in texts])) if texts else 0.0}
    pair = dictionaries(rest)
    meter = Meter(*pair)
    x = np.array([meter.features(raw) for raw, _ in apart])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    return {"pair": pair, "mean": mean, "scale": scale, "weights": logistic((x - mean) / scale, ys)}


def scored(docs: DataFrame, model: dict, text: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with the probability that the whole text is toxic; null and empty texts are scored as empty.

    Rows of one text, repeated ones included, score alike; texts of any length are read whole, window by window; a column
    named as `out` is replaced; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value
        meter = Meter(*model["pair"]) if "pair" in model else None

        def of(texts: pa.Array) -> list:
            raws = raw_texts(texts)
            if meter is None:
                return [pa.array([model["share"]] * len(raws), pa.float64())]
            x = (np.array([meter.features(raw) for raw in raws]) - model["mean"]) / model["scale"]
            return [pa.array(sigmoid(x @ model["weights"][:-1] + model["weights"][-1]), pa.float64())]

        return of

    return annotated(docs, [T.StructField(out, T.DoubleType())], make, (text,))


def learn(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, label: str = "toxic") -> dict:
    """The model from the labelled documents outside the held-out fold, about SAMPLE rows of each label."""
    return fitted(labelled_sample(docs, labels, label, SAMPLE, parts, held), fit)
