"""Language identification by a byte convolutional network, trained in numpy.

A text is cut into windows of fixed length; bytes are embedded, filters of several widths run over each window, the
largest answer of each filter goes through a softmax layer. A document's probabilities are its windows', weighted by
their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import annotated, fitted, fold, stored, within_bytes

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 8
BATCH = 128
#: About so many texts of each language to learn from, by a hash of the id, and of all languages together (LEAST_TEXTS of each at least).
SAMPLE, ALL_TEXTS, LEAST_TEXTS = 1_200, 40_000, 8
#: Rows (an id and a language) of a sample that is broadcast, at most.
MOST_BROADCAST = 200_000
#: Of a text of more than LONG characters so many pieces are learned from, LONG characters together.
LONG, PASSAGES = 131_072, 64
#: Windows to learn from: in all, and of one text.
TRAIN_WINDOWS, TEXT_WINDOWS = 30_000, 16
#: One text in so many is left out of the training; this share of those scores below the least score of a text of any language
#: (nothing does where too few texts are left out to tell such a share).
LEFT_OUT, LOWEST = 8, 0.002
LETTER = regex.compile(r"\p{L}")


def windows(text: str) -> np.ndarray:
    """The lower-case text's bytes in rows of WINDOW; the last row ends in zeros."""
    a = np.frombuffer(text.lower().encode(), np.uint8)
    out = np.zeros(max(1, -(-len(a) // WINDOW)) * WINDOW, np.uint8)
    out[: len(a)] = a
    return out.reshape(-1, WINDOW)


class Network:
    """p: embed (256, E; row 0, the padding, is zero), filters (wide*E, F), bias (F), out (F, classes), last (classes)."""

    def __init__(self, p: dict):
        self.p, self.wide = p, max(WIDTHS)

    @staticmethod
    def fresh(classes: int) -> Network:
        rng, wide, total = np.random.default_rng(11), max(WIDTHS), FILTERS * len(WIDTHS)
        p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "filters": rng.normal(0, 0.2, (wide * EMBED, total)), "bias": np.zeros(total), "out": rng.normal(0, 0.1, (total, classes)), "last": np.zeros(classes)}
        p["embed"][0] = 0
        return Network({k: v.astype(np.float32) for k, v in p.items()})

    def mask(self) -> np.ndarray:
        """A filter of width w sees the first w of the widest filter's places."""
        return np.repeat((np.arange(self.wide)[:, None] < np.array(WIDTHS)).astype(np.float32), FILTERS, 1).repeat(EMBED, 0)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        n, places = len(x), WINDOW - self.wide + 1
        e = self.p["embed"][x].reshape(n, WINDOW * EMBED)
        view = np.lib.stride_tricks.as_strided(e, (n, places, self.wide * EMBED), (e.strides[0], EMBED * 4, 4))
        columns = np.ascontiguousarray(view).reshape(n * places, -1)
        answers = (columns @ self.p["filters"]).reshape(n, places, -1)
        pooled = np.maximum(answers.max(1) + self.p["bias"], 0)
        z = pooled @ self.p["out"] + self.p["last"]
        z = np.exp(z - z.max(1, keepdims=True))
        return columns, answers, pooled, z / z.sum(1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + BATCH])[3] for i in range(0, len(x), BATCH)])

    def document(self, text: str) -> tuple[int, float]:
        """The likeliest language of a whole text and its probability: the mean over windows, weighted by their bytes."""
        x = windows(text)
        weight = np.maximum((x > 0).sum(1), 1).astype(float)
        mean = weight @ self.probabilities(x) / weight.sum()
        k = int(mean.argmax())
        return k, min(1.0, float(mean[k]))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict:
        columns, answers, pooled, prob = self.forward(x)
        n, places, total = answers.shape
        d = prob.copy()
        d[np.arange(n), y] -= 1
        d /= n
        back = (d @ self.p["out"].T) * (pooled > 0)
        where = answers.argmax(1)  # only the place of the largest answer learns
        rows = columns.reshape(n, places, -1)[np.arange(n)[:, None], where]  # n, total, wide*E
        g = {"out": pooled.T @ d, "last": d.sum(0), "bias": back.sum(0), "filters": np.einsum("nfe,nf->ef", rows, back) * self.mask(), "embed": np.zeros((256, EMBED), np.float32)}
        into = (back[:, :, None] * self.p["filters"].T[None]).reshape(n, total, self.wide, EMBED)
        seen = x[np.arange(n)[:, None, None], where[:, :, None] + np.arange(self.wide)]
        np.add.at(g["embed"], seen, into)
        g["embed"][0] = 0
        return g


def fit(texts: list[tuple[str, str]], epochs: int = 4) -> dict:
    """The languages, the trained parameters (Adam over shuffled windows) and `least`, the lowest scores of texts left out.

    Every language has the same number of windows, or all that it has; a text has TEXT_WINDOWS of them at most.
    """
    names = sorted({lang for _, lang in texts})
    rng = np.random.default_rng(5)
    texts = [(t, names.index(lang)) for t, lang in texts if t]
    if len(names) < 2 or not texts:
        return {"names": names, "least": 0.0}
    texts = [texts[i] for i in rng.permutation(len(texts))]
    apart = texts[::LEFT_OUT] if len(texts) >= 8 * LEFT_OUT else []
    own: list[list] = [[] for _ in names]
    for i, (t, k) in enumerate(texts):
        if not apart or i % LEFT_OUT:
            x = windows(t)
            own[k].append(x[np.sort(rng.permutation(len(x))[:TEXT_WINDOWS])])
    quota = max(1, TRAIN_WINDOWS // len(names))
    drawn = [(w := np.concatenate(o))[rng.permutation(len(w))[:quota]] if o else np.zeros((0, WINDOW), np.uint8) for o in own]
    x, y = np.concatenate(drawn), np.repeat(np.arange(len(names)), [len(d) for d in drawn])
    net = Network.fresh(len(names))
    net.p["filters"] *= net.mask()
    m, v, t = {k: np.zeros_like(a) for k, a in net.p.items()}, {k: np.zeros_like(a) for k, a in net.p.items()}, 0
    least = 300
    for _ in range(max(epochs, -(-least * BATCH // len(x)))):
        order = rng.permutation(len(x))
        for i in range(0, len(x), BATCH):
            t += 1
            g = net.gradients(x[order[i : i + BATCH]], y[order[i : i + BATCH]])
            for k, a in net.p.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                a -= 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)
    scores = [net.document(t)[1] for t, _ in apart]
    return {"names": names, "p": net.p, "least": float(np.quantile(scores, LOWEST, method="lower")) if len(scores) * LOWEST >= 1 else 0.0}


def learn(docs: DataFrame, parts: int = 5, held: int = 0, text: str = "text", lang: str = "lang", doc: str = "doc_id") -> dict:
    """The model from texts with a language outside the held-out fold, some of every language that they hold.

    An id that stands in many rows counts with one of its texts (the first by hash), equal texts of a language count once,
    and of a very long text passages from all over it do.
    """
    own = docs.where(F.col(lang).isNotNull() & F.col(doc).isNotNull() & (fold(doc, parts) != held)).select(doc, lang).distinct()
    sizes = own.groupBy(lang).agg(F.count("*").alias("n"))
    n_languages = sizes.count()
    each = max(LEAST_TEXTS, min(SAMPLE, ALL_TEXTS // max(1, n_languages)))
    part = F.xxhash64(doc).bitwiseAND(F.lit(2**63 - 1)) / float(2**63)
    some = own.join(sizes, lang).where(part * F.col("n") <= each).select(doc, lang)
    some = F.broadcast(some) if n_languages * each <= MOST_BROADCAST else some
    rows = docs.where(F.col(text).isNotNull()).select(doc, lang, _passages(F.col(text)).alias("t")).join(some, [doc, lang])
    one = rows.groupBy(doc, lang).agg(F.min_by("t", F.xxhash64("t")).alias("t")).select("t", F.col(lang).alias("l")).distinct()
    return fitted(within_bytes(stored(one, "languages"), "t"), fit)


def _passages(text: Column) -> Column:
    """A text of up to LONG characters as it is; PASSAGES evenly spaced pieces of a longer one."""
    step = F.floor(F.char_length(text) / PASSAGES)
    pieces = F.transform(F.sequence(F.lit(0), F.lit(PASSAGES - 1)), lambda k: F.substring(text, (k * step + 1).cast("int"), F.lit(LONG // PASSAGES)))
    return F.when(F.char_length(text) <= LONG, text).otherwise(F.array_join(pieces, " "))


def identified(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score, from whole texts; `und` and 0 for a null text or one without a letter (category L).

    With one learned language every text with a letter is of that language, with none every text is `und`. Rows of one
    text, repeated ones included, have one result; columns named as the results are replaced; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value
        names, net = model["names"], Network(model["p"]) if "p" in model else None

        def of(column: pa.Array) -> list:
            best, score = [], []
            for t in column.to_pylist():
                k, value = (-1, 0.0) if not t or not names or not LETTER.search(t) else (0, 1.0) if net is None else net.document(t)
                best.append("und" if k < 0 else names[k])
                score.append(value)
            return [pa.array(best, pa.string()), pa.array(score, pa.float64())]

        return of

    return annotated(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())], make, (text,))
