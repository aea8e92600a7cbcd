"""Importance resampling towards a target text: hashed n-gram features, weights by bucket, Gumbel-perturbed draws.

The features of a document are counted by the crc32 of their bytes. Each document is scanned once: its words, joined by one
space, give a running CRC at each word's end. CRCs are linear over GF(2): that of an n-gram is the running CRC at its end,
less the one at its start shifted over the n-gram's bytes. So n-grams of every length cost a few table look-ups, and none
is built as a string.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.operators.ranks import with_rank

from .shared import annotated, byte_slices, raw_texts, stored, words

BUCKETS = 10_000
#: Documents of fewer words are not drawn; of the others PERCENT in a hundred are.
LEAST_WORDS, PERCENT = 20, 10
SEED = 2024
#: The reflected polynomial of crc32 (fixed value).
POLYNOMIAL = 0xEDB88320


def _shift_tables(levels: int = 32) -> np.ndarray:
    """tables[k, j, b]: what byte j of a CRC turns into, if it is b and 2**k zero bytes follow."""
    bits = np.zeros((levels, 32), np.uint32)
    for i in range(32):
        c = 1 << i
        for _ in range(8):
            c = c >> 1 ^ (POLYNOMIAL if c & 1 else 0)
        bits[0, i] = c
    tables = np.zeros((levels, 4, 256), np.uint32)
    values = np.arange(256, dtype=np.uint32)
    for k in range(levels):
        for j in range(4):
            for i in range(8):
                tables[k, j] ^= np.where(values >> i & 1, bits[k, 8 * j + i], 0).astype(np.uint32)
        if k + 1 < levels:
            bits[k + 1] = _apply(tables[k], bits[k])
    return tables


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0].take(crc & 255) ^ table[1].take(crc >> 8 & 255) ^ table[2].take(crc >> 16 & 255) ^ table[3].take(crc >> 24)


TABLES = _shift_tables()
SPACE = np.uint32(crc32(b" "))


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each CRC carried over `length` zero bytes."""
    crc = crc.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        some = np.flatnonzero(length >> k & 1)
        crc[some] = _apply(TABLES[k], crc[some])
    return crc


def running(tokens: list[bytes]) -> np.ndarray:
    """The CRC at the end of each word of one text, a separator standing before each word."""
    return np.fromiter(accumulate(tokens, lambda crc, word: crc32(word, crc32(b" ", crc)), initial=0), np.uint32, len(tokens) + 1)[1:]


def gram_crcs(texts: list[list[bytes]], least: int = 1, most: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The crc32 of every run of least to most consecutive words of each text, joined by one space, and the number of the text."""
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.concatenate([running(t) for t in texts] or [np.zeros(0, np.uint32)])
    sizes = np.fromiter((len(w) for t in texts for w in t), np.int64, len(ends))
    text = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    before = np.concatenate([np.zeros(1, np.uint32), ends[:-1]]) if len(ends) else ends
    before[first[counts > 0]] = 0
    starts = _apply(TABLES[0], before) ^ SPACE
    past = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes + 1)])
    crcs, whose = [], []
    for n in range(least, most + 1):
        at = np.arange(max(0, len(ends) - n + 1))
        at = at[text[at] == text[at + n - 1]]
        crcs.append(ends[at + n - 1] ^ shifted(starts[at], past[at + n] - past[at] - 1))
        whose.append(text[at])
    return np.concatenate(crcs), np.concatenate(whose)


def bucket_counts(rows: DataFrame, text: str = "text", buckets: int = BUCKETS, least: int = 1, most: int = 1) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task gives a row for each bucket at most, and so does their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for (part,) in byte_slices((batch.column(0),)):
                crcs, _ = gram_crcs([words(raw) for raw in raw_texts(part)], least, most)
                total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log of how much likelier each bucket is in the target, with one added to each count; rounded down."""
    s_all, t_all, k = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, text: str = "text", least: int = 1, most: int = 1) -> DataFrame:
    """docs with n_words, n_features and weight, the mean gain of the features rounded down (0 without features)."""

    def make():
        def of(column: pa.Array) -> list[pa.Array]:
            texts = [words(raw) for raw in raw_texts(column)]
            crcs, whose = gram_crcs(texts, least, most)
            # features lie by length of n-gram: sums by text; in doubles they are exact below 2**53
            n = np.bincount(whose, minlength=len(texts)).astype(np.int64)
            total = np.bincount(whose, gain[crcs % np.uint32(len(gain))], minlength=len(texts)).astype(np.int64)
            return [pa.array(np.fromiter(map(len, texts), np.int64, len(texts))), pa.array(n), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))]

        return of

    fields = [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]
    return annotated(docs, fields, make, (text,))


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of docs (doc_id, text); rank is null where a document is not drawn.

    Gumbel noise, drawn from a hash of the id, turns the highest scores into a draw without replacement in proportion to the
    weights. Null texts have no words. A null id is hashed as an empty one and stands before others of its score; repeated
    rows are drawn each for itself. An empty table gives an empty one, an empty target weighs by rarity alone.
    """
    docs = docs.select("doc_id", "text")
    found = weighted(docs, gains(bucket_counts(docs), bucket_counts(target))).drop("text")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    found = stored(found.withColumn("score", F.col("weight") + noise), "weighted")
    long = F.col("n_words") >= least_words
    most = percent * found.where(long).count() // 100
    # the rank's order: highest score first, then the smaller id
    ranked = with_rank(found.where(long), [-F.col("score"), F.col("doc_id"), F.col("n_features"), F.col("weight")])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return ranked.unionByName(found.where(~long).withColumn("rank", F.lit(None).cast("long")))
