"""What the training-data operators share: tables, lineage cuts, tokens, folds."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Tuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.sources.store import shared_dir, stored
from leafmill.sources.tables import table

__all__ = ["annotated", "byte_slices", "fitted", "fold", "hash_sample", "hot_keys", "join_keyed", "labelled_sample", "logistic", "mix", "most_frequent", "ranges", "raw_texts", "shared_dir", "sigmoid", "stored", "table", "within_bytes", "words"]

#: ASCII letters to lower case, digits kept, other ASCII to blanks; bytes of other characters are kept.
WORD_BYTES = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
#: Text bytes that a Python function is given at once.
SLICE_BYTES = 4_000_000
#: Bytes of texts that a classifier is fitted on, at most.
SAMPLE_BYTES = 24_000_000
#: Keys that hold more than 1 / HOT of all rows are hot, so there are fewer than HOT of them.
HOT = 1_000


def byte_slices(columns: tuple[pa.Array, ...], most: int = SLICE_BYTES) -> Iterator[tuple[pa.Array, ...]]:
    """Consecutive slices of the columns that hold about `most` bytes of the first, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(columns[0]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield tuple(c.slice(at, stop - at) for c in columns)
        at = stop


def annotated(docs: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[..., list]], columns: tuple[str, ...], most: int = SLICE_BYTES) -> DataFrame:
    """docs with the fields added, without a shuffle: only `columns` go to Python, and only the fields come back.

    make() is called once a task and returns a function from Arrow arrays of the columns, some megabytes of the first
    one, to one Arrow array for each field. A column of docs that bears the name of a field, in whatever case, is replaced by it.
    """
    names = [f.name for f in fields]
    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    none = [pa.array([], _arrow(f.dataType)) for f in fields]

    def run(batches: Iterator[Tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        of = make()
        for batch in batches:
            batch = batch if isinstance(batch, tuple) else (batch,)
            parts = [of(*part) for part in byte_slices(batch, most)] or [none]
            yield pa.StructArray.from_arrays([pa.concat_arrays(p) if len(p) > 1 else p[0] for p in zip(*parts, strict=True)], names)
            pa.default_memory_pool().release_unused()

    found = F.arrow_udf(run, T.StructType(fields)).asNondeterministic()
    return docs.withColumn("_found", found(*columns)).select(*kept, "_found.*")


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind.fields])
    return {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}[kind.simpleString()]


def most_frequent(counts: DataFrame, most: int, n: str = "n") -> DataFrame:
    """The rows of the highest counts, as many as fit in `most` without parting rows of one band of counts.

    Bands are sixteenths of a power of two; only their sizes reach the driver, so no task ranks all rows. If the highest
    band alone holds more than `most` rows, they are ranked.
    """
    banded = counts.withColumn("_band", F.floor(F.log2(n) * 16))
    sizes = {r["_band"]: r["rows"] for r in banded.groupBy("_band").agg(F.count("*").alias("rows")).collect()}
    total, least = 0, None
    for band in sorted(sizes, reverse=True):
        total += sizes[band]
        if total > most:
            break
        least = band
    if least is None:
        return counts.orderBy(F.desc(n)).limit(most) if sizes else counts
    return banded.where(F.col("_band") >= least).drop("_band")


def hot_keys(sizes: DataFrame, total: int, n: str = "n") -> DataFrame:
    """The rows of sizes (one a key, n rows each) that hold more than 1 / HOT of the total: fewer than HOT, whatever the total."""
    return sizes.where(F.col(n) * HOT > total)


def join_keyed(rows: DataFrame, sizes: DataFrame, key: list[str], total: int, n: str = "n") -> DataFrame:
    """rows joined with `sizes`, which has one row a key and the number n of the key's rows among `total` in all.

    Hot keys, fewer than HOT, are joined where their rows lie, by a broadcast; the rows of the other keys are shuffled,
    and none of these keys has more than 1 / HOT of them. Both tables are read more than once, so they should be stored ones.
    """
    hot = hot_keys(sizes, total, n)
    if hot.isEmpty():
        return rows.join(sizes, key)
    hot = F.broadcast(hot)
    cool = rows.join(hot.select(*key), key, "left_anti").join(sizes.where(F.col(n) * HOT <= total), key)
    return rows.join(hot, key).unionByName(cool)


def raw_texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def fold(column: str, parts: int) -> Column:
    """crc32 of the number as text, modulo parts; null counts as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts, F.lit(0))


def words(raw: bytes | None) -> list[bytes]:
    """Lower-case runs of ASCII letters, digits and any character beyond ASCII."""
    return raw.translate(WORD_BYTES).split() if raw else []


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start .. start + length - 1 of each range, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser: every bit of x and seed moves every bit of the result."""
    x = x ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def share_of(key: str | list[str], part: float) -> Column:
    """Whether a row's key falls into about `part` of all hash values; never an empty range of them."""
    key = [key] if isinstance(key, str) else key
    top = 2**63 - 1
    return F.xxhash64(*key).bitwiseAND(F.lit(top)) <= max(1, min(top, int(part * top)))


def hash_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows of those counted, by a hash of the key; all of them if there are no more.

    A range of hash values is kept, so nothing is ranked and no task sends the driver more than its own share.
    """
    n = rows.count()
    return rows if n <= most else rows.where(share_of(key, most / n))


def within_bytes(rows: DataFrame, text: str, most: int = SAMPLE_BYTES) -> DataFrame:
    """rows of a small stored sample, cut by a hash of the text to about `most` bytes of text; texts of over most / 16 bytes go."""
    size = F.octet_length(text)
    rows = rows.where(size <= most // 16)
    total = rows.agg(F.sum(size)).first()[0] or 0
    return rows if total <= most else rows.where(share_of(text, most / total))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bounds: dict[int, int], parts: int, held: int, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """raw (binary), label to fit a classifier on: of each label about bounds[label] label rows, by a hash of the id.

    Rows of the held-out fold (crc32 of the id modulo parts = held) never take part. An id that stands in many rows counts
    with one of its texts (the first by hash), and equal texts of a label count once, so neither crowds out the others. The
    sample is bounded in rows and, by within_bytes(), in bytes.
    """
    wanted = labels.where(F.col(doc).isNotNull() & (fold(doc, parts) != held)).select(doc, F.col(label).cast("int").alias("label")).distinct()
    parted = [hash_sample(wanted.where(F.col("label") == k), doc, n) for k, n in bounds.items()]
    some = parted[0]
    for more in parted[1:]:
        some = some.unionByName(more)
    rows = docs.select(doc, F.col(text).cast("binary").alias("raw")).where("raw is not null").join(F.broadcast(some), doc)
    one = rows.groupBy(doc, "label").agg(F.min_by("raw", F.xxhash64("raw")).alias("raw")).select("raw", "label").distinct()
    found = stored(one, "labelled")
    return within_bytes(found, "raw")


def fitted(sample: DataFrame, fit: Callable[[list[tuple]], dict]) -> dict:
    """The model that fit() makes of the distinct rows of a bounded sample, in order; it runs in a task, the driver gets the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: set[tuple] = set()
        for batch in batches:
            rows.update(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sorted(rows)))], pa.binary())], ["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([])


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights, the intercept last, of a logistic regression by Newton steps; x is scaled by the caller."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = penalty * np.append(np.ones(len(w) - 1), 1e-6)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(ridge + 1e-9), x.T @ (p - y) / len(y) + ridge * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))
