"""Benchmark decontamination by an FM-index over each shard of the training texts.

A shard's words become symbols of the benchmark's vocabulary; every word that no benchmark window holds is a break, and
stretches too short to hold a window are left out (no window can occur there). The shard's index is a Burrows-Wheeler
transform held in a wavelet matrix with rank counts and every eighth suffix position. All benchmark windows are searched
backward at once; their occurrences are located through the sampled positions and merged into removal spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import WORD_BYTES, annotated, ranges, raw_texts, stored, words

WINDOW = 10
#: Benchmark bytes that are broadcast at once; a larger benchmark is searched block by block.
BLOCK_BYTES = 4_000_000
#: Text bytes of a shard, which has an index of its own.
SHARD_BYTES = 16_000_000
SAMPLE = 8
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


class WaveletMatrix:
    """Rank queries over an array of symbols, one bit plane a level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.size, self.planes, self.zeros = len(symbols), [], []
        rest = symbols
        for bit in range(bits - 1, -1, -1):
            ones = (rest >> bit) & 1
            packed = np.packbits(ones.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            self.planes.append((packed, np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))])))
            self.zeros.append(len(rest) - int(ones.sum()))
            rest = np.concatenate([rest[ones == 0], rest[ones == 1]])
        self.bits = bits

    @staticmethod
    def _ones(plane: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
        packed, counts = plane
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return counts[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before the position; arrays."""
        low, high = np.zeros_like(at), at.copy()
        for level in range(self.bits):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = self._ones(self.planes[level], low), self._ones(self.planes[level], high)
            low = np.where(one, self.zeros[level] + a, low - a)
            high = np.where(one, self.zeros[level] + b, high - b)
        return high - low

    def at(self, position: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(position)
        for level in range(self.bits):
            packed, _ = self.planes[level]
            one = ((packed[position >> 6] >> (position & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            a = self._ones(self.planes[level], position)
            position = np.where(one, self.zeros[level] + a, position - a)
            symbol = symbol * 2 + one
        return symbol


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling: ranks of twice the length from pairs of ranks."""
    n, step = len(symbols), 1
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    while True:
        later = np.zeros(n, np.int64)
        later[: n - step] = rank[step:] + 1
        key = rank * (n + 2) + later
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.zeros(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = fresh
        if n == 0 or rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


class FMIndex:
    """Backward search and location over symbols > 0; 0 is a break between stretches."""

    def __init__(self, symbols: np.ndarray, top: int):
        text = np.concatenate([symbols + 1, [0]]).astype(np.int64)  # the end is the one smallest symbol
        order = suffix_array(text)
        self.size = len(text)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 2))])
        self.wavelet = WaveletMatrix(text[order - 1], max(1, int(top + 1).bit_length()))
        self.sampled = order % SAMPLE == 0
        self.mark = np.concatenate([[0], np.cumsum(self.sampled)])
        self.positions = order[self.sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix rows low..high of each phrase; phrases are aligned to the right of the array."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        width = phrases.shape[1]
        for k in range(width):
            live = np.nonzero((k < lengths) & (low < high))[0]
            if not len(live):
                break
            symbol = phrases[live, width - 1 - k] + 1
            start = self.before[symbol]
            low[live] = start + self.wavelet.rank(symbol, low[live])
            high[live] = start + self.wavelet.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back until a sampled one."""
        out, steps = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        rows, live = rows.copy(), np.arange(len(rows))
        while len(live):
            hit = self.sampled[rows]
            out[live[hit]] = self.positions[self.mark[rows[hit]]] + steps[live[hit]]
            live, rows = live[~hit], rows[~hit]
            if len(live):
                symbol = self.wavelet.at(rows)
                rows = self.before[symbol] + self.wavelet.rank(symbol, rows)
                steps[live] += 1
        return out


def phrases_of(items: list[tuple[str | None, bytes | None]], window: int) -> dict:
    """The vocabulary and the windows of benchmark items: `window` words each, or all of a shorter item."""
    vocabulary: dict[bytes, int] = {}
    rows, lengths, owners = [], [], []
    for item, raw in items:
        found = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(raw)]
        size = min(window, len(found))
        for i in range(len(found) - size + 1 if found else 0):
            rows.append([0] * (window - size) + found[i : i + size])
            lengths.append(size)
            owners.append(item)
    return {"vocabulary": vocabulary, "phrases": np.array(rows, np.int64).reshape(len(rows), window), "lengths": np.array(lengths, np.int64), "owners": owners}


def occurrences(ids: list[np.ndarray], bench: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document number, first word, word after the last, and window number of every occurrence in a shard."""
    none = (np.zeros(0, np.int64),) * 4
    if not len(bench["lengths"]):
        return none
    sizes = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate([np.append(x, 0) for x in ids]) if ids else np.zeros(0, np.int64)
    known = np.concatenate([[0], (flat > 0).view(np.int8), [0]])
    edge = np.diff(known)
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    keep = ends - starts >= bench["lengths"].min()
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return none
    length = ends - starts + 1  # each stretch with the break behind it
    places = ranges(starts, length)
    text = flat[places].astype(np.int64)
    index = FMIndex(text, len(bench["vocabulary"]) + 1)
    low, high = index.search(bench["phrases"], bench["lengths"])
    which = np.repeat(np.arange(len(low)), high - low)
    at = places[index.locate(ranges(low, high - low))] if len(which) else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    doc = np.searchsorted(first, at, side="right") - 1
    start = at - first[doc]
    return doc, start, start + bench["lengths"][which], which


def merged_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of a document become one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    wide = int(end.max()) + 2
    reach = np.maximum.accumulate(doc * wide + end)
    fresh = np.concatenate([[True], (doc[1:] * wide + start[1:]) > reach[:-1]])
    last = np.concatenate([np.nonzero(fresh)[0][1:] - 1, [len(doc) - 1]])
    return doc[fresh], start[fresh], reach[last] - doc[fresh] * wide


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark in blocks of bounded size, for the broadcasts."""
    raw = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("binary").alias("raw")).where("raw is not null")
    total = raw.agg(F.sum(F.octet_length("raw") + 16)).first()[0] or 0
    n = total // BLOCK_BYTES + 1
    for block in range(n):
        yield [(r.item, bytes(r.raw)) for r in raw.where(F.pmod(F.hash("item", "raw"), F.lit(n)) == block).collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, spans (merged, of word numbers, end after the last) and items (ids as sorted strings).

    Null or empty texts have no words; items without words have no windows; the windows of an item without an id make
    spans, but there is no id to list; repeated documents and repeated items are each taken as they stand. Texts of any
    length are searched whole. Columns of docs named as the results are replaced; an empty table gives no rows.
    """
    fields = [T.StructField("n_words", T.LongType()), T.StructField("spans", SPAN), T.StructField("items", T.ArrayType(T.StringType()))]
    out = docs.drop("n_words", "spans", "items")
    for k, block in enumerate(_blocks(benchmark, item, item_text)):
        sent = docs.sparkSession.sparkContext.broadcast(phrases_of(block, window))
        more = ("spans", "items") if k else ()
        out = annotated(stored(out, "leaks") if k else out, fields, lambda sent=sent: _searcher(sent.value), (text, *more), SHARD_BYTES)
    return out


def _searcher(bench: dict) -> Callable[..., list]:
    known, owners = bench["vocabulary"].get, bench["owners"]

    def of(texts: pa.Array, earlier_spans: pa.Array | None = None, earlier_items: pa.Array | None = None) -> list:
        """The second and third arrays are what earlier blocks of the benchmark have found."""
        ids = [np.fromiter(map(known, w, repeat(0)), np.int32, len(w)) for w in map(words, raw_texts(texts))]
        doc, start, end, which = occurrences(ids, bench)
        items: list[set] = [set() for _ in ids]
        if len(doc):
            for d, w in np.unique(np.stack([doc, which], 1), axis=0).tolist():
                if owners[w] is not None:
                    items[d].add(owners[w])
        if earlier_spans is not None:
            for d, (spans, names) in enumerate(zip(earlier_spans.to_pylist(), earlier_items.to_pylist(), strict=True)):
                items[d].update(names)
                doc, start, end = np.append(doc, [d] * len(spans)), np.append(start, [s["start"] for s in spans]), np.append(end, [s["end"] for s in spans])
            doc, start, end = doc.astype(np.int64), start.astype(np.int64), end.astype(np.int64)
        spans: list[list] = [[] for _ in ids]
        for d, a, b in zip(*(x.tolist() for x in merged_spans(doc, start, end)), strict=True):
            spans[d].append({"start": a, "end": b})
        return [pa.array([len(x) for x in ids], pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]

    return of


def cut_spans(leaks: DataFrame, text: str = "text") -> DataFrame:
    """The texts of find_leaks() without the words of their spans; what stands between words is kept."""

    def make():
        def of(texts: pa.Array, found: pa.Array) -> list:
            out = []
            for raw, spans in zip(raw_texts(texts), found.to_pylist(), strict=True):
                out.append(raw if raw is None or not spans else without(raw, [(s["start"], s["end"]) for s in spans]))
            return [pa.array(out, pa.binary()).cast(pa.string())]

        return of

    return annotated(leaks, [T.StructField("cut", T.StringType())], make, (text, "spans"))


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """raw without the words of the spans, from the first byte of the first to the last byte of the last."""
    solid = np.frombuffer(raw.translate(WORD_BYTES), np.uint8) > 32
    solid |= np.frombuffer(raw, np.uint8) >= 128
    edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*parts, raw[at:]])

