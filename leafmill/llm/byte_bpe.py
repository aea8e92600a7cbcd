"""Byte-level BPE encoding and decoding under the ranks of a public vocabulary file.

The words (pieces) that a corpus repeats most are encoded on Spark: an `aggregate` over each distinct word's byte array
folds the ranked merges, looking ranks up in a literal map. Each document is then cut into pieces and its ids are put
together from that table; a piece beyond the table (rare words, very long runs) takes the same ranked merges inside the
task. Decoding indexes a literal array of the binary pieces by the ids and concatenates them, in DataFrame functions.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections import Counter
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import annotated, byte_slices, most_frequent, stored

#: Distinct words that Spark encodes ahead and sends to every task: the bound of what is broadcast.
HEAD_WORDS = 65_536
#: Longer words are left to the tasks, whose merge takes n log n steps.
HEAD_BYTES = 48
#: The literal rank map is an array of this many small maps, as Spark searches a literal map entry by entry.
BUCKETS = 16_384
#: Words that a task counts before it hands them on, and rare words whose ids it remembers; results don't depend on them.
REMEMBERED, CACHED = 200_000, 300_000
#: Above every rank: parts that don't merge.
NEVER = 1 << 40
#: Characters of a text whose pieces are met one by one, not listed.
LONG = 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines `base64 rank`."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def rank_map(ranks: dict[bytes, int]) -> Column:
    """A literal array of maps from a token's hexadecimal bytes to its rank, dealt by crc32."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        key = token.hex().upper()
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def folded(word: Column, ranks: Column) -> Column:
    """The ids of a binary word; the literal stands in the plan once, bound as the one element of an array."""
    return F.get(F.transform(F.array(ranks), lambda bound: _folded(word, bound)), 0)


def _folded(word: Column, ranks: Column) -> Column:
    """The word's bytes, then the leftmost lowest-ranked pair merged again and again."""
    rank = lambda key: F.try_element_at(F.get(ranks, (F.crc32(key.cast("binary")) % BUCKETS).cast("int")), key)
    whole = F.hex(word)
    size = F.octet_length(word)
    pieces = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.substring(whole, 2 * i + 1, F.lit(2)))

    def step(parts: Column, _: Column) -> Column:
        rest = F.greatest(F.size(parts) - 1, F.lit(0))
        found = F.zip_with(F.slice(parts, 1, rest), F.slice(parts, 2, rest), lambda a, b: rank(F.concat(a, b)))

        def merge(ranked: Column) -> Column:
            at = F.array_position(ranked, F.array_min(ranked)).cast("int")
            return F.concat(F.slice(parts, 1, at - 1), F.array(F.concat(F.get(parts, at - 1), F.get(parts, at))), F.slice(parts, at + 2, F.size(parts)))

        # the pairs' ranks are bound once, as the one element of an array
        return F.get(F.transform(F.array(found), lambda ranked: F.when(F.array_min(ranked).isNull(), parts).otherwise(merge(ranked))), 0)

    done = F.aggregate(F.sequence(F.lit(1), size), pieces, step)
    one = rank(whole)
    return F.when(size == 0, F.array().cast("array<int>")).when(one.isNotNull(), F.array(one)).otherwise(F.transform(done, rank))


def encode_words(words: DataFrame, ranks: dict[bytes, int], word: str = "word") -> DataFrame:
    """words with `ids` (array of int) of the binary column; DataFrame functions only."""
    return words.withColumn("ids", folded(F.col(word), rank_map(ranks)))


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece, by a heap of the ranked pairs: the order of merges is that of `folded`."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n < 40:
        rank = ranks.get
        parts = [piece[i : i + 1] for i in range(n)]
        found = [rank(piece[i : i + 2], NEVER) for i in range(n - 1)]  # of each part with the next one
        while found and (best := min(found)) < NEVER:
            at = found.index(best)
            parts[at] += parts.pop(at + 1)
            del found[at]
            if at:
                found[at - 1] = rank(parts[at - 1] + parts[at], NEVER)
            if at < len(found):
                found[at] = rank(parts[at] + parts[at + 1], NEVER)
        return [ranks[p] for p in parts]
    ends, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
    live = [True] * n
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, mid, end = heapq.heappop(heap)
        j = right[i]
        if not live[i] or j < 0 or ends[i] != mid or ends[j] != end:
            continue
        live[j], ends[i], right[i] = False, end, right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for a in (left[i], i):
            if a >= 0 and (b := right[a]) >= 0 and (r := ranks.get(piece[a : ends[b]])) is not None:
                heapq.heappush(heap, (r, a, ends[a], ends[b]))
    return [ranks[piece[i : ends[i]]] for i in range(n) if live[i]]


def word_counts(docs: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """Every distinct piece of the texts with its count; each task sums its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = regex.compile(pattern).findall, Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()).cast(pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for (part,) in byte_slices((batch.column(0),)):
                for value in part.to_pylist():
                    if value:
                        seen.update(cut(value))
                    if len(seen) > REMEMBERED:
                        yield out()
                        seen.clear()
        if seen:
            yield out()

    return docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Pieces(dict):
    """The ids of pieces, as little-endian bytes: those encoded ahead, and those merged here, some of which are remembered.

    It is broadcast empty; what a Python worker remembers stays for its next tasks.
    """

    def __init__(self, known: dict[str, bytes], ranks: dict[bytes, int]):
        self.known, self.ranks = known.get, ranks

    def __missing__(self, piece: str) -> bytes:
        ids = self.known(piece)
        if ids is None:
            ids = pack(f"<{len(found := merged(piece.encode(), self.ranks))}i", *found)
        self[piece] = ids
        return ids


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", head_words: int = HEAD_WORDS) -> DataFrame:
    """docs with `tokens` (array of int), `ids` (the same as little-endian unsigned 32-bit integers, binary), `n_tokens` long.

    A null or empty text has no ids. Every row keeps its other columns, repeated rows stay repeated, and columns named as
    the results are replaced. Texts are cut by the pattern as wholes; no special token is known.
    """
    spark = docs.sparkSession
    counts = stored(word_counts(docs, pattern, text).where((F.octet_length("word") <= HEAD_BYTES) & (F.col("n") > 1)), "bpe-words")
    head = most_frequent(counts, head_words).repartition(32)
    rows = encode_words(head, ranks).select("word", "ids").toArrow()
    known = {word.decode(): np.array(ids, "<i4").tobytes() for word, ids in zip(rows["word"].to_pylist(), rows["ids"].to_pylist(), strict=True)}
    sent = spark.sparkContext.broadcast(Pieces(known, ranks))

    def make():
        expression, pieces = regex.compile(pattern), sent.value

        def of(texts: pa.Array) -> list:
            if len(pieces) > CACHED:
                pieces.clear()
            cut = lambda t: expression.findall(t) if len(t) < LONG else (m.group() for m in expression.finditer(t))
            ids = [b"".join(map(pieces.__getitem__, cut(value))) if value else b"" for value in texts.to_pylist()]
            ends, data = np.cumsum([0, *map(len, ids)]), pa.py_buffer(b"".join(ids))
            whole = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int32)), data])
            return [pa.ListArray.from_arrays(pa.array(ends // 4, pa.int32()), pa.array(np.frombuffer(data, "<i4"))), whole]

        return of

    fields = [T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("ids", T.BinaryType())]
    return annotated(docs.drop("n_tokens"), fields, make, (text,)).withColumn("n_tokens", F.size("tokens").cast("long"))


def decode(encoded: DataFrame, ranks: dict[bytes, int], tokens: str = "tokens") -> DataFrame:
    """encoded with `decoded`: the binary pieces of the tokens, concatenated by DataFrame functions. Null tokens give no bytes.

    The pieces, in hexadecimal digits, are one literal array, which the tokens index.
    """
    pieces = [""] * (max(ranks.values(), default=0) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    table = F.split(F.lit(",".join(pieces)), ",")
    piece = lambda i: F.coalesce(F.nullif(F.get(table, i), F.lit("")), F.raise_error(F.lit("an id beyond the ranks")))
    return encoded.withColumn("decoded", F.coalesce(F.unhex(F.array_join(F.transform(tokens, piece), "")), F.lit(b"")))
