"""Near-duplicates by Order MinHash, verified by banded alignment.

A text's k-mers of words carry their occurrence number (the second time a k-mer stands in a text is another element). Each
hash function picks the two smallest elements, kept in the order in which they stand in the text: equal sketches are
likely where the edit similarity is high, and rearranged texts agree less than their k-mer sets do. Edits that are spread
evenly leave no five words in a row long before the similarity falls to 0.8, so a series of shorter k-mers stands beside
the 5-word one (SERIES).
Documents that share a sketch are candidates, each with a representative of the sketch's bucket; a banded alignment of
their words accepts pairs of edit similarity 0.8 or more. Exact copies are folded into one text beforehand. A document
meets first the representative with which it shares the most buckets, and others only while no links join the two.

A bucket's members that are unlike its representatives, as where strangers share a long passage, are bucketed again by
hashes of what they do not share with the first one, and so on until no bucket holds unmatched members. What is left of a
text shrinks each time, so this ends, and each round's work is in proportion to the unmatched members.

The hashed texts lie in buckets of their key and are not shuffled again: a pair takes its key's text to the other's bucket,
and what is left of a text is a bit for each of its elements.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.sources.store import keyed_table

from .shared import HOT, annotated, byte_slices, hot_keys, join_keyed, mix, stored, words

K = 5
#: Words of a k-mer and hash functions of each series.
SERIES = ((K, 16), (3, 40))
ALL_SKETCHES = sum(n for _, n in SERIES)
#: Products of elements and factors held at once.
SKETCH_CELLS = 1_000_000
SIMILARITY = 0.8
#: Hash functions that bucket the unmatched by the rest of their texts.
REST_SKETCHES = 16
#: Words of the texts aligned at once.
ALIGNED_CELLS = 4_000_000


def hashed_words(raw: bytes | None) -> np.ndarray:
    found = words(raw)
    return np.fromiter(map(zlib.crc32, found), np.uint64, len(found))


def elements(texts: list[np.ndarray], k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-labelled k-mers of each text in text order, and where each text's begin.

    A text of fewer than k words has its whole self as its one k-mer; a text without words has none.
    """
    sizes = np.array([max(len(w) - k + 1, min(len(w), 1)) for w in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    kmers, label = np.zeros(int(first[-1]), np.uint64), np.zeros(int(first[-1]), np.uint64)
    for w, a, n in zip(texts, first, sizes, strict=False):
        h = kmers[a : a + n]
        for j in range(min(k, len(w))):
            h *= np.uint64(0x100000001B3)
            h += w[j : j + n]
        ordered = np.sort(h)
        if (ordered[1:] == ordered[:-1]).any():
            label[a : a + n] = occurrences(h)
    return mix(mix(kmers, 1) + label * np.uint64(0xD6E8FEB86659FD93), 2), first


def occurrences(values: np.ndarray) -> np.ndarray:
    """How often each value stood before, at each place."""
    order = np.argsort(values, kind="stable")
    ordered, at = values[order], np.arange(len(values))
    same = np.concatenate([[False], ordered[1:] == ordered[:-1]])
    out = np.zeros(len(values), np.uint64)
    out[order] = at - np.maximum.accumulate(np.where(same, 0, at))
    return out


def two_smallest(items: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each factor the two elements whose product with it is smallest, in text order; one element stands for both."""
    a, b = np.zeros(len(factors), np.uint64), np.zeros(len(factors), np.uint64)
    step = max(1, SKETCH_CELLS // len(items))
    for at in range(0, len(factors), step):
        h = factors[at : at + step, None] * items
        one = h.argmin(1)
        h[np.arange(len(h)), one] = np.uint64(2**64 - 1)
        two = h.argmin(1)
        a[at : at + step], b[at : at + step] = items[np.minimum(one, two)], items[np.maximum(one, two)]
    return a, b


def sketches(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each text with words: its number, and a row of hashes of two elements in text order, of each series in turn."""
    live = np.array([i for i, w in enumerate(texts) if len(w)], np.int64)
    out = np.zeros((len(live), ALL_SKETCHES), np.int64)
    at = 0
    for k, n in SERIES:
        items, first = elements(texts, k)
        factors = mix(np.arange(at, at + n, dtype=np.uint64), 10) | np.uint64(1)
        pairs = np.zeros((2, len(live), n), np.uint64)
        for i, t in enumerate(live.tolist()):
            pairs[0, i], pairs[1, i] = two_smallest(items[first[t] : first[t + 1]], factors)
        for s in range(n):
            out[:, at + s] = mix(pairs[0, :, s] * np.uint64(0x9E3779B97F4A7C15) + mix(pairs[1, :, s], 3), 100 + at + s).view(np.int64)
        at += n
    return live, out


def least_distance(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the edit distance: an edit takes at most two pairs of neighbouring words away."""
    most = max(len(a), len(b)) - 1
    if most < 1 or min(len(a), len(b)) < 2:
        return abs(len(a) - len(b))
    (x, n), (y, m) = (np.unique(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:], return_counts=True) for w in (a, b))
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = int(np.minimum(n, m[at])[y[at] == x].sum())
    return (most - common + 1) // 2


def distances(pairs: list[tuple[np.ndarray, np.ndarray]], band: int) -> np.ndarray:
    """Word edit distances of pairs inside a band of diagonals, all pairs a row at a time; right where at most `band`."""
    n, width = len(pairs), 2 * band + 1
    la, lb = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    rows = int(la.max(initial=0))
    a = np.zeros((n, rows), np.uint64)
    b = np.full((n, rows + 2 * width), 2**63, np.uint64)  # beyond b's end nothing matches
    for i, (x, y) in enumerate(pairs):
        a[i, : len(x)] = x
        y = y[: rows + width]
        b[i, band : band + len(y)] = y
    far = np.int32(1 << 29)
    offset = np.arange(width, dtype=np.int32)
    d = np.where(offset >= band, offset - band, far).astype(np.int32)[None].repeat(n, 0)  # row 0: j = offset - band
    out = np.full(n, far, np.int32)
    ends = lb - la + band  # the offset of the last cell
    fine = (ends >= 0) & (ends < width)
    done = np.nonzero((la == 0) & fine)[0]
    out[done] = d[done, ends[done]]
    for i in range(1, rows + 1):
        match = b[:, i - 1 : i - 1 + width] == a[:, i - 1 : i]
        d_new = d + (~match)  # along the diagonal
        d_new[:, :-1] = np.minimum(d_new[:, :-1], d[:, 1:] + 1)  # a word of a is dropped
        j = i + offset - band
        d_new[:, j < 0] = far
        if i <= band:
            d_new[:, band - i] = i
        d = np.minimum.accumulate(d_new - offset, axis=1) + offset  # words of b are dropped
        done = np.nonzero((la == i) & fine)[0]
        if len(done):
            out[done] = d[done, ends[done]]
    return out


def similar(pairs: list[tuple[np.ndarray, np.ndarray]], least: float = SIMILARITY) -> np.ndarray:
    """Whether 1 - edit distance / longer length is at least `least`, by bands that widen until they can tell."""
    out = np.zeros(len(pairs), bool)
    trimmed, allowed = [], np.zeros(len(pairs), np.int64)
    for i, (a, b) in enumerate(pairs):
        longest = max(len(a), len(b))
        allowed[i] = int(np.floor((1 - least) * longest + 1e-9))
        n = min(len(a), len(b))
        diff = np.nonzero(a[:n] != b[:n])[0]
        head = int(diff[0]) if len(diff) else n
        a, b = a[head:], b[head:]
        n = min(len(a), len(b))
        diff = np.nonzero(a[::-1][:n] != b[::-1][:n])[0]
        tail = int(diff[0]) if len(diff) else n
        trimmed.append((a[: len(a) - tail], b[: len(b) - tail]))
    gap = np.array([abs(len(a) - len(b)) for a, b in trimmed], np.int64)
    size = np.array([max(len(a), len(b)) for a, b in trimmed], np.int64)
    out[size <= allowed] = True
    live = np.nonzero((gap <= allowed) & ~out)[0]
    gap[live] = np.maximum(gap[live], [least_distance(*trimmed[i]) for i in live])
    live = live[gap[live] <= allowed[live]]  # from here on gap is the least band that can tell
    band = 8
    while len(live):
        own = live[gap[live] <= band]
        later = live[gap[live] > band]
        unsure = []
        own = own[np.argsort(size[own])]
        at = 0
        while at < len(own):
            stop = at + 1
            while stop < len(own) and (stop + 1 - at) * (size[own[stop]] + 4 * band) < ALIGNED_CELLS // 4 and (stop - at) * (2 * band + 1) < 40_000:
                stop += 1
            group = own[at:stop]
            found = distances([trimmed[i] for i in group], band)
            out[group] = found <= np.minimum(allowed[group], band)
            unsure.append(group[(found > band) & (allowed[group] > band)])
            at = stop
        live = np.concatenate([later, *unsure])
        band = min(4 * band, int(allowed[live].max(initial=band)))
    return out


def _signatures(texts: DataFrame) -> DataFrame:
    """key, bucket (which names its hash function too) of texts (key, raw); the text's words are hashed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raws = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            at = 0
            while at < len(raws):
                stop, size = at, 0
                while stop < len(raws) and size < 4_000_000:
                    size += len(raws[stop])
                    stop += 1
                live, rows = sketches([hashed_words(r) for r in raws[at:stop]])
                if len(live):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys[at:stop][live], ALL_SKETCHES)), pa.array(rows.reshape(-1))], ["key", "bucket"])
                at = stop

    return texts.mapInArrow(run, "key long, bucket long")


def _hashed_texts(raw: DataFrame) -> DataFrame:
    """key, words: the hashes of the text's words, four bytes each."""

    def make():
        return lambda texts: [pa.array([hashed_words(t).astype(np.uint32).tobytes() for t in texts.to_pylist()], pa.binary())]

    return annotated(raw, [T.StructField("words", T.BinaryType())], make, ("raw",)).select("key", "words")


def _verified(edges: DataFrame, texts: DataFrame, least: float, with_rest: bool = True) -> DataFrame:
    """edges (place, key, other, rest) with `alike`; of unlike pairs, rest is what is left of it without other's elements (or null).

    rest has a bit for each element of key's text, none where nothing is left; a null stands for all of them. texts lie in
    buckets of their key, so the pairs go to them. The pairs of an `other` with many of them are dealt over copies of its
    text, as many as keep every share below 1 / HOT of all pairs.
    """
    edges = stored(edges, "omh-edges")
    total = edges.count()
    shares = F.ceil(F.col("n") * HOT / max(1, total)).cast("int").alias("shares")
    hot = stored(hot_keys(edges.groupBy("other").agg(F.count("*").alias("n")), total).select("other", shares), "omh-hubs")
    columns = ["a", "b", "place", "key", "other", "rest"]
    left = lambda some: some.join(texts, "key").withColumnRenamed("words", "a")
    others = texts.select(F.col("key").alias("other"), F.col("words").alias("b"))
    none_hot = hot.isEmpty()
    both = left(edges if none_hot else edges.join(F.broadcast(hot), "other", "left_anti")).join(others, "other").select(*columns)
    if not none_hot:
        dealt = left(edges.join(F.broadcast(hot), "other")).withColumn("share", F.pmod(F.xxhash64("key", "place"), "shares").cast("int"))
        copies = others.join(F.broadcast(hot), "other").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
        both = both.unionByName(dealt.join(copies, ["other", "share"]).select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda c: [np.frombuffer(w, np.uint32).astype(np.uint64) for w in c.to_pylist()]
        for batch in batches:
            for a, b, place, key, other, rest in byte_slices(tuple(batch.columns), 2_000_000):
                part = pa.RecordBatch.from_arrays([place, key, other, rest], ["place", "key", "other", "rest"])
                pairs = list(zip(of(a), of(b), strict=True))
                alike = similar(pairs, least)
                rests = [None if same or not with_rest else left_over(rest, a, b) for same, rest, (a, b) in zip(alike.tolist(), rest.to_pylist(), pairs, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(rests, pa.binary()), pa.array(alike)], ["place", "key", "other", "rest", "alike"])

    return both.mapInArrow(run, "place long, key long, other long, rest binary, alike boolean")


def bits(rest: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(rest, np.uint8), count=n).astype(bool)


def left_over(rest: bytes | None, a: np.ndarray, b: np.ndarray) -> bytes:
    """A bit for each element of a: whether it is in rest (a null holds all) and b does not have it. Empty if none is left."""
    own = elements([a])[0]
    left = ~np.isin(own, elements([b])[0])
    if rest is not None:
        left &= bits(rest, len(own))
    return np.packbits(left).tobytes() if left.any() else b""


def _rest_signatures(pending: DataFrame, texts: DataFrame) -> DataFrame:
    """place, key, sketch number, bucket of the unmatched (place, key, rest): the smallest hash of the rest's elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, rests, *ids in byte_slices(tuple(batch.columns), 2_000_000):
                own, first = elements([np.frombuffer(w, np.uint32).astype(np.uint64) for w in texts.to_pylist()])
                kept = [bits(r, n) for r, n in zip(rests.to_pylist(), np.diff(first).tolist(), strict=True)]
                items, starts = own[np.concatenate(kept)], np.cumsum([0, *map(np.count_nonzero, kept)])[:-1]
                rows = np.stack([np.minimum.reduceat(mix(items, 300 + s), starts) for s in range(REST_SKETCHES)], 1).view(np.int64)
                numbers = np.tile(np.arange(REST_SKETCHES, dtype=np.int32), len(kept))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(c.to_numpy(zero_copy_only=False), REST_SKETCHES)) for c in ids] + [pa.array(numbers), pa.array(rows.reshape(-1))], ["place", "key", "sketch", "bucket"])

    return pending.join(texts, "key").select("words", "rest", "place", "key").mapInArrow(run, "place long, key long, sketch int, bucket long")


def _unmatched_links(pending: DataFrame, texts: DataFrame, least: float) -> list[DataFrame]:
    """Links (key, other) among the unmatched members (place, key, rest) of each place, round by round until none are left."""
    links = []
    while True:
        pending = stored(pending, "omh-pending")
        buckets = stored(_rest_signatures(pending, texts), "omh-rest")
        group = buckets.groupBy("place", "sketch", "bucket").agg(F.min("key").alias("other"), F.max("key").alias("high"), F.count("*").alias("n")).where("other < high").drop("high")
        met = join_keyed(buckets, stored(group, "omh-group"), ["place", "sketch", "bucket"], buckets.count())
        pairs = met.where("key <> other").select("place", "key", "other").distinct()
        checked = stored(_verified(pairs.join(pending, ["place", "key"]), texts, least), "omh-checked")
        if checked.isEmpty():
            return links
        links.append(checked.where("alike").select("key", "other"))
        # whoever is like one of its place's representatives is matched
        matched = checked.where("alike").select("place", "key").distinct()
        unlike = checked.where("not alike and length(rest) > 0").join(matched, ["place", "key"], "left_anti")
        pending = unlike.select(F.xxhash64("place", "other").alias("place"), "key", "rest")


def components(edges: DataFrame) -> DataFrame:
    """key, root of every key of the edges (key, other): the smallest key it is linked with, directly or by others.

    Each round a node takes the smallest root of its neighbours, then its root's root; the tables are written each round.
    """
    both = stored(edges.select("key", "other").union(edges.select(F.col("other"), F.col("key"))).distinct(), "omh-links")
    roots = stored(both.groupBy("key").agg(F.least(F.min("other"), F.col("key")).alias("root")), "omh-roots")
    while True:
        near = both.join(roots.select(F.col("key").alias("other"), F.col("root").alias("seen")), "other").groupBy("key").agg(F.min("seen").alias("seen"))
        hop = roots.select(F.col("key").alias("root"), F.col("root").alias("next"))
        fresh = roots.join(near, "key").join(hop, "root").select("key", "root", F.least("root", "seen", "next").alias("new"))
        fresh = stored(fresh, "omh-roots")
        if fresh.where("new < root").isEmpty():
            return fresh.select("key", F.col("new").alias("root"))
        roots = fresh.select("key", F.col("new").alias("root"))


def _united(links: list[DataFrame]) -> DataFrame:
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    return found


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (key, other) that links found so far, with their roots (key, root), do not join."""
    pairs = stored(pairs, "omh-pairs")
    seen = roots.select(F.col("key").alias("other"), F.col("root").alias("other_root"))
    ends = stored(pairs.groupBy("other").agg(F.count("*").alias("n")).join(seen, "other", "left").select("other", "n", F.coalesce("other_root", "other").alias("other_root")), "omh-ends")
    met = join_keyed(pairs, ends, ["other"], pairs.count()).join(roots, "key", "left")
    return met.where(F.coalesce("root", "key") != F.col("other_root")).select("key", "other")


def classes(docs: DataFrame, text: str = "text", doc: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, is_first of every row: class_id is the smallest doc_id of its near-duplicates, itself included.

    Texts compare by their words (lower-case runs of ASCII letters, digits and other characters). Texts without words
    are copies of one another only if the texts are equal (an empty text is one of them); rows with a null text, or without an id, stand alone (their
    class is their own id) and are first. Repeated rows with one id share its class; all of them are first if one is.
    """
    raw = docs.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).cast("long").alias("key"), F.col(text).cast("binary").alias("raw"))
    hashes = stored(raw.select("key", F.sha2("raw", 256).alias("hash")), "omh-hashes")
    shared = stored(hashes.groupBy("hash").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1"), "omh-shared")
    copies = stored(join_keyed(hashes, shared, ["hash"], hashes.count()).where("key <> first").groupBy("key").agg(F.min("first").alias("first")), "omh-copies")
    buckets = stored(_signatures(raw).join(copies.select("key"), "key", "left_anti"), "omh-buckets")
    # the largest key is the other representative: the buckets of one shared passage then have few pairs of representatives
    group = buckets.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("some"), F.count("*").alias("n"), F.bit_xor("key").alias("all")).where("low < some")
    group = stored(group, "omh-group")
    # the smallest, the largest and the exclusive-or of all tell every member of up to three
    middle = F.when(F.col("n") == 3, F.col("all").bitwiseXOR(F.col("low")).bitwiseXOR(F.col("some"))).otherwise(F.col("low"))
    small = group.where("n <= 3").select(F.explode(F.array_distinct(F.array("low", middle, "some"))).alias("key"), "low", "some")
    large = stored(group.where("n > 3").drop("all"), "omh-large")
    met = stored(join_keyed(buckets, large, ["bucket"], buckets.count()).select("key", "low", "some").unionByName(small), "omh-met")
    members = stored(met.select("key").distinct(), "omh-members")
    # hashed before anything is shuffled, as the hashes take less room than the texts
    texts, drop = keyed_table(_hashed_texts(raw).join(members, "key", "left_semi").dropDuplicates(["key"]), "omh_texts", "key")
    whole = lambda edges: edges.select(F.col("other").alias("place"), "key", "other", F.lit(None).cast("binary").alias("rest"))
    alike = lambda tables: [t.where("alike").select("key", "other") for t in tables]
    first = stored(met.where("key <> low").groupBy("key", F.col("low").alias("other")).agg(F.count("*").alias("times")), "omh-first")
    best = first.groupBy("key").agg(F.max_by("other", F.struct("times", -F.col("other"))).alias("other"))
    checked = [stored(_verified(whole(best), texts, least), "omh-checked")]
    later = first.select("key", "other").join(checked[0].select("key", "other"), ["key", "other"], "left_anti")
    checked.append(stored(_verified(whole(_apart(later, components(alike(checked)[0]))), texts, least), "omh-checked"))
    both = checked[0].unionByName(checked[1])
    roots = components(_united(alike(checked)))
    # a text unlike its bucket's smallest key meets the bucket's largest one, if no links join them
    failed = met.join(both.where("not alike").select("key", F.col("other").alias("low")), ["key", "low"])
    failed = stored(failed.where("key <> some").select("key", "low", "some").distinct(), "omh-failed")
    open_ = stored(_apart(failed.select("key", F.col("some").alias("other")).distinct(), roots), "omh-open")
    second = open_.join(both.select("key", "other"), ["key", "other"], "left_anti")
    again = stored(_verified(whole(second), texts, least, with_rest=False).drop("rest"), "omh-checked")
    links = alike([*checked, again])
    # a text unlike both is left with what it does not share with the smallest key; the other representative stays to be met
    strange = open_.join(links[2], ["key", "other"], "left_anti").withColumnRenamed("other", "some")
    lone = failed.join(strange, ["key", "some"]).select("key", F.col("low").alias("other")).distinct()
    pending = both.where("length(rest) > 0").join(lone, ["key", "other"], "left_semi").select("place", "key", "rest")
    links += _unmatched_links(pending, texts, least)
    drop()
    roots = components(_united(links))
    moved = copies.join(roots.withColumnRenamed("key", "first"), "first", "left").select("key", F.coalesce("root", "first").alias("root"))
    mapped = moved.unionByName(roots.join(copies.select("key"), "key", "left_anti")).groupBy("key").agg(F.min("root").alias("root"))
    own = docs.select(F.col(doc).alias("doc_id")).join(mapped.withColumnRenamed("key", "doc_id"), "doc_id", "left")
    return own.select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), F.coalesce(F.col("doc_id") == F.col("root"), F.lit(True)).alias("is_first"))
