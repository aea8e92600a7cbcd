"""Approximate nearest neighbours by multi-index hashing over learned binary codes.

Vectors are centred, turned by a rotation learned on a bounded sample (principal axes, then the rotation that brings the
sample nearest to the corners of a cube) and cut to their signs. Each of a code's m substrings has an index of its own: a
table keyed by the substring's number and value, in which every row carries its whole code and vector. A code within
Hamming radius r of a query must, in one of the m substrings, lie within r / m of it (the first r mod m + 1 substrings
within the quotient, the others within one less), so probing those substring values retrieves every code within r. What is
retrieved is ranked by its exact Euclidean distance on the original vectors.

The radius grows by query. The sample tells, for pairs at each distance, the radius that holds RECALL of them, whatever the
size of the data. A query is searched with a small radius first; its k-th distance found bounds the true one, so it is
searched again only if that distance asks for a larger radius, with that radius, or if fewer than k were found.

The index is dealt by (substring, leading bits of its value), with more bits as data grow and salts for keys of many rows;
queries are sent to the keys that they probe, and each key answers with its k best of a query. No query or row passes
through the driver. Rows of equal vectors are one row of the index that lists their k + 1 smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import share_of, stored

SUBSTRING = 16
#: About so many distinct rows, chosen by a hash of id and vector, teach the rotation and the radius; of them, queries for the radius.
SAMPLE, SAMPLE_QUERIES = 20_000, 400
RECALL = 0.88
#: Sample pairs of a query that teach the radius: its nearest, and as many others; bins of their distances.
PAIRS, BINS = 64, 24
#: Rows that a key of the index should hold.
KEY_ROWS = 4_096


def usable(vector: Column) -> Column:
    """Not null, not zero, of finite components only."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def encoded(x: np.ndarray, model: dict) -> np.ndarray:
    """Rows of substring values."""
    return np.packbits((x - model["mean"]) @ model["turn"] > 0, axis=1).view(np.uint16)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def reaches(radius: int, m: int) -> list[int]:
    """How far to probe in each of m substrings; -1: not at all."""
    deep, extra = divmod(radius, m)
    return [min(SUBSTRING, deep if j <= extra else deep - 1) for j in range(m)]


def learn(x: np.ndarray, k: int = 10, ids: np.ndarray | None = None) -> dict:
    """Mean, rotation, and radii by distance from sample vectors; the number of bits is the dimension, down to whole substrings.

    ids: whose vectors they are, if an id may have several; only other ids count for the k-th distance.
    """
    dims = x.shape[1]
    bits = max(SUBSTRING, dims // SUBSTRING * SUBSTRING)
    mean = x.mean(0)
    axes = np.linalg.svd(x - mean, full_matrices=False)[2][:bits].T
    rng = np.random.default_rng(17)
    if axes.shape[1] < bits:  # few dimensions or rows: random axes fill up
        axes = np.concatenate([axes, rng.normal(size=(dims, bits - axes.shape[1]))], 1)
    z = (x - mean) @ axes
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(30):
        u, _, v = np.linalg.svd(np.sign(z @ turn).T @ z)
        turn = (u @ v).T
    model = {"mean": mean, "turn": axes @ turn, "bits": bits, "distances": [], "radii": [], "first": bits, "next": bits}
    codes = encoded(x, model)
    ids = np.arange(len(x)) if ids is None else ids
    if len(x) > 2 * k:
        near, far, kth = [], [], []
        for i in rng.permutation(len(x))[:SAMPLE_QUERIES]:
            d = np.sqrt(((x - x[i]) ** 2).sum(1))
            others = np.nonzero(ids != ids[i])[0]
            order = others[np.argsort(d[others], kind="stable")]
            distinct = np.sort(np.unique(ids[order], return_index=True)[1])
            if len(distinct) >= k:
                kth.append(d[order[distinct[k - 1]]])
            near.append(order[:PAIRS])
            far.append(rng.choice(others, min(PAIRS, len(others)), replace=False) if len(others) else others)
            near[-1], far[-1] = (np.stack([d[r], hamming(codes[r], codes[i])]) for r in (near[-1], far[-1]))
        pairs = np.concatenate(near + far, 1)
        pairs = pairs[:, np.argsort(pairs[0], kind="stable")]
        bins = [b for b in np.array_split(pairs, BINS, axis=1) if b.shape[1]]
        if bins and kth:
            model["distances"] = [float(b[0, -1]) for b in bins]
            model["radii"] = [int(r) for r in np.maximum.accumulate([np.quantile(b[1], RECALL, method="higher") for b in bins])]
            model["first"], model["next"] = (needed(model, float(np.quantile(kth, part))) for part in (0.1, 0.9))
    return model


def needed(model: dict, distance: float) -> int:
    """The radius that holds RECALL of the pairs of a distance; all bits beyond the distances of the sample."""
    return next((r for d, r in zip(model["distances"], model["radii"], strict=True) if distance <= d), model["bits"])


class Shard:
    """Rows of the index, each with the ids of its vector's copies, ordered by one substring's value."""

    def __init__(self, ids: list[np.ndarray], x: np.ndarray, codes: np.ndarray, j: int):
        order = np.argsort(codes[:, j], kind="stable")
        self.x, self.codes, self.j = x[order], codes[order], j
        sizes = np.array([len(ids[i]) for i in order], np.int64)
        self.ids, self.row = np.concatenate([ids[i] for i in order]), np.repeat(np.arange(len(order)), sizes)
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        self.values, self.starts = np.unique(self.codes[:, j], return_index=True)
        self.starts = np.append(self.starts, len(order))

    def probed(self, code: np.ndarray, reach: int) -> np.ndarray:
        """The rows whose substring is within reach."""
        met = np.nonzero(np.bitwise_count(self.values ^ code[self.j]) <= reach)[0] if reach >= 0 else np.zeros(0, np.int64)
        return np.concatenate([np.arange(self.starts[v], self.starts[v + 1]) for v in met]) if len(met) else met

    def nearest(self, own: int, q: np.ndarray, code: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and exact distances of the k nearest within the radius; ties go to smaller ids, an id comes once."""
        rows = self.probed(code, reaches(radius, len(code))[self.j])
        rows = rows[hamming(self.codes[rows], code) <= radius]
        rough = ((self.x[rows] - q) ** 2).sum(1)
        last = 2 * k
        while len(rows) > 2 * last:  # the edge widens until k other ids are inside; all that tie with the last row stay
            inside = rough <= np.partition(rough, last)[last] * (1 + 1e-9)
            found = np.unique(np.concatenate([self.ids[self.ends[r] : self.ends[r + 1]] for r in rows[inside]]))
            if len(found) - (own in found) >= k:
                rows, rough = rows[inside], rough[inside]
                break
            last *= 4
        sizes = self.ends[rows + 1] - self.ends[rows]
        ids = np.concatenate([np.zeros(0, np.int64), *[self.ids[self.ends[r] : self.ends[r + 1]] for r in rows]])
        d = np.sqrt(np.repeat(rough, sizes))
        ids, d = ids[ids != own], d[ids != own]
        order = np.lexsort((ids, d))
        ids, d = ids[order], d[order]
        first = np.sort(np.unique(ids, return_index=True)[1])[:k]
        return ids[first], d[first]


def folded(rows: DataFrame, k: int) -> DataFrame:
    """ids, v: a row for each distinct vector with its k + 1 smallest ids; no task holds all ids of a vector."""
    rows = rows.withColumn("s1", F.xxhash64(F.lit(1), "v")).withColumn("s2", F.xxhash64(F.lit(2), "v"))
    place = Window.partitionBy("s1", "s2").orderBy("id")
    few = rows.select("id", "s1", "s2").distinct().withColumn("at", F.row_number().over(place)).where(F.col("at") <= k + 1)
    few = few.groupBy("s1", "s2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min("id").alias("id"))
    return rows.join(few, ["id", "s1", "s2"]).groupBy("s1", "s2").agg(F.first("v").alias("v"), F.first("ids").alias("ids")).select("ids", "v")


INDEX = "j int, value int, code binary, ids array<long>, v array<double>"


def indexed(rows: DataFrame, model: dict) -> DataFrame:
    """INDEX: each row of folded() once for every substring."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = encoded(matrix(batch.column(1)), sent.value)
                raw = pa.array([c.tobytes() for c in codes], pa.binary())
                for j in range(codes.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array([j] * len(codes), pa.int32()), pa.array(codes[:, j].astype(np.int32)), raw, batch.column(0), batch.column(1)], ["j", "value", "code", "ids", "v"])

    return rows.select("ids", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, INDEX)


def matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).astype(float)


PROBE = "j int, high int, id long, radius int, code binary, v array<double>"


def probes(asked: DataFrame, model: dict, high_bits: int) -> DataFrame:
    """PROBE: each query (id, v, radius) once for every key that holds substring values within its reach."""
    sent = asked.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        highs = np.arange(1 << high_bits)
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = encoded(matrix(batch.column(1)), sent.value)
            for i, (code, radius) in enumerate(zip(codes, batch.column(2).to_pylist(), strict=True)):
                for j, reach in enumerate(reaches(radius, len(code))):
                    met = highs[np.bitwise_count(highs ^ (int(code[j]) >> (SUBSTRING - high_bits))) <= reach]
                    same = np.full(len(met), i)
                    yield pa.RecordBatch.from_arrays([pa.array([j] * len(met), pa.int32()), pa.array(met, pa.int32()), batch.column(0).take(same), batch.column(2).take(same), pa.array([code.tobytes()] * len(met), pa.binary()), batch.column(1).take(same)], ["j", "high", "id", "radius", "code", "v"])

    return asked.select("id", F.col("v").cast("array<double>").alias("v"), "radius").mapInArrow(run, PROBE)


class Index:
    """The stored index, the leading bits of its keys, and the salts of keys that hold many rows."""

    def __init__(self, rows: DataFrame, model: dict):
        self.model = model
        table = stored(indexed(rows, model), "mih-index")
        n = table.count() * SUBSTRING // model["bits"]
        self.high_bits = int(np.clip(np.ceil(np.log2(max(1, n / KEY_ROWS))), 0, SUBSTRING))
        table = table.withColumn("high", F.shiftright("value", SUBSTRING - self.high_bits))
        # at most bits / SUBSTRING x 2^SUBSTRING keys, however many rows there are
        self.large = F.broadcast(table.groupBy("j", "high").count().where(F.col("count") > 2 * KEY_ROWS).select("j", "high", F.ceil(F.col("count") / KEY_ROWS).cast("int").alias("salts")))
        self.rows = table.join(self.large, ["j", "high"], "left").select(
            self._key(F.coalesce(F.pmod(F.xxhash64("ids"), F.col("salts")), F.lit(0))), F.lit(0).alias("kind"), "j", F.lit(None).cast("long").alias("id"), F.lit(0).alias("radius"), "code", "ids", "v"
        )

    def _key(self, salt: Column) -> Column:
        return F.xxhash64("j", "high", salt.cast("int")).alias("key")

    def search(self, asked: DataFrame, k: int) -> DataFrame:
        """query_id, vec_id, score, rank, radius of the k nearest of each query (id, v, radius) within its radius."""
        sent = probes(asked, self.model, self.high_bits).join(self.large, ["j", "high"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        sent = sent.select(self._key(F.col("salt")), F.lit(1).alias("kind"), "j", "id", "radius", "code", F.lit(None).cast("array<long>").alias("ids"), "v")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A key's rows come first, then its queries, which are answered batch by batch."""
            key, rows, shard = None, [], None
            for batch in batches:
                keys = batch.column(0).to_numpy()
                edges = [0, *(np.nonzero(np.diff(keys))[0] + 1).tolist(), len(keys)]
                for a, b in zip(edges, edges[1:]):
                    if a == b:
                        continue
                    if keys[a] != key:
                        key, rows, shard = keys[a], [], None
                    part = batch.slice(a, b - a)
                    of_rows = int((part.column(1).to_numpy() == 0).sum())
                    if of_rows:
                        rows.append(part.slice(0, of_rows))
                    part = part.slice(of_rows)
                    if not part.num_rows or not rows:
                        continue
                    if shard is None:
                        ids = [np.array(i, np.int64) for r in rows for i in r.column(6).to_pylist()]
                        codes = np.frombuffer(b"".join(c for r in rows for c in r.column(5).to_pylist()), np.uint16).reshape(len(ids), -1)
                        shard = Shard(ids, np.concatenate([matrix(r.column(7)) for r in rows]), codes, rows[0].column(2)[0].as_py())
                    found = [shard.nearest(i, q, np.frombuffer(c, np.uint16), r, k) for i, q, c, r in zip(part.column(3).to_pylist(), matrix(part.column(7)), part.column(5).to_pylist(), part.column(4).to_pylist(), strict=True)]
                    sizes = [len(f[0]) for f in found]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(3).to_numpy(), sizes)), pa.array(np.repeat(part.column(4).to_numpy(), sizes).astype(np.int32)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], ["query_id", "radius", "vec_id", "score"])

        n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        met = self.rows.unionByName(sent).repartition(n, "key").sortWithinPartitions("key", "kind").mapInArrow(run, "query_id long, radius int, vec_id long, score double")
        best = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"), F.first("radius").alias("radius"))
        place = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """About `most` of the distinct rows (id, v), by a hash of both: an id of many rows has its share, repeated rows count once."""
    n = rows.select(F.xxhash64("id", "v").alias("slot")).distinct().count()
    some = rows if n <= most else rows.where(share_of(["id", "v"], most / n))
    return some.dropDuplicates(["id", "v"])


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, vec: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: of each query row its k nearest among the vectors of another id.

    Rows without an id, with a null or zero vector, with null or non-finite components, or of another dimension than
    most take no part, as candidates or as queries. Repeated rows of an id count once: as a candidate with its nearest
    vector, as a query with its smallest. Ties go to the smaller vec_id. Other columns are ignored.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    of = lambda df: df.where(F.col(vec).isNotNull() & usable(F.col(embedding))).select(F.col(vec).cast("long").alias("id"), F.col(embedding).alias("v"))
    rows = of(vectors)
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return empty
    rows = rows.where(F.size("v") == dims["d"])
    asked = stored(of(queries).where(F.size("v") == dims["d"]).groupBy("id").agg(F.min("v").alias("v")), "mih-asked")
    sample = sampled(rows, SAMPLE).toArrow()
    ids, x = sample["id"].to_numpy(), matrix(sample["v"].combine_chunks())
    model = learn(x, k, ids)
    index = Index(folded(rows, k), model)
    asks = lambda d: F.coalesce(*[F.when(d <= edge, r) for edge, r in zip(model["distances"], model["radii"], strict=True)], F.lit(model["bits"]))
    open_, parts = asked.withColumn("radius", F.lit(model["first"])), []
    while True:
        found = stored(index.search(open_, k), "mih-found")
        ends = found.groupBy("query_id").agg(F.max("score").alias("far"), F.count("*").alias("n"))
        told = open_.join(ends, F.col("id") == F.col("query_id"), "left").drop("query_id")
        # with k answers the farthest one tells the radius, with fewer the radius grows to the next step, then to all bits
        more = F.when(F.col("n") >= k, asks(F.col("far"))).otherwise(F.when(F.col("radius") < model["next"], model["next"]).otherwise(model["bits"]))
        open_ = stored(told.withColumn("more", more).where(F.col("more") > F.col("radius")).select("id", "v", F.col("more").alias("radius")), "mih-open")
        if open_.isEmpty():
            parts.append(found)
            break
        parts.append(found.join(open_.select(F.col("id").alias("query_id")), "query_id", "left_anti"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("query_id", "rank", "vec_id", "score")
