"""A gated recurrent language model, trained in numpy by truncated backpropagation and applied to whole documents.

Words are lower-case runs of non-blank bytes, each document ends with an end token. Exact word counts of the training
documents come from one Spark aggregation. The most frequent words are the network's own vocabulary; every other word,
unseen ones included, belongs to one of a fixed number of tail groups, whose words share out their group's probability by
their smoothed counts. The softmax is factored: a class given the state, then a word given class and state.

Training is data-parallel. In each round every task runs truncated backpropagation over its own share of the documents,
state carried from window to window, starting from the parameters of the round before; the parameters are then averaged,
weighted by tokens, in blocks and in two steps, so no task or driver sees all of them. Every training token is learned
from once. Scoring carries the state through a document's windows, so its score is that of the complete document.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .shared import byte_slices, fold, most_frequent, stored

#: Words of the network's vocabulary (with the end token) and of each of its classes.
VOCABULARY, CLASS_WORDS = 2_048, 64
#: Groups of other words, by their last two bytes.
TAILS = 32
STATE = 24
LANES, LANE_WORDS, STEPS = 512, 2_048, 16
ROUNDS = 4
RATE = 0.15
#: Words whose counts every task holds; rarer words' counts come by a shuffle.
KNOWN_WORDS = 131_072
#: Distinct words a task counts before it hands them on, and document bytes packed into lanes at once.
HELD_WORDS, HELD_BYTES = 400_000, 24_000_000
PARTS, HELD = 5, 1
END = b""  # no word is empty


def tokens(raw: bytes | None) -> list[bytes]:
    return (raw or b"").lower().split() + [END]


crc = zlib.crc32


def tail_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAILS


def word_counts(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """word, tail, n over the documents of the training folds; each task sums its own words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([tail_of(w) for w in seen], pa.int32()), pa.array(seen.values(), pa.int64())], ["word", "tail", "n"])

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                seen.update(tokens(raw))
                if len(seen) > HELD_WORDS:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    train = docs.where(fold(doc, PARTS) != HELD).select(F.col(text).cast("binary").alias("raw"))
    return train.mapInArrow(run, "word binary, tail int, n long").groupBy("word").agg(F.first("tail").alias("tail"), F.sum("n").alias("n"))


class Lexicon:
    """The vocabulary's word numbers, classes and counts, and the tail groups' sums."""

    def __init__(self, top: list[tuple[bytes, int]], tails: dict[int, tuple[int, int]], total: int, distinct: int):
        self.known = dict(top)
        own = [w for w, _ in top[: VOCABULARY - 1] if w != END]
        self.own = {w: i for i, w in enumerate([END, *own])}
        self.heads = len(self.own)
        self.head_classes = -(-self.heads // CLASS_WORDS)
        self.classes = self.head_classes + TAILS
        self.total, self.distinct = total, distinct
        counts = np.array([self.known.get(w, 0) + 0.5 for w in self.own], float)
        for w in [END, *own]:
            n, v = tails.get(tail_of(w), (0, 0))
            if w in self.known:
                tails = tails | {tail_of(w): (n - self.known[w], v - 1)}
        self.tail_mass = np.array([tails.get(k, (0, 0))[0] + 0.5 * (tails.get(k, (0, 0))[1] + 1) for k in range(TAILS)])
        self.counts = counts

    def number(self, word: bytes) -> int:
        """0 .. heads-1 for the vocabulary, heads + group for other words."""
        found = self.own.get(word)
        return self.heads + tail_of(word) if found is None else found

    def start(self) -> dict[str, np.ndarray]:
        """Parameters before training: biases give the smoothed word frequencies, the rest is small noise."""
        rng, h = np.random.default_rng(3), STATE
        padded = np.zeros(self.head_classes * CLASS_WORDS)
        padded[: self.heads] = self.counts
        groups = padded.reshape(-1, CLASS_WORDS)
        inner = np.where(groups > 0, np.log(np.maximum(groups, 1e-9)), -1e4)
        p = {
            "inputs": rng.normal(0, 0.3, (2 * h, self.heads + TAILS)), "state": rng.normal(0, 0.7 / np.sqrt(h), (2 * h, h)),
            "class_w": rng.normal(0, 0.05, (self.classes, h)), "class_b": np.log(np.concatenate([groups.sum(1), self.tail_mass])),
            "word_w": rng.normal(0, 0.05, (self.head_classes, CLASS_WORDS, h)), "word_b": inner,
        }
        p["class_b"] -= p["class_b"].max()
        p["word_b"] -= p["word_b"].max(1, keepdims=True)
        return {k: np.ascontiguousarray(v, np.float32) for k, v in p.items()}


class Lanes:
    """Documents laid end to end in lanes, the longest lane first, one lane after another in one array of word numbers."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        self.words, self.lengths = words, lengths
        self.base = np.cumsum(lengths) - lengths

    def window(self, owner: np.ndarray, at: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Word and document numbers of the places at .. at + steps of the lanes that reach them, -1 beyond a lane's end."""
        live = int(np.searchsorted(-self.lengths, -at))
        place = np.arange(at, min(at + steps, int(self.lengths[0])))[:, None]
        inside = place < self.lengths[:live]
        place = np.where(inside, place + self.base[:live], 0)
        return np.where(inside, self.words[place], -1), np.where(inside, owner[place], -1)

    def __len__(self) -> int:
        return int(self.lengths[0]) if len(self.lengths) else 0


def packed(docs: list[np.ndarray]) -> tuple[Lanes, np.ndarray]:
    """The documents in lanes, and the document number of each of the lanes' words; what is held is in proportion to the words.

    There are LANES lanes, fewer where they would be shorter than LANE_WORDS, so that little text still makes many windows.
    """
    count = int(np.clip(sum(map(len, docs)) // LANE_WORDS, LANES // 16, LANES))
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    loads, lanes = [0] * count, [[] for _ in range(count)]
    heap = [(0, k) for k in range(count)]
    for i in order:
        load, k = heapq.heappop(heap)
        lanes[k].append(i)
        loads[k] = load + len(docs[i])
        heapq.heappush(heap, (loads[k], k))
    ranked = sorted(range(count), key=lambda k: -loads[k])
    laid = [i for k in ranked for i in lanes[k]]
    words = np.concatenate([np.zeros(0, np.int32), *(docs[i] for i in laid)]).astype(np.int32, copy=False)
    owner = np.repeat(np.array(laid, np.int32), [len(docs[i]) for i in laid])
    return Lanes(words, np.array([loads[k] for k in ranked], np.int64)), owner


def weighed(z: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of columns of logits: the log-probability of one place each, and all places' weights, in place, with their sums."""
    if z.max() > 60:
        z -= z.max(0)
    picked = z[which, np.arange(z.shape[1])]
    np.exp(z, out=z)
    total = z.sum(0)
    return picked - np.log(total), z, total


class Network:
    """Arrays keep features ahead of words, so that numpy's inner loops run along many words.

    The squashing function is x / (1 + |x|), which numpy computes several times faster than tanh.
    """

    def __init__(self, p: dict[str, np.ndarray], heads: int):
        self.p, self.heads, self.head_classes = p, heads, len(p["word_w"])

    def states(self, before: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list, list]:
        """States ahead of each word of a window (steps, lanes), and each step's old states and gates.

        The gate z and candidate c move h to h + z (c - h).

        before: the word before each place; fresh: where a document starts, whose state is zero and which reads the end token.
        """
        steps, lanes = before.shape
        hs, olds, gates = np.empty((STATE, steps, lanes), np.float32), [], []
        stays, rows = (~fresh).astype(np.float32), np.ascontiguousarray(self.p["inputs"].T)
        for t in range(steps):
            h = h * stays[t]
            olds.append(h)
            g = self.p["state"] @ h
            g += rows.take(before[t], 0).T
            size = np.abs(g)
            size += 1
            g /= size
            z, c = g[:STATE], g[STATE:]
            z *= 0.5
            z += 0.5
            h = h + z * (c - h)
            gates.append(g)
            hs[:, t] = h
        return hs, olds, gates

    def sorted_by_class(self, flat: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places and words in order of their class, the classes, and where each class of the vocabulary begins."""
        k = np.where(ids < self.heads, ids // CLASS_WORDS, ids - self.heads + self.head_classes)
        order = np.argsort(k.astype(np.int16), kind="stable")
        return flat[order], ids[order], k[order], np.searchsorted(k[order], np.arange(self.head_classes + 1))

    def class_part(self, hs: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = self.p["class_w"] @ hs
        z += self.p["class_b"][:, None]
        return weighed(z, k)

    def word_parts(self, hs: np.ndarray, ids: np.ndarray, edges: np.ndarray) -> Iterator[tuple]:
        """For each class of the vocabulary that is met: its places, words inside it, log-probabilities, weights, sums."""
        for c in range(self.head_classes):
            own = slice(edges[c], edges[c + 1])
            if edges[c] < edges[c + 1]:
                z = self.p["word_w"][c] @ hs[:, own]
                z += self.p["word_b"][c][:, None]
                inner = ids[own] - c * CLASS_WORDS
                yield c, own, inner, *weighed(z, inner)

    def windows(self, ids: Lanes, owner: np.ndarray) -> Iterator[tuple]:
        """Windows of STEPS places with their states; lanes end in order of their length, state goes on to the next window."""
        self.lanes = len(ids.lengths)
        h, last, previous = np.zeros((STATE, self.lanes), np.float32), np.full(self.lanes, -1, np.int32), np.zeros(self.lanes, np.int32)
        for at in range(0, len(ids), STEPS):
            w, o = ids.window(owner, at, STEPS)
            live = w.shape[1]
            fresh = np.concatenate([last[None, :live], o[:-1]]) != o
            before = np.where(fresh, 0, np.maximum(np.concatenate([previous[None, :live], w[:-1]]), 0))
            hs, olds, gates = self.states(before, fresh, h[:, :live])
            h, last, previous = hs[:, -1].copy(), o[-1], w[-1]
            flat = np.nonzero(o.reshape(-1) >= 0)[0]
            flat, words, k, edges = self.sorted_by_class(flat, w.reshape(-1)[flat])
            yield before, fresh, hs, olds, gates, flat, words, k, edges, o

    def scores(self, ids: Lanes, owner: np.ndarray, docs: int) -> np.ndarray:
        """Natural log-probability of each document's words and tail groups."""
        out = np.zeros(docs)
        for _, _, hs, _, _, flat, words, k, edges, o in self.windows(ids, owner):
            states = hs.reshape(STATE, -1).take(flat, 1)
            logp, _, _ = self.class_part(states, k)
            for _, own, _, inner, _, _ in self.word_parts(states, words, edges):
                logp[own] += inner
            out += np.bincount(o.reshape(-1)[flat], logp, docs)
        return out

    def train(self, ids: Lanes, owner: np.ndarray, rate: float, moments: dict) -> None:
        """One pass of truncated backpropagation: gradients stop at a window's start, the state does not."""
        for *window, _ in self.windows(ids, owner):
            self.update(self.gradients(*window), rate, moments)

    def gradients(self, before, fresh, hs, olds, gates, flat, words, k, edges) -> dict[str, np.ndarray]:
        p, n = self.p, np.float32(max(len(flat), self.lanes * STEPS // 2))  # a window of few words moves little
        states = hs.reshape(STATE, -1).take(flat, 1)
        _, prob, total = self.class_part(states, k)
        prob *= 1 / (n * total)
        prob[k, np.arange(len(k))] -= 1 / n
        g = {"class_w": prob @ states.T, "class_b": prob.sum(1), "word_w": np.zeros_like(p["word_w"]), "word_b": np.zeros_like(p["word_b"])}
        d = p["class_w"].T @ prob
        for c, own, inner, _, z, total in self.word_parts(states, words, edges):
            z *= 1 / (n * total)
            z[inner, np.arange(len(inner))] -= 1 / n
            g["word_w"][c] = z @ states[:, own].T
            g["word_b"][c] = z.sum(1)
            d[:, own] += p["word_w"][c].T @ z
        place = np.full(hs[0].size, len(flat))  # of each place in d, whose last column is zero
        place[flat] = np.arange(len(flat))
        dh = np.concatenate([d, np.zeros((STATE, 1), np.float32)], 1).take(place, 1).reshape(hs.shape)
        into = np.empty((2 * STATE, *hs.shape[1:]), np.float32)
        g["state"] = np.zeros_like(p["state"])
        carry = np.zeros((STATE, hs.shape[2]), np.float32)
        stays, back = (~fresh).astype(np.float32), p["state"].T
        for t in range(hs.shape[1] - 1, -1, -1):
            carry += dh[:, t]
            g_t = gates[t]
            z, c = g_t[:STATE], g_t[STATE:]
            slope = np.abs(g_t)
            slope[:STATE] = np.abs(2 * z - 1)
            np.subtract(1, slope, out=slope)
            slope *= slope
            d_t = np.concatenate([carry * (c - olds[t]) * 0.5, carry * z])
            d_t *= slope
            into[:, t] = d_t
            g["state"] += d_t @ olds[t].T
            carry *= 1 - z
            carry += back @ d_t
            carry *= stays[t]
        flat_into = into.reshape(2 * STATE, -1)
        order = np.argsort(before.reshape(-1).astype(np.int16), kind="stable")
        ids = before.reshape(-1)[order]
        first = np.nonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))[0]
        g["inputs"] = (ids[first], np.add.reduceat(flat_into.take(order, 1), first, axis=1))
        return g

    def update(self, g: dict, rate: float, moments: dict) -> None:
        """Adagrad; the inputs' columns are updated where they were read."""
        for k, d in g.items():
            if k == "inputs":
                ids, d = d
                m = moments[k][:, ids] + d * d
                moments[k][:, ids] = m
                self.p[k][:, ids] -= rate * d / (np.sqrt(m) + 1e-6)
            else:
                moments[k] += d * d
                self.p[k] -= rate * d / (np.sqrt(moments[k]) + 1e-6)


class Reader:
    """Word numbers of texts, and the logarithms of their words' counts: one look-up a word, more only for rare ones."""

    def __init__(self, lexicon: Lexicon):
        known = list(lexicon.known)
        self.at = dict(zip(known, range(len(known)), strict=True)).get
        self.heads = lexicon.heads
        self.numbers = np.array([*map(lexicon.number, known), 0], np.int32)
        self.logs = np.log10(np.array([*lexicon.known.values(), 0]) + 0.5)

    def read(self, raw: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words, and their places among the known words (-1 for others)."""
        words = tokens(raw)
        place = np.fromiter(map(self.at, words, repeat(-1)), np.int32, len(words))
        ids = self.numbers[place]
        rare = np.nonzero(place < 0)[0]
        ids[rare] = [self.heads + crc(words[i][-2:]) % TAILS for i in rare.tolist()]
        if place[-1] < 0:  # the end token, where nothing was learned from
            ids[-1] = 0
        return ids, place

    def lessons(self, raws: list) -> list[np.ndarray]:
        """What training reads: each text whole, so that its state is carried from its first word to its end token."""
        return [self.read(raw)[0] for raw in raws]


def _held(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.Array, list]]:
    """The first column and the texts of slices that hold some megabytes of text."""
    for batch in batches:
        for texts, first in byte_slices((batch.column(column), batch.column(0)), HELD_BYTES):
            yield first, texts.to_pylist()


BLOCKS = 16


def _averaged(shards: DataFrame) -> DataFrame:
    """Blocks of parameters (block, salt, weight, values) averaged by weight, first within a salt, then over all."""

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for batch in batches:
            for block, salt, weight, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = sums.setdefault((block, salt), [0.0, 0.0])
                own[0] += weight
                own[1] = own[1] + weight * np.frombuffer(values, np.float32).astype(float)
        for (block, salt), (weight, total) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([salt], pa.int32()), pa.array([weight], pa.float64()), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], ["block", "salt", "weight", "values"])

    kind = "block int, salt int, weight double, values binary"
    some = shards.repartition(BLOCKS * 4, "block", "salt").mapInArrow(mean, kind)
    return some.withColumn("salt", F.lit(0)).repartition(BLOCKS, "block").mapInArrow(mean, kind)


def fit(docs: DataFrame, lexicon: Lexicon, doc: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Trained parameters: each round learns from its share of the training documents, then averages.

    The sums of squared gradients, which set the step sizes, are averaged and carried on like the parameters.
    """
    spark = docs.sparkSession
    p = lexicon.start()
    p |= {f"{k}.moment": np.full(v.shape, 1e-4, np.float32) for k, v in p.items()}
    shapes = {k: v.shape for k, v in p.items()}
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast((lexicon, p))
        rate = RATE * (1 - 0.5 * turn / max(1, rounds - 1))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, rate=rate) -> Iterator[pa.RecordBatch]:
            lexicon, start = sent.value
            net = Network({k: v.copy() for k, v in start.items() if "." not in k}, lexicon.heads)
            moments = {k: start[f"{k}.moment"].copy() for k in net.p}
            reader, weight, salt = Reader(lexicon), 0, 0
            for _, raws in _held(batches, 0):
                texts = reader.lessons(raws)
                salt = zlib.crc32(raws[0] or b"") % 64
                net.train(*packed(texts), rate, moments)
                weight += sum(map(len, texts))
            if weight:
                found = net.p | {f"{k}.moment": v for k, v in moments.items()}
                flat = np.concatenate([found[k].reshape(-1) for k in sorted(found)])
                for block, part in enumerate(np.array_split(flat, BLOCKS)):
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([salt], pa.int32()), pa.array([float(weight)], pa.float64()), pa.array([part.tobytes()], pa.binary())], ["block", "salt", "weight", "values"])

        share = docs.where((fold(doc, PARTS) != HELD) & (F.pmod(F.xxhash64(doc), F.lit(rounds)) == turn)).select(F.col(text).cast("binary").alias("raw"))
        blocks = _averaged(share.mapInArrow(run, "block int, salt int, weight double, values binary")).collect()
        if blocks:
            flat = np.concatenate([np.frombuffer(b["values"], np.float32) for b in sorted(blocks, key=lambda b: b["block"])])
            at, p = 0, {}
            for k in sorted(shapes):
                size = int(np.prod(shapes[k]))
                p[k] = flat[at : at + size].reshape(shapes[k]).copy()
                at += size
    return p


def lexicon_of(counts: DataFrame) -> Lexicon:
    """From word counts: the most frequent words, KNOWN_WORDS at most, and sums by tail group and over all."""
    top: list[Row] = most_frequent(counts, KNOWN_WORDS).select("word", "n").collect()
    tails = {r["tail"]: (r["n"], r["v"]) for r in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    ordered = sorted(((bytes(r["word"]), r["n"]) for r in top), key=lambda w: (-w[1], w[0]))
    return Lexicon(ordered, tails, sum(n for n, _ in tails.values()), sum(v for _, v in tails.values()))


SCORED = "doc_id long, n_tokens long, known long, seen_log double, net_log double, rare array<struct<word: binary, times: long>>"


def scored(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; scores are log10 probabilities.

    Learns from the documents whose crc32 fold is not the held-out one (a null id counts as fold 0). A null text is
    empty: its one token is the end. Texts of any length are scored whole, with the state carried to their end; repeated
    rows score alike. With no training document every word is unseen; an empty table gives no rows. Other columns,
    whatever their names, take no part.
    """
    spark = docs.sparkSession
    counts = stored(word_counts(docs, doc, text), "lm-counts")
    lexicon = lexicon_of(counts)
    p = fit(docs, lexicon, doc, text)
    sent = spark.sparkContext.broadcast((lexicon, p))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, p = sent.value
        net, reader = Network(p, lexicon.heads), Reader(lexicon)
        shift = np.log10(lexicon.tail_mass)
        for ids_of, raws in _held(batches, 1):
            read, rows, rare_words, rare_times, ends = [], [], [], [], [0]
            for raw in raws:
                ids, place = reader.read(raw)
                rare = np.nonzero(place < 0)[0]
                if len(rare):
                    own = tokens(raw)
                    found = Counter([own[i] for i in rare.tolist()])
                    rare_words += found
                    rare_times += found.values()
                ends.append(len(rare_words))
                logs = np.where(place < 0, 0.0, reader.logs[place])
                tail = ids >= lexicon.heads
                read.append(ids)
                rows.append((len(ids), int((place >= 0).sum()), float(logs.sum()), float(logs[tail].sum() - shift[ids[tail] - lexicon.heads].sum())))
            logp = net.scores(*packed(read), len(read)) / np.log(10)
            n, known, seen, moved = zip(*rows, strict=True)
            rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_times, pa.int64())], ["word", "times"]))
            yield pa.RecordBatch.from_arrays([ids_of, pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(seen, pa.float64()), pa.array(logp + np.array(moved)), rare], [f.split()[0] for f in SCORED.split(", ", 5)])

    base = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("raw"))
    # each row's number is written with it, so that the rare words' counts come back to the row, whatever its id
    marked = stored(base.mapInArrow(score, SCORED).withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    tails = marked.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times").join(counts.select("word", "n"), "word", "left")
    tails = tails.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_log"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    both = marked.drop("rare").join(tails, "row", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return both.select(
        "doc_id", (fold("doc_id", PARTS) == HELD).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(lexicon.total).cast("long").alias("train_tokens"),
        (F.col("seen_log") + rare_log - F.col("n_tokens") * float(np.log10(lexicon.total + 0.5 * (lexicon.distinct + 1)))).alias("base_score"), (F.col("net_log") + rare_log).alias("score"),
    )
