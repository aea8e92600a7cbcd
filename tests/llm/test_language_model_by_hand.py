"""The language model against plain Python: counts, base scores, and a document's log-likelihood step by step."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import gated_lm

DOCS = "doc_id long, text string"


def squashed(x):
    return x / (1 + abs(x))


def by_hand(p, lexicon, raw):
    """The natural log-probability of a text's words and tail groups, one word at a time, in double precision."""
    words, h, before, total = gated_lm.tokens(raw), np.zeros(gated_lm.STATE), 0, 0.0
    for word in words:
        g = squashed(p["state"].astype(float) @ h + p["inputs"][:, before].astype(float))
        z, c = g[: gated_lm.STATE] * 0.5 + 0.5, g[gated_lm.STATE :]
        h = h + z * (c - h)
        n = lexicon.number(word)
        scores = p["class_w"].astype(float) @ h + p["class_b"]
        k = n // gated_lm.CLASS_WORDS if n < lexicon.heads else n - lexicon.heads + lexicon.head_classes
        total += scores[k] - np.log(np.exp(scores).sum())
        if n < lexicon.heads:
            inner = p["word_w"][k].astype(float) @ h + p["word_b"][k]
            total += inner[n % gated_lm.CLASS_WORDS] - np.log(np.exp(inner).sum())
        before = n
    return total


def model():
    words = [(f"w{i}".encode(), 500 - i) for i in range(150)] + [(b"", 90)]
    tails = {}
    for w, n in words:
        a = tails.get(gated_lm.tail_of(w), (0, 0))
        tails[gated_lm.tail_of(w)] = (a[0] + n, a[1] + 1)
    lexicon = gated_lm.Lexicon(words, tails, sum(n for _, n in words), len(words))
    p = lexicon.start()
    rng = np.random.default_rng(4)
    return lexicon, {k: (v + rng.normal(0, 0.2, v.shape)).astype(np.float32) for k, v in p.items()}


def test_document_scores_equal_a_word_by_word_version():
    lexicon, p = model()
    rng = np.random.default_rng(5)
    raws = [" ".join(f"w{rng.integers(0, 170)}" for _ in range(n)).encode() for n in (0, 1, 3, 15, 16, 17, 64, 200, 5)] + [None]
    docs = [gated_lm.Reader(lexicon).read(raw)[0] for raw in raws]
    found = gated_lm.Network(p, lexicon.heads).scores(*gated_lm.packed(docs), len(docs))
    assert found == pytest.approx([by_hand(p, lexicon, raw) for raw in raws], rel=1e-4)


def test_gradients_of_inputs_and_biases():
    lexicon, p = model()
    net = gated_lm.Network({k: v.astype(np.float64) for k, v in p.items()}, lexicon.heads)
    rng = np.random.default_rng(6)
    docs = [np.append(rng.integers(1, lexicon.heads, 9), 0).astype(np.int32) for _ in range(gated_lm.LANES // 16)]
    lanes, owner = gated_lm.packed(docs)
    (*window, _), = list(net.windows(lanes, owner))
    g = net.gradients(*window)
    n = max(len(window[5]), net.lanes * gated_lm.STEPS // 2)
    ids, columns = g["inputs"]
    dense = np.zeros_like(net.p["inputs"])
    dense[:, ids] = columns
    for name, found in {"inputs": dense, "class_b": g["class_b"], "word_b": g["word_b"]}.items():
        at = np.unravel_index(np.abs(found).argmax(), found.shape)
        old, step = net.p[name][at], 1e-2
        net.p[name][at] = old + step
        up = -net.scores(lanes, owner, len(docs)).sum() / n
        net.p[name][at] = old - step
        down = -net.scores(lanes, owner, len(docs)).sum() / n
        net.p[name][at] = old
        assert found[at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=1e-5)


def test_counts_and_base_scores_equal_plain_python(spark, monkeypatch):
    monkeypatch.setattr(gated_lm, "KNOWN_WORDS", 20)
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"W{int(rng.zipf(1.5)) % 300}" for _ in range(rng.integers(0, 40)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "a\tb  c\n"), (None, "W1 w2"), (5, rows[5][1]), (303, "é É x")]
    docs = spark.createDataFrame(rows, DOCS)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t in rows if not held(i) for w in gated_lm.tokens(t and t.encode()))
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        words = gated_lm.tokens(t and t.encode())
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)
        want.append((str(i), held(i), len(words), sum(counts[w] > 0 for w in words), total, round(base, 6)))
    found = gated_lm.scored(docs.withColumn("row", F.lit("clash")).withColumn("raw", F.lit(1))).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == sorted(want)


def test_a_text_of_a_million_words():
    """What is held is in proportion to the words, however long one text is."""
    lexicon, p = model()
    long = gated_lm.Reader(lexicon).read(b"w1 w2 w3 w4 " * 250_000)[0]
    short = [gated_lm.Reader(lexicon).read(b"w5 w6")[0] for _ in range(1_000)]
    lanes, owner = gated_lm.packed([*short, long])
    assert lanes.words.nbytes + owner.nbytes < 10 * (len(long) + 3_000)
    assert lanes.lengths[0] == 1_000_001 and len(lanes) == 1_000_001
    w, o = lanes.window(owner, 999_990, 16)
    assert w.shape == (11, 1) and (o == 1_000).all()
