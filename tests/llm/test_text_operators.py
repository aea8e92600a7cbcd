"""Order MinHash, FM-index, byte BPE, classifiers and the language model on small and odd inputs."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.llm import byte_bpe, byte_cnn, fm_index, gated_lm, nbsvm, order_minhash, toxicity
from leafmill.llm.shared import words

DOCS = "doc_id long, text string"
RANKS = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, one letter, repeated rows, a long text, a null id."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "a"), (4, "the same row"), (4, "the same row"), (5, long), (None, "no id here"), (6, "\n\n  \t"), (7, "Ünïcödé ≠ ascii 😀 x")]
    return spark.createDataFrame(rows, DOCS)


def sentence(rng, n):
    return " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "magna", "vero", "eos", "stet", "clita"]) + str(rng.randrange(60)) for _ in range(n))


# --- Order MinHash


def brute_distance(a, b):
    d = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(d[j] + 1, new[-1] + 1, d[j - 1] + (x != y)))
        d = np.array(new)
    return d[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), max_size=40)), min_size=1, max_size=5))
def test_banded_alignment_is_exact(pairs):
    arrays = [(np.array(a, np.uint64), np.array(b, np.uint64)) for a, b in pairs]
    want = [brute_distance(a, b) <= int(np.floor(0.2 * max(len(a), len(b)) + 1e-9)) for a, b in pairs]
    assert order_minhash.similar(arrays).tolist() == want
    assert [x == brute_distance(a, b) for x, (a, b) in zip(order_minhash.distances(arrays, 50), pairs)] == [True] * len(pairs)


def test_near_duplicates_group(spark):
    rng = random.Random(1)
    base = sentence(rng, 200).split()
    near = base[:50] + ["changed"] + base[51:150] + base[152:]
    turned = base[100:] + base[:100]
    other = sentence(rng, 200)
    rows = [(10, " ".join(base)), (11, " ".join(near)), (12, " ".join(base)), (13, other), (14, " ".join(base).upper() + "!"), (15, " ".join(turned)), (16, "short text"), (17, "short text"), (18, "short texts")]
    found = {r.doc_id: r for r in order_minhash.classes(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i: r.class_id for i, r in found.items()} == {10: 10, 11: 10, 12: 10, 13: 13, 14: 10, 15: 15, 16: 16, 17: 16, 18: 18}
    assert sorted(i for i, r in found.items() if r.is_first) == [10, 13, 15, 16, 18]


def test_a_large_group_of_copies_is_one_class(spark):
    rng = random.Random(2)
    base = sentence(rng, 120).split()
    rows = [(i, " ".join(base[:i % 7] + ["x"] + base[i % 7 :]) if i % 2 else " ".join(base)) for i in range(400)]
    assert order_minhash.classes(spark.createDataFrame(rows, DOCS)).select("class_id").distinct().count() == 1


def test_minhash_odd_rows(spark, odd):
    found = order_minhash.classes(odd.withColumn("class_id", F.lit("clash"))).collect()
    assert len(found) == 9
    assert {(r.doc_id, r.class_id) for r in found} == {(i, i) for i in (1, 2, 3, 4, 5, 6, 7)} | {(None, None)}
    assert all(r.is_first for r in found)
    assert order_minhash.classes(spark.createDataFrame([], DOCS)).count() == 0


# --- FM-index


def brute_leaks(docs, items, window=10):
    phrases = {}
    for item, text in items:
        w = words(text.encode()) if text else []
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            phrases.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        w, hit, ids = words(text.encode()) if text else [], set(), set()
        for size in {len(p) for p in phrases}:
            for i in range(len(w) - size + 1):
                if owners := phrases.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    ids |= owners
        out[doc] = (len(w), len(hit), sorted(ids))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    items = [(i, sentence(rng, rng.choice([0, 1, 4, 9, 10, 11, 30]))) for i in range(30)] + [(99, None), (5, "two words")]
    docs = []
    for i in range(120):
        parts = [sentence(rng, rng.randrange(40))]
        if i % 3 == 0:
            w = items[rng.randrange(30)][1].split()
            parts.append(" ".join(w[rng.randrange(len(w) + 1) :]).upper())
        docs.append((i, ", ".join([*parts, sentence(rng, 5)])))
    docs += [(200, None), (201, ""), (202, docs[0][1])]
    found = fm_index.find_leaks(spark.createDataFrame(docs, DOCS).withColumn("spans", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for r in found} == brute_leaks(docs, items)
    for r in found:
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_benchmark_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, sentence(rng, 25)) for i in range(12)]
    docs = [(i, sentence(rng, 8) + " " + items[i % 12][1] + " " + items[(i + 5) % 12][1]) for i in range(20)]
    a, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    whole = {r.doc_id: (r.spans, r["items"]) for r in fm_index.find_leaks(a, b).collect()}
    monkeypatch.setattr(fm_index, "BLOCK_BYTES", 600)
    assert {r.doc_id: (r.spans, r["items"]) for r in fm_index.find_leaks(a, b).collect()} == whole
    assert all(not r.spans for r in fm_index.find_leaks(a, b.limit(0)).collect())


def test_cut_spans_keeps_the_rest(spark):
    docs = spark.createDataFrame([(1, "Keep this, alpha beta gamma! and that.")], DOCS)
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    assert fm_index.cut_spans(fm_index.find_leaks(docs, bench)).first().cut == "Keep this, ! and that."


def test_suffix_array_and_rank():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 200):
        x = rng.integers(1, 4, n)
        order = fm_index.suffix_array(np.append(x, 0))
        assert order.tolist() == sorted(range(n + 1), key=lambda i: np.append(x, 0)[i:].tolist())
        w = fm_index.WaveletMatrix(x, 3)
        for s in range(5):
            at = np.arange(n + 1)
            assert w.rank(np.full(n + 1, s), at).tolist() == [int((x[:i] == s).sum()) for i in at]
        assert w.at(np.arange(n)).tolist() == x.tolist()


# --- byte-level BPE


def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_bpe_equals_tiktoken(spark, odd):
    docs = odd.unionByName(spark.createDataFrame([(20, "don't   stop\n\n  now 1234 x" + "é" * 500), (21, "a" * 5_000), (22, "漢字かな交じり文 עברית"), (23, "the the the thing thing <|endoftext|>")], DOCS)).withColumn("ids", F.lit("clash"))
    found = byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN), RANKS).collect()
    assert len(found) == 13
    for r in found:
        ids = reference().encode_ordinary(r.text or "")
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert bytes(r.decoded) == (r.text or "").encode()


def test_decoding_odd_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, reference().encode_ordinary("héllo wörld"))], "doc_id long, tokens array<int>").withColumn("decoded", F.lit(1))
    assert {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(rows, RANKS).collect()} == {1: b"", 2: b"", 3: "héllo wörld".encode()}
    wrong = byte_bpe.decode(spark.createDataFrame([(1, [10**6])], "doc_id long, tokens array<int>"), RANKS)
    with pytest.raises(Exception, match="beyond the ranks"):
        wrong.collect()


def test_native_fold_equals_merges(spark):
    pieces = [b"", b"a", b" thonwhing", b"zzzzqqqq", " éèçà".encode(), b"!!!###", b" disgusting", b"12345678"]
    rows = byte_bpe.encode_words(spark.createDataFrame([(bytearray(p),) for p in pieces], "word binary"), RANKS).collect()
    assert [list(r.ids) for r in rows] == [byte_bpe.merged(p, RANKS) if p else [] for p in pieces]


@settings(max_examples=80, deadline=None)
@given(st.binary(min_size=1, max_size=120))
def test_heap_merges_equal_tiktoken(piece):
    assert byte_bpe.merged(piece, RANKS) == reference()._core_bpe.encode_single_piece(piece)


def test_bpe_empty_table(spark):
    assert byte_bpe.encode(spark.createDataFrame([], DOCS), RANKS, P.PATTERN).count() == 0


def test_rank_file(tmp_path):
    (tmp_path / "r").write_text(f"{base64.b64encode(b'ab').decode()} 7\n")
    assert byte_bpe.read_ranks(str(tmp_path / "r")) == {b"ab": 7}


# --- classifiers


def labelled(n=240):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        text = sentence(rng, 60)
        rows.append((i, text.replace(" ", " idiot moron ", 3) if bad else text))
        labels.append((i, 0 if i % 2 else 1, int(bad)))
    return rows, labels


def test_toxicity_separates_and_takes_odd_rows(spark, odd):
    rows, labels = labelled()
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, marks)
    found = {r.doc_id: r.toxicity for r in toxicity.scored(docs.withColumn("toxicity", F.lit("clash")), model).collect()}
    assert np.mean([(found[i] > 0.5) == (i % 3 == 0) for i, _ in rows]) > 0.95
    assert all(0 <= r.toxicity <= 1 for r in toxicity.scored(odd, model).collect())
    none = toxicity.learn(docs, marks.limit(0))
    assert {r.toxicity for r in toxicity.scored(odd, none).collect()} == {0.0}


def test_quality_separates_and_takes_odd_rows(spark, odd):
    rng = random.Random(7)
    rows = [(i, sentence(rng, 50).upper().replace(" ", "!! ") if i % 3 == 0 else sentence(rng, 50)) for i in range(240)]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int")
    model = nbsvm.learn(docs, marks)
    found = {r.doc_id: r.quality_score for r in nbsvm.scored(docs, model).collect()}
    assert np.mean([(found[i] > 0.5) == (i % 3 > 0) for i in range(240)]) > 0.97
    assert all(0 <= r.quality_score <= 1 for r in nbsvm.scored(odd, model).collect())
    assert {r.quality_score for r in nbsvm.scored(odd, nbsvm.learn(docs, marks.limit(0))).collect()} == {0.5}
    assert nbsvm.scored(docs.limit(0), model).count() == 0


def test_dual_coordinate_descent_finds_the_margin():
    rows, y = [np.array([0]), np.array([1]), np.array([0, 2]), np.array([1, 2])] * 5, np.array([1.0, -1.0, 1.0, -1.0] * 5)
    w, bias = nbsvm.descend(rows, y, np.ones(3))
    assert all((w[r] @ nbsvm.unit(np.ones(len(r))) + bias) * s > 0.5 for r, s in zip(rows, y))


def test_language_id(spark, odd):
    rng = random.Random(8)
    kinds = {"aa": "abcdeabc", "bb": "uvwxyzuv", "cc": "éèàçôêéè"}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(5)) for _ in range(40)), k) for i in range(150) for k in [list(kinds)[i % 3]]]
    docs = spark.createDataFrame(rows, DOCS + ", lang string")
    model = byte_cnn.learn(docs)
    found = byte_cnn.identified(docs, model).collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    strange = {r.doc_id: (r.lang_pred, r.lang_score) for r in byte_cnn.identified(odd.where("doc_id < 7"), model).collect()}
    assert strange[1] == strange[2] == strange[6] == ("und", 0.0) and strange[5][0] in kinds
    assert byte_cnn.identified(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in byte_cnn.identified(docs, byte_cnn.learn(docs.limit(0))).collect()} == {"und"}


# --- language model


def test_scores_are_probabilities_and_beat_the_base(spark):
    rng = random.Random(9)
    held = next(i for i in range(900, 1000) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows = [(i, " ".join(["one two three four five six"] * 8) if i % 2 else " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(50))) for i in range(300)]
    rows += [(800, None), (801, ""), (held, "unseen words only"), (held, "unseen words only")]
    found = gated_lm.scored(spark.createDataFrame(rows, DOCS)).collect()
    assert len(found) == 304
    assert sum(r.score for r in found) > sum(r.base_score for r in found) * 0.9
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    assert by[800][0].n_tokens == by[801][0].n_tokens == 1
    assert by[held][0].score == pytest.approx(by[held][1].score) and by[held][0].n_tokens == 4 and by[held][0].n_known == 1
    assert all(r.score < 0 for r in found)


def test_class_factored_softmax_sums_to_one():
    top = [(f"w{i}".encode(), 100 - i) for i in range(60)] + [(b"", 50)]
    tails = {}
    for w, n in top:
        k = gated_lm.tail_of(w)
        a = tails.get(k, (0, 0))
        tails[k] = (a[0] + n, a[1] + 1)
    lexicon = gated_lm.Lexicon(top, tails, sum(n for _, n in top), len(top))
    net = gated_lm.Network(lexicon.start(), lexicon.heads)
    hs = np.random.default_rng(0).normal(0, 0.3, (gated_lm.STATE, 1)).astype(np.float32)
    total = 0.0
    for word in range(lexicon.heads + gated_lm.TAILS):
        _, ids, k, edges = net.sorted_by_class(np.array([0]), np.array([word]))
        logp, _, _ = net.class_part(hs, k)
        for _, own, _, inner, _, _ in net.word_parts(hs, ids, edges):
            logp[own] += inner
        total += float(np.exp(logp[0]))
    assert total == pytest.approx(1, abs=1e-4)


def test_backpropagation_equals_differences():
    top = [(f"w{i}".encode(), 100 - i) for i in range(40)] + [(b"", 50)]
    tails = {k: (10_000, 100) for k in range(gated_lm.TAILS)}
    lexicon = gated_lm.Lexicon(top, tails, sum(n for _, n in top), len(top))
    net = gated_lm.Network({k: v.astype(np.float64) for k, v in lexicon.start().items()}, lexicon.heads)
    rng = np.random.default_rng(1)
    docs = [np.append(rng.integers(1, lexicon.heads, 9), 0).astype(np.int32) for _ in range(gated_lm.LANES // 16)]
    ids, owner = gated_lm.packed(docs)
    (*window, _), = list(net.windows(ids, owner))
    g = net.gradients(*window)
    scale = len(window[5]) / max(len(window[5]), net.lanes * gated_lm.STEPS // 2)
    loss = lambda: -net.scores(ids, owner, len(docs)).sum() / len(window[5]) * scale
    for name in ("state", "class_w", "word_w"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old, step = net.p[name][at], 1e-2
        net.p[name][at] = old + step
        up = loss()
        net.p[name][at] = old - step
        down = loss()
        net.p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=1e-5)


def test_language_model_empty_table(spark):
    assert gated_lm.scored(spark.createDataFrame([], DOCS)).count() == 0

