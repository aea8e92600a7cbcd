"""Spelling variants, licence scans and importance resampling against brute force, on odd rows and through their registered queries."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.llm import licenses, queries, resample, variants
from leafmill.llm.shared import words

DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.mark.parametrize("name", ["op11_variable_grams", "op12_rare_words", "op13_prefix_crc"])
def test_registered_query_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found, want = queries.QUERIES[name](spark, SF).toArrow(), con.execute(queries.ORACLES[name]).to_arrow_table()
    assert sorted(found.column_names) == sorted(want.column_names)
    assert len(found) > 0
    rows = lambda t: sorted(map(str, t.select(sorted(t.column_names)).to_pylist()))
    assert rows(found) == rows(want)


# --- spelling variants


def brute_words(docs):
    counts = {}
    for doc, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] = counts.get(w, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_variants(docs):
    n = brute_words(docs)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min((v for v in near[w] if n[v] >= 10 * n[w]), key=lambda v: (-n[v], v), default=None) for w in n}
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def test_variants_equal_brute_force(spark):
    rng = random.Random(1)
    stems = ["".join(rng.choice(["ta", "mi", "ro", "né", "the", "ion", "s"]) for _ in range(rng.randrange(3, 7))) for _ in range(60)]
    docs = []
    for i in range(400):
        text = []
        for _ in range(60):
            w = stems[int(60 * rng.random() ** 3)]
            if rng.random() < 0.15:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abÿ") + w[k:], w[:k] + rng.choice("abÉ") + w[k + 1 :], w + "s", "x" + w])
            text.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        docs.append((i, rng.choice([" ", ", ", "\n", "9"]).join(text)))
    docs += [(None, docs[0][1]), (7, docs[7][1]), (500, None), (501, ""), (502, "abcdefg " * 3 + "ABCDEFH " * 30), (503, "×÷×÷×÷× ×÷×÷×÷×"), (504, "longer" * 3_000 + " " + "longer" * 3_000 + "s")]
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.variants(spark.createDataFrame(docs, DOCS).withColumn("Word", F.lit(1)).withColumn("N", F.lit(2))).collect()}
    want = brute_variants(docs)
    assert found == want
    assert sum(v[0] is not None for v in want.values()) > 100
    assert any(v[0] not in (None, v[1]) for v in want.values())  # a form that has a form


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=7, max_size=14), st.integers(0, 14), st.sampled_from("abcd"), st.sets(st.text("abc^$", min_size=2, max_size=4), max_size=60))
def test_words_with_one_edit_share_a_merged_list(word, at, letter, grams):
    frequent = {g: 5 for g in grams}
    keys = variants.merged_keys(word, frequent)
    for other in (word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :], word[:at] + word[at + 1 :]):
        if other != word and len(other) >= 7:
            assert keys & variants.merged_keys(other, frequent)


def test_variants_of_nothing(spark):
    assert variants.variants(spark.createDataFrame([], DOCS)).count() == 0
    assert variants.variants(spark.createDataFrame([(1, None), (2, "short words only")], DOCS)).count() == 0


def test_a_word_that_is_a_third_of_all_rows(spark):
    docs = [(i, "constant " * 40 + f"constan{'abcdefgh'[i % 8]} " * 2) for i in range(300)]
    found = {r.word: (r.n, r.n_near, r.root) for r in variants.variants(spark.createDataFrame(docs, DOCS)).collect()}
    assert found == {w: (v[2], v[3], v[1]) for w, v in brute_variants(docs).items()}


# --- licence scans


def brute_scan(text):
    w = words(text.encode()) if text else []
    found = []
    for t in licenses.TEMPLATES:
        for s in range(len(w)):
            if all(w[s + at : s + at + len(p)] == p for at, p in t.phrases):
                found.append((t, s, sum(w[s + i : s + i + 1] == [x] for i, x in enumerate(t.words)) / len(t.words)))
    base = [s for t, s, _ in found if t.base]
    names = lambda some: ",".join(sorted({t.label for t, _, _ in some}))
    return len(w), len(base), min(base, default=None), max(base, default=None), names([x for x in found if x[0].base]), names(found), max((x[2] for x in found), default=0.0)


def test_licences_equal_brute_force(spark):
    rng = random.Random(2)
    notices = [b" ".join(t.words).decode() for t in licenses.TEMPLATES]
    pool = sorted({w for n in notices for w in n.split()})
    docs = [(1, None), (2, ""), (3, "MIT"), (4, "the mit, license!"), (5, "cc by cc by cc-by/cc by"), (6, "cc0 1.0 universal"), (7, "gnu " * 500 + "general public license"), (None, "Apache License"), (8, "x " * 50_000 + "MIT License"), (8, "x " * 50_000 + "MIT License")]
    for i in range(300):
        w = [rng.choice(pool) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            notice = rng.choice(notices).split()
            if rng.random() < 0.5:
                notice[rng.randrange(len(notice))] = "other"
            k = rng.randrange(len(w) + 1)
            w[k:k] = notice if rng.random() < 0.8 else notice[: rng.randrange(len(notice)) + 1]
        docs.append((100 + i, rng.choice([" ", "-", ",\n"]).join(w).upper()))
    rows = licenses.scanned(spark.createDataFrame(docs, DOCS).withColumn("labels", F.lit("clash"))).collect()
    fields = [f.name for f in licenses.FIELDS]
    assert sorted(map(str, ((r.doc_id, *(r[f] for f in fields)) for r in rows))) == sorted(map(str, ((d, *brute_scan(t)) for d, t in docs)))
    assert {x for r in rows for x in r["labels"].split(",")} >= {"gpl", "apache", "cc-by", "mit", "bsd", "cc0", "zlib"}
    assert any(0 < r.score < 1 for r in rows)
    assert licenses.scanned(spark.createDataFrame([], DOCS)).count() == 0


# --- importance resampling


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("aé Z9-", max_size=40), max_size=6), st.integers(1, 3), st.integers(0, 3))
def test_gram_crcs_are_those_of_the_bytes(texts, least, more):
    tokens = [words(t.encode()) for t in texts]
    crcs, whose = resample.gram_crcs(tokens, least, least + more)
    want = [(zlib.crc32(b" ".join(t[i : i + n])), k) for n in range(least, least + more + 1) for k, t in enumerate(tokens) for i in range(len(t) - n + 1)]
    assert list(zip(crcs.tolist(), whose.tolist())) == want


def test_crcs_of_long_grams():
    tokens = [[b"w" * (i % 97 + 1) for i in range(3_000)]]
    crcs, _ = resample.gram_crcs(tokens, 2_999, 3_000)
    assert crcs.tolist() == [zlib.crc32(b" ".join(tokens[0][:-1])), zlib.crc32(b" ".join(tokens[0][1:])), zlib.crc32(b" ".join(tokens[0]))]


def brute_draw(docs, target, most=1, percent=10):
    grams = lambda text: [b" ".join(w[i : i + n]) for w in [words(text.encode()) if text else []] for n in range(1, most + 1) for i in range(len(w) - n + 1)]
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for counts, rows in ((s, docs), (t, target)):
        for _, text in rows:
            for g in grams(text):
                counts[zlib.crc32(g) % 10_000] += 1
    gain = [math.floor(1000 * math.log((y + 1.0) * (s.sum() + 10_000.0) / ((x + 1.0) * (t.sum() + 10_000.0)))) for x, y in zip(s, t)]
    out = []
    for doc, text in docs:
        f = [gain[zlib.crc32(g) % 10_000] for g in grams(text)]
        weight = sum(f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(words(text.encode()) if text else []), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    long = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    for k, r in enumerate(long[: percent * len(long) // 100]):
        r[5] = k + 1
    return out


@pytest.mark.parametrize("most", [1, 3])
def test_draw_equals_brute_force(spark, most, monkeypatch):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("lorem Ipsum dolor sit amet, élan vital 42".split()) + rng.choice(["", "s", "x"]) for _ in range(n))
    docs = [(i, text(rng.randrange(60))) for i in range(300)] + [(1000, None), (1001, ""), (1002, "only"), (None, text(30)), (1003, text(20_000))]
    docs += [(2000, docs[5][1] + " more words" * 15)] * 3
    target = [(1, "lorem ipsum dolors"), (2, None), (3, text(50))]
    if most > 1:
        for name in ("bucket_counts", "weighted"):
            monkeypatch.setattr(resample, name, lambda *a, f=getattr(resample, name), **k: f(*a, **k, most=most))
    found = resample.drawn(spark.createDataFrame(docs, DOCS).withColumn("Score", F.lit(1)), spark.createDataFrame(target, "item_id long, text string")).collect()
    assert sorted(map(str, (list(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")) for r in found))) == sorted(map(str, brute_draw(docs, target, most)))


def test_draw_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert resample.drawn(none, none.withColumnRenamed("doc_id", "item_id")).count() == 0
    only = resample.drawn(spark.createDataFrame([(1, None), (1, None)], DOCS), none).toPandas()
    assert only["rank"].isna().all() and (only["weight"] == 0).all() and len(only) == 2
    assert pd.unique(only["n_features"]).tolist() == [0]
