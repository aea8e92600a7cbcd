"""Long texts, null and repeated rows, and records patched field by field, against brute force."""

import os
import random
import time
import uuid
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from leafmill.functions.arrays import pieces_joined, running
from leafmill.operators import documents, editlog, redaction
from leafmill.plans.registry import ORACLES, QUERIES
from leafmill.sources.tables import doc_pages, page_counts
from leafmill.streaming import jobs as J
from leafmill.streaming import sinks as S


def taken(df):
    began = time.perf_counter()
    rows = df.collect()
    return rows, time.perf_counter() - began


def test_running_joins_all_before(spark):
    lists = [[], [4], [4, -1], list(range(37)), [random.Random(1).randrange(100) for _ in range(1_000)], None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<long>")
    found = {r.i: (r.s, r.m) for r in df.select("i", running(F.col("x"), lambda a, x: a + x).alias("s"), running(F.col("x"), F.greatest).alias("m")).collect()}
    for i, x in enumerate(lists):
        assert found[i] == ((None, None) if x is None else ([sum(x[: k + 1]) for k in range(len(x))], [max(x[: k + 1]) for k in range(len(x))]))


def test_pieces_of_wide_texts(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        text = "".join(rng.choice(["a", "é", "漢", "😀", "\n"]) for _ in range(rng.choice([0, 1, 5, 255, 256, 257, 1_500])))
        cuts = sorted(rng.sample(range(len(text) + 4), min(len(text) + 4, 2 * rng.randrange(6))))
        rows.append((i, text, list(zip(cuts[::2], cuts[1::2]))))
    df = spark.createDataFrame(rows, "i int, text string, spans array<struct<start:long,end:long>>")
    found = {r.i: r.t for r in df.select("i", pieces_joined(F.col("text"), F.col("spans"), lambda s, old: F.concat(F.lit("["), F.upper(old), F.lit("]"))).alias("t")).collect()}
    for i, text, spans in rows:
        out, at = "", 0
        for a, b in spans:
            out, at = out + text[at:a] + "[" + text[a:b].upper() + "]", min(b, len(text))
        assert found[i] == out + text[at:]


@pytest.mark.parametrize("letter", ["o", "é"])
def test_many_spans_of_a_long_text(spark, letter):
    n = 32_000
    text = " and ".join(f"user{i} w{letter}rd, user{i}@example.org" for i in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    redaction.redact_own(df.limit(0)).collect()  # compiles
    rows, seconds = taken(redaction.redact_own(df))
    assert rows[0].text == " and ".join(f"user{i} w{letter}rd, " + "█" * len(f"user{i}@example.org") for i in range(n)) and seconds < 15
    rows, seconds = taken(redaction.splice_own(df))
    assert rows[0].text == " and ".join(f"user{i} w{letter}rd, \n" for i in range(n)) and seconds < 15


def test_many_lines_of_a_long_text(spark):
    lines = [f"line {i}" for i in range(320_000)]
    rows, seconds = taken(doc_pages(spark.createDataFrame([("s", 1, "\n".join(lines))], "source string, doc_id long, text string")))
    assert [r.text for r in rows] == ["\n".join(lines[i : i + 10]) for i in range(0, len(lines), 10)] and seconds < 15


def test_spans_that_overlap_within_a_row(spark):
    rng = random.Random(3)
    rows = [(i, [(a := rng.randrange(60), a + rng.randrange(1, 9), rng.choice(["blur", "blackout"])) for _ in range(rng.randrange(12))]) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, spans array<struct<start:long,end:long,type:string>>")
    found = {r.i: r for r in df.select("i", redaction.merged_in(F.col("spans")).alias("merged"), redaction.apart_in(F.col("spans")).alias("apart")).collect()}
    for i, spans in rows:
        merged, apart, reach = [], [], 0
        for a, b, _ in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
            if b > max(a, reach):
                apart.append((max(a, reach), b, kind))
            reach = max(reach, b)
        assert [tuple(s) for s in found[i].merged] == merged and [tuple(s) for s in found[i].apart] == apart


def test_null_and_repeated_documents_are_numbered_once(spark, tmp_path):
    text = lambda n: "\n".join(f"l{i}" for i in range(n))
    rows = [("a", 1, text(25)), ("a", 1, text(25)), ("a", 1, text(3)), ("a", None, text(12)), ("a", None, None), (None, 1, "x"), (None, None, None), (None, None, None), ("b", 2, "")]
    spark.createDataFrame([(*r, 1) for r in rows], "source string, doc_id long, text string, Pages int").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    order = lambda rows: sorted(rows, key=str)
    found = QUERIES["paginate"](spark, str(tmp_path)).collect()
    assert order((r.source, r.doc_id, r.page_no, r.running_no, r.text) for r in found) == order(con.execute(f"SELECT source, doc_id, page_no, running_no, text FROM ({ORACLES['paginate']})").fetchall())
    assert sorted(r.running_no for r in found if r.source == "a") == list(range(1, 11))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("source is null").select("source", "doc_id", "text").distinct()
    assert documents.paginate(docs, doc_pages(docs)).count() == 2
    chosen, errors = documents.select_pages(doc_pages(docs), page_counts(docs), spark.createDataFrame([(None, "1"), (1, "7")], "doc_id long, spec string"))
    assert [(r.doc_id, r.text) for r in chosen.collect()] == [(None, "")] and [(r.doc_id, r.reason) for r in errors.collect()] == [(1, "out of range")]


# --- records


FIELDS = ["page_index", "value", "colour"]
LOG = "session long, ts timestamp_ntz, event_id long, action string, element string, page_index int, patch map<string,string>"


def brute_records(log):
    found = {}
    for session, _, _, action, element, page, patch in sorted(log, key=lambda r: (r[0], r[1], r[2])):
        own = found.setdefault(session, {})
        if action == "ADD":
            own[element] = dict(patch)
        elif action == "UPDATE" and element in own:
            own[element] |= patch
        elif action == "DELETE":
            own.pop(element, None)
        elif action == "CLEAR_PAGE":
            found[session] = {e: r for e, r in own.items() if r.get("page_index") != str(page)}
    return {(s, e): tuple(r.get(f) for f in FIELDS) for s, own in found.items() for e, r in own.items()}


@pytest.fixture(scope="module")
def log():
    rng = random.Random(4)
    rows = []
    for i in range(1_500):
        action = rng.choice(["ADD", "ADD", "UPDATE", "UPDATE", "UPDATE", "DELETE", "CLEAR_PAGE"])
        patch = {f: rng.choice([None, "0", "1", "2"]) for f in FIELDS if rng.random() < 0.5} if action in ("ADD", "UPDATE") else None
        rows.append((rng.choice([1, 1, 1, 2, 3]), datetime(2024, 1, 1) + timedelta(minutes=i // 3), i, action, f"e{rng.randrange(6)}", rng.randrange(3), patch))
    return rows


def test_records_are_patched_field_by_field(spark, log):
    for n in (7, 100, 700, 1_500):
        found = editlog.fold_records(spark.createDataFrame(log[:n], LOG), FIELDS).collect()
        assert {(r.session, r.element): tuple(r[f] for f in FIELDS) for r in found} == brute_records(log[:n])
        assert len(found) == len(brute_records(log[:n]))
    assert editlog.fold_records(spark.createDataFrame([], LOG), FIELDS).count() == 0


def test_a_stream_of_patches_gives_what_changed(spark, log, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.STATE_STORE)
    for i in range(5):
        spark.createDataFrame(log[300 * i : 300 * (i + 1)], LOG).coalesce(1).write.parquet(f"{tmp_path}/{i}")
        part = next(f for f in os.listdir(tmp_path / str(i)) if f.startswith("part-"))
        os.rename(tmp_path / str(i) / part, tmp_path / f"batch-{i}.parquet")
        os.utime(tmp_path / f"batch-{i}.parquet", (1_000_000 + i, 1_000_000 + i))
    stream = J.fold_records_stream(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path)))
    batches = []
    S.drained_into(stream, lambda df, n: batches.append(df.collect()), f"records-{uuid.uuid4().hex}")
    for n in (1, 3, 5):
        found = J.latest_records(spark.createDataFrame([r for b in batches[:n] for r in b], stream.schema), FIELDS).collect()
        assert {(r.session, r.element): tuple(r[f] for f in FIELDS) for r in found} == brute_records(log[: 300 * n])
    assert max(len(b) for b in batches) <= 18  # elements that changed, each once
