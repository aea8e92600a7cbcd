"""Streams that keep the state of many keys in buckets: few states for many keys, exact large and null keys."""

from pyspark.sql import functions as F
from test_expiry_and_sinks import DRAFT, HANDOFF, REQUEST, at, batches, run  # noqa: F401

from leafmill.streaming import buckets as B
from leafmill.streaming import expiry as E
from leafmill.streaming import jobs as J

BIG = 2**60 + 1


def test_many_drafts_take_a_state_and_a_timer_a_bucket(batches):  # noqa: F811
    first = [(BIG + k, at(k % 60), at(k % 60), float(k), False, BIG + k) for k in range(3_000)] + [(None, at(0), at(0), 1.0, False, 1)]
    second = [(BIG + k, at(70), at(70) if k % 2 else None, None, k % 3 == 0, BIG + 3_000 + k) for k in range(3_000)]
    found, held = run(E.expire_drafts_stream(batches(DRAFT, [first, second]), 86_400))
    rows = sum(found, [])
    assert {r[0] for r in rows} == {BIG + k for k in range(3_000)} | {None}
    assert sorted(r[1] for r in rows if r[4] == "ended") == [BIG + k for k in range(1, 3_000, 2)]
    assert sorted(r[1] for r in rows if r[4] == "live") == [1] + [BIG + k for k in range(3_000)] + [BIG + 3_000 + k for k in range(3_000) if k % 2 and k % 3]
    assert held <= 2 * B.BUCKETS


def test_many_handoffs_take_a_state_and_a_timer_a_bucket(batches):  # noqa: F811
    first = [(BIG + k, at(k % 60), BIG + k, "save", float(k)) for k in range(3_000)] + [(None, at(0), 1, "save", 1.0)]
    second = [(BIG + k, at(62), BIG + 3_000 + k, "take", None) for k in range(0, 3_000, 2)]
    found, held = run(E.handoff_timers_stream(batches(HANDOFF, [first, second]), 3_600))
    rows = sum(found, [])
    ok = {r[1]: r[2] for r in rows if r[3] == "ok"}
    assert ok == {BIG + 3_000 + k: float(k) for k in range(0, 3_000, 2) if k % 60 >= 2}
    assert sorted(r[1] for r in rows if r[3] == "expired") == [1] + [BIG + k for k in range(3_000) if k % 60 < 2]
    assert held <= 2 * B.BUCKETS


def test_rows_that_a_filter_drops_still_move_the_watermark(batches):  # noqa: F811
    lists = [[(1, at(0), 1, "save", 1.0), (2, at(1), 2, "other", None)], [(3, at(6), 3, "other", None)]]
    found, held = run(E.handoff_timers_stream(J.above_mark(batches(HANDOFF, lists), F.col("kind").isin("save", "take")), 300))
    assert sum(found, []) == [(1, 1, None, "expired")]
    assert held == 0
    asked = batches(REQUEST, [[(1, at(0), 1, "ask"), (2, at(0), 2, "done"), (5, at(1), 3, "other")], [(3, at(60), 4, "other")]])
    found, _ = run(E.request_timeouts_stream(*[J.above_mark(asked, F.col("kind") == k) for k in ("ask", "done")], "5 minutes"))
    assert sum(found, []) == [(1, found[0][0][1], 1)]


LOG = "session long, ts timestamp, event_id long, action string, element string, page_index int, value double"


def test_many_sessions_take_two_states_a_bucket(spark, batches):  # noqa: F811
    """A bucket holds its sessions' elements or records and its version; one with nothing left holds the version alone."""
    first = [(BIG + k, at(0), BIG + k, "ADD", "e", k % 3, float(k)) for k in range(3_000)] + [(None, at(0), 1, "ADD", "e", None, None), (BIG, at(0), 2, "ADD", "f", 1, None)]
    second = [(BIG + k, at(1), BIG + k, "CLEAR_PAGE", None, 0, None) for k in range(3_000)] + [(BIG + 4, at(2), 3, "UPDATE", "e", 0, -1.0)]
    rows = batches(LOG, [first, second])
    found, held = run(J.fold_edits_stream(rows))
    left = J.latest_version(spark.createDataFrame(sum(found, []), "session long, version long, element string, page_index int, value double"))
    want = {(BIG + k, "e", k % 3, -1.0 if k == 4 else float(k)) for k in range(3_000) if k % 3} | {(BIG, "f", 1, None)}
    assert set(map(tuple, left.where("session is not null").collect())) == want
    assert held <= 2 * B.BUCKETS
    patch = F.create_map(F.lit("page_index"), F.col("page_index").cast("string"), F.lit("value"), F.col("value").cast("string"))
    found, held = run(J.fold_records_stream(rows.withColumn("patch", F.when(F.col("action") != "CLEAR_PAGE", patch)).drop("value")))
    left = J.latest_records(spark.createDataFrame(sum(found, []), "session long, version long, element string, fields string"), ["value"]).where("session is not null")
    assert {(s, e, v and float(v)) for s, e, v in left.collect()} == {(s, e, v) for s, e, _, v in want}
    assert held <= 2 * B.BUCKETS


def test_many_slots_drafts_and_takes_take_a_state_a_bucket(batches):  # noqa: F811
    saves = [(BIG + k, at(0), BIG + k, "save", float(k)) for k in range(3_000)]
    takes = [(BIG + k, at(2 + k % 2 * 60), BIG + 3_000 + k, "take", None) for k in range(0, 3_000, 3)]
    found, held = run(J.take_handoff_stream(batches(HANDOFF, [saves, takes]), 3_600))
    assert sum(found, []) == sorted([(BIG + k, BIG + 3_000 + k, None, "expired") if k % 2 else (BIG + k, BIG + 3_000 + k, float(k), "ok") for k in range(0, 3_000, 3)], key=str)
    assert held <= B.BUCKETS
    slots = "slot long, ts timestamp, generation long, seq long"
    found, held = run(J.drop_superseded_stream(batches(slots, [[(BIG + k, at(0), BIG, 1) for k in range(3_000)], [(BIG + k, at(1), BIG - 1 + k % 3, 2) for k in range(3_000)]])))
    assert len(found[0]) == 3_000 and all(r[3] for r in found[0])
    assert {r[0] - BIG for r in found[1] if r[3]} == {k for k in range(3_000) if k % 3} and held <= B.BUCKETS
    drafts = [[(BIG + k, at(0), at(5), 1.0, False, 1) for k in range(3_000)], [(BIG + k, at(0), at(4 + k % 2) if k % 5 else None, 2.0, True, 2) for k in range(3_000)]]
    found, held = run(J.latest_draft_stream(batches(DRAFT, drafts)))
    assert {r[0] - BIG for r in found[1]} == {k for k in range(3_000) if k % 2 and k % 5}
    assert {r[1] for r in found[1]} == {2} and held <= B.BUCKETS
