"""Streams over several batches: what expires and leaves the state, sinks that a batch reaches twice, rows behind the watermark."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from leafmill.sources.store import shared_dir
from leafmill.streaming import expiry as E
from leafmill.streaming import jobs as J
from leafmill.streaming import sinks as S


@pytest.fixture
def batches(spark, tmp_path):
    """A stream that gives each list of rows as one batch, with a watermark on ts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.STATE_STORE)

    def make(schema, lists, lateness="0 seconds"):
        where = tmp_path / uuid.uuid4().hex
        where.mkdir()
        names = [f.split(" ")[0] for f in schema.split(", ")]
        for i, rows in enumerate(lists):
            df = spark.createDataFrame(rows, schema.replace("timestamp", "string"))
            kinds = dict(f.split(" ") for f in schema.split(", "))
            df.select(*[F.col(n).cast(kinds[n]).alias(n) for n in names]).coalesce(1).write.parquet(f"{where}/{i}")
            part = next(f for f in os.listdir(where / str(i)) if f.startswith("part-"))
            os.rename(where / str(i) / part, where / f"batch-{i}.parquet")
            os.utime(where / f"batch-{i}.parquet", (1_000_000 + i, 1_000_000 + i))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(where)).withWatermark("ts", lateness)

    return make


def run(stream):
    """Rows by batch, and the state's rows after the last one."""
    out = []
    done = S.drained_into(stream, lambda df, n: out.append(sorted(map(tuple, df.collect()), key=str)), "test")
    return [rows for rows in out if rows], done.lastProgress.stateOperators[0].numRowsTotal


def at(minute, second=0):
    return f"2024-01-01 {minute // 60:02}:{minute % 60:02}:{second:02}"


HANDOFF = "key long, ts timestamp, seq long, kind string, payload double"


def test_a_save_that_nobody_takes_expires_once_and_leaves_the_state(batches):
    first = [(1, at(0), 1, "save", 1.0), (2, at(1), 2, "save", 2.0), (3, at(2), 3, "save", 3.0)]
    second = [(2, at(4), 4, "take", None), (9, at(20), 5, "take", None)]  # the watermark passes 5 minutes of keys 1 and 3
    third = [(1, at(21), 6, "take", None), (9, at(40), 7, "take", None)]
    found, held = run(E.handoff_timers_stream(batches(HANDOFF, [first, second, third]), 300))
    assert sorted(sum(found, []), key=lambda r: r[1]) == [(1, 1, None, "expired"), (3, 3, None, "expired"), (2, 4, 2.0, "ok"), (9, 5, None, "empty"), (1, 6, None, "empty"), (9, 7, None, "empty")]
    assert held == 0


def test_a_take_at_the_very_limit_gets_the_save(batches):
    rows = [(1, at(0), 1, "save", 1.0), (1, at(5), 2, "take", None), (2, at(0), 3, "save", 2.0), (2, at(5, 1), 4, "take", None), (3, at(0), 5, "save", 1.0), (3, at(3), 6, "save", None), (3, at(4), 7, "take", None)]
    found, held = run(E.handoff_timers_stream(batches(HANDOFF, [rows, [(9, at(30), 9, "take", None)]]), 300))
    assert sorted(sum(found, []), key=lambda r: r[1]) == [(1, 2, 1.0, "ok"), (2, 3, None, "expired"), (2, 4, None, "empty"), (3, 7, None, "empty"), (9, 9, None, "empty")]
    assert held == 0


DRAFT = "key long, ts timestamp, saved_at timestamp, payload double, deleted boolean, seq long"


def test_drafts_expire_at_their_age_and_not_before(spark, batches, tmp_path):
    day = lambda d, s=0: f"2024-01-{d:02} 00:00:{s:02}"
    first = [(1, day(1), day(1), 1.0, False, 1), (2, day(1, 1), day(1, 1), 2.0, False, 2), (3, day(1), None, 3.0, False, 3), (4, day(1), day(1), 4.0, False, 4)]
    second = [(4, day(2), day(2), 4.5, True, 5), (5, day(15), day(15), 5.0, False, 6)]  # the watermark comes to exactly key 1's age
    older = [(4, day(15, 1), day(1, 5), 9.0, False, 7), (6, day(15, 1), day(1), 9.0, False, 8)]  # undone by the deletion; expired from the start
    stream = E.expire_drafts_stream(batches(DRAFT, [first, second, older]))
    out = []
    done = S.drained_into(stream, lambda df, n: out.append(df.collect()), "test")
    changes = [(r.key, r.seq, r.change) for rows in out for r in rows]
    assert sorted(changes) == [(1, 1, "expired"), (1, 1, "live"), (2, 2, "expired"), (2, 2, "live"), (4, 4, "ended"), (4, 4, "live"), (5, 6, "live")]
    upto = lambda n: sorted((r.key, r.payload) for r in E.live_drafts(spark.createDataFrame([r for rows in out[:n] for r in rows], stream.schema)).collect())
    sizes = [len(rows) for rows in out]
    assert upto(len(out)) == [(5, 5.0)]
    assert upto(1) == [(1, 1.0), (2, 2.0), (4, 4.0)]
    # at the watermark of 15 January 00:00:00 key 1 has expired, key 2, a second younger, hasn't
    when = {r.key: n for n, rows in enumerate(out) for r in rows if r.change == "expired"}
    assert when[1] < when[2] < len(sizes)
    assert done.lastProgress.stateOperators[0].numRowsTotal <= 4  # draft and timer of key 5, tombstone and timer of key 4 at most


REQUEST = "key long, ts timestamp, seq long, kind string"


def test_requests_time_out_and_leave_the_state(batches):
    first = [(1, at(0), 1, "ask"), (2, at(0), 2, "ask"), (3, at(1), 3, "ask"), (3, at(1), 4, "done")]
    second = [(2, at(5), 5, "done"), (1, at(6), 6, "done"), (4, at(60), 7, "ask")]
    third = [(None, at(200), 8, "ask"), (4, at(200), 9, "done"), (5, at(200), 10, "ask")]
    rows = batches(REQUEST, [first, second, third])
    found, _ = run(E.request_timeouts_stream(rows.where("kind = 'ask'"), rows.where("kind = 'done'"), "5 minutes"))
    assert sorted(r[2] for r in sum(found, [])) == [1, 7]  # an answer at the limit counts, one after it doesn't; the last two may still be answered
    lots = [[(k, at(20 * b), b * 100 + k, "ask") for k in range(50)] for b in range(12)]
    rows = batches(REQUEST, lots)
    found, held = run(E.request_timeouts_stream(rows.where("kind = 'ask'"), rows.where("kind = 'done'"), "5 minutes"))
    assert len(sum(found, [])) == 11 * 50 and held <= 4 * 50  # a few rows of state a request of the last batch


def test_a_batch_that_comes_again_changes_nothing(spark):
    schema = "key long, at long, payload string"
    table = S.LastWrites(spark, f"{shared_dir(spark)}/writes-{uuid.uuid4().hex}", schema, ["key"], ["at"])
    rows = lambda: sorted(map(tuple, table.rows().collect()))
    one, two, three = (spark.createDataFrame(r, schema) for r in ([(1, 5, "a"), (2, 5, "b"), (2, 7, "c"), (4, None, "n")], [(1, 4, "old"), (3, 1, "d")], [(2, 9, None)]))
    assert rows() == []
    table.upsert(one, 0)
    table.upsert(two, 1)
    want = [(1, 5, "a"), (2, 7, "c"), (3, 1, "d"), (4, None, "n")]
    assert rows() == want
    table.upsert(two, 1)  # the batch was written, its commit was lost
    assert rows() == want
    table.compact()
    table.upsert(two, 1)
    assert rows() == want
    spark.createDataFrame([(1, 99, "half")], schema).write.parquet(f"{table.path}/changes/n=2")
    os.remove(f"{table.path.removeprefix('file:')}/changes/n=2/_SUCCESS")  # a try that broke off
    assert rows() == want
    table.upsert(three, 2)
    table.compact()
    table.compact()
    assert rows() == [(1, 5, "a"), (2, 9, None), (3, 1, "d"), (4, None, "n")]
    assert S.versions(spark, f"{table.path}/base") == [1, 2]


def test_late_rows_are_kept_aside(spark, batches):
    schema = "key long, ts timestamp"
    lists = [[(1, at(60)), (2, at(30))], [(3, at(50)), (4, at(49)), (5, at(90)), (6, None)], [(7, at(79)), (8, at(80)), (9, at(80, 1))], [(10, at(30))]]
    stream = batches(schema, lists, "10 minutes")
    side = S.LateRows(spark, f"{shared_dir(spark)}/late-{uuid.uuid4().hex}", "ts", "10 minutes")
    again = []

    def twice(df, n):
        side.split(df, n)
        if n not in again:
            again.append(n)
            side.split(df, n)

    S.drained_into(stream, twice, "split")
    assert sorted(r.key for r in side.rows("late", schema).collect()) == [3, 4, 7, 8, 10]
    assert sorted(r.key for r in side.rows("on_time", schema).collect()) == [1, 2, 5, 6, 9]
    # Spark drops what is behind the watermark of the batch before
    done = S.drained_into(stream.where("ts is not null").groupBy(F.window("ts", "1 second")).count(), lambda df, n: df.collect(), "dropped")
    assert sum(p.stateOperators[0].numRowsDroppedByWatermark for p in done.recentProgress if p.stateOperators) == 1
