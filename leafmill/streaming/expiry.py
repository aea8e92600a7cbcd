"""Streams whose results depend on time going by: requests without an answer, hand-offs nobody takes, drafts that expire.

Time is the watermark, so results don't depend on when a batch runs, and what has run out of time leaves the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.streaming.buckets import Bucket, in_buckets, values


def request_timeouts_stream(requests: DataFrame, completions: DataFrame, limit: str) -> DataFrame:
    """key, ts, seq of the requests (key, ts, seq) without a completion (key, ts) of their key from then until the limit.

    Both inputs need a watermark on ts. A request is given once the watermark has passed its limit; requests and completions
    that no later row can meet leave the state.
    """
    done = completions.select(F.col("key").alias("done_key"), F.col("ts").alias("done_ts"))
    within = (F.col("key") == F.col("done_key")) & (F.col("done_ts") >= F.col("ts")) & (F.col("done_ts") <= F.col("ts") + F.expr(f"interval {limit}"))
    return requests.select("key", "ts", "seq").join(done, within, "leftOuter").where("done_ts is null").select("key", "ts", "seq")


class HandoffTimers(Bucket):
    """The saves that wait for a take, and a timer for the moment from which none may have the first of them."""

    SCHEMA = "key long, seq long, payload double, status string"

    def __init__(self, seconds: int):
        self.age = seconds * 1_000_000

    def timer(self, at: int) -> int:
        """In milliseconds, rounded up: rows that are still to come are later than a watermark that has passed it."""
        return -(-(at + self.age) // 1_000)

    def first(self, state: dict) -> int | None:
        times = [at for at, *_ in state.values() if at is not None]
        return self.timer(min(times)) if times else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, state = [], self.load()
        before = self.first(state)
        for k, at, seq, kind, payload in values(rows, ["key", "ts_micros", "seq", "kind", "payload"], ["ts_micros", "seq"]):
            saved = state.pop(k, None)
            if saved is not None and None not in (at, saved[0]) and at - saved[0] > self.age:  # its timer would have gone off before this row
                out.append((k, saved[1], None, "expired"))
                saved = None
            if kind == "save":
                state[k] = [at, seq, payload]
            else:
                ok = saved is not None and saved[2] is not None
                out.append((k, seq, saved[2] if ok else None, "ok" if ok else "empty"))
        self.store(state)
        self.wake(before, self.first(state))
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, now = self.load(), timerValues.getCurrentWatermarkInMs()
        left = {k: s for k, s in state.items() if s[0] is None or self.timer(s[0]) > now}
        self.store(left)
        self.wake(None, self.first(left))
        yield self.frame([(k, s[1], None, "expired") for k, s in state.items() if k not in left])


def handoff_timers_stream(rows: DataFrame, seconds: int = 300) -> DataFrame:
    """key, seq, payload, status of rows (key, ts, seq, kind save/take, payload) with a watermark on ts.

    A take gives `ok` with the payload of the save that waits, or `empty`. A save that nobody took in time gives a row of its
    own seq, `expired`, when a later row of the key or the watermark shows it, and leaves the state; one that a newer save
    replaces in time gives none.
    """
    return in_buckets(rows, "key", HandoffTimers(seconds), "EventTime")


class DraftExpiry(Bucket):
    """The keys' last writes, and a timer for the moment at which the first of them expires. A deletion is kept as long as a draft, so that no older write undoes it."""

    SCHEMA = "key long, seq long, micros long, payload double, change string"

    def __init__(self, seconds: int):
        self.age = seconds * 1_000_000

    def timer(self, at: int) -> int:
        return -(-(at + self.age) // 1_000)

    def first(self, state: dict) -> int | None:
        return self.timer(min(d[0] for d in state.values())) if state else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, now, state = [], timerValues.getCurrentWatermarkInMs(), self.load()
        before = self.first(state)
        for k, at, seq, payload, deleted in values(rows, ["key", "saved_at_micros", "seq", "payload", "deleted"]):
            old = state.get(k)
            if at is None or self.timer(at) <= now or old is not None and [at, seq] <= old[:2]:
                continue  # expired from the start, or older than what is known
            if old is not None and not old[2]:
                out.append((k, old[1], old[0], None, "ended"))
            state[k] = [at, seq, deleted]
            if not deleted:
                out.append((k, seq, at, payload, "live"))
        self.store(state)
        self.wake(before, self.first(state))
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, now = self.load(), timerValues.getCurrentWatermarkInMs()
        left = {k: d for k, d in state.items() if self.timer(d[0]) > now}
        self.store(left)
        self.wake(None, self.first(left))
        yield self.frame([(k, d[1], d[0], None, "expired") for k, d in state.items() if k not in left and not d[2]])


def expire_drafts_stream(drafts: DataFrame, seconds: int = 14 * 86_400) -> DataFrame:
    """key, seq, micros (of saved_at), payload, change of drafts (key, ts, saved_at, payload, deleted, seq) with a watermark on ts.

    `live` when a write becomes a key's last one, `ended` when a newer write replaces or deletes it, `expired` when the
    watermark reaches saved_at plus the age, that moment included. A write without a stamp expires at once, so it gives no
    row. live_drafts() has what is left.
    """
    return in_buckets(drafts, "key", DraftExpiry(seconds), "EventTime")


def live_drafts(changes: DataFrame) -> DataFrame:
    """key, saved_at, payload of the drafts that are live after all changes of expire_drafts_stream(), in whatever order these are read."""
    state = changes.groupBy("key", "seq", "micros").agg(F.max("payload").alias("payload"), F.count_if(F.col("change") != "live").alias("over"))
    return state.where("over = 0").select("key", F.timestamp_micros("micros").cast("timestamp_ntz").alias("saved_at"), "payload")
