"""Registered streaming queries: each drains a stream over the events and reads its sink."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leafmill.plans.records import BURSTS, HANDOFFS, K, drafts_of, typed
from leafmill.plans.registry import ORACLES, query
from leafmill.sources.store import shared_dir
from leafmill.sources.tables import RECORD_FIELDS, edit_log, event_key, record_log
from leafmill.streaming import expiry as E
from leafmill.streaming import jobs as J
from leafmill.streaming import sinks as S


def stream(spark, sf):
    return J.events_stream(spark, f"{sf}/events.parquet")


def ordered(spark, sf):
    return J.in_time_order(spark, f"{sf}/events.parquet")


def stateful(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.STATE_STORE)


@query("SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value, props FROM events")
def events_stream(spark, sf):
    return J.drained(stream(spark, sf), "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"""WITH {BURSTS} SELECT user_id AS key, min(ts) AS burst_start, max(ts) + INTERVAL 2 HOUR AS burst_end, arg_max(value, (ts, event_id)) AS payload FROM b GROUP BY user_id, burst HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def debounce_saves_stream(spark, sf):
    rows = ordered(spark, sf).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("payload"), F.when(F.col("event_type") == "error", "idle").otherwise("editing").alias("status"))
    found = J.drained(J.debounce_stream(rows, "2 hours"), "bursts")
    return found.withColumn("burst_start", F.col("burst_start").cast("timestamp_ntz")).withColumn("burst_end", F.col("burst_end").cast("timestamp_ntz"))


@query(f"""WITH g AS (SELECT user_id || '-' || {K} AS gesture, ts, event_id, value FROM events),
b AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY gesture ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY gesture ORDER BY ts, event_id) + INTERVAL 6 HOUR, true) AS fresh FROM g))
SELECT gesture, arg_max(value, (ts, event_id)) AS patch, max(ts) AS ts FROM b GROUP BY gesture, burst HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def commit_once_stream(spark, sf):
    rows = ordered(spark, sf)
    moves = rows.select(F.concat_ws("-", F.col("user_id").cast("string"), event_key(rows).cast("string")).alias("gesture"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("patch"))
    return J.drained(J.commit_once_stream(moves, "6 hours"), "commits").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(ORACLES["drop_superseded"])
def drop_superseded_stream(spark, sf):
    stateful(spark)
    rows = ordered(spark, sf)
    return J.drained(J.drop_superseded_stream(rows.select(F.col("user_id").alias("slot"), event_key(rows).cast("long").alias("generation"), "ts", F.col("event_id").alias("seq"))), "superseded").withColumn("generation", F.col("generation").cast("int"))


@query(ORACLES["latest_draft"])
def latest_draft_stream(spark, sf):
    stateful(spark)
    return J.latest_writes(J.drained(J.latest_draft_stream(drafts_of(ordered(spark, sf))), "drafts"))


@query(ORACLES["fold_edits"])
def fold_edits_stream(spark, sf):
    stateful(spark)
    return J.latest_version(J.drained(J.fold_edits_stream(edit_log(ordered(spark, sf))), "folded"))


@query(ORACLES["take_handoff"].replace("SELECT key, take_ts, seq, save_ts,", "SELECT key, seq,"))
def take_handoff_stream(spark, sf):
    stateful(spark)
    rows = ordered(spark, sf).where("event_type in ('signup', 'purchase')")
    kind = F.when(F.col("event_type") == "signup", "save").otherwise("take")
    return J.drained(J.take_handoff_stream(rows.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"), F.when(F.col("event_id") % 7 > 0, F.col("value")).alias("payload")), 6 * 3600), "taken")




#: How far the watermark comes over all events, in whole milliseconds.
MARK = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)"


@query(f"""SELECT r.user_id AS key, r.ts, r.event_id AS seq FROM events r WHERE event_type = 'view' AND r.ts + INTERVAL 6 HOUR < {MARK}
AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'click' AND c.user_id = r.user_id AND c.ts BETWEEN r.ts AND r.ts + INTERVAL 6 HOUR)""")
def request_timeouts_stream(spark, sf):
    rows = ordered(spark, sf).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), "event_type")
    found = E.request_timeouts_stream(*[J.above_mark(rows, F.col("event_type") == t) for t in ("view", "click")], "6 hours")
    return J.drained(found, "timeouts").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"""WITH {HANDOFFS}, n AS (SELECT *, lead(ts) OVER own AS next_ts, lag(kind) OVER own AS before, lag(ts) OVER own AS before_ts, lag(payload) OVER own AS waiting FROM h WINDOW own AS (PARTITION BY key ORDER BY ts, seq)),
t AS (SELECT key, seq, CASE WHEN before = 'save' AND ts - INTERVAL 6 HOUR <= before_ts THEN waiting END AS payload FROM n WHERE kind = 'take')
SELECT key, seq, payload, CASE WHEN payload IS NULL THEN 'empty' ELSE 'ok' END AS status FROM t
UNION ALL SELECT key, seq, NULL, 'expired' FROM n WHERE kind = 'save' AND (next_ts > ts + INTERVAL 6 HOUR OR next_ts IS NULL AND ts + INTERVAL 6 HOUR <= {MARK})""")
def handoff_timers_stream(spark, sf):
    stateful(spark)
    rows = J.above_mark(ordered(spark, sf), F.col("event_type").isin("signup", "purchase"))
    kind = F.when(F.col("event_type") == "signup", "save").otherwise("take")
    kept = rows.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"), F.when(F.col("event_id") % 7 > 0, F.col("value")).alias("payload"))
    return J.drained(E.handoff_timers_stream(kept, 6 * 3600), "handoffs")


OWN_DRAFTS = f"own AS (SELECT user_id * 100 + {K} AS key, CASE WHEN event_id % 11 > 0 THEN ts END AS saved_at, value AS payload, event_type = 'error' AS deleted, event_id AS seq FROM events)"


@query(f"""WITH {OWN_DRAFTS}, last AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY saved_at DESC NULLS LAST, seq DESC) AS n FROM own)
SELECT key, saved_at, payload FROM last WHERE n = 1 AND NOT deleted AND saved_at + INTERVAL 14 DAY > {MARK}""")
def expire_drafts_stream(spark, sf):
    stateful(spark)
    rows = ordered(spark, sf)
    own = drafts_of(rows.withColumn("user_id", F.col("user_id") * 100 + event_key(rows)), "ts")
    return E.live_drafts(J.drained(E.expire_drafts_stream(own), "expiring"))


@query(ORACLES["latest_draft"])
def latest_draft_upserts(spark, sf):
    kept = S.LastWrites(spark, f"{shared_dir(spark)}/last-writes-{uuid.uuid4().hex}", "key long, saved_at timestamp, payload double, deleted boolean, seq long", ["key"], ["saved_at", "seq"])
    S.drained_into(drafts_of(stream(spark, sf)), kept.upsert, "upserts")
    kept.compact()
    return kept.rows().where("not deleted").select("key", F.col("saved_at").cast("timestamp_ntz").alias("saved_at"), "payload")


@query(ORACLES["fold_records"])
def fold_records_stream(spark, sf):
    stateful(spark)
    return typed(J.latest_records(J.drained(J.fold_records_stream(record_log(ordered(spark, sf))), "records"), RECORD_FIELDS))
