"""Drafts, hand-offs, requests and gestures as batch jobs over keyed, time-stamped records."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A draft lives 14 days, a hand-off five minutes.
DRAFT_AGE, HANDOFF_AGE = "interval 14 days", "interval 5 minutes"


def latest_draft(drafts: DataFrame) -> DataFrame:
    """key, saved_at, payload of the last write of each key; a delete (deleted = true) removes it. Ties: the larger seq."""
    last = drafts.groupBy("key").agg(F.max_by(F.struct("saved_at", "payload", "deleted"), F.struct("saved_at", "seq")).alias("d"))
    return last.where("not d.deleted").select("key", "d.saved_at", "d.payload")


def expire_drafts(drafts: DataFrame, as_of: Column, max_age: str = DRAFT_AGE) -> DataFrame:
    """drafts with live: not live from exactly max_age on, or without a stamp."""
    return drafts.withColumn("live", F.coalesce(as_of < F.col("saved_at") + F.expr(max_age), F.lit(False)))


def take_handoff(rows: DataFrame, max_age: str = HANDOFF_AGE) -> DataFrame:
    """key, take_ts, seq, save_ts, payload, status of each take of rows (key, ts, seq, kind save/take, payload).

    A take consumes the latest save since the take before it: `ok`, `expired` if it is older than max_age (a save without a
    stamp never is), `empty` if there is none or it has no payload.
    """
    own = Window.partitionBy("key").orderBy("ts", "seq")
    turn = rows.withColumn("turn", F.coalesce(F.sum(F.when(F.col("kind") == "take", 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    saved = F.last(F.when(F.col("kind") == "save", F.struct("ts", "payload")), ignorenulls=True).over(Window.partitionBy("key", "turn").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1))
    takes = turn.withColumn("saved", saved).where("kind = 'take'")
    status = F.when(F.col("saved").isNull(), "empty").when(F.col("ts") - F.expr(max_age) > F.col("saved.ts"), "expired").when(F.col("saved.payload").isNull(), "empty").otherwise("ok")
    return takes.select("key", F.col("ts").alias("take_ts"), "seq", F.col("saved.ts").alias("save_ts"), F.when(status == "ok", F.col("saved.payload")).alias("payload"), status.alias("status"))


def debounce_saves(edits: DataFrame, gap: str) -> DataFrame:
    """key, burst_start, burst_end, payload: one save for each run of edits without a pause of `gap`; works on streams."""
    rows = edits.where("status = 'editing'").groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.max_by("payload", F.struct("ts", "seq")).alias("payload"))
    return rows.select("key", F.col("w.start").alias("burst_start"), F.col("w.end").alias("burst_end"), "payload")


def first_claim(claims: DataFrame) -> DataFrame:
    """slot, claimant, ts of the first claim; of claims at one time the lower priority number wins."""
    return claims.groupBy("slot").agg(F.min_by(F.struct("claimant", "ts"), F.struct("ts", "priority", "seq")).alias("c")).select("slot", "c.claimant", "c.ts")


def drop_superseded(results: DataFrame) -> DataFrame:
    """results (slot, generation, ts, seq) with kept: no newer generation had been requested when the result came."""
    newest = F.max("generation").over(Window.partitionBy("slot").orderBy("ts", "seq"))
    return results.withColumn("kept", F.col("generation") == newest)


def commit_once(moves: DataFrame) -> DataFrame:
    """gesture, patch, ts: the last patch of each gesture."""
    return moves.groupBy("gesture").agg(F.max_by(F.struct("patch", "ts"), F.struct("ts", "seq")).alias("m")).select("gesture", "m.patch", "m.ts")


def resume_list(live: DataFrame, registry: DataFrame) -> DataFrame:
    """tool, title, saved_at, rank of the live drafts of known tools, newest first (no stamp is oldest). One row a tool."""
    newest = live.groupBy("tool").agg(F.max("saved_at").alias("saved_at"))  # the window then holds a row a known tool
    rows = newest.join(registry, "tool")
    place = Window.orderBy(F.desc_nulls_last("saved_at"), "tool")
    return rows.select("tool", "title", "saved_at", F.row_number().over(place).alias("rank"))


def hint_reconcile(hints: DataFrame, drafts: DataFrame, as_of: Column, max_age: str = DRAFT_AGE) -> DataFrame:
    """key, state of an advisory index (key) against the records: ok, stale_hint, missing_hint, expired."""
    own = expire_drafts(drafts, as_of, max_age).select("key", "live")
    rows = hints.select("key", F.lit(True).alias("hinted")).join(own, "key", "full_outer")
    state = F.when(F.col("live").isNull(), "stale_hint").when(~F.col("live"), "expired").when(F.col("hinted").isNull(), "missing_hint").otherwise("ok")
    return rows.select("key", state.alias("state"))


def request_timeouts(requests: DataFrame, completions: DataFrame, limit: str) -> DataFrame:
    """key, ts, seq of the requests without a completion of their key from then until the limit.

    The next completion after each request comes from one sorted pass over a key, not from a join of all pairs.
    """
    both = requests.select("key", "ts", "seq", F.lit(1).alias("ask")).unionByName(completions.select("key", "ts", "seq", F.lit(0).alias("ask")))
    later = Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("ask")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = both.withColumn("done", F.min(F.when(F.col("ask") == 0, F.col("ts"))).over(later)).where("ask = 1")
    return rows.where(F.col("done").isNull() | (F.col("done") > F.col("ts") + F.expr(limit))).select("key", "ts", "seq")


def current_page(visibility: DataFrame) -> DataFrame:
    """session, ts, seq, page: at each row the page of the highest last known ratio, the lowest page of equals.

    A page that has not been seen counts as 0, so page 0 is the answer until some ratio is above 0. A session's rows come
    in order and are read as a stream; what is held is the last ratio of each page that it has shown.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, last, heap = None, {}, []
        for rows in batches:
            found = []
            for key, page, ratio in zip(rows["session"].tolist(), rows["page"].tolist(), rows["ratio"].tolist(), strict=True):
                if key != session:
                    session, last, heap = key, {}, []
                if page == page and ratio == ratio:  # neither is missing
                    last[page] = ratio
                    heapq.heappush(heap, (-ratio, page))
                while heap and last[heap[0][1]] != -heap[0][0]:  # a ratio that no longer holds
                    heapq.heappop(heap)
                found.append(int(heap[0][1]) if heap and heap[0][0] < 0 else 0)
            yield rows[["session", "ts", "seq"]].assign(page=pd.array(found, "Int32"))

    kinds = dict(visibility.dtypes)
    rows = visibility.select("session", "ts", "seq", "page", F.col("ratio").cast("double")).repartition("session").sortWithinPartitions("session", "ts", "seq")
    return rows.mapInPandas(run, f"session {kinds['session']}, ts {kinds['ts']}, seq {kinds['seq']}, page int")
