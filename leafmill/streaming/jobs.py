"""Structured Streaming twins of the record jobs.

Event time is the rows' ts; rows that come more than ten minutes late are dropped by the jobs that keep a watermark. State
is one small record, or one session's elements, a key, kept by bucket (buckets.py). The jobs take batches in event-time
order: a registered drain reads the events through in_time_order(), so its result doesn't depend on how the rows lie
in files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from leafmill.operators.drafts import debounce_saves
from leafmill.sources.store import shared_dir
from leafmill.sources.tables import SCHEMAS
from leafmill.streaming.buckets import Bucket, in_buckets, values

LATENESS = "10 minutes"
#: Rows of a file that in_time_order() writes, about.
FILE_ROWS = 1_000_000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events_stream(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """The events below a path as a stream, at most `files` new files a batch; ts is a timestamp with a watermark."""
    raw = spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATENESS)


def above_mark(stream: DataFrame, condition: Column, ts: str = "ts") -> DataFrame:
    """Rows of a stream that meet a condition; its watermark still follows all rows.

    Spark moves a filter that doesn't name the watermark's column below it, where the watermark sees only what is left. So
    the condition goes with one on that column which no time meets.
    """
    return stream.where(condition | (F.col(ts) < F.timestamp_micros(F.lit(-(2**63)))))


def modified(status) -> int:
    """When a file was modified last, in milliseconds."""
    return status.getModificationTime()


def in_time_order(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """The events below a path as events_stream() gives them, but so that no batch holds rows that belong before an earlier one's.

    The events are written to the shared folder by ranges of ts; a stream takes the files of the earliest modification
    time first, so these are set in the ranges' order. Where the file system doesn't keep them, all is one batch.
    """
    import time
    import uuid

    rows = spark.read.schema(SCHEMAS["events"]).option("recursiveFileLookup", "true").parquet(path)
    ordered = f"{shared_dir(spark)}/ordered-{uuid.uuid4().hex}"
    rows.repartitionByRange(rows.count() // FILE_ROWS + 1, "ts").sortWithinPartitions("ts", "event_id").write.parquet(ordered)
    folder = spark._jvm.org.apache.hadoop.fs.Path(ordered)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = lambda: sorted((f for f in system.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName())
    start = int(time.time() * 1000)
    found = parts()
    times = [start + i for i in range(len(found))]
    try:
        for f, t in zip(found, times, strict=True):
            system.setTimes(f.getPath(), t, -1)
        kept = [modified(f) for f in parts()] == times
    except Py4JJavaError:
        kept = False
    return events_stream(spark, ordered, files if kept else max(1, len(found)))


def drained(stream: DataFrame, label: str) -> DataFrame:
    """What a stream gives for all that is there now, from a parquet sink with a checkpoint in the shared folder."""
    import uuid

    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def debounce_stream(edits: DataFrame, gap: str) -> DataFrame:
    """Closed bursts only: a burst is given once the watermark has passed its end."""
    return debounce_saves(edits, gap)


def commit_once_stream(moves: DataFrame, gap: str) -> DataFrame:
    """gesture, patch, ts: one commit of the last patch for each run of a gesture's moves without a pause of `gap`."""
    rows = moves.groupBy("gesture", F.session_window("ts", gap).alias("w")).agg(F.max_by("patch", F.struct("ts", "seq")).alias("patch"), F.max("ts").alias("last"))
    return rows.select("gesture", "patch", F.col("last").alias("ts"))


class Newest(Bucket):
    """The newest generation that each slot has asked for; a result of an older one is superseded."""

    SCHEMA = "slot long, generation long, seq long, kept boolean"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, newest = [], self.load()
        for slot, generation, seq in values(rows, ["slot", "generation", "seq"], ["ts_micros", "seq"]):
            if generation is not None:
                newest[slot] = max(newest.get(slot, generation), generation)
            out.append((slot, generation, seq, None if generation is None else generation == newest[slot]))
        self.store(newest)
        yield self.frame(out)


def drop_superseded_stream(results: DataFrame) -> DataFrame:
    """slot, generation, seq, kept of results (slot, generation, ts, seq)."""
    return in_buckets(results, "slot", Newest())


class LatestDraft(Bucket):
    """The keys' last writes; gives those, with a version, that a batch changed. A write without a stamp is the oldest."""

    SCHEMA = "key long, version long, micros long, payload double, deleted boolean"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, new = self.load(), {}
        place = lambda d: (d[1] is not None, d[1] or 0, d[2])
        for k, *write in values(rows, ["key", "saved_at_micros", "seq", "payload", "deleted"]):
            old = state.get(k)
            draft, last = [(0 if old is None else old[0]) + 1, *write], new.get(k, old)
            if last is None or place(draft) > place(last):
                new[k] = draft
        self.store(state | new)
        yield self.frame([(k, version, micros, payload, deleted) for k, (version, micros, _, payload, deleted) in new.items()])


def latest_draft_stream(drafts: DataFrame) -> DataFrame:
    """key, version, micros (of saved_at), payload, deleted of drafts (key, saved_at, payload, deleted, seq), whenever a key's last write changes."""
    return in_buckets(drafts, "key", LatestDraft())


def latest_writes(changes: DataFrame) -> DataFrame:
    """key, saved_at, payload of each key's last change, without deleted ones."""
    last = changes.groupBy("key").agg(F.max_by(F.struct("micros", "payload", "deleted"), "version").alias("d")).where("not d.deleted")
    return last.select("key", F.timestamp_micros("d.micros").cast("timestamp_ntz").alias("saved_at"), "d.payload")


def next_version(state) -> int:
    """The number of a bucket's batch, which rises from batch to batch."""
    version = (state.get()[0] if state.exists() else 0) + 1
    state.update((version,))
    return version


class FoldEdits(Bucket):
    """The sessions' elements, folded as fold_edits() folds them; gives all of a session, with a version, after each batch that has rows of it."""

    SCHEMA = "session long, version long, element string, page_index int, value double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.version = handle.getValueState("version", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, touched = self.load(), {}
        for session, action, element, page, value in values(rows, ["session", "action", "element", "page_index", "value"], ["ts_micros", "event_id"]):
            if session not in touched:
                touched[session] = {e: (p, v) for e, p, v in state.get(session, [])}
            elements = touched[session]
            if action == "ADD":
                elements[element] = (page, value)
            elif action == "UPDATE" and element in elements and value is not None:
                elements[element] = (elements[element][0], value)
            elif action == "DELETE":
                elements.pop(element, None)
            elif action == "CLEAR_PAGE" and page is not None:
                for other in [e for e, (p, _) in elements.items() if p == page]:
                    del elements[other]
        state |= {session: [(e, *v) for e, v in elements.items()] for session, elements in touched.items()}
        self.store({session: elements for session, elements in state.items() if elements})
        version = next_version(self.version)
        yield self.frame([(session, version, *e) for session in touched for e in state[session] or [(None, None, None)]])


def fold_edits_stream(log: DataFrame) -> DataFrame:
    return in_buckets(log, "session", FoldEdits())


def latest_version(folded: DataFrame) -> DataFrame:
    """The elements of each session's last version."""
    last = folded.groupBy("session").agg(F.max("version").alias("version"))
    return folded.join(last, ["session", "version"], "left_semi").where("element is not null").select("session", "element", "page_index", "value")


class FoldRecords(Bucket):
    """The sessions' records as fold_records() has them; gives those that a batch changed, with a version, and none (null) where one ended."""

    SCHEMA = "session long, version long, element string, fields string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.version = handle.getValueState("version", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, touched, changed = self.load(), {}, {}
        for session, action, element, page, patch in values(rows, ["session", "action", "element", "page_index", "patch"], ["ts_micros", "event_id"]):
            if session not in touched:
                touched[session] = dict(state.get(session, []))
            records, ended = touched[session], []
            if action == "ADD":
                records[element] = json.loads(patch)
            elif action == "UPDATE" and element in records:
                records[element] |= json.loads(patch)
            elif action == "DELETE" and element in records:
                ended = [element]
            elif action == "CLEAR_PAGE" and page is not None:
                ended = [e for e, fields in records.items() if fields.get("page_index") == str(page)]
            else:
                continue
            for e in ended:
                del records[e]
            changed |= dict.fromkeys((session, e) for e in ended or ([] if action == "CLEAR_PAGE" else [element]))
        state |= {session: list(records.items()) for session, records in touched.items()}
        self.store({session: records for session, records in state.items() if records})
        version = next_version(self.version)
        yield self.frame([(session, version, e, json.dumps(touched[session][e]) if e in touched[session] else None) for session, e in changed])


def fold_records_stream(log: DataFrame) -> DataFrame:
    """session, version, element, fields (JSON; null where the record ended) of each record that a batch of the log changed."""
    rows = log.withColumn("patch", F.to_json("patch", {"ignoreNullFields": "false"}))
    return in_buckets(rows, "session", FoldRecords())


def latest_records(changes: DataFrame, fields: list[str]) -> DataFrame:
    """session, element and the fields of the records that are left after all changes, in whatever order these are read."""
    last = changes.groupBy("session", "element").agg(F.max_by(F.struct("fields"), "version").alias("r")).where("r.fields is not null")
    parsed = F.from_json("r.fields", "map<string,string>")
    return last.select("session", "element", *[parsed[f].alias(f) for f in fields])


class TakeHandoff(Bucket):
    """The last unconsumed saves of the keys; a take consumes its key's and says whether it was fresh."""

    SCHEMA = "key long, seq long, payload double, status string"

    def __init__(self, seconds: int):
        self.seconds = seconds

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, state = [], self.load()
        for k, micros, seq, kind, payload in values(rows, ["key", "ts_micros", "seq", "kind", "payload"], ["ts_micros", "seq"]):
            if kind == "save":
                state[k] = [micros, payload]
                continue
            saved = state.pop(k, None)
            old = saved is not None and None not in (micros, saved[0]) and micros - saved[0] > self.seconds * 1_000_000
            status = "empty" if saved is None else "expired" if old else "empty" if saved[1] is None else "ok"
            out.append((k, seq, saved[1] if status == "ok" else None, status))
        self.store(state)
        yield self.frame(out)


def take_handoff_stream(rows: DataFrame, seconds: int = 300) -> DataFrame:
    """key, seq, payload, status of each take of rows (key, ts, seq, kind, payload)."""
    return in_buckets(rows, "key", TakeHandoff(seconds))
