"""Registered streams over an events folder of many files whose time ranges overlap."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_queries import SF, normal

from leafmill.plans.registry import ORACLES, QUERIES
from leafmill.streaming import jobs


@pytest.fixture(scope="module")
def scattered(spark, tmp_path_factory):
    """The events in 30 files by a hash of their id, so each file spans all times."""
    where = tmp_path_factory.mktemp("scattered")
    spark.read.parquet(f"{SF}/events.parquet").repartition(30, F.xxhash64("event_id")).write.parquet(f"{where}/events.parquet")
    return str(where)


@pytest.mark.parametrize("name", ["debounce_saves_stream", "commit_once_stream", "fold_edits_stream", "take_handoff_stream", "drop_superseded_stream", "latest_draft_stream", "request_timeouts_stream", "handoff_timers_stream", "expire_drafts_stream", "latest_draft_upserts"])
@pytest.mark.parametrize("stamped", [True, False])
def test_files_do_not_change_a_stream(spark, scattered, monkeypatch, name, stamped):
    monkeypatch.setattr(jobs, "FILE_ROWS", 60)
    if not stamped:  # as where the file system keeps no times
        monkeypatch.setattr(jobs, "modified", lambda f: 0)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{scattered}/events.parquet/*.parquet'")
    want = con.execute(ORACLES[name]).df()
    found = QUERIES[name](spark, scattered).toPandas()
    pd.testing.assert_frame_equal(normal(found), normal(want[found.columns]))


def test_files_are_stamped_in_time_order(spark, scattered, monkeypatch):
    monkeypatch.setattr(jobs, "FILE_ROWS", 60)
    where = []
    monkeypatch.setattr(jobs, "events_stream", lambda s, path, files: where.append((path, files)))
    jobs.in_time_order(spark, f"{scattered}/events.parquet")
    path, files = where[0]
    parts = sorted((f for f in os.listdir(path) if f.startswith("part-")), key=lambda f: os.stat(f"{path}/{f}").st_mtime_ns)
    spans = [duckdb.sql(f"SELECT min(ts), max(ts) FROM '{path}/{f}'").fetchall()[0] for f in parts]
    assert files == 8 and len(parts) > 8
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
