"""Durations and snapshots of jobs whose stages never got past 0, or took months, against their SQL."""

from __future__ import annotations

from datetime import datetime, timedelta

import duckdb
import pytest

from docpipe.plans import catalog


@pytest.mark.parametrize("name", ["stage_durations", "job_snapshot"])
def test_stages_without_progress(spark, tmp_path, name):
    start = datetime(2024, 1, 1)
    # event_id % 130 - 10 is the progress, event_id % 6 the stage; user 2 takes 200 days
    rows = [(260, 1, "signup", 0), (4, 1, "view", 1), (130, 1, "view", 2), (134, 1, "view", 3), (261, 2, "signup", 0), (30, 2, "view", 1), (36, 2, "view", 200 * 86_400), (3, 2, "view", 5)]
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
    con.executemany("insert into events values (?, ?, ?, ?, 0, '')", [(e, start + timedelta(seconds=s), u, kind) for e, u, kind, s in rows])
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    want = con.execute(catalog.oracle_sql()[name]).fetchall()
    got = catalog.queries()[name](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert name == "job_snapshot" or 0.0 in {r[2] for r in want} and max(r[2] for r in want) > 1e7
