"""The live feed: the stream against the table, restarts, late and repeated events, timeouts."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docpipe.streaming import feed, jobs

START = datetime(2024, 1, 1)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(autouse=True)
def rocks(spark):
    held = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, feed.ROCKS)
    yield
    spark.conf.set(PROVIDER, held)


def job_events(n: int, seed: int, n_jobs: int = 12) -> list[tuple]:
    rng = random.Random(seed)
    actions = ("create", "update", "update", "update", "complete", "error", "cancel", "other")
    return [(f"j{rng.randrange(n_jobs)}", START + timedelta(seconds=i // 2), i, rng.choice(actions[:4] if i < n // 2 else actions), rng.choice((*jobs.STAGES, None)), rng.choice((-5, 10, 10, 50, 140)), None) for i in range(n)]


def plain_feed(rows: list[tuple]) -> list[tuple]:
    """One event after another, each once."""
    states: dict = {}
    out = []
    for job, ts, seq, action, stage, progress, message in sorted(set(rows), key=lambda r: r[1:3]):
        before = states.get(job)
        states[job] = jobs.transition(before, action, stage, progress, message)
        if states[job][0] is not None and (before is None or before[:3] != states[job][:3]):
            out.append((job, seq, "progress" if states[job][0] in jobs.OPEN else "complete", *states[job][:3]))
    return sorted(out)


def run_stream(spark, tmp_path, late: str, idle: int = 10**6) -> list[tuple]:
    """What is in the sink after everything in the folder of events has been read; called again, goes on from the checkpoint."""
    source = spark.readStream.schema(jobs.EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    query = feed.streaming_feed(source, late, idle).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    return sorted((r["job_id"], r["seq"], r["event"], r["status"], r["progress"], r["stage"]) for r in spark.read.schema(feed.FEED).parquet(str(tmp_path / "out")).collect())


def put(spark, tmp_path, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, jobs.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))


def test_table_like_one_event_after_another(spark):
    rows = job_events(600, 1, 40)
    rows += rows[::5]
    got = feed.job_feed(spark.createDataFrame(rows, jobs.EVENT).repartition(3))
    assert sorted((r["job_id"], r["seq"], r["event"], r["status"], r["progress"], r["stage"]) for r in got.collect()) == plain_feed(rows)
    assert feed.job_feed(spark.createDataFrame([], jobs.EVENT)).count() == 0


def test_stream_equals_table_over_a_restart(spark, tmp_path):
    """Events out of order within the allowed time and repeated, over three files, a stop, and two more files."""
    rng, rows = random.Random(7), job_events(240, 3)
    mixed = sorted([*rows, *rows[::7]], key=lambda r: (r[2] + rng.randrange(-25, 25), rng.random()))
    cut = [mixed[i : i + 60] for i in range(0, len(mixed), 60)]
    for part in cut[:3]:
        put(spark, tmp_path, part)
    first = run_stream(spark, tmp_path, "40 seconds")
    assert first and set(first) <= set(plain_feed(rows))
    for part in [*cut[3:], [("end", START + timedelta(days=1), 10**6, "other", None, 0, None)]]:
        put(spark, tmp_path, part)
    assert run_stream(spark, tmp_path, "40 seconds") == plain_feed(rows)


def test_ended_jobs_stay_ended_and_silent_ones_time_out(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    put(spark, tmp_path, [("a", at(0), 1, "create", None, None, None), ("a", at(1), 2, "update", "ocr", 30, None), ("b", at(0), 1, "create", None, None, None), ("b", at(2), 2, "complete", None, None, None), ("c", at(3), 1, "update", None, 5, None)])
    put(spark, tmp_path, [("b", at(20), 3, "update", "llm", 5, None), ("x", at(500), 1, "other", None, 0, None)])
    put(spark, tmp_path, [("a", at(1), 3, "cancel", None, None, None), ("y", at(501), 1, "other", None, 0, None)])  # far too late
    assert run_stream(spark, tmp_path, "5 seconds", idle=60) == [("a", 1, "progress", "started", 0, "upload"), ("a", 2, "progress", "processing", 30, "ocr"), ("a", 2, "timeout", "processing", 30, "ocr"), ("b", 1, "progress", "started", 0, "upload"), ("b", 2, "complete", "completed", 100, "upload")]


def test_the_provider_has_to_be_named(spark):
    spark.conf.unset(PROVIDER)
    with pytest.raises(ValueError, match="providerClass"):
        feed.streaming_feed(spark.readStream.format("rate").load().select(F.lit("a").alias("job_id"), F.col("timestamp").alias("ts")))
