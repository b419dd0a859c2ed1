"""The live feed of a job: every snapshot that differs from the one before, until the job ends or falls silent.

`job_feed` works it out over a table, `streaming_feed` keeps it for a stream. Both take events (jobs.EVENT) by (ts, seq); the
same event twice counts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docpipe.streaming.jobs import ENDS, OPEN, RETENTION, clamped, transition

FEED = "job_id string, ts timestamp, seq long, event string, status string, progress int, stage string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def job_feed(events: DataFrame) -> DataFrame:
    """FEED of a table of events: a row for each event after which a created job's snapshot differs, the last of a job that
    ended with event `complete`, others `progress`.

    States after each event are running maxima and last values over the job's events in order, so nothing is held as one value.
    """
    order = ("ts", "seq")
    job = Window.partitionBy("job_id").orderBy(*order)
    before, sofar = job.rowsBetween(Window.unboundedPreceding, -1), job.rowsBetween(Window.unboundedPreceding, 0)
    ever = lambda c, w: F.coalesce(F.max(c).over(w), F.lit(False))
    seen = events.select("job_id", *order, "action", "stage", "progress").dropDuplicates(["job_id", *order])
    seen = seen.withColumns({"created": ever(F.col("action") == "create", sofar), "born": ever(F.col("action") == "create", before)})
    seen = seen.withColumn("ends", F.col("born") & F.coalesce(F.col("action").isin(*ENDS), F.lit(False))).withColumn("over", ever(F.col("ends"), before))
    acts = F.col("born") & ~F.col("over")
    update, end = acts & (F.col("action") == "update"), acts & F.col("ends")
    moved = update | (end & (F.col("action") == "complete"))
    last = lambda value, where: F.last(F.when(where, value), ignorenulls=True).over(sofar)
    final = last(F.col("action"), end)
    status = F.coalesce(*(F.when(final == action, name) for action, name in ENDS.items()), F.when(ever(update, sofar), "processing"), F.lit("started"))
    state = seen.withColumns({"status": status, "done": F.when(final == "complete", 100).otherwise(F.coalesce(last(clamped(F.col("progress")), update), F.lit(0))).cast("int"), "place": F.coalesce(last(F.col("stage"), moved & F.col("stage").isNotNull()), F.lit("upload"))})
    snapshot = F.struct("status", "done", "place")
    sent = state.where("created").withColumn("was", F.lag(snapshot).over(job)).where(F.col("was").isNull() | ~snapshot.eqNullSafe(F.col("was")))
    event = F.when(F.col("status").isin(*OPEN), "progress").otherwise("complete")
    return sent.select("job_id", "ts", "seq", event.alias("event"), "status", F.col("done").alias("progress"), F.col("place").alias("stage"))


class JobFeed(StatefulProcessor):
    """State of a job: events that wait for the watermark, and what the events before have made of it.

    Events are worked off in order once the watermark has passed them, so it doesn't matter in which order they arrive, or
    how often. A timer stands at the first waiting event; without one, at the end of the idle time, when a job that has not
    ended is given up with event `timeout` and all state goes.
    """

    PENDING = "us long, seq long, action string, stage string, progress int, message string"
    HELD = "status string, progress int, stage string, message string, n_events long, us long, seq long"

    def __init__(self, idle_seconds: int = RETENTION):
        self.idle = idle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.PENDING)
        self.held = handle.getValueState("held", self.HELD)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        fresh = [(r["us"], r["seq"], r["action"], r["stage"], r["progress"], r["message"]) for r in rows if r["us"] // 1000 >= mark]
        if fresh:
            self.pending.appendList(fresh)
        yield from self.work_off(key, mark)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        yield from self.work_off(key, timerValues.getCurrentWatermarkInMs())

    def work_off(self, key: Any, mark: int) -> Iterator[Row]:
        waiting = {(e[0], e[1]): tuple(e) for e in (self.pending.get() if self.pending.exists() else ())}
        held = tuple(self.held.get()) if self.held.exists() else None
        state, at = (held[:5], held[5:]) if held else (None, (-1, -1))
        out = []
        for place in sorted(waiting):
            us, seq, action, stage, progress, message = waiting[place]
            if us // 1000 >= mark:
                break
            del waiting[place]
            if place <= at:
                continue  # worked off before
            before, at = state, place
            state = transition(before, action, stage, progress, message)
            if state[0] is not None and (before is None or before[:3] != state[:3]):
                out.append((key[0], us, seq, "progress" if state[0] in OPEN else "complete", *state[:3]))
        if waiting:
            self.pending.put(sorted(waiting.values(), key=lambda e: e[:2]))
            self.handle.registerTimer(min(waiting)[0] // 1000 + 1)
        else:
            self.pending.clear()
        if state is not None and not waiting and mark >= at[0] // 1000 + self.idle:
            if state[0] in OPEN:
                out.append((key[0], at[0], at[1], "timeout", *state[:3]))
            self.held.clear()
        elif state is not None:
            if held is None or at != held[5:]:
                self.held.update((*state, *at))
            if not waiting:
                self.handle.registerTimer(at[0] // 1000 + self.idle)
        for job, us, seq, event, status, progress, stage in out:
            yield Row(job_id=job, us=us, seq=seq, event=event, status=status, progress=progress, stage=stage)


def streaming_feed(events: DataFrame, late: str = "10 minutes", idle_seconds: int = RETENTION) -> DataFrame:
    """FEED of a stream of events, in append mode: each row once, when the watermark (`late` behind the newest event) has passed
    its event. Events later than that are dropped, as are those without a time or number.

    A job that is `idle_seconds` without an event is given up (`timeout`), and forgotten, as are ended ones. State is kept by
    the RocksDB provider (ROCKS), which the session has to name in spark.sql.streaming.stateStore.providerClass; it outlives a
    restart from the checkpoint.
    """
    name = "spark.sql.streaming.stateStore.providerClass"
    if events.sparkSession.conf.get(name, None) != ROCKS:
        raise ValueError(f"{name} has to be {ROCKS}")
    keyed = events.where("ts is not null and seq is not null").withWatermark("ts", late).select("job_id", "ts", F.unix_micros("ts").alias("us"), "seq", "action", "stage", "progress", "message")
    made = keyed.groupBy("job_id").transformWithState(JobFeed(idle_seconds), "job_id string, us long, seq long, event string, status string, progress int, stage string", "append", "eventTime")
    return made.select("job_id", F.timestamp_micros("us").alias("ts"), "seq", "event", "status", "progress", "stage")
