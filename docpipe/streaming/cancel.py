"""Cancelling a job while it works: wishes in a shared folder, read between stages, during them, and at batch borders in tasks."""

from __future__ import annotations

import hashlib
import threading
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.sources.ledger import file_system
from docpipe.sources.places import Folder
from docpipe.streaming.jobs import EVENT


class Cancelled(RuntimeError):
    """The job was cancelled; it has left no output."""


class Wishes:
    """Which jobs somebody wants cancelled: a small file for each, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self.folder = Folder(spark, self.path)

    @staticmethod
    def name(job_id: str) -> str:
        return hashlib.sha256(job_id.encode()).hexdigest()

    def cancel(self, job_id: str) -> bool:
        """Wishes a job cancelled; False if that was wished before."""
        return self.folder.write_new(self.name(job_id), job_id)

    def wished(self, job_id: str) -> bool:
        return self.folder.exists(self.name(job_id))

    def withdraw(self, job_id: str) -> None:
        self.folder.delete(self.name(job_id))

    def at_borders(self, df: DataFrame, job_id: str, seconds: float = 1.0) -> DataFrame:
        """The same rows; a task looks for the wish at batch borders, every `seconds` at most, and fails if it is there."""
        path, name = self.path, self.name(job_id)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, base = file_system(path)
            looked = 0.0
            for batch in batches:
                if time.monotonic() - looked >= seconds:
                    looked = time.monotonic()
                    if system.get_file_info(f"{base}/{name}").is_file:
                        raise Cancelled(job_id)
                yield batch

        return df.mapInArrow(run, df.schema)


Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def run_stages(docs: DataFrame, stages: list[Stage], out: str, job_id: str, wishes: Wishes, poll: float = 0.2) -> DataFrame:
    """Runs the stages one after another, each written and read again below `out`, and returns events of the job (jobs.EVENT).

    A wish to cancel stops the job before its next stage, in the midst of one (its Spark jobs are cancelled by their tag; other
    jobs of the session go on) and at batch borders of its tasks. Then what it wrote is deleted and Cancelled is raised, with
    the events so far, the last of them a cancel, as its second argument. The result appears in `out`/result, by a rename, only
    when all stages are done.
    """
    spark = docs.sparkSession
    folder, tag, log = Folder(spark, out), f"cancel-{Wishes.name(job_id)[:16]}", []
    stopped, found = threading.Event(), threading.Event()

    def note(action: str, stage: str | None, progress: int | None, message: str | None = None) -> None:
        log.append((job_id, time.time(), len(log), action, stage, progress, message))

    def watch() -> None:
        while not stopped.wait(poll):
            if wishes.wished(job_id):
                found.set()
                spark.sparkContext.cancelJobsWithTag(tag)

    def events() -> DataFrame:
        rows = spark.createDataFrame(log, "job_id string, t double, seq long, action string, stage string, progress int, message string")
        return rows.withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long"))).select([c.split()[0] for c in EVENT.split(", ")])

    note("create", None, None)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    spark.sparkContext.addJobTag(tag)
    try:
        for number, (name, stage) in enumerate(stages):
            if wishes.wished(job_id):
                raise Cancelled(job_id)
            note("update", name, 100 * number // len(stages))
            path = f"{out}/stages/{number}"
            made = wishes.at_borders(stage(docs), job_id)
            made.write.mode("overwrite").parquet(path)
            docs = spark.read.schema(made.schema).parquet(path)
        if wishes.wished(job_id):
            raise Cancelled(job_id)
        folder.move(f"stages/{len(stages) - 1}", "result")
        note("complete", stages[-1][0], 100)
    except Exception as e:
        folder.delete("stages")
        if isinstance(e, Cancelled) or found.is_set() or wishes.wished(job_id):
            note("cancel", None, None, "Processing cancelled by user")
            raise Cancelled(job_id, events()) from e
        note("error", None, None, str(e)[:500])
        raise
    finally:
        stopped.set()
        watcher.join()
        spark.sparkContext.removeJobTag(tag)
    folder.delete("stages")
    return events()
