"""A ledger of model answers: every question is asked once, whatever fails in between.

A question is addressed by the SHA-256 of the model's identity (name and options), the prompt and the image. Only questions
without an answer in the ledger are asked. Tasks put answers into the ledger while they work, as small Parquet files that
appear whole, so a killed job leaves what it has got, and its successor goes on from there.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.sources.places import Folder
from docpipe.sources.plugins import LanguageModel

SCHEMA = "key string, response string, error string, attempts int, millis long"
ARROW = pa.schema([("key", pa.string()), ("response", pa.string()), ("error", pa.string()), ("attempts", pa.int32()), ("millis", pa.int64())])


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


@dataclass(frozen=True)
class Calls:
    """How a task asks: calls in flight at a time, attempts for each question, seconds before the second one (doubled for each
    further one), answers or seconds after which a file is written."""

    in_flight: int = 4
    attempts: int = 4
    wait: float = 0.5
    longest_wait: float = 30.0
    flush_rows: int = 20
    flush_seconds: float = 5.0


def ask(model: LanguageModel, prompt: str, image: bytes | None, calls: Calls) -> tuple[str | None, str | None, int]:
    """Answer, error and number of attempts. Errors that say so (retryable = False) are not tried again."""
    pause = calls.wait
    for attempt in range(1, calls.attempts + 1):
        try:
            return model.complete(prompt, image), None, attempt
        except Exception as e:  # noqa: BLE001  a call's failure is data
            error = f"{type(e).__name__}: {e}"
            if attempt == calls.attempts or not getattr(e, "retryable", True):
                return None, error, attempt
            time.sleep(min(pause, calls.longest_wait))
            pause *= 2
    return None, "no attempts", 0


@dataclass
class Writer:
    """Collects rows of the ledger and writes them as files that appear under their name only when they are whole."""

    uri: str
    calls: Calls
    rows: list[dict] = field(default_factory=list)
    since: float = field(default_factory=time.monotonic)

    def add(self, **row: object) -> None:
        self.rows.append(row)
        if len(self.rows) >= self.calls.flush_rows or time.monotonic() - self.since > self.calls.flush_seconds:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            system, base = file_system(self.uri)
            system.create_dir(base, recursive=True)
            name = uuid.uuid4().hex
            pq.write_table(pa.Table.from_pylist(self.rows, ARROW), f"{base}/.{name}", filesystem=system)
            system.move(f"{base}/.{name}", f"{base}/{name}.parquet")
        self.rows, self.since = [], time.monotonic()


class ResponseLedger:
    """The ledger at a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def rows(self) -> DataFrame:
        """All entries: key, response, error, attempts, millis. A question may have several, failures among them."""
        folder = Folder(self.spark, self.path)
        if not any(name.endswith(".parquet") for name in folder.names()):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def answers(self) -> DataFrame:
        """One entry for each question: an answer if there is any, the first of several, else the last failure."""
        there = F.col("response").isNotNull()
        best = F.struct(there.alias("good"), F.when(there, -F.col("millis")).otherwise(F.col("millis")).alias("at"), "response", "error")
        return self.rows().groupBy("key").agg(F.max_by(F.struct("response", "error", "attempts"), best).alias("a")).select("key", "a.*")

    def complete(self, prompts: DataFrame, model: Callable[[], LanguageModel], identity: str, image: str | None = None, calls: Calls = Calls(), tasks: int | None = None) -> DataFrame:
        """`prompts` (doc_id, kind, prompt and others) with response, error and attempts (in place of their own); asks what the ledger does not know.

        Equal questions are asked once. Failures are kept, but asked again by the next run. Null prompts are not asked, and
        have neither answer nor error. tasks: how many ask at a time, each with up to calls.in_flight calls.
        """
        keyed = prompts.drop("response", "error", "attempts").withColumn("__key", question(F.col("prompt"), identity, F.col(image) if image else None))
        known = self.rows().where("response is not null").select(F.col("key").alias("__key"))
        picture = (F.col(image) if image else F.lit(None)).cast("binary").alias("image")
        unknown = keyed.where("prompt is not null").select("__key", "prompt", picture).join(known, "__key", "left_anti").dropDuplicates(["__key"])
        unknown = unknown.repartition(tasks or self.spark.sparkContext.defaultParallelism)
        path = self.path

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = None
            writer, n = Writer(path, calls), 0

            def store(done: set[Future]) -> None:
                for one in done:
                    key, (response, error, attempts) = one.result()
                    writer.add(key=key, response=response, error=error, attempts=attempts, millis=int(time.time() * 1000))

            with ThreadPoolExecutor(calls.in_flight) as pool:
                flying: set[Future] = set()
                try:
                    for batch in batches:
                        made = made or model()
                        for key, prompt, picture in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                            if len(flying) >= calls.in_flight:
                                done, flying = wait(flying, return_when=FIRST_COMPLETED)
                                store(done)
                            flying.add(pool.submit(lambda k=key, p=prompt, i=picture: (k, ask(made, p, i, calls))))
                            n += 1
                finally:
                    store(wait(flying).done)
                    writer.flush()
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

        unknown.mapInArrow(run, "n long").agg(F.sum("n")).collect()
        return keyed.join(self.answers().withColumnRenamed("key", "__key"), "__key", "left").drop("__key")

    def compact(self) -> int:
        """Makes one set of files of the many small ones; returns how many there were. No job may be asking meanwhile.

        The new files stand beside the old ones before those go, and entries that are there twice count once.
        """
        folder = Folder(self.spark, self.path)
        old = [name for name in folder.names() if name.endswith(".parquet")]
        if old:
            self.answers().withColumn("millis", F.lit(0).cast("long")).write.mode("append").parquet(self.path)
            for name in old:
                folder.delete(name)
        return len(old)


def question(prompt: Column, identity: str, image: Column | None = None) -> Column:
    """The address of a question; parts are told apart by their lengths."""
    part = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    picture = F.coalesce(F.sha2(image.cast("binary"), 256), F.lit("")) if image is not None else F.lit("")
    return F.sha2(F.concat(part(F.lit(identity)), part(prompt), picture).cast("binary"), 256)
