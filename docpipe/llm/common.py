"""What the operators share: the shared folder, tables written to cut lineage, and file access from tasks."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.sources.places import bounded_batches  # noqa: F401  passed on to the operators


class _Made(threading.local):
    """Folders below the shared one that this thread has made and not dropped, in order; so one run never drops another's."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_made = _Made()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for `name` below spark.checkpoint.dir, which driver and executors share.

    Only in local mode (tests, one machine) may that setting be missing: a local folder is made then and set as the
    checkpoint folder. On a cluster a missing setting is an error, as no executor could read another's local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext.getCheckpointDir()
        if not held and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = held.rsplit("/", 1)[0] if held else "file://" + tempfile.mkdtemp(prefix="docpipe-")
        if not held:
            spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/docpipe/{name}-{uuid.uuid4().hex}"
    _made.paths.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> int:
    """A mark for `drop_since`: how many folders this thread has made."""
    return len(_made.paths)


def drop_since(spark: SparkSession, mark: int, keep: str | None = None) -> None:
    """Deletes the folders that this thread made since the mark, but for `keep`.

    For callers that have written what they need: DataFrames that read one of the folders can't be read any more.
    """
    for path in [p for p in _made.paths[mark:] if p != keep]:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        _made.paths.remove(path)


def partitions(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs) and the path inside it."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    system, path = file_system(uri)
    system.create_dir(path, recursive=True)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str, chars: int = 300_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cuts Arrow batches so that each slice holds about `chars` bytes of `column`, or one longer row; only a slice's texts
    are Python strings at a time."""
    for batch in batches:
        values = batch.column(column)
        sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(values):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + chars, "right")))
            yield batch.slice(start, stop - start), ["" if x is None else x for x in values.slice(start, stop - start).to_pylist()]
            start = stop
        pa.default_memory_pool().release_unused()  # workers live on; what they hold of a batch should not


def runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[object, pa.Table]]:
    """The groups of rows with equal values of `column`, which must come together, each as a table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values, start = batch.column(column).to_pylist(), 0
        for at, value in enumerate(values):
            if value != last and (held or at > start):
                if at > start:
                    held.append(batch.slice(start, at - start))
                yield last, pa.Table.from_batches(held)
                held, start = [], at
            last = value
        held.append(batch.slice(start))
    if held:
        yield last, pa.Table.from_batches(held)
