"""Folders that driver and executors share, and small files in them that the driver reads and writes."""

from __future__ import annotations

import tempfile
import uuid
from typing import Any

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for `name` below spark.checkpoint.dir. Only in local mode may the setting be missing: a local folder is
    made then; on a cluster that is an error, as executors could not read it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext.getCheckpointDir()
        if not held and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = held.rsplit("/", 1)[0] if held else "file://" + tempfile.mkdtemp(prefix="docpipe-")
        if not held:
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/docpipe/{name}-{uuid.uuid4().hex}"


class Folder:
    """A folder of any file system that Spark knows, seen from the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str = "") -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        """What a folder holds; nothing if it is not there."""
        try:
            return [x.getPath().getName() for x in self._fs.listStatus(self._at(name))]
        except Exception as e:  # noqa: BLE001  only a missing folder is nothing
            if "FileNotFound" in str(e):
                return []
            raise

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Writes a file that is not there yet; False if somebody else was first."""
        try:
            stream = self._fs.create(self._at(name), False)
        except Exception as e:  # noqa: BLE001  only a file that is there is an answer
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)

    def move(self, name: str, to: str) -> None:
        """Renames a file or folder; in place of what is there, if anything."""
        self.delete(to)
        if not self._fs.rename(self._at(name), self._at(to)):
            raise OSError(f"{self.path}/{name} could not be renamed")


def bounded_batches(spark: SparkSession, most_mb: int = 16) -> None:
    """Lowers the session's limit on the bytes of an Arrow batch, so that Python workers hold little of long texts at a time.

    Sessions with a lower limit keep it; it changes no result.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name, None) or ""
    if not held.rstrip("b").isdigit() or not 0 < int(held.rstrip("b")) <= most_mb << 20:
        spark.conf.set(name, f"{most_mb << 20}b")
