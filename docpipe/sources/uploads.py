"""Uploaded files: what is accepted and why the rest is not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 50 * 1024 * 1024
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def rejection(path: Column, length: Column, max_bytes: int = MAX_BYTES) -> Column:
    """The reason a file is refused, null if it is taken."""
    name = F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1)
    return F.when(name == "", "no name").when(~F.lower(name).endswith(".pdf"), "not a pdf").when(length > max_bytes, "too large")


def read_uploads(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Accepted files with their content. Name and size are checked in the scan, so refused contents are never read."""
    files = spark.read.format("binaryFile").load(path)
    return files.where(rejection(F.col("path"), F.col("length"), max_bytes).isNull() & (F.col("length") <= max_bytes))


def rejected_uploads(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, length, reason of refused files, without their contents."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.withColumn("reason", rejection(F.col("path"), F.col("length"), max_bytes)).where("reason is not null")


def stream_uploads(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, files_per_trigger: int = 100) -> DataFrame:
    """Accepted files as they arrive."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return files.where(rejection(F.col("path"), F.col("length"), max_bytes).isNull())
