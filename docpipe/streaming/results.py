"""A sink of results by key: batches that can be written again, and the latest row of each key. `store` does the same for
long histories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_batch(rows: DataFrame, path: str, batch: int) -> None:
    """Writes a batch into a folder of its own; the same batch written again replaces itself, so a replay changes nothing."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch of a stream of results."""
    return lambda rows, batch: write_batch(rows, path, batch)


def latest(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """Of each key the row of its last batch (of several in that batch, the greatest): what upserts would have left."""
    rows = spark.read.parquet(path)
    row = F.struct(*(c for c in rows.columns if c != "batch"))
    last = rows.groupBy(key).agg(F.max_by(row, F.struct("batch", F.to_json(row))).alias("row"))
    return last.select("row.*")
