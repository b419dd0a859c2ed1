"""A store of the latest row of each key: batches are appended to a log by bucket, and compacted into a base.

    log/batch=7/bucket=3/...     the rows of a batch, one for a key at most
    base/version=2/bucket=3/...  the latest rows of a bucket, as a compaction left them
    current/00000002             which version holds each bucket, and up to which batch

Readers take the newest file in `current` that can be read, and merge the batches after it while reading. A compaction
writes only the buckets that the log touches and becomes visible by that one small file; a crash before it changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docpipe.sources.places import Folder


class KeyedStore:
    """A store at a path. `schema` are the rows' columns, `key` the column that tells them apart, `order` the columns that say
    which of several rows of a key in one batch is the latest (then a hash of the row)."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, key: str = "id", order: tuple[str, ...] = (), buckets: int = 64):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.folder = Folder(spark, self.path)
        if taken := {"bucket", "batch", "version"} & set(self.schema.names):
            raise ValueError(f"columns of the store's own: {sorted(taken)}")

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def current(self) -> dict:
        """The newest version: number, upto (a batch), buckets (of each, the version that holds it)."""
        for name in sorted(self.folder.names("current"), reverse=True):
            try:
                held = json.loads(self.folder.read(f"current/{name}"))
            except ValueError:  # a writer died, or is not done
                continue
            return {"number": int(name), "upto": held["upto"], "buckets": {int(k): v for k, v in held["buckets"].items()}}
        return {"number": 0, "upto": -1, "buckets": {}}

    def batches(self, after: int) -> list[int]:
        """Batches in the log that are whole, after a number."""
        found = [int(name.removeprefix("batch=")) for name in self.folder.names("log") if name.startswith("batch=")]
        return sorted(n for n in found if n > after and self.folder.exists(f"log/batch={n}/_SUCCESS"))

    def upsert(self, rows: DataFrame, batch: int) -> None:
        """Appends a batch, numbered from 0. The same batch again replaces itself, or is passed over once it is compacted, so a
        replay changes nothing. Rows with a null key are one key. Other columns than the schema's are not kept."""
        if batch <= self.current()["upto"]:
            return
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        row = F.struct(*(f.name for f in self.schema))
        last = rows.select(*columns).groupBy(self.key).agg(F.max_by(row, F.struct(*self.order, F.xxhash64(F.to_json(row)))).alias("__row"))
        last.select("__row.*").withColumn("bucket", self.bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/log/batch={batch}")

    def writer(self, compact_every: int = 50) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: upserts, with a compaction now and then."""

        def write(rows: DataFrame, batch: int) -> None:
            self.upsert(rows, batch)
            if len(self.batches(self.current()["upto"])) >= compact_every:
                self.compact()

        return write

    def _read(self, base: str, paths: list[str], extra: str) -> DataFrame:
        schema = T.StructType([*self.schema.fields, *T.StructType.fromDDL(extra).fields])
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{base}").parquet(*paths)

    def _log(self, batches: list[int]) -> DataFrame:
        """The latest row of each key in these batches, with bucket."""
        rows = self._read("log", [f"{self.path}/log/batch={n}" for n in batches], "batch long, bucket int")
        names = [f.name for f in self.schema]
        return rows.groupBy("bucket", self.key).agg(F.max_by(F.struct(*names), "batch").alias("__row")).select("__row.*", "bucket")

    def _base(self, buckets: dict[int, int]) -> DataFrame:
        return self._read("base", [f"{self.path}/base/version={version}/bucket={b}" for b, version in sorted(buckets.items())], "version int, bucket int").drop("version")

    def _merged(self, now: dict, batches: list[int], only: list[int] | None = None) -> DataFrame:
        base = self._base({b: v for b, v in now["buckets"].items() if only is None or b in only})
        log = self._log(batches)
        log = log if only is None else log.where(F.col("bucket").isin(only))
        kept = base.join(log.select(F.col(self.key).alias("__key"), F.col("bucket").alias("__bucket")), (F.col("bucket") == F.col("__bucket")) & F.col(self.key).eqNullSafe(F.col("__key")), "left_anti")
        return kept.unionByName(log)

    def latest(self) -> DataFrame:
        """The latest row of every key. Base rows are not shuffled by what the log holds where that is small enough for Spark
        to broadcast; each key is looked for in its own bucket alone."""
        now = self.current()
        return self._merged(now, self.batches(now["upto"])).drop("bucket")

    def lookup(self, *keys: object) -> DataFrame:
        """The latest rows of some keys; only their buckets are read, of the base and of each batch."""
        kind = self.schema[self.key].dataType
        wanted = self.spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField(self.key, kind)]))
        only = sorted({r[0] for r in wanted.select(self.bucket()).collect()})
        now = self.current()
        rows = self._merged(now, self.batches(now["upto"]), only)
        return rows.where(F.col(self.key).isin([k for k in keys if k is not None]) | (F.col(self.key).isNull() if None in keys else F.lit(False))).drop("bucket")

    def compact(self) -> bool:
        """Moves whole batches of the log into the base; False if there are none, or if another compaction was first.

        Versions and batches that the version before still needed are deleted only now, so readers of the version before
        last are the first that could miss files.
        """
        now = self.current()
        batches = self.batches(now["upto"])
        if not batches:
            return False
        number = max([now["number"], *(int(n) for n in self.folder.names("current"))]) + 1
        touched = sorted({int(name.removeprefix("bucket=")) for n in batches for name in self.folder.names(f"log/batch={n}") if name.startswith("bucket=")})
        out = f"base/version={number}"
        self._merged(now, batches, touched).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{out}")
        held = {name.removeprefix("bucket=") for name in self.folder.names(out) if name.startswith("bucket=")}
        buckets = {str(b): v for b, v in now["buckets"].items() if b not in touched} | {b: number for b in held}
        if not self.folder.write_new(f"current/{number:08}", json.dumps({"upto": batches[-1], "buckets": buckets})):
            return False
        self.clean(now)
        return True

    def clean(self, before: dict) -> None:
        """Deletes what neither the current version nor `before` reads."""
        now = self.current()
        needed = {*now["buckets"].values(), *before["buckets"].values(), now["number"]}
        for name in self.folder.names("base"):
            if name.startswith("version=") and int(name.removeprefix("version=")) not in needed and int(name.removeprefix("version=")) < now["number"]:
                self.folder.delete(f"base/{name}")
        for name in self.folder.names("log"):
            if name.startswith("batch=") and int(name.removeprefix("batch=")) <= before["upto"]:
                self.folder.delete(f"log/{name}")
        for name in self.folder.names("current"):
            if int(name) < before["number"]:
                self.folder.delete(f"current/{name}")
