"""The keyed store: upserts, replays, compaction, crashes between its steps, lookups by bucket."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docpipe.streaming.store import KeyedStore

SCHEMA = "id string, v int, m map<string,int>"


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, f"file://{tmp_path}/store", SCHEMA, "id", ("v",), 4)


def put(store, batch: int, rows: dict, more: list = ()) -> None:
    held = [(k, v, {"n": v}) for k, v in rows.items()] + [(k, v, {"n": v}) for k, v in more]
    store.upsert(store.spark.createDataFrame(held, SCHEMA).withColumn("bucket", F.lit("clash")), batch)


def read(df) -> dict:
    rows = df.collect()
    got = {r["id"]: r["v"] for r in rows}
    assert len(got) == len(rows) and all(r["m"] == {"n": r["v"]} for r in rows) and df.columns == ["id", "v", "m"]
    return got


def test_like_a_dictionary(store):
    """Random upserts, replays and compactions, with a null key and repeated keys in a batch."""
    rng, want = random.Random(1), {}
    done: dict = {}
    for batch in range(9):
        rows = {rng.choice([*"abcdefghij", None]): rng.randrange(1000) for _ in range(rng.randrange(1, 6))}
        done[batch] = rows
        put(store, batch, rows, [(k, -1) for k in rows])
        want |= rows
        if rng.random() < 0.4:
            again = rng.randrange(batch + 1)
            put(store, again, done[again])
        if batch % 3 == 2:
            assert store.compact()
        assert read(store.latest()) == want
    keys = ["a", "c", None, "zz"]
    assert read(store.lookup(*keys)) == {k: v for k, v in want.items() if k in keys}
    assert store.compact() is False or store.batches(-1)
    assert read(store.latest()) == want


def test_nothing_yet(store):
    assert read(store.latest()) == {} and read(store.lookup("a")) == {} and store.compact() is False
    put(store, 0, {})
    assert read(store.latest()) == {}


def test_a_compaction_that_dies_changes_nothing(store, monkeypatch):
    """Before its file, while writing it, and between the file and the cleaning."""
    put(store, 0, {"a": 1, "b": 2})
    store.compact()
    put(store, 1, {"b": 3, "c": 4})
    want = {"a": 1, "b": 3, "c": 4}
    with monkeypatch.context() as m:
        m.setattr(store.folder, "write_new", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            store.compact()
    assert read(store.latest()) == want
    store.folder.write_new("current/00000007", '{"upto": 1, "buck')  # a writer that died in the middle
    assert read(store.latest()) == want and store.current()["number"] == 1
    with monkeypatch.context() as m:
        m.setattr(store, "clean", lambda _: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            store.compact()
    assert store.current()["number"] == 8 and read(store.latest()) == want
    put(store, 1, {"b": 99})  # a replay of what is compacted
    put(store, 2, {"a": 7})
    assert read(store.latest()) == want | {"a": 7}
    assert store.compact() and read(store.latest()) == want | {"a": 7}


def test_a_batch_that_is_not_whole_is_not_read(store, tmp_path):
    put(store, 0, {"a": 1})
    put(store, 1, {"a": 2})
    (tmp_path / "store/log/batch=1/_SUCCESS").unlink()
    assert read(store.latest()) == {"a": 1}
    assert store.compact() and store.current()["upto"] == 0
    put(store, 1, {"a": 2})
    assert read(store.latest()) == {"a": 2}


def test_only_the_first_of_two_compactions_counts(store):
    put(store, 0, {"a": 1})
    store.folder.write_new("current/00000001", '{"upto": -1, "buckets": {}}')
    held = store.folder.names
    store.folder.names = lambda name="": [] if name == "current" else held(name)  # as if it had begun before the other
    assert store.compact() is False
    store.folder.names = held
    assert read(store.latest()) == {"a": 1}


def test_lookup_reads_its_bucket_alone(store):
    for batch in range(3):
        put(store, batch, {k: batch for k in "abcdefgh"})
        if batch == 1:
            store.compact()
    files = store.lookup("a").inputFiles()
    bucket = store.spark.createDataFrame([("a",)], "id string").select(store.bucket()).first()[0]
    assert files and all(f"bucket={bucket}/" in f for f in files if "/base/" in f)
    plan = store.lookup("a")._jdf.queryExecution().executedPlan().toString()
    assert f"bucket#" in plan and "PartitionFilters" in plan
    assert len({f.split("/version=")[1].split("/")[0] for f in store.latest().inputFiles() if "/base/" in f}) == 1


def test_untouched_buckets_stay(store):
    """A compaction writes the buckets that the log touches and no others."""
    put(store, 0, {k: 0 for k in "abcdefgh"})
    store.compact()
    put(store, 1, {"a": 1})
    store.compact()
    assert sorted(store.current()["buckets"].values()).count(2) == 1
    assert read(store.latest()) == {k: int(k == "a") for k in "abcdefgh"}


def test_a_stream_into_the_store(store, spark, tmp_path):
    for part in range(5):
        spark.createDataFrame([(k, part * 10 + i, {"n": part * 10 + i}) for i, k in enumerate("abc")], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):
        query = source.writeStream.foreachBatch(store.writer(2)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    assert set(read(store.latest())) == set("abc") and store.current()["number"] >= 2
