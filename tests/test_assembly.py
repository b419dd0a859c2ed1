"""Documents from streams of pages, and jobs that are cancelled while they work."""

from __future__ import annotations

import random
import threading
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docpipe.operators import layout
from docpipe.streaming import assembly, cancel, feed, jobs

START = datetime(2024, 1, 1)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
RESULT = "doc_id string, event string, n_pages int, missing array<int>, page_no int, text string"


@pytest.fixture
def rocks(spark):
    held = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, feed.ROCKS)
    yield
    spark.conf.set(PROVIDER, held)


def put(spark, tmp_path, rows):
    spark.createDataFrame(rows, assembly.PAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))


def run(spark, tmp_path, **how):
    source = spark.readStream.schema(assembly.PAGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "pages"))
    query = assembly.assembled(source, **how).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return spark.read.schema(RESULT).parquet(str(tmp_path / "out")).collect()


def test_pages_in_any_order_like_the_table(spark, rocks, tmp_path):
    """Shuffled and repeated pages over several files and a restart; blank and null pages."""
    rng = random.Random(2)
    rows = [(f"d{d}", p, n, rng.choice([f"page {p} of {d}", " \n", None, "x"]), START + timedelta(seconds=d)) for d, n in enumerate(rng.choices(range(1, 8), k=25)) for p in range(n)]
    mixed = [*rows, *rows[::4]]
    rng.shuffle(mixed)
    for i in range(2):
        put(spark, tmp_path, mixed[i::4])
    run(spark, tmp_path, late="1 hour")
    for i in range(2, 4):
        put(spark, tmp_path, mixed[i::4])
    got = run(spark, tmp_path, late="1 hour")
    assert {r["event"] for r in got} == {"complete"} and len(got) == 25 and all(r["missing"] == [] for r in got)
    want = {r["doc_id"]: r["text"] for r in layout.document_text(spark.createDataFrame(rows, assembly.PAGES), "text").collect()}
    assert {r["doc_id"]: r["text"] for r in got if r["text"]} == want


def test_deadlines_and_late_pages(spark, rocks, tmp_path):
    """What is there at the deadline is sent, with what is missing; a page after it comes alone; repeats of pages never do."""
    at = lambda s: START + timedelta(seconds=s)
    put(spark, tmp_path, [("a", 2, 3, "third", at(0)), ("a", 0, None, "first", at(1)), ("b", 0, 1, "only", at(1))])
    put(spark, tmp_path, [("x", 0, 9, "", at(100))])
    put(spark, tmp_path, [("y", 0, 9, "", at(101)), ("a", 1, 3, "second", at(2)), ("a", 0, 3, "first again", at(3)), ("b", 0, 1, "only", at(2))])
    put(spark, tmp_path, [("z", 0, 9, "", at(102))])
    got = sorted((r["doc_id"], r["event"], r["n_pages"], r["missing"], r["page_no"], r["text"]) for r in run(spark, tmp_path, late="5 seconds", wait_seconds=30) if r["doc_id"] in "ab")
    assert got == [("a", "late", 3, [], 1, "second"), ("a", "partial", 3, [1], None, "first\n\nthird"), ("b", "complete", 1, [], None, "only")]


def slow(batches):
    for batch in batches:
        time.sleep(0.3)
        yield batch


def stages(reached: list):
    def first(df):
        reached.append(1)
        return df.withColumn("a", F.col("id") + 1)

    def second(df):
        reached.append(2)
        return df.repartition(2).mapInArrow(slow, df.schema)

    def third(df):
        reached.append(3)
        return df

    return [("ocr", first), ("llm", second), ("postprocess", third)]


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(name)
    spark.conf.set(name, "10")
    yield
    spark.conf.set(name, held)


def test_cancel_in_the_midst_of_a_stage(spark, tmp_path, small_batches):
    """The job stops long before it would be done and leaves nothing; another one, at work meanwhile, is not disturbed."""
    wishes, reached, ends = cancel.Wishes(spark, f"file://{tmp_path}/wishes"), [], {}

    def other():
        ends["other"] = cancel.run_stages(spark.range(40), stages([]), f"file://{tmp_path}/other", "other", wishes)

    def wish():
        while 2 not in reached:
            time.sleep(0.05)
        time.sleep(1)
        assert wishes.cancel("job") and not wishes.cancel("job")

    threads = [threading.Thread(target=other), threading.Thread(target=wish)]
    for t in threads:
        t.start()
    began = time.perf_counter()
    with pytest.raises(cancel.Cancelled) as raised:
        cancel.run_stages(spark.range(2000), stages(reached), f"file://{tmp_path}/job", "job", wishes)
    assert time.perf_counter() - began < 20 and reached == [1, 2]
    for t in threads:
        t.join()
    assert not (tmp_path / "job" / "result").exists() and not (tmp_path / "job" / "stages").exists()
    state = jobs.job_states(raised.value.args[1]).first()
    assert (state["status"], state["progress"], state["stage"], state["message"]) == ("cancelled", 33, "llm", "Processing cancelled by user")
    assert jobs.job_states(ends["other"]).first()["status"] == "completed"
    assert spark.read.parquet(str(tmp_path / "other/result")).count() == 40 and not (tmp_path / "other/stages").exists()


def test_cancel_before_and_between_stages(spark, tmp_path):
    wishes, reached = cancel.Wishes(spark, f"file://{tmp_path}/wishes"), []
    wishes.cancel("early")
    with pytest.raises(cancel.Cancelled):
        cancel.run_stages(spark.range(5), stages(reached), f"file://{tmp_path}/early", "early", wishes)
    assert reached == []
    wishes.withdraw("early")
    cancel.run_stages(spark.range(5), stages(reached), f"file://{tmp_path}/early", "early", wishes)
    assert reached == [1, 2, 3] and spark.read.parquet(str(tmp_path / "early/result")).count() == 5


def test_tasks_stop_at_batch_borders(spark, tmp_path, small_batches):
    """Without anybody on the driver to cancel it."""
    wishes = cancel.Wishes(spark, f"file://{tmp_path}/wishes")
    rows = wishes.at_borders(spark.range(200), "job", seconds=0)
    assert rows.count() == 200
    wishes.cancel("job")
    with pytest.raises(Exception, match="Cancelled"):
        rows.collect()


def test_failures_are_not_cancellations(spark, tmp_path):
    def broken(df):
        return df.select(F.raise_error(F.lit("broken")).alias("x"))

    with pytest.raises(Exception, match="broken") as raised:
        cancel.run_stages(spark.range(5), [("ocr", broken)], f"file://{tmp_path}/bad", "bad", cancel.Wishes(spark, f"file://{tmp_path}/wishes"))
    assert not isinstance(raised.value, cancel.Cancelled) and not (tmp_path / "bad" / "stages").exists()
