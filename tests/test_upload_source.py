"""The data source of uploads: planning, pruning, refusals, failures, and the stream."""

from __future__ import annotations

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docpipe.sources import upload_source as u

READER = "docpipe.sources.plugins:TextPages"


class Torn:
    """Gives two pages, then fails; has no count."""

    def pages(self, content, dpi):
        if content == b"bad":
            raise ValueError("not to be read")
        yield from (b"one", b"two")
        raise ValueError("torn page")


class Forbidden:
    def __init__(self):
        raise AssertionError("no content was asked for")


@pytest.fixture
def folder(spark, tmp_path):
    spark.dataSource.register(u.UploadPages)
    (tmp_path / "deep").mkdir()
    for i, (name, data) in enumerate({"a.pdf": b"one\ftwo", "deep/B.PDF": b"\f".join(b"page %d " % i * 30 for i in range(100)), "c.txt": b"no", "big.pdf": b"x" * 60_000, "empty.pdf": b"", ".hidden.pdf": b"x", "_SUCCESS": b""}.items()):
        (tmp_path / name).write_bytes(data)
        os.utime(tmp_path / name, (1_700_000_000 + i, 1_700_000_000 + i))
    return tmp_path


def load(spark, folder, **options):
    held = spark.read.format("uploads").option("reader", READER).option("maxBytes", 50_000)
    for k, v in options.items():
        held = held.schema(v) if k == "schema" else held.option(k, v)
    return held.load(str(folder))


def name(r) -> str:
    return r["path"].rpartition("/")[2]


def test_pages_and_refusals(spark, folder):
    rows = load(spark, folder, splitBytes=4000).collect()
    pages = {(name(r), r["page_no"]): bytes(r["image"]) for r in rows if r["image"] is not None}
    assert {name(r): r["reason"] for r in rows if r["reason"]} == {"c.txt": "not a pdf", "big.pdf": "too large"}
    assert Counter(k[0] for k in pages) == {"a.pdf": 2, "B.PDF": 100, "empty.pdf": 1}
    assert pages["a.pdf", 1] == b"two" and pages["B.PDF", 57] == b"page 57 " * 30 and pages["empty.pdf", 0] == b""
    assert all(r["error"] is None for r in rows) and {name(r): r["length"] for r in rows}["big.pdf"] == 60_000
    assert load(spark, folder, splitBytes=4000).rdd.getNumPartitions() >= 6
    assert load(spark, folder).rdd.getNumPartitions() == 1


def test_partitions_are_of_bytes():
    files = [u.Upload(f"{i}.pdf", size, i) for i, size in enumerate((10, 4000, 4000, 25_000, 10, 3000))] + [u.Upload("x.txt", 10**9, 9, "not a pdf")]
    plan = u.planned(files, 8192, True)
    assert [(p.part, p.parts) for p in plan if p.files[0].path == "3.pdf"] == [(i, 4) for i in range(4)]
    assert Counter(f.path for p in plan for f in p.files) == {"3.pdf": 4, **{f.path: 1 for f in files if f.path != "3.pdf"}}
    assert all(sum(f.length for f in p.files if not f.reason) <= 8192 for p in plan if p.parts == 1)
    assert len(u.planned(files, 8192, False)) == 1


def test_columns_that_are_not_asked_for_cost_nothing(spark, folder):
    """Names and sizes need no reader at all."""
    rows = spark.read.format("uploads").schema("path string, length long, reason string").option("reader", f"{__name__}:Forbidden").option("maxBytes", 50_000).load(str(folder)).collect()
    assert {name(r): (r["length"], r["reason"]) for r in rows} == {"a.pdf": (7, None), "B.PDF": (len(b"\f".join(b"page %d " % i * 30 for i in range(100))), None), "c.txt": (2, "not a pdf"), "big.pdf": (60_000, "too large"), "empty.pdf": (0, None)}


def test_first_pages_alone(spark, folder):
    rows = load(spark, folder, pages=1, splitBytes=4000, schema="path string, page_no int").where("page_no is not null").collect()
    assert {(name(r), r["page_no"]) for r in rows} == {("a.pdf", 0), ("B.PDF", 0), ("empty.pdf", 0)} and len(rows) == 3


def test_failures_are_rows(spark, folder):
    (folder / "bad.pdf").write_bytes(b"bad")
    rows = load(spark, folder, reader=f"{__name__}:Torn").where("reason is null").collect()
    got = {(name(r), r["page_no"]): (r["image"] and bytes(r["image"]), r["error"]) for r in rows}
    assert got["a.pdf", 1] == (b"two", None) and got["a.pdf", 2] == (None, "ValueError: torn page") and got["bad.pdf", 0] == (None, "ValueError: not to be read")
    parts = load(spark, folder, reader=f"{__name__}:Torn", splitBytes=4000).where("path like '%B.PDF'").collect()
    assert [(r["page_no"], r["error"]) for r in parts] == [(0, "ValueError: torn page")]


def test_wrong_options(spark, folder):
    for held in (spark.read.format("uploads").load(str(folder)), load(spark, folder, schema="path string, nothing int")):
        with pytest.raises(Exception, match="reader has to name|no columns"):
            held.collect()


def test_no_files(spark, tmp_path):
    spark.dataSource.register(u.UploadPages)
    assert load(spark, tmp_path).count() == 0


def test_stream(spark, folder, tmp_path_factory):
    """New files are read once each, over a restart too."""
    out = tmp_path_factory.mktemp("stream")

    def run():
        pages = spark.readStream.format("uploads").option("reader", READER).option("maxBytes", 50_000).option("splitBytes", 4000).load(str(folder))
        query = pages.select("path", "page_no", "reason").writeStream.format("parquet").option("path", str(out / "rows")).option("checkpointLocation", str(out / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(60)
        return Counter((name(r), r["page_no"]) for r in spark.read.schema("path string, page_no int, reason string").parquet(str(out / "rows")).collect())

    first = run()
    assert first["B.PDF", 99] == 1 and first["c.txt", None] == 1 and sum(first.values()) == 105
    (folder / "new.pdf").write_bytes(b"a\fb\fc")
    later = run()
    assert later - first == Counter({("new.pdf", i): 1 for i in range(3)}) and not first - later


def test_tasks_are_bounded(spark, tmp_path):
    """However many shares the files have, a scan has no more tasks than asked for, and every page is read once."""
    for i in range(30):
        (tmp_path / f"{i}.pdf").write_bytes(b"\f".join(f"{i} {j} ".encode() * 20 for j in range(10)))
    pages = u.planned(u._Scan({"path": str(tmp_path), "reader": "docpipe.sources.plugins:TextPages"}, spark.range(1).selectExpr("1 as page_no").schema).listed(), 500, True)
    for most in (1, 7, 1000):
        dealt = u.shares(pages, most)
        assert len(dealt) == min(most, len(pages)) and [p for s in dealt for p in s.pages] == pages
    assert u.shares([], 5) == [] and u.MOST_TASKS == 1000
    spark.dataSource.register(u.UploadPages)
    read = spark.read.format("uploads").option("reader", "docpipe.sources.plugins:TextPages").option("splitBytes", 500).option("tasks", 6).load(str(tmp_path))
    assert read.rdd.getNumPartitions() == 6 < len(pages)
    assert sorted((r["path"].rpartition("/")[2], r["page_no"], bytes(r["image"])) for r in read.collect()) == sorted((f"{i}.pdf", j, f"{i} {j} ".encode() * 20) for i in range(30) for j in range(10))
