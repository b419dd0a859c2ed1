"""Matching, whole invoices, layout edges, uploads, plug-ins and jobs in batch and stream."""

from __future__ import annotations

import random
import subprocess
import sys
from collections import defaultdict
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from docpipe.operators import layout
from docpipe.operators.matching import greedy_matches, matched_rows
from docpipe.operators.validate import invoice_totals
from docpipe.plans import catalog, invoice
from docpipe.plans.prompts import extraction_prompt
from docpipe.sources import plugins, uploads
from docpipe.streaming import jobs


def plain_greedy(scores):
    """Items in order take their best line; a taken one counts half a point less; the first of equals wins."""
    by = defaultdict(lambda: defaultdict(dict))
    for doc, item, line, score in scores:
        by[doc][item][line] = score
    out = {}
    for doc, items in by.items():
        used = set()
        for item in sorted(items):
            left = {line: s - 0.5 * (line in used) for line, s in items[item].items()}
            best = min(left, key=lambda x: (-left[x], x))
            out[doc, item] = best if left[best] > 0 else None
            used |= {best} if left[best] > 0 else set()
    return out


def test_greedy(spark):
    rng = random.Random(8)
    scores = [(d, i, k, rng.choice((-1.0, 0.0, 0.5, 1.0, 1.5, 2.0))) for d in range(12) for i in range(1, 6) for k in range(4)]
    got = greedy_matches(spark.createDataFrame(scores, "doc_id int, item_no int, line_idx int, score double"))
    assert {(r["doc_id"], r["item_no"]): r["line_idx"] for r in got.collect()} == plain_greedy(scores)


def test_greedy_query(spark, sf):
    scores = [tuple(r) for r in catalog.queries()["match_score"](spark, sf).collect()]
    got = {(r["doc_id"], r["item_no"]): r["line_idx"] for r in catalog.queries()["match_greedy"](spark, sf).collect()}
    assert got == plain_greedy(scores)


def test_unmatched_items_have_empty_rows(spark):
    items = spark.createDataFrame([(1, 1, "pear", "1", "5", "5", "5"), (2, 1, "fig", "1", "", "", "")], "doc_id int, item_no int, name string, quantity string, unit_price string, net string, gross string")
    lines = spark.createDataFrame([(1, 0, "pear 5,00"), (1, 1, "Total 5,00")], "doc_id int, line_idx int, line string")
    assert {r["doc_id"]: r["row_text"] for r in matched_rows(items, lines).collect()} == {1: "pear 5,00", 2: ""}


REMAPS = [
    # quantity, unit, net, gross, row, then what is expected: amounts and warnings
    (("1", "1580.00", "1580.00", "1580.00", "soap 1 1244,00 1244,00 27% 336,00 1580,00"), ("1244.00", "1244.00", "1580.00", ["remapped_prices_by_vat_rule"])),
    (("1", "1244.00", "1244.00", "1580.00", "soap 1 1244,00 1244,00 27% 336,00 1580,00"), ("1244.00", "1244.00", "1580.00", [])),
    (("1", "100.00", "100.00", "100.00", ""), ("100.00", "100.00", "100.00", [])),
    (("x", "1", "1", "1", "a 1,0 2,0 3,0"), ("1", "1", "1", ["invalid_numeric_values"])),
    (("1", "5.00", "20.00", "10.00", ""), ("5.00", "20.00", "10.00", ["gross_less_than_net", "unit_price_ne_net_when_qty_1"])),
    (("2", "10.00", "20.00", "60.00", "tea 2 10,00 20,00 27% 5,40 25,40"), ("20.00", "20.00", "25.40", ["remapped_prices_by_vat_rule"])),
]


def test_repairs(spark):
    rows = [("d", i, "n", *given[:4], "HUF", given[4]) for i, (given, _) in enumerate(REMAPS)]
    items = spark.createDataFrame(rows, "doc_id string, item_no int, name string, quantity string, unit_price string, net string, gross string, currency string, row_text string")
    got = {r["item_no"]: (r["unit_price"], r["net"], r["gross"], r["warnings"]) for r in invoice.repaired(items, "fixed").collect()}
    for i, (_, want) in enumerate(REMAPS):
        assert got[i] == want, REMAPS[i]


def test_process(spark):
    meta = '```json\n{"seller":{"name":"S Kft"},"buyer":{"name":"B"},"invoice_number":"7","issue_date":"15.01.2024","currency":""}\n```'
    items = '{"invoice_data":[{"name":"Soap","quantity":"1","unit_price":"1 580,00 Ft","net":"1580","gross":"1580,00","currency":"Ft"},{"name":"Tea","quantity":"1","unit_price":"10,00","net":"30,00","gross":"38,10"},"junk"]}'
    responses = spark.createDataFrame([("a", "metadata", meta), ("a", "items", items), ("b", "metadata", "{broken"), ("c", "full", None)], "doc_id string, kind string, response string")
    texts = spark.createDataFrame([("a", "Item qty\nSoap 1 1244,00 1244,00 27% 336,00 1580,00\nTea 3 10,00 30,00 38,10"), ("b", None)], "doc_id string, table_text string")
    got = {r["id"]: r for r in invoice.process(responses, texts, "fixed").collect()}
    a = got["a"]
    assert (a["seller"]["name"], a["invoice_number"], a["issue_date"], a["currency"], a["parse_error"]) == ("S Kft", "7", "2024-01-15", "HUF", False)
    assert [(i["name"], i["quantity"], i["unit_price"], i["net"], i["gross"]) for i in a["invoice_data"]] == [("Soap", "1", "1244.00", "1244.00", "1580.00"), ("Tea", "3", "10.00", "30.00", "38.10")]
    assert float(a["total_net"]) == 1274.0 and float(a["total_gross"]) == 1618.1
    for key in ("b", "c"):
        assert got[key]["parse_error"] and got[key]["invoice_data"] == [] and got[key]["currency"] == "HUF"


def test_process_query(spark, sf):
    rows = catalog.queries()["process_invoices"](spark, sf).collect()
    items = catalog.queries()["invoice_totals"](spark, sf).collect()
    by = {r["id"]: r for r in rows}
    assert len(by) == len(rows)
    assert all(by[r["doc_id"]]["n_items"] == r["n_items"] for r in items)


def test_totals_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id int, item_no int, name string, net string, gross string")
    assert invoice_totals(empty).count() == 0
    row = invoice_totals(spark.createDataFrame([(1, 1, None, None, None)], empty.schema)).first()
    assert (row["n_items"], float(row["total_net"]), row["warnings"]) == (1, 0.0, [])


WORDS = "doc_id string, page_no int, block_no int, line_no int, word_no int, value string, x double, y double, confidence double"


def test_anchor_does_not_drift(spark):
    words = spark.createDataFrame([("d", 0, 0, 0, i, f"w{i}", float(i), y, 0.5) for i, y in enumerate((1.0, 1.005, 1.01, 1.02))], WORDS)
    assert [r["anchored_line"] for r in layout.anchored_lines(words).orderBy("word_no").collect()] == [0, 0, 1, 2]
    assert layout.mean_confidence(words).first()["confidence"] == 50.0
    assert layout.column_split(words).first()["split_x"] is None
    assert layout.structured_text(words.limit(0)).count() == 0


def test_table_rows_with_few_rows_keep_all(spark):
    lines = spark.createDataFrame([("d", 0, "hello"), ("d", 1, "a 1,0 2,0 3,0"), ("e", 0, "pear 1,0 2,0 3,0"), ("e", 1, "in a box"), ("e", 2, "very nice"), ("e", 3, "net price"), ("e", 4, "1,0 2,0 3,0")], "doc_id string, line_no int, line string")
    got = {(r["doc_id"], r["line_no"]): r["line"] for r in layout.table_rows(lines).collect()}
    assert got == {("d", 0): "hello", ("d", 1): "a 1,0 2,0 3,0", ("e", 0): "pear 1,0 2,0 3,0 in a box very nice", ("e", 3): "net price"}


def test_uploads(spark, tmp_path):
    for name, data in (("a.pdf", b"one\ftwo"), ("B.PDF", b"x" * 50), ("c.txt", b"no")):
        (tmp_path / name).write_bytes(data)
    taken = uploads.read_uploads(spark, str(tmp_path), 20)
    assert [r["path"].rpartition("/")[2] for r in taken.collect()] == ["a.pdf"]
    assert {r["path"].rpartition("/")[2]: r["reason"] for r in uploads.rejected_uploads(spark, str(tmp_path), 20).collect()} == {"B.PDF": "too large", "c.txt": "not a pdf"}
    stream = uploads.stream_uploads(spark, str(tmp_path), 20).select("path", "length").writeStream.format("memory").queryName("uploads").trigger(availableNow=True).start()
    assert stream.awaitTermination(60)
    assert spark.table("uploads").count() == 1
    words = plugins.recognized_words(plugins.page_images(taken, plugins.TextPages), plugins.TextWords)
    assert sorted((r["page_no"], r["value"]) for r in words.collect()) == [(0, "one"), (1, "two")]


class Broken:
    def pages(self, content, dpi):
        yield b"good"
        raise ValueError("torn page")

    def words(self, image):
        raise RuntimeError("no model")

    def complete(self, prompt, image=None):
        raise TimeoutError("slow")


def test_failures_are_rows(spark):
    files = spark.createDataFrame([("f", bytearray(b"x"))], "path string, content binary")
    pages = plugins.page_images(files, Broken)
    assert [(r["page_no"], r["error"]) for r in pages.orderBy("page_no").collect()] == [(0, None), (1, "ValueError: torn page")]
    assert [r["error"] for r in plugins.recognized_words(pages, Broken).collect()] == ["RuntimeError: no model"]
    prompts = spark.createDataFrame([("f", "text")], "doc_id string, t string").select("doc_id", F.lit("full").alias("kind"), extraction_prompt(F.col("t")).alias("prompt"))
    assert [r["error"] for r in plugins.completions(prompts, Broken).collect()] == ["TimeoutError: slow"]
    assert plugins.model_ready("gemma2:9b", ["gemma2:latest"]) and not plugins.model_ready("x", [])


def job_events(n: int, seed: int) -> list[tuple]:
    rng, start = random.Random(seed), datetime(2024, 1, 1)
    actions = ("create", "update", "update", "update", "complete", "error", "cancel", "other")
    return [(f"j{rng.randint(0, 9)}", start + timedelta(seconds=i), i, rng.choice(actions[:4] if i < n // 2 else actions), rng.choice((*jobs.STAGES, None)), rng.randint(-20, 140), rng.choice((None, "m"))) for i in range(n)]


def test_stream_equals_batch(spark, tmp_path):
    rows = job_events(200, 3)
    df = spark.createDataFrame(rows, jobs.EVENT)
    want = {r["job_id"]: tuple(r) for r in jobs.job_states(df).collect()}
    for part in range(2):
        df.where(F.floor(F.col("seq") / 100) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = jobs.streaming_states(spark.readStream.schema(jobs.EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events")))
    query = stream.writeStream.outputMode("update").format("memory").queryName("states").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    last = {}
    for r in spark.table("states").collect():
        if r["job_id"] not in last or r["n_events"] > last[r["job_id"]]["n_events"]:
            last[r["job_id"]] = r
    for job, state in want.items():
        if state[1] is not None:
            assert tuple(last[job])[:5] == state[:5], job


def test_transition_equals_columns():
    held = None
    for action, want in (("update", None), ("create", "started"), ("update", "processing"), ("cancel", "cancelled"), ("update", "cancelled"), ("complete", "cancelled")):
        held = jobs.transition(held, action, "ocr", 150, None)
        assert held[0] == want
    assert held[1] == 100 and pd.notna(held[4])


def test_retention(spark):
    df = spark.createDataFrame([("a", datetime(2024, 1, 1, 10)), ("b", datetime(2024, 1, 1, 11, 30))], "job_id string, updated_at timestamp")
    assert [r["job_id"] for r in jobs.retained(df, F.lit("2024-01-01 12:00:00").cast("timestamp")).collect()] == ["b"]


def test_entry_point_without_the_optional_parts():
    """The queries outside the optional subpackage are there even where that and the pipeline can't be imported."""
    code = "import sys; sys.modules['docpipe.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'invoice_totals' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_job_states_like_a_fold(spark):
    """Random events, jobs without a creation, created twice, ended and gone on with: as one event after another."""
    rng, rows = random.Random(31), []
    for job in range(120):
        for seq in range(rng.randint(1, 12)):
            action = rng.choice(("create", "update", "update", "update", "complete", "error", "cancel"))
            rows.append((f"j{job}", datetime(2024, 1, 1, 0, rng.randint(0, 3)), seq, action, rng.choice((None, "ocr", "llm", "vision")), rng.choice((None, -5, 0, 40, 170)), rng.choice((None, None, "hello", "bye"))))
    got = {r["job_id"]: tuple(r)[1:] for r in jobs.job_states(spark.createDataFrame(rows, jobs.EVENT)).collect()}
    want: dict = {}
    for row in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        want[row[0]] = jobs.transition(want.get(row[0]), *row[3:])
    assert got == want
