"""The line scan over batches: any batch borders, odd values, very long pages."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docpipe.operators import layout

WORDS = "doc_id string, page_no int, block_no int, line_no int, word_no int, value string, x double, y double, confidence double"


def folded(ys: list[float | None], tolerance: float) -> list[int]:
    out, anchor, line = [], None, -1
    for y in ys:
        if y is None or anchor is None or not abs(y - anchor) < tolerance:
            anchor, line = y, line + 1
        out.append(line)
    return out


def a_page(rng: random.Random, doc: str | None, page: int, n: int) -> list[tuple]:
    number = lambda top: rng.choice([None, *[rng.randrange(top) / 1000] * 20])
    return [(doc, page, 0, i // 5, i, rng.choice(["a", "bb", None, "c c"]), number(200), number(60), 0.5) for i in range(n)]


def test_lines_like_a_fold(spark):
    """Pages of all sizes, null documents, places and values; batches of a few rows and of many."""
    rng = random.Random(1)
    rows = [w for d in (None, "a", "b") for p in range(6) for w in a_page(rng, d, p, rng.choice([1, 2, 30, 200]))]
    words = spark.createDataFrame(rows, WORDS).repartition(4)
    low = lambda v: (v is not None, v or 0)
    pages: dict = {}
    for r in sorted(rows, key=lambda r: (low(r[7]), low(r[6]), *r[2:5])):
        pages.setdefault(r[:2], []).append(r)
    want_lines, want_texts = {}, {}
    for page, held in pages.items():
        texts: dict = {}
        for r, line in zip(held, folded([r[7] for r in held], layout.LINE_TOLERANCE), strict=True):
            want_lines[(*page, r[4])] = line
            texts.setdefault(line, []).append(r)
        for line, line_words in texts.items():
            parts, before = [], None
            for r in sorted(line_words, key=lambda r: (low(r[6]), *r[2:5])):
                gap = before is not None and r[6] is not None and r[6] - before > layout.WORD_GAP
                parts += [] if r[5] is None else ["  " * gap + r[5]]
                before = r[6]
            want_texts[(*page, line)] = " ".join(parts)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most in ("3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            anchored = layout.anchored_lines(words)
            assert {(r["doc_id"], r["page_no"], r["word_no"]): r["anchored_line"] for r in anchored.collect()} == want_lines
            assert {tuple(r)[:3]: r["text"] for r in layout.spaced_lines(words).collect()} == want_texts
            assert {tuple(r)[:3]: r["text"] for r in layout.gap_spaced_lines(anchored).collect()} == want_texts
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert layout.anchored_lines(words.limit(0)).count() == 0 and layout.spaced_lines(words.limit(0)).count() == 0


def test_fold_carries_the_anchor_only():
    """Batch borders change nothing, and what the fold holds does not grow with the page."""
    ys = np.sort(np.random.default_rng(3).random(5000)).tolist()
    fold = layout.Anchors(("k",), 0.008)
    got = []
    for at in range(0, len(ys), 7):
        part = ys[at : at + 7]
        got += fold.lines(pa.RecordBatch.from_arrays([pa.array(["p"] * len(part)), pa.array(part)], ["k", "y"]))
        assert set(vars(fold)) == {"keys", "tolerance", "last", "anchor", "line"}
    assert got == folded(ys, 0.008)


def test_a_page_of_a_million_words(spark):
    n = 1_000_000
    words = spark.range(n).select(F.lit("d").alias("doc_id"), F.lit(0).alias("page_no"), F.lit(0).alias("block_no"), F.lit(0).alias("line_no"), F.col("id").cast("int").alias("word_no"), F.lit("w").alias("value"), (F.col("id") % 10 / 100).alias("x"), (F.floor(F.col("id") / 10) / 100).alias("y"), F.lit(1.0).alias("confidence"))
    row = layout.spaced_lines(words).agg(F.count("*").alias("n"), F.max("anchored_line").alias("last"), F.countDistinct("text").alias("texts"), F.max("text").alias("text")).first()
    assert (row["n"], row["last"], row["texts"], row["text"]) == (n // 10, n // 10 - 1, 1, " ".join("w" * 10))


def test_lines_of_a_batch_at_once():
    """Places that are all there need no look at single words, and texts are as word by word."""
    rng = random.Random(4)
    rows = [(rng.randrange(300) / 1000, 0, rng.randrange(3), rng.randrange(50), rng.choice(["a", "bb", ""])) for _ in range(2000)]
    starts = np.array([0, *sorted(rng.sample(range(1, 2000), 300))])
    words = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["x", "block_no", "line_no", "word_no", "value"])
    want = [layout.spaced_text(rows[a:b]) for a, b in zip(starts, [*starts[1:], 2000], strict=True)]
    alone, layout.spaced_text = layout.spaced_text, None
    try:
        assert layout.line_texts(words, starts).to_pylist() == want
    finally:
        layout.spaced_text = alone


def test_columns_by_counts(spark):
    """What is shuffled to find a split is the number of words at each x; words without an x, at one x and at none count."""
    rows = [(d, x) for d, xs in {"a": [0.1] * 6 + [0.6] * 6, "b": [None] * 3 + [0.1] * 4 + [0.5] * 4, "c": [0.2] * 12, "d": [0.1, 0.9], "e": [None] * 11}.items() for x in xs]
    words = spark.createDataFrame(rows, "doc_id string, x double").withColumns({"page_no": F.lit(0), "block_no": F.lit(0), "line_no": F.lit(0), "word_no": F.monotonically_increasing_id()})
    split = layout.column_split(words)
    assert {r["doc_id"]: (r["n_words"], r["split_x"]) for r in split.collect()} == {"a": (12, 0.35), "b": (11, 0.3), "c": (12, None), "d": (2, None), "e": (11, None)}
    assert "word_no" not in split._jdf.queryExecution().optimizedPlan().toString().split("Window")[-1].split("Aggregate")[0]


def test_table_rows_count_prices_once(spark):
    """Prices of a line are found once, headers and continuing lines as before."""
    lines = ["Item quantity unit net gross", "pear 1,00 2,00 3,00 net", "deluxe edition", "in blue box", "Total", "1,00 2,00 3,00", "net 1,00 2,00", "ear 4.00 5.00 6.00", "", "sum of it", None, "ab 1,00 2,00 3,00 4,00"]
    rows = layout.table_rows(spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], "doc_id string, line_no int, line string"))
    got = [(r["line_no"], r["line"]) for r in rows.orderBy("line_no").collect()]
    assert got == [(0, lines[0]), (1, "pear 1,00 2,00 3,00 net deluxe edition in blue box"), (6, lines[6]), (7, lines[7])]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
