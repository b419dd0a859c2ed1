"""Layout of recognised words: lines, gaps, columns, table rows.

Words are rows of doc_id, page_no, block_no, line_no, word_no, value, x, y, confidence. Everything is keyed by document
and page, so one shuffle serves a whole page. Lines are found in a scan over sorted words, so no page has to fit in memory
before its text is put together.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docpipe.functions.text import clean_text, fold_accents, strip

LINE_TOLERANCE, COLUMN_LINE_TOLERANCE = 0.008, 0.015
WORD_GAP, COLUMN_GAP = 0.03, 0.15
PAGE = ("doc_id", "page_no")
PRICE = r"(\d+[.,]\d+)"
WORD = r"([a-zA-ZáéíóöőúüűÁÉÍÓÖŐÚÜŰ]{3,})"
# Words of lines that continue no name, and of table headers.
NO_CONTINUATION = r"(?iu)total|nettó|bruttó|áfa|összesen|sum|subtotal|pozíció|leírás"
TABLE_HEADER = r"(?iu)pozíció|leírás|mennyiség|egységár|nettó|bruttó|quantity|unit|net|gross"


def plain_text(words: DataFrame) -> DataFrame:
    """doc_id, page_no, text: words in the recogniser's own order, a line for each of its lines, folded.

    Words are dealt by page once; lines and pages are both gathered where they lie.
    """
    lines = words.repartition(*PAGE).groupBy(*PAGE, "block_no", "line_no").agg(F.array_sort(F.collect_list(F.struct("word_no", "value"))).alias("w"))
    lines = lines.select(*PAGE, "block_no", "line_no", F.array_join("w.value", " ").alias("line")).where(strip(F.col("line")) != "")
    pages = lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("block_no", "line_no", "line"))).alias("l"))
    return pages.select(*PAGE, fold_accents(F.array_join("l.line", "\n")).alias("text"))


def in_order(words: DataFrame, keys: tuple[str, ...], rest: tuple[str, ...] = ("confidence",)) -> DataFrame:
    """Words dealt by page and sorted by (y, x, place) within it: a page is a stretch of rows of one task, spilled where it must be."""
    place = ("y", "x", "block_no", "line_no", "word_no", "value", *rest)
    return words.select(*keys, *place).repartition(*keys).sortWithinPartitions(*keys, *place)


def page_starts(batch: pa.RecordBatch, keys: tuple[str, ...], last: tuple | None) -> np.ndarray:
    """Which rows of a batch begin a page; last: the keys of the row before it. Null keys are equal to each other."""
    new = np.zeros(batch.num_rows, bool)
    for key in keys:
        column = batch.column(key)
        here, before = column[1:], column[:-1]
        differs = pc.coalesce(pc.not_equal(here, before), pc.xor(pc.is_null(here), pc.is_null(before)))
        new[1:] |= differs.to_numpy(zero_copy_only=False)
    new[0] = last is None or last != tuple(batch.column(key)[0].as_py() for key in keys)
    return new


class Anchors:
    """The fold that numbers lines: it holds the line that is open, its number and its first word's y, and nothing of the page."""

    def __init__(self, keys: tuple[str, ...], tolerance: float):
        self.keys, self.tolerance = keys, tolerance
        self.last: tuple | None = None
        self.anchor: float | None = None
        self.line = -1

    def lines(self, batch: pa.RecordBatch) -> list[int]:
        """The line of each word of the next batch."""
        out = []
        anchor, line, tolerance = self.anchor, self.line, self.tolerance
        for y, first in zip(batch.column("y").to_pylist(), page_starts(batch, self.keys, self.last).tolist(), strict=True):
            if first:
                anchor, line = y, 0
            elif y is None or anchor is None or not abs(y - anchor) < tolerance:
                anchor, line = y, line + 1
            out.append(line)
        self.anchor, self.line = anchor, line
        self.last = tuple(batch.column(key)[batch.num_rows - 1].as_py() for key in self.keys)
        return out


def anchored_lines(words: DataFrame, keys: tuple[str, ...] = PAGE, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """`words` of a page with anchored_line: a word joins the line while its y is less than `tolerance` from the line's first word.

    The anchor does not move with the words, so this is a fold over the page in (y, x, place) order, not a comparison of
    neighbours. Words go by in Arrow batches; what is carried from one to the next is the anchor. Words without a y are lines
    of their own, before the others.
    """
    dealt = in_order(words, keys)
    schema = T.StructType([*(dealt.schema[k] for k in keys), T.StructField("anchored_line", T.IntegerType()), *(f for f in dealt.schema if f.name not in keys)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Anchors(keys, tolerance)
        for batch in batches:
            if batch.num_rows:
                lines = pa.array(fold.lines(batch), pa.int32())
                yield pa.RecordBatch.from_arrays([lines if f.name == "anchored_line" else batch.column(f.name) for f in schema], [f.name for f in schema])

    return dealt.mapInArrow(run, schema)


def spaced_text(words: list[tuple]) -> str:
    """Words (x, block_no, line_no, word_no, value) of a line by x, with three spaces where their left edges lie over WORD_GAP
    apart, else one. Words without an x come first, without a gap; null values are left out."""
    words.sort(key=lambda w: tuple((v is not None, v != v, v) if v == v else (True, True, 0) for v in w[:4]))
    parts, before = [], None
    for x, _, _, _, value in words:
        if value is not None:
            parts.append("  " + value if x is not None and before is not None and x - before > WORD_GAP else value)
        before = x
    return " ".join(parts)


def line_texts(words: pa.RecordBatch, starts: np.ndarray) -> pa.Array:
    """spaced_text of each line of words, whose first rows are given, all lines at once; one by one only where something is
    null or no number."""
    columns = [words.column(c) for c in ("x", "block_no", "line_no", "word_no", "value")]
    *places, values = columns
    bounds = np.append(starts, words.num_rows)
    if any(c.null_count for c in columns) or np.isnan(places[0].to_numpy()).any():
        rows = list(zip(*(c.to_pylist() for c in columns), strict=True))
        return pa.array([spaced_text(rows[a:b]) for a, b in pairwise(bounds.tolist())], pa.string())
    x, block, line, word = (c.to_numpy() for c in places)
    order = np.lexsort((word, line, block, x, np.repeat(np.arange(len(starts)), np.diff(bounds))))
    left = x[order].astype(np.float64)
    far = np.append(False, left[1:] - left[:-1] > WORD_GAP)
    far[starts] = False
    sorted_values = values.take(pa.array(order))
    parts = pc.if_else(pa.array(far), pc.binary_join_element_wise("  ", sorted_values, ""), sorted_values)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), parts), " ")


def spaced_lines(words: DataFrame, keys: tuple[str, ...] = PAGE, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """keys, anchored_line, text of every line: anchored_lines and gap_spaced_lines in one scan, which holds a batch and the
    words of the line that is open. The lines of a batch are put together at once."""
    dealt = in_order(words, keys, ())
    schema = T.StructType([*(dealt.schema[k] for k in keys), T.StructField("anchored_line", T.IntegerType()), T.StructField("text", T.StringType())])
    named = [*keys, "anchored_line", "x", "block_no", "line_no", "word_no", "value"]

    def made(parts: list[pa.RecordBatch], starts: np.ndarray) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]
        first = whole.select(named[: len(keys) + 1]).take(pa.array(starts))
        return pa.RecordBatch.from_arrays([*first.columns, line_texts(whole, starts)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, held = Anchors(keys, tolerance), []
        for batch in batches:
            if not batch.num_rows:
                continue
            open_line, starts = fold.line, page_starts(batch, keys, fold.last)
            lines = pa.array(fold.lines(batch), pa.int32())
            begins = np.flatnonzero(starts | (np.diff(lines.to_numpy(), prepend=open_line) != 0))
            words = pa.RecordBatch.from_arrays([lines if c == "anchored_line" else batch.column(c) for c in named], named)
            if not len(begins):
                held.append(words)
                continue
            first, last = int(begins[0]), int(begins[-1])
            if held:
                yield made([*held, words.slice(0, first)], np.zeros(1, np.int64))
            if last > first:
                yield made([words.slice(first, last - first)], begins[:-1] - first)
            held = [words.slice(last)]
        if held:
            yield made(held, np.zeros(1, np.int64))

    return dealt.mapInArrow(run, schema)


def gap_spaced_lines(words: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """keys, anchored_line, text: words by x, with three spaces where their left edges lie over WORD_GAP apart, else one."""
    line = Window.partitionBy(*keys, "anchored_line").orderBy("x", "block_no", "line_no", "word_no")
    gap = F.col("x") - F.lag("x").over(line)
    parts = words.select(*keys, "anchored_line", F.row_number().over(line).alias("at"), F.when(gap > WORD_GAP, F.concat(F.lit("  "), "value")).otherwise(F.col("value")).alias("part"))
    joined = parts.groupBy(*keys, "anchored_line").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("p"))
    return joined.select(*keys, "anchored_line", F.array_join("p.part", " ").alias("text"))


def structured_text(words: DataFrame) -> DataFrame:
    """doc_id, page_no, text: lines rebuilt from the words' places, folded; cleaned in `cleaned`."""
    lines = spaced_lines(words).where(strip(F.col("text")) != "")
    pages = lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("anchored_line", "text"))).alias("l"))
    text = fold_accents(F.array_join("l.text", "\n"))
    return pages.select(*PAGE, text.alias("text"), clean_text(text).alias("cleaned"))


def document_text(pages: DataFrame, column: str = "cleaned") -> DataFrame:
    """doc_id, text: pages in order with an empty line between, blank pages dropped."""
    docs = pages.where(strip(F.col(column)) != "").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", F.col(column).alias("t")))).alias("p"))
    return docs.select("doc_id", F.array_join("p.t", "\n\n").alias("text"))


def column_split(words: DataFrame) -> DataFrame:
    """doc_id, n_words, split_x: where a document's words fall into two columns; null with fewer than ten words or no gap over COLUMN_GAP.

    The largest gap between neighbouring x in the middle half decides, the first of equals. Only the numbers of words at each
    x are shuffled: a gap lies after the last of the words at an x.
    """
    counted = words.groupBy("doc_id", "x").agg(F.count("*").alias("k"))
    by_x = Window.partitionBy("doc_id").orderBy("x")
    last = F.sum("k").over(by_x.rowsBetween(Window.unboundedPreceding, 0)) - 1
    placed = counted.select("doc_id", "x", "k", last.alias("at"), F.lead("x").over(by_x).alias("next_x"), F.sum("k").over(Window.partitionBy("doc_id")).alias("n"))
    quarter, three = F.floor(F.col("n") / 4), F.floor(3 * F.col("n") / 4)
    inner = (F.col("at") >= quarter) & (F.col("at") < three) & F.col("next_x").isNotNull() & (F.col("next_x") > F.col("x"))
    gap = F.when(inner, F.struct((F.col("next_x") - F.col("x")).alias("gap"), (-F.col("at")).alias("place"), ((F.col("x") + F.col("next_x")) / 2).alias("middle")))
    best = placed.groupBy("doc_id").agg(F.sum("k").alias("n_words"), F.max(gap).alias("best"))
    return best.select("doc_id", "n_words", F.when((F.col("n_words") >= 10) & (F.col("best.gap") > COLUMN_GAP), F.col("best.middle")).alias("split_x"))


def two_column_text(words: DataFrame) -> DataFrame:
    """doc_id, page_no, text of documents that have two columns: the left one's lines, then the right one's, under headings."""
    sided = words.join(column_split(words).where("split_x is not null"), "doc_id").withColumn("side", F.when(F.col("x") < F.col("split_x"), 0).otherwise(1))
    keys = (*PAGE, "side")
    lines = spaced_lines(sided, keys, COLUMN_LINE_TOLERANCE)
    sides = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("anchored_line", "text"))).alias("l")).select(*keys, F.array_join("l.text", "\n").alias("t"))
    pages = sides.groupBy(*PAGE).agg(F.coalesce(F.max(F.when(F.col("side") == 0, F.col("t"))), F.lit("")).alias("left"), F.coalesce(F.max(F.when(F.col("side") == 1, F.col("t"))), F.lit("")).alias("right"))
    text = F.concat(F.lit("=== LEFT COLUMN ===\n"), "left", F.lit("\n\n=== RIGHT COLUMN ===\n"), "right")
    return pages.select(*PAGE, fold_accents(text).alias("text"))


def table_rows(lines: DataFrame, key: str = "doc_id", order: str = "line_no", text: str = "line") -> DataFrame:
    """key, order, line of a table's rows: lines with three prices and a word, each with up to two lines that continue its
    name, and header lines. A document with fewer than two such rows keeps all its lines.

    A continuing line holds no price, so it is never a row itself, and two neighbours decide everything.
    """
    w = Window.partitionBy(key).orderBy(order)
    line = F.coalesce(F.col(text), F.lit(""))
    # a step of its own, so that no line is counted through twice; rows and lines of bare prices need no look at their words
    counted = lines.select(key, order, line.alias("line"), F.size(F.regexp_extract_all(line, F.lit(PRICE), F.lit(1))).alias("prices"), line.rlike(WORD).alias("worded"), (strip(line) == "").alias("blank"))
    prices, worded, line = F.col("prices"), F.col("worded"), F.col("line")
    goes_on = F.when((prices == 0) & worded & ~F.col("blank"), ~line.rlike(NO_CONTINUATION)).otherwise(False)
    head = F.when((prices < 3), line.rlike(TABLE_HEADER)).otherwise(False)
    marked = counted.select(key, order, "line", ((prices >= 3) & worded).alias("row"), goes_on.alias("goes_on"), "blank", head.alias("head"))
    near = {name: fn(c, k).over(w) for c, name, fn, k in (("line", "l1", F.lead, 1), ("line", "l2", F.lead, 2), ("goes_on", "c1", F.lead, 1), ("goes_on", "c2", F.lead, 2), ("blank", "b1", F.lead, 1), ("row", "r1", F.lag, 1), ("row", "r2", F.lag, 2), ("goes_on", "p1", F.lag, 1), ("blank", "pb1", F.lag, 1))}
    seen = marked.withColumns({k: v if k in ("l1", "l2") else F.coalesce(v, F.lit(False)) for k, v in near.items()})
    second = F.col("c2") & (F.col("c1") | F.col("b1"))
    full = F.concat("line", F.when(F.col("c1"), F.concat(F.lit(" "), strip(F.col("l1")))).otherwise(""), F.when(second, F.concat(F.lit(" "), strip(F.col("l2")))).otherwise(""))
    taken = F.col("goes_on") & (F.col("r1") | (F.col("r2") & F.col("p1")))
    kept = seen.select(key, order, F.when(F.col("row"), full).otherwise(F.col("line")).alias("out"), "line", (F.col("row") | (F.col("head") & ~taken)).alias("keep"))
    n = F.sum(F.col("keep").cast("int")).over(Window.partitionBy(key))
    return kept.withColumn("n", n).where((F.col("n") < 2) | F.col("keep")).select(key, order, F.when(F.col("n") < 2, F.col("line")).otherwise(F.col("out")).alias("line"))


def mean_confidence(words: DataFrame) -> DataFrame:
    """doc_id, confidence in percent."""
    return words.groupBy("doc_id").agg(F.coalesce(F.avg("confidence") * 100, F.lit(0.0)).alias("confidence"))
