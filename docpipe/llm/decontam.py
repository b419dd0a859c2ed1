"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item of n distinct shingles counts as contained in a document that holds at least `threshold` of them. Shingles are
runs of five words; an item of fewer words has one shingle, all of them, and is looked for among the document's runs of as
many words, so short items are found inside long documents too. Items are partitioned by width and size (powers of two).
In the partition up to size u, an item's sketch is its k = floor((1 - t) * u) + 1 smallest shingle hashes (a bottom-k
MinHash). A document that contains the item lacks at most floor((1 - t) * n) of its shingles, so it holds at least one of
any k: looking up every shingle of a document in the partitions' sketches finds every candidate. The document side is not
sketched, since banded signatures of long documents lose short items. Candidates are then verified by counting the item's
shingles in the document. Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpipe.llm import spans
from docpipe.llm.common import bounded_batches, slices, text_or_empty

THRESHOLD = 0.8
WORDS = 5
MOST_SHINGLES = 400_000
FOUND = "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double"


def sketch_size(n: int, threshold: float = THRESHOLD) -> int:
    """Hashes to keep of an item of n distinct shingles, by the upper bound of its size partition."""
    upper = 1 << max(0, n - 1).bit_length()
    return min(n, math.floor((1 - threshold) * upper + 1e-9) + 1)


def least_shared(n: int, threshold: float = THRESHOLD) -> int:
    return math.ceil(threshold * n - 1e-9)


class Partition:
    """Sketches of the items of one width and size, for lookups of a document's shingles."""

    def __init__(self, members: list[int], sets: list[np.ndarray], threshold: float):
        least = [np.sort(spans.mix(sets[i]))[: sketch_size(len(sets[i]), threshold)] for i in members]
        keys, owner = np.concatenate(least), np.repeat(np.array(members), [len(x) for x in least])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def candidates(self, mixed: np.ndarray) -> np.ndarray:
        """Items of which a sketch holds one of the shingles."""
        mixed = mixed[self.seen[(mixed >> np.uint64(48)).astype(np.int64)]]
        low, high = np.searchsorted(self.keys, mixed, "left"), np.searchsorted(self.keys, mixed, "right")
        hit = np.flatnonzero(high > low)
        return np.unique(np.concatenate([self.owner[low[i] : high[i]] for i in hit])) if len(hit) else self.owner[:0]


class Sketches:
    """A bounded block of items: whole shingle sets, and the partitions' sketches."""

    def __init__(self, items: list[tuple[int, int, np.ndarray]], threshold: float):
        self.ids, self.sets, self.threshold = [i for i, _, _ in items], [s for _, _, s in items], threshold
        members: dict[tuple[int, int], list[int]] = {}
        for at, (_, width, shingles) in enumerate(items):
            members.setdefault((width, (len(shingles) - 1).bit_length()), []).append(at)
        self.partitions: dict[int, list[Partition]] = {}
        for (width, _), held in sorted(members.items()):
            self.partitions.setdefault(width, []).append(Partition(held, self.sets, threshold))

    def matches(self, texts: list[str]):
        """For each text, the items that it contains: pairs of place and shared shingles, as they are found."""
        single, at = spans.word_hashes(texts)
        by_width = {width: spans.grams(single, at, width) for width in self.partitions}
        for i in range(len(texts)):
            yield self._of_text({width: hashes[bounds[i] : bounds[i + 1]] for width, (hashes, bounds) in by_width.items()})

    def _of_text(self, held: dict[int, np.ndarray]):
        for width, shingles in held.items():
            mixed, document = spans.mix(shingles), None
            for partition in self.partitions[width] if len(shingles) else ():
                for at in partition.candidates(mixed).tolist():
                    document = np.unique(shingles) if document is None else document
                    wanted = self.sets[at]
                    place = np.minimum(np.searchsorted(document, wanted), len(document) - 1)
                    shared = int((document[place] == wanted).sum())
                    if shared >= least_shared(len(wanted), self.threshold):
                        yield at, shared


def item_blocks(items: DataFrame, threshold: float, most: int):
    """Blocks of items, each of about `most` shingles at the most, so that what a task holds does not grow with the items."""
    rows = items.select(items["item_id"].cast("long").alias("item_id"), text_or_empty().alias("text")).distinct()
    words = rows.agg(F.sum(F.length("text") / 2 + 1).alias("n")).first()["n"] or 0
    n = max(1, math.ceil(words / 2 / most))
    for block in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block)

        def pack(batches):
            for batch, texts in slices(batches, "text"):
                single, at = spans.word_hashes(texts)
                widths, sets = np.minimum(np.diff(at), WORDS), []
                for i, width in enumerate(widths.tolist()):
                    hashes, _ = spans.grams(single[at[i] : at[i + 1]], np.array([0, at[i + 1] - at[i]]), width) if width else (single[:0], None)
                    sets.append(np.unique(hashes).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(widths, pa.int32()), pa.array(sets, pa.binary())], ["item_id", "width", "shingles"])

        found = part.mapInArrow(pack, "item_id long, width int, shingles binary").where("item_id is not null and length(shingles) > 0").collect()
        yield Sketches([(r["item_id"], r["width"], np.frombuffer(r["shingles"], np.uint64)) for r in sorted(found)], threshold)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, most: int = MOST_SHINGLES) -> DataFrame:
    """Pairs of a document and an item whose shingles it holds to at least `threshold`.

    Null or empty texts, and items with a null id, match nothing. An item of one to four words is contained where they
    stand in a row. Words are runs of letters and numbers (a text without spaces is one word). Repeated documents repeat
    their rows; of rows with one item_id and different texts the best counts; ties keep each item. Empty tables give no
    rows; other columns are not read. Documents are read once for each block of items (one block up to MOST_SHINGLES) and
    never shuffled.
    """
    bounded_batches(docs.sparkSession)
    spark, out = docs.sparkSession, None
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text"))
    for sketches in item_blocks(items, threshold, most):
        held = spark.sparkContext.broadcast(sketches)

        def run(batches, held=held):
            sketches = held.value
            for batch, texts in slices(batches, "text"):
                doc_ids, columns = batch.column("doc_id").to_pylist(), ([], [], [], [], [])
                for doc_id, contained in zip(doc_ids, sketches.matches(texts), strict=True):
                    best: dict[int, tuple] = {}
                    for at, shared in contained:
                        n = len(sketches.sets[at])
                        row = (shared / n, n, shared)
                        best[sketches.ids[at]] = max(row, best.get(sketches.ids[at], row))
                    for item, (part, n, shared) in best.items():
                        for column, value in zip(columns, (doc_id, item, n, shared, part), strict=True):
                            column.append(value)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"])

        found = rows.mapInArrow(run, FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, most: int = MOST_SHINGLES) -> DataFrame:
    """`docs` without the rows that contain an item, with all their columns, whatever their names; null and empty texts
    contain nothing, repeated rows share their fate, empty tables stay empty, and without items all rows stay.

    Narrow passes, one for each block of items: no document is shuffled, and each row is judged by its own text.
    """
    bounded_batches(docs.sparkSession)
    out = docs
    for sketches in item_blocks(items, threshold, most):
        held = docs.sparkSession.sparkContext.broadcast(sketches)

        def run(batches, held=held):
            for batch, texts in slices(batches, "text"):
                clean = [next(contained, None) is None for contained in held.value.matches(texts)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


ORACLE = """
with words as (
  select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') as w from documents),
item_words as (
  select item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') as w from benchmark),
widths as (select distinct least(len(w), 5) as k from item_words where len(w) > 0),
doc_shingles as (
  select distinct doc_id, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) as s from words, widths where k < 5
  union all select distinct doc_id, 5, unnest([w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] for i in range(1, len(w) - 3)]) from words),
item_shingles as (
  select distinct item_id, least(len(w), 5) as k, unnest(case when len(w) >= 5 then [w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] for i in range(1, len(w) - 3)]
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from item_words),
sizes as (select item_id, count(*) as n from item_shingles group by item_id),
shared as (select doc_id, item_id, count(*) as c from doc_shingles join item_shingles using (k, s) group by doc_id, item_id)
select doc_id, item_id, n as n_item_shingles, c as n_shared, c / n::double as containment
from shared join sizes using (item_id) where c >= ceil(0.8 * n - 1e-9)
"""
