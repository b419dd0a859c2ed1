"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of PASSAGE characters. Each passage is encoded from what its characters and words look
like (histogram of neighbouring character classes, repeated words), through a learned layer. Gated attention weights
(tanh times sigmoid) are learned from document labels alone; the weighted passage representation is scored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpipe.llm import spans
from docpipe.llm.common import bounded_batches, slices, text_or_empty

PASSAGE = 400
#: Labelled documents to fit on, at the most; half of each label, by the smallest hashes of doc_id.
MOST_LABELLED = 2000
LETTERS = 4  # classes: capitals, small letters, letters past ASCII of either case; then the marks below
MARKS = " \n\t.,;:!?|*#$%&@<>{}[]()/\\'\"-_=+~^`"
GROUPS = [" ", "\n\t", ".,;:", "!", "?", "|", "*#$%&@~^`", "<>{}[]()/\\=+_", "'\"-"]
DIGIT = LETTERS + len(GROUPS)
REST = DIGIT + 1
CLASSES = REST + 1
FEATURES = CLASSES * CLASSES + 4


@cache
def character_classes() -> np.ndarray:
    kind = spans.classes()
    out = np.full(len(kind), REST, np.uint8)
    out[kind == spans.LETTER] = 3
    out[kind == spans.NUMBER] = DIGIT
    out[[c for c in range(0x250) if chr(c).isupper()]] = 2
    out[ord("A") : ord("Z") + 1] = 0
    out[ord("a") : ord("z") + 1] = 1
    for i, group in enumerate(GROUPS):
        out[[ord(c) for c in group]] = LETTERS + i
    return out


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (one of zeros for an empty text) and where each text's begin."""
    codes, offsets = spans.code_points(texts)
    lengths = np.diff(offsets)
    counts = np.maximum(1, -(-lengths // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros((bounds[-1], FEATURES), np.float32)
    if not len(codes):
        return out, bounds
    doc = np.repeat(np.arange(len(texts)), lengths)
    passage = bounds[doc] + (np.arange(len(codes)) - offsets[doc]) // PASSAGE
    kind = character_classes()[codes].astype(np.int64)
    same = passage[1:] == passage[:-1]
    pair = (passage[:-1] * CLASSES + kind[:-1]) * CLASSES + kind[1:]
    size = np.bincount(passage, minlength=len(out)).astype(np.float32)[:, None]
    table = np.bincount(pair[same], minlength=len(out) * CLASSES * CLASSES).reshape(len(out), -1)
    out[:, : CLASSES * CLASSES] = np.sqrt(table / np.maximum(size, 1))
    starts, ends = spans.word_bounds(codes, offsets)
    if len(starts):
        word, at = spans.hashes(codes, starts, ends), passage[starts]
        n = np.bincount(at, minlength=len(out))
        again = np.zeros(len(word), bool)
        again[1:] = (word[1:] == word[:-1]) & (at[1:] == at[:-1])
        key = np.sort((at.astype(np.uint64) << np.uint64(40)) | (word >> np.uint64(24)))
        repeated = at[:0] if len(key) < 2 else (key[1:][key[1:] == key[:-1]] >> np.uint64(40)).astype(np.int64)
        some = np.maximum(n, 1)
        out[:, -4] = np.bincount(at, again, minlength=len(out)) / some
        out[:, -3] = np.bincount(repeated, minlength=len(out)) / some
        out[:, -2] = np.bincount(at, ends - starts, minlength=len(out)) / some / 20
        out[:, -1] = n / np.maximum(size[:, 0], 1) * 4
    return out, bounds


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _segments(values: np.ndarray, bounds: np.ndarray, how) -> np.ndarray:
    return how.reduceat(values, bounds[:-1])


class AttentionMIL:
    """Encoder, gated attention and scorer; `prior` alone where only one label was seen."""

    def __init__(self, hidden: int = 24, attention: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        norm = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.w = {"encode": norm(FEATURES, hidden), "bias": np.zeros(hidden), "tanh": norm(hidden, attention), "gate": norm(hidden, attention), "attend": norm(attention, 1)[:, 0], "score": norm(hidden, 1)[:, 0], "offset": np.zeros(1)}
        self.prior: float | None = None

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
        w, size = self.w, np.diff(bounds)
        h = np.tanh(x @ w["encode"] + w["bias"])
        t, g = np.tanh(h @ w["tanh"]), _sigmoid(h @ w["gate"])
        e = (t * g) @ w["attend"]
        e = np.exp(e - np.repeat(_segments(e, bounds, np.maximum), size))
        a = e / np.repeat(_segments(e, bounds, np.add), size)
        z = _segments(a[:, None] * h, bounds, np.add)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["score"] + w["offset"])}

    def gradients(self, x: np.ndarray, bounds: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        w, size, f = self.w, np.diff(bounds), self.forward(x, bounds)
        d = (f["p"] - y) / len(y)
        dz = np.repeat(d[:, None] * w["score"], size, axis=0)
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(_segments(f["a"] * da, bounds, np.add), size))
        dtg = de[:, None] * w["attend"]
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ w["tanh"].T + dg @ w["gate"].T) * (1 - f["h"] ** 2)
        out = {"encode": x.T @ dh, "bias": dh.sum(0), "tanh": f["h"].T @ dt, "gate": f["h"].T @ dg, "attend": (f["t"] * f["g"]).T @ de, "score": f["z"].T @ d, "offset": np.array([d.sum()])}
        return {k: v + decay * w[k] for k, v in out.items()}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 11) -> AttentionMIL:
        """Adam over batches of documents."""
        if len(set(labels.tolist())) < 2:
            self.prior = float(labels.mean()) if len(labels) else 0.5
            return self
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for start in range(0, len(bags), batch):
                mine, step = order[start : start + batch], step + 1
                bounds = np.concatenate([[0], np.cumsum([len(bags[i]) for i in mine])])
                for k, g in self.gradients(np.concatenate([bags[i] for i in mine]), bounds, labels[mine], decay).items():
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, texts: list[str]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        return self.forward(*passages(texts))["p"]


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_bags(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELLED) -> tuple[list[np.ndarray], np.ndarray]:
    """Passage features and labels of a bounded sample of the documents that are labelled and not held out."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    order = F.xxhash64("doc_id")
    sample = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(order, "doc_id").limit(most // 2).collect()]
    if not sample:
        return [], np.zeros(0)
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["y"]) for r in sample], "doc_id long, y int")  # at most `most` rows
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # of a repeated id always the same text

    def run(batches):
        for batch, texts in slices(batches, "text"):
            x, bounds = passages(texts)
            packed = [x[a:b].astype(np.float16).tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(packed, pa.binary())], ["doc_id", "y", "x"])

    got = sorted(rows.mapInArrow(run, "doc_id long, y int, x binary").collect(), key=lambda r: r["doc_id"])
    return [np.frombuffer(r["x"], np.float16).reshape(-1, FEATURES).astype(np.float64) for r in got], np.array([r["y"] for r in got], np.float64)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELLED) -> AttentionMIL:
    return AttentionMIL().fit(*training_bags(docs, labels, label, most))


def scored(docs: DataFrame, model: AttentionMIL) -> DataFrame:
    """doc_id, held_out, score and predicted of each row, from its whole text alone.

    Null texts count as empty and are scored as a passage of nothing; repeated rows repeat; a null doc_id is never held
    out. With no usable labels every score is 0.5; with one kind only, that label. One narrow pass.
    """
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, texts in slices(batches, "text"):
            score = held.value.score(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("held_out", held_out())
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on the labelled documents and scores all; see `scored` for nulls, empty texts, repeats and missing labels.

    Of an id with several labels the larger counts, of one with several texts the smallest text; labels for no document,
    null or other than 0 and 1 are left out.
    """
    return scored(docs, fit(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, whatever their names, whose text the fitted model accepts.

    Null texts count as empty; repeated rows share their fate; empty tables stay empty; without usable labels all rows stay.
    """
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        for batch, texts in slices(batches, "text"):
            yield batch.filter(pa.array(held.value.score(texts) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
