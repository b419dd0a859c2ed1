"""Small gradient-boosted trees on binned features, with logistic loss and calibrated outputs.

Rows that fall into the same bins are one row with counts. A level of a tree needs nothing but sums of gradients by node,
feature and bin, so rows may be at hand (Rows) or in a table (DealtRows), whose tasks return such sums. Gradients are summed as
whole numbers: the trees are the same however the rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpipe.llm.common import materialize

Levels = list[tuple[np.ndarray, np.ndarray]]
Tree = tuple[Levels, np.ndarray]
#: What one is as a whole number in sums of gradients.
SCALE = 1 << 24
#: Rows (of a few dozen bytes) up to which a table is brought to hand. Of larger ones: rows that a task looks at for each level,
#: most tasks for a level, and trees after which a table's margins are written anew.
AT_HAND, TASK_ROWS, MOST_TASKS, WRITTEN = 50_000, 50_000, 256, 10
STEP = 1000  # margins are told apart by thousandths


def nodes(binned: np.ndarray, levels: Levels) -> np.ndarray:
    node, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
    for feature, split in levels:
        node = node * 2 + (binned[rows, feature[node]] > split[node])
    return node


class Rows:
    """Binned rows at hand; n: how many each stands for (1 by default), good: how many of these are good."""

    def __init__(self, binned: np.ndarray, good: np.ndarray, n: np.ndarray | None = None):
        self.binned, self.good, self.n, self.margin = binned, good, np.ones(len(good)) if n is None else n, np.zeros(len(good))

    def sums(self, levels: Levels, width: int) -> np.ndarray:
        """Scaled gradients and their derivatives, summed by node, feature and bin."""
        p, all_nodes, of = 1 / (1 + np.exp(-self.margin)), 1 << len(levels), self.binned.shape[1]
        node, out = nodes(self.binned, levels) * width, np.zeros((2, all_nodes, of, width), np.int64)
        both = self.good * SCALE - self.n * np.rint(p * SCALE), self.n * np.rint(p * (1 - p) * SCALE)
        for j in range(of):
            key = node + self.binned[:, j]
            for k, x in enumerate(both):
                out[k, :, j] = np.bincount(key, x, all_nodes * width).reshape(all_nodes, width)
        return out

    def add(self, tree: Tree) -> None:
        self.margin += tree[1][nodes(self.binned, tree[0])]


def parts(batches: Iterator[pa.RecordBatch], of: int, trees: list[Tree]) -> Iterator[tuple[pa.RecordBatch, Rows]]:
    """Each batch of DealtRows.table with its rows and their margins after the trees that are not in its column yet."""
    for batch in batches:
        if batch.num_rows:
            good, n = (batch.column(name).to_numpy().astype(float) for name in ("good", "n"))
            rows = Rows(np.frombuffer(b"".join(batch.column("binned").to_pylist()), np.uint8).reshape(-1, of), good, n)
            rows.margin = batch.column("margin").to_numpy().copy()
            for tree in trees:
                rows.add(tree)
            yield batch, rows


class DealtRows:
    """A written table of binned (a byte for each feature), n, good and margin, each level's sums of which come from its tasks."""

    def __init__(self, table: DataFrame, of: int, rows: int):
        self.table, self.of, self.pending, self.tasks = table, of, [], max(1, min(MOST_TASKS, -(-rows // TASK_ROWS)))

    def sums(self, levels: Levels, width: int) -> np.ndarray:
        total = np.zeros((2, 1 << len(levels), self.of, width), np.int64)
        of, trees = self.of, list(self.pending)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = sum((rows.sums(levels, width) for _, rows in parts(batches, of, trees)), np.zeros_like(total))
            yield pa.RecordBatch.from_arrays([pa.array([mine.tobytes()], pa.binary())], ["sums"])

        for (part,) in self.table.coalesce(self.tasks).mapInArrow(run, "sums binary").collect():
            total += np.frombuffer(part, np.int64).reshape(total.shape)
        return total

    def add(self, tree: Tree) -> None:
        self.pending.append(tree)
        if len(self.pending) == WRITTEN:
            of, trees = self.of, list(self.pending)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch, rows in parts(batches, of, trees):
                    at = batch.schema.get_field_index("margin")
                    yield batch.set_column(at, batch.schema.field(at), pa.array(rows.margin))

            self.table, self.pending = materialize(self.table.coalesce(self.tasks).mapInArrow(run, self.table.schema), "margins"), []


def rows_of(table: DataFrame, of: int) -> Rows | DealtRows:
    """The rows of a written table of binned, n and good: at hand if they are few."""
    rows = table.count()
    if rows > AT_HAND:
        return DealtRows(table.withColumn("margin", F.lit(0.0)), of, rows)
    held = table.select("binned", "n", "good").collect()
    n, good = (np.array([r[k] for r in held], float) for k in ("n", "good"))
    return Rows(np.frombuffer(b"".join(r["binned"] for r in held), np.uint8).reshape(-1, of), good, n)


class BoostedTrees:
    """Level-wise trees of a fixed depth; leaves are Newton steps; outputs are calibrated by a line through the margins."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.3, bins: int = 32, least: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.cuts: list[np.ndarray] = []
        self.grown: list[Tree] = []
        self.line = (1.0, 0.0)

    def cut(self, x: np.ndarray) -> BoostedTrees:
        """Sets the bins by quantiles of each feature."""
        self.cuts = [np.unique(np.quantile(column, np.linspace(0, 1, self.bins + 1)[1:-1])) for column in x.T]
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(cut, column, "right") for cut, column in zip(self.cuts, x.T, strict=True)], axis=1).astype(np.uint8)

    def fit(self, sources: Iterable[Rows | DealtRows]) -> BoostedTrees:
        """Trees of the rows of all sources; `cut` comes first."""
        sources = list(sources)
        for _ in range(self.trees):
            levels: Levels = []
            for level in range(self.depth):
                n, every = 1 << level, np.arange(1 << level)
                g, h = (sum(s.sums(levels, self.bins + 1) for s in sources) / SCALE).cumsum(-1)
                total_g, total_h = g[..., -1:], h[..., -1:]
                gain = g**2 / (h + self.least) + (total_g - g) ** 2 / (total_h - h + self.least) - total_g**2 / (total_h + self.least)
                best = gain.reshape(n, -1).argmax(1)
                feature, split = best // (self.bins + 1), best % (self.bins + 1)
                split[gain.reshape(n, -1)[every, best] <= 1e-9] = self.bins
                levels.append((feature, split))
            low_g, low_h = g[every, feature, split], h[every, feature, split]
            step = lambda a, b: self.rate * a / (b + self.least)
            leaf = np.stack([step(low_g, low_h), step(total_g[every, feature, 0] - low_g, total_h[every, feature, 0] - low_h)], axis=1).ravel()
            self.grown.append((levels, leaf))
            for s in sources:
                s.add(self.grown[-1])
        return self

    def binned_margin(self, binned: np.ndarray) -> np.ndarray:
        """Margins in whole STEPs, so that few differ and equal ones can be counted."""
        out = np.zeros(len(binned))
        for levels, leaf in self.grown:
            out += leaf[nodes(binned, levels)]
        return np.rint(out * STEP) / STEP

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.binned_margin(self.binned(x))

    def calibrate(self, margin: np.ndarray, n: np.ndarray, good: np.ndarray, steps: int = 400) -> BoostedTrees:
        """Platt's line, fitted on margins of rows that the trees have not seen: how many have each, and how many of them are good."""
        a, b, all_good = 1.0, 0.0, good.sum()
        high, low = (all_good + 1) / (all_good + 2), 1 / (n.sum() - all_good + 2)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
            d, h = n * p - good * high - (n - good) * low, n * (p * (1 - p) + 1e-6)
            b -= d.sum() / h.sum()
            a -= (d * margin).sum() / ((h * margin * margin).sum() + 1e-6)
        self.line = (float(a), float(b))
        return self

    def likely(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.line[0] * margin + self.line[1], -30, 30)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.likely(self.margin(x))
