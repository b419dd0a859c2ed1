"""Exact top-k by inner product: exhaustive term-at-a-time accumulation over blocks.

Candidates are packed into blocks of postings: for every dimension (term) the rows where it is not zero, and its
weights. For a query, a row of terms and weights, each term's postings are scattered, weighted, into a dense array of
scores, one for each candidate of the block; partition selection keeps the block's best, and the blocks' best are merged.
Query blocks meet candidate blocks in an equi-join on the pair of block numbers, so each pair is a task's row of bounded
size and no single task or executor holds all rows.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES = 8192
QUERIES = 1024
PACKED = "block int, pack binary"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the components as floats or doubles; without null vectors, null or non-finite components and rows without
    an id. Floats stay floats, half the bytes in the shuffle; Python reads both as doubles."""
    plain = vectors.schema["embedding"].dataType.elementType.typeName() in ("float", "double")
    v = F.col("embedding") if plain else F.col("embedding").cast("array<double>")
    rows = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & ((F.abs(x) < F.lit(float("inf")))))
    return rows.where(F.coalesce(finite, F.lit(False)))


def quantized(lists: list[list[float]], scale: int) -> np.ndarray:
    """floor(scale * x) of each component, in rows padded with zeros; Python integers where 64 bits don't hold them."""
    width = max(map(len, lists), default=0)
    plain = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        plain[i, : len(x)] = x
    if not plain.size or np.abs(plain).max() < 2.0**62 / scale:
        return np.floor(plain * scale).astype(np.int64)
    big = 2.0**53  # doubles past it are whole numbers
    return np.array([[int(x) * scale if abs(x) >= big else math.floor(x * scale) for x in row] for row in plain.tolist()], object)


def largest(matrix: np.ndarray) -> int:
    """The largest size of a component, as a Python integer."""
    return max(abs(int(matrix.max())), abs(int(matrix.min()))) if matrix.size else 0


def narrowed(matrix: np.ndarray) -> np.ndarray:
    """The matrix in the smallest type of integers that holds it."""
    top = largest(matrix)
    kind = next((k for k in (np.int16, np.int32, np.int64) if top <= np.iinfo(k).max), object)
    return matrix.astype(kind)


def score_type(bound: int) -> type:
    """What sums of products up to `bound` are exact in; floats where they are, since their products are the fastest."""
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object


def postings(matrix: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """By dimension: the rows with a weight (None: all rows) and their weights."""
    out = []
    for column in matrix.T:
        rows = np.flatnonzero(column)
        out.append((None, np.ascontiguousarray(column)) if len(rows) == len(column) else (rows.astype(np.int32), column[rows]))
    return out


def _blocks(rows: DataFrame, n: int, most: int, candidates: bool, scale: int) -> DataFrame:
    """Packed rows, a block or more for each of n even partitions; block = partition number, then a running number."""

    def run(batches):
        from pyspark import TaskContext

        part, ids, terms, made = TaskContext.get().partitionId(), [], [], 0

        def pack():
            matrix = narrowed(quantized(terms, scale))
            data = pickle.dumps((np.array(ids, np.int64), postings(matrix) if candidates else matrix, largest(matrix)), protocol=5)
            return pa.RecordBatch.from_arrays([pa.array([part + made * n], pa.int32()), pa.array([data], pa.binary())], ["block", "pack"])

        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            terms += batch.column("v").to_pylist()
            while len(ids) >= 2 * most:
                rest = ids[most:], terms[most:]
                ids, terms = ids[:most], terms[:most]
                yield pack()
                (ids, terms), made = rest, made + 1
        if ids:
            yield pack()

    return rows.repartition(n).mapInArrow(run, PACKED)


def best(queries: tuple[np.ndarray, np.ndarray, int], block: tuple[np.ndarray, list, int], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, candidate id and score of each query's k best of the block (ties to smaller ids), itself left out."""
    (query_ids, weights, top), (ids, held, block_top) = queries, block
    kind = score_type(top * block_top * max(1, len(held)))
    lists = [(rows, values.astype(kind)) for rows, values in held]
    of, found, scores = [], [], []
    for row, (query_id, terms) in enumerate(zip(query_ids.tolist(), weights.astype(kind), strict=True)):
        score = np.zeros(len(ids), kind)
        for term in np.flatnonzero(terms[: len(lists)]).tolist():
            rows, values = lists[term]
            if rows is None:
                score += terms[term] * values
            else:
                score[rows] += terms[term] * values
        others = np.flatnonzero(ids != query_id)
        mine = score[others]
        if kind is object:
            order = np.array(heapq.nsmallest(k, range(len(others)), key=lambda i: (-mine[i], ids[others[i]])), np.int64)  # noqa: B023
        else:
            if len(mine) > k:
                least = np.partition(mine, len(mine) - k)[len(mine) - k]
                others, mine = others[mine >= least], mine[mine >= least]
            order = np.lexsort((ids[others], -mine))[:k]
        of.append(np.full(len(order), row))
        found.append(ids[others[order]])
        scores.append(mine[order] if kind is object else mine[order].astype(np.int64))
    return np.concatenate(of), np.concatenate(found), np.concatenate(scores)


LEAST, MOST = -(2**63), 2**63 - 1


def beyond(score: int) -> bytes | None:
    """Bytes that order scores outside 64 bits as the scores themselves; null inside, which stands between both sides."""
    if LEAST <= score <= MOST:
        return None
    size = (abs(score).bit_length() + 7) // 8
    if score > 0:
        return b"\2" + size.to_bytes(2, "big") + score.to_bytes(size, "big")
    return b"\0" + (0xFFFF - size).to_bytes(2, "big") + (256**size + score).to_bytes(size, "big")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k best rows of `vectors` by integer inner product.

    Both have vec_id and embedding. Rows with a null id, a null vector, null or non-finite components take no part; finite
    ones of any size do. Shorter vectors count as ending in zeros; rows with the query's own id are no candidates.
    Repeated candidate rows each take a rank; a repeated query row is answered once, but one id with different vectors
    is answered for each. Scores are exact and ranked exactly; one that 64 bits can't hold is returned as the nearest long.
    Empty tables give no rows; other columns are not read.
    """
    rows = usable(vectors)
    asked = usable(queries).distinct()
    n = max(1, -(-rows.count() // CANDIDATES))
    m = max(1, -(-asked.count() // QUERIES))
    packed = _blocks(rows, n, CANDIDATES, True, scale).select(F.col("block").alias("c"), F.col("pack").alias("candidates"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("part"))
    wanted = _blocks(asked, m, QUERIES, False, scale).select(F.col("block").alias("q"), F.pmod("block", F.lit(m)).alias("part"), F.col("pack").alias("queries"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("c0"))
    pairs = packed.withColumn("c0", F.pmod("c", F.lit(n))).join(wanted, ["part", "c0"])

    def run(batches):
        for batch in batches:
            for q, one, two in zip(batch.column("q").to_pylist(), batch.column("queries").to_pylist(), batch.column("candidates").to_pylist(), strict=True):
                asked = pickle.loads(one)
                of, found, scores = best(asked, pickle.loads(two), k)
                key = np.int64(q) * (1 << 20) + of
                far = None if scores.dtype != object else [beyond(int(x)) for x in scores]
                near = scores if far is None else np.array([min(MOST, max(LEAST, int(x))) for x in scores], np.int64)
                columns = [pa.array(asked[0][of]), pa.array(key), pa.array(found), pa.array(near), pa.nulls(len(of), pa.binary()) if far is None else pa.array(far, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "key", "vec_id", "score", "beyond"])

    found = pairs.select("q", "queries", "candidates").mapInArrow(run, "query_id long, key long, vec_id long, score long, beyond binary")
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), F.desc(F.coalesce("beyond", F.lit(b"\1"))), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as t from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.t, c.t), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 5
"""
