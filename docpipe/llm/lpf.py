"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document with a smaller doc_id are removed.

The rule is that of the longest-previous-factor array: a place is covered if its longest factor that also starts earlier,
here in a document with a smaller id, reaches SIZE bytes. In suffix order that factor is shared with the previous or the
next smaller position. A suffix array of the whole corpus would have to move every suffix, so the suffixes that can matter
are brought together first, in buckets that are sorted on their own:

1. Texts are packed into chunks, files in the shared folder, that tasks read again by name.
2. Every window of SIZE bytes has an anchor: the smallest hash of its ANCHOR-byte strings. Equal windows have equal
   anchors at equal places, so windows can only match within an anchor's bucket. Neighbouring windows with one anchor are
   a run. Runs whose whole surroundings are equal (a class, told by a 64-bit hash) match in all their windows: they are
   one suffix for our purpose, and all but those of the class's smallest doc_id are removed, in the chunk itself first and
   then across chunks.
3. Where an anchor has several classes, the bytes of the classes' first runs meet in buckets. There the suffixes are
   sorted up to SIZE bytes, with their common prefixes; the previous and next smaller positions over their doc_ids give the
   longest-previous-factor array (lengths up to SIZE), and a window is removed if its entry reaches SIZE.
4. Each chunk gathers its removed windows and writes its documents' results.

Hot keys: equal runs are merged within a chunk before anything is shuffled. Anchors with over COMMON runs in a chunk never
enter the anchor's bucket: their windows are bucketed one by one by their own contents (equal ones merged within the chunk),
and a mark tells the bucket to treat what other chunks hold of the anchor alike. So an anchor adds at most COMMON runs of
about 30 bytes for each chunk to its bucket, a window one row. Packs number chunks times buckets; take larger chunks where
both are many.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpipe.llm import spans
from docpipe.llm.common import bounded_batches, file_system, make_dir, materialize, partitions, runs, shared_dir, slices, text_or_empty

SIZE = 50
ANCHOR = 20
CHUNK_BYTES = 1 << 22
SEGMENT = 1 << 21
#: Anchors with more classes in a bucket, or more runs in a chunk, are compared window by window, elsewhere.
MANY_CLASSES, COMMON = 64, 8
LAST_ID = 2**63 - 1
PACKED = "bucket int, chunk long, kind int, pack binary"
DONE, LOCAL, ASK, CONTEXT, MARK = 0, 1, 2, 3, 4


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length; the 64-bit hashes first and as they are, the others by differences and squeezed."""
    plain = b"".join(a.tobytes() for a in arrays if a.dtype == np.uint64 or a.dtype == np.uint32)
    rest = zlib.compress(b"".join(np.diff(a.astype(np.int64), prepend=0).tobytes() for a in arrays if a.dtype == np.int64), 1)
    return len(arrays[0]).to_bytes(4, "little") + plain + rest


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    n, at, out = int.from_bytes(data[:4], "little"), 4, []
    for kind in kinds:
        if kind is not np.int64:
            out.append(np.frombuffer(data, kind, n, at))
            at += out[-1].nbytes
    rest = np.frombuffer(zlib.decompress(data[at:]), np.int64).reshape(-1, n).cumsum(axis=1)
    return [*out, *rest]


def anchored_runs(data: np.ndarray, bounds: np.ndarray, size: int = SIZE, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor: first window, number of windows, anchor hash, class hash, document number."""
    out = [[], [], [], [], []]
    document = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    for begin in range(0, max(0, len(data) - size + 1), SEGMENT):
        part = data[begin : begin + SEGMENT + size - 1]
        n, wide = len(part), size - anchor + 1
        windows = n - size + 1
        total = np.zeros(n + 1, np.uint64)
        length = 1 << (SEGMENT + size).bit_length()
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * spans.powers(spans.BASE, length)[:n], out=total[1:])
        back = spans.powers(spans.INVERSE, length)
        hashed = spans.mix((total[anchor:] - total[:-anchor]) * back[: n - anchor + 1])
        least = (hashed & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(hashed), dtype=np.uint64)
        reach = 1
        while reach * 2 <= wide:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < wide:
            least = np.minimum(least[: len(least) - (wide - reach)], least[wide - reach :])
        at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        mine = document[begin : begin + n]
        whole = mine[:windows] == mine[size - 1 :]
        change = np.ones(windows + 1, bool)
        change[1:windows] = (at[1:] != at[:-1]) | (whole[1:] != whole[:-1]) | (mine[1:windows] != mine[: windows - 1])
        edges = np.flatnonzero(change)
        first, last = edges[:-1], edges[1:] - 1
        keep = whole[first]
        first, last = first[keep], last[keep]
        place = at[first]
        shape = ((place - first).astype(np.uint64) << np.uint64(32)) + (last - first).astype(np.uint64)
        context = spans.mix((total[last + size] - total[first]) * back[first] + spans.mix(shape))
        for held, values in zip(out, (first + begin, last - first + 1, hashed[place], context ^ hashed[place], mine[first].astype(np.int64)), strict=True):
            held.append(values)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64 if i in (0, 1, 4) else np.uint64) for i, x in enumerate(out))


def common_prefixes(view: np.ndarray, begin: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """Of suffixes in order, each cut off at SIZE bytes (rows of `view` at `begin`), how many bytes each shares with the one before; 0 for the first."""
    out = np.zeros(len(begin), np.int64)
    for i in range(1, len(begin), step):
        here = slice(i, min(i + step, len(begin)))
        unlike = view[begin[here]] != view[begin[here.start - 1 : here.stop - 1]]
        first = unlike.argmax(axis=1)
        out[here] = np.where(unlike[np.arange(len(first)), first], first, view.shape[1])
    return out


def previous_smaller(values: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest one before it with a smaller value, else -1, and the least of `common` (what each place shares
    with the one before) from behind that place up to it, else 0.

    All places follow their pointers at once; what a pointer skips is never smaller, so pointers may follow pointers.
    """
    out, low = np.arange(-1, len(values) - 1), common.copy()
    open_ = np.arange(len(values))
    while len(open_):
        at = out[open_]
        ends = (at < 0) | (low[open_] == 0)  # nothing is shared any more with what is further away
        out[open_[ends]], low[open_[ends]] = -1, 0
        open_, at = open_[~ends], at[~ends]
        climbs = values[at] >= values[open_]
        open_, at = open_[climbs], at[climbs]
        out[open_], low[open_] = out[at], np.minimum(low[open_], low[at])
    return out, low


def longest_previous(view: np.ndarray, begin: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The longest-previous-factor array of suffixes: rows of `view` (SIZE bytes of each place) at `begin`, each of a document.

    Of each suffix the length of the longest factor that it begins with and that also begins a suffix with a smaller id,
    SIZE for longer ones. In suffix order that factor is shared with the previous or the next smaller position; how much is
    shared with either is the least common prefix of neighbours between.
    """
    suffixes = np.ascontiguousarray(view[begin]).view(f"S{view.shape[1]}")[:, 0] if len(begin) else np.zeros(0, "S1")
    order = np.argsort(suffixes, kind="stable")
    del suffixes
    common, held = common_prefixes(view, begin[order]), ids[order]
    _, before = previous_smaller(held, common)
    _, after = previous_smaller(held[::-1], np.append(0, common[:0:-1]) if len(common) else common)
    out = np.zeros(len(ids), np.int64)
    out[order] = np.maximum(before, after[::-1])
    return out


def local_firsts(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each row has the smallest id of its key."""
    order = np.lexsort((ids, key))
    starts = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, bool)
    least = ids[order][np.maximum.accumulate(np.where(starts, np.arange(len(key)), 0))] if len(key) else ids
    out = np.zeros(len(key), bool)
    out[order] = ids[order] == least
    return out


def write_chunks(docs: DataFrame, uri: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """chunk, uri, path: files of whole texts with their ids; a longer text has a chunk of its own."""
    make_dir(uri)

    def run(batches):
        from pyspark import TaskContext

        system, base = file_system(uri)
        ids, texts, held, made = [], [], 0, 0
        number = TaskContext.get().partitionId() << 32

        def close():
            path = f"{base}/{uuid.uuid4().hex}"
            head = np.array([LAST_ID if i is None else i for i in ids], "<i8").tobytes() + np.array([i is not None for i in ids], "u1").tobytes() + np.array([len(t) for t in texts], "<i8").tobytes()
            with system.open_output_stream(path, compression=None) as out:
                out.write(len(ids).to_bytes(8, "little") + head + zstandard.ZstdCompressor(3).compress(b"".join(texts)))
            return pa.RecordBatch.from_arrays([pa.array([number + made], pa.int64()), pa.array([path])], ["chunk", "path"])

        for batch, values in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), values, strict=True):
                data = text.encode("utf-8", "surrogatepass")
                if held and held + len(data) > chunk_bytes:
                    yield close()
                    ids, texts, held, made = [], [], 0, made + 1
                ids.append(doc_id)
                texts.append(data)
                held += len(data)
        if ids:
            yield close()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return materialize(rows.mapInArrow(run, "chunk long, path string"), "chunks")


def read_chunk(uri: str, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids (null as the largest), whether each is known, bounds and bytes."""
    with file_system(uri)[0].open_input_file(path) as f:
        raw = f.read()
    n = int.from_bytes(raw[:8], "little")
    ids, known, sizes = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "u1", n, 8 + 8 * n), np.frombuffer(raw, "<i8", n, 8 + 9 * n)
    data = zstandard.ZstdDecompressor().decompress(raw[8 + 17 * n :])
    return ids, known.astype(bool), np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(data, np.uint8)


def _row(bucket: int, chunk: int, kind: int, data: bytes) -> tuple[int, int, int, bytes]:
    return int(bucket), int(chunk), kind, data


def _batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary())], ["bucket", "chunk", "kind", "pack"])


def _aside(chunk: int, buckets: int) -> int:
    """A bucket below 0 for rows that pass a stage as they are, spread over the tasks."""
    return -1 - (chunk + (chunk >> 32)) % buckets


def _by_bucket(bucket: np.ndarray):
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    return [(int(bucket[order[a]]), order[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def chunk_runs(chunks: DataFrame, uri: str, buckets: int) -> DataFrame:
    """Runs of every chunk by anchor bucket; runs that an earlier document of the same chunk repeats are done already, and
    those of anchors that are common in the chunk are asked for window by window, with a mark for the bucket."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, _, bounds, data = read_chunk(uri, row["path"])
                first, n, anchor, context, doc = anchored_runs(data, bounds)
                owner = ids[doc]
                mine = local_firsts(context, owner)
                aside = _aside(row["chunk"], buckets)
                rows = [_row(aside, row["chunk"], LOCAL, pack(first[~mine], n[~mine]))] if not mine.all() else []
                first, n, anchor, context, owner = (x[mine] for x in (first, n, anchor, context, owner))
                _, of, count = np.unique(anchor, return_inverse=True, return_counts=True)
                common = (count > COMMON)[of]
                low, bucket_of = (anchor & np.uint64(0xFFFFFFFF)).astype(np.uint32), ((anchor >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
                if common.any():
                    rows.append(_row(aside, row["chunk"], ASK, pack(first[common], n[common], np.ones(int(common.sum()), np.int64))))
                    for bucket, at in _by_bucket(bucket_of[common]):
                        rows.append(_row(bucket, row["chunk"], MARK, pack(np.unique(low[common][at]))))
                first, n, low, bucket_of, context, owner = (x[~common] for x in (first, n, low, bucket_of, context, owner))
                for bucket, at in _by_bucket(bucket_of):
                    rows.append(_row(bucket, row["chunk"], ASK, pack(low[at], context[at], first[at], n[at], owner[at])))
                yield _batch(rows)

    return chunks.mapInArrow(run, PACKED)


def resolve_classes(rows: DataFrame) -> DataFrame:
    """Per bucket: runs whose class has a smaller doc_id are done; first runs of anchors with several classes are asked for."""

    def run(batches):
        for bucket, table in runs(batches, "bucket"):
            if bucket < 0:
                yield from (b.select(["bucket", "chunk", "kind", "pack"]) for b in table.to_batches())
                continue
            kinds, numbers, data = (table.column(name).to_pylist() for name in ("kind", "chunk", "pack"))
            marks = [unpack(x, np.uint32)[0] for x, kind in zip(data, kinds, strict=True) if kind == MARK]
            chunks, packs = [c for c, kind in zip(numbers, kinds, strict=True) if kind == ASK], [unpack(x, np.uint32, np.uint64, np.int64, np.int64, np.int64) for x, kind in zip(data, kinds, strict=True) if kind == ASK]
            if not packs:
                continue
            chunk = np.repeat(np.array(chunks, np.int64), [len(p[0]) for p in packs])
            anchor, context, first, n, owner = (np.concatenate([p[i] for p in packs]) for i in range(5))
            del packs, data, table
            order = np.lexsort((owner, context, anchor))
            chunk, anchor, context, first, n, owner = (x[order] for x in (chunk, anchor, context, first, n, owner))
            index = np.arange(len(anchor))
            new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
            new_class = new_anchor | np.concatenate([[True], context[1:] != context[:-1]])
            least = owner[np.maximum.accumulate(np.where(new_class, index, 0))]
            done = owner > least
            group = np.cumsum(new_anchor) - 1
            starts = np.flatnonzero(new_anchor)
            classes = np.add.reduceat(new_class.astype(np.int64), starts)
            differ = np.maximum.reduceat(np.where(new_class, owner, -(2**63)), starts) > np.minimum.reduceat(owner, starts)
            common = np.isin(anchor, np.unique(np.concatenate(marks))) if marks else np.zeros(len(anchor), bool)
            ask = ~done & ((differ & (classes > 1))[group] | common)
            many = (classes > MANY_CLASSES)[group] | common
            out = []
            for kind, chosen in ((DONE, np.flatnonzero(done)), (ASK, np.flatnonzero(ask))):
                for _, at in _by_bucket(np.unique(chunk[chosen], return_inverse=True)[1]) if len(chosen) else []:
                    at = chosen[at]
                    at = at[np.argsort(first[at], kind="stable")]
                    extra = (many[at].astype(np.int64),) if kind == ASK else ()
                    out.append(_row(bucket, chunk[at[0]], kind, pack(first[at], n[at], *extra)))
            yield _batch(out)

    keyed = rows.repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket")
    return keyed.mapInArrow(run, PACKED)


def _windows(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Starts of all windows of the runs."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def window_hashes(data: np.ndarray, at: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """A hash of each window, worked out for some at a time."""
    view, weights = np.lib.stride_tricks.sliding_window_view(data, SIZE), spans.powers(spans.BASE, 64)[:SIZE]
    parts = [view[at[i : i + step]].astype(np.uint64) @ weights for i in range(0, len(at), step)]
    return spans.mix(np.concatenate([np.zeros(0, np.uint64), *parts]))


def window_firsts(data: np.ndarray, at: np.ndarray, owner: np.ndarray, hashed: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """Whether no equal window of the chunk has a smaller id. Windows with equal hashes are compared byte by byte."""
    order = np.lexsort((owner, hashed))
    new = np.concatenate([[True], hashed[order][1:] != hashed[order][:-1]])
    same, view = np.flatnonzero(~new), np.lib.stride_tricks.sliding_window_view(data, SIZE)
    for i in range(0, len(same), step):
        part = same[i : i + step]
        new[part] = (view[at[order[part]]] != view[at[order[part - 1]]]).any(axis=1)
    start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    out = np.zeros(len(at), bool)
    out[order] = owner[order[start]] == owner[order]
    return out


def contexts(asked: DataFrame, chunks: DataFrame, uri: str, buckets: int) -> DataFrame:
    """The bytes of the runs that were asked for, by bucket; runs of very common anchors window by window."""

    def run(batches):
        for chunk, table in runs(batches, "chunk"):
            ids, _, bounds, data = read_chunk(uri, table.column("path")[0].as_py())
            doc = lambda first: ids[np.searchsorted(bounds, first, "right") - 1]  # noqa: B023, E731
            rows, common = [], []
            for bucket, packed in zip(table.column("bucket").to_pylist(), table.column("pack").to_pylist(), strict=True):
                first, n, many = unpack(packed, np.int64, np.int64, np.int64)
                common.append((first[many > 0], n[many > 0]))
                first, n = first[many == 0], n[many == 0]
                if len(first):
                    text = b"".join(data[a : a + m + SIZE - 1].tobytes() for a, m in zip(first.tolist(), n.tolist(), strict=True))
                    rows.append(_row(bucket, chunk, CONTEXT, _joined(text, pack(first, n, doc(first)))))
            first, n = (np.concatenate(x) for x in zip(*common, strict=True))
            if len(first):
                at = _windows(first, n)
                owner, hashed = doc(at), window_hashes(data, at)
                mine = window_firsts(data, at, owner, hashed)
                if not mine.all():
                    done = np.sort(at[~mine])
                    rows.append(_row(_aside(chunk, buckets), chunk, LOCAL, pack(done, np.ones_like(done))))
                at, owner, hashed = at[mine], owner[mine], hashed[mine]
                for bucket, chosen in _by_bucket((hashed % np.uint64(buckets)).astype(np.int64)):
                    chosen = chosen[np.argsort(at[chosen], kind="stable")]
                    text = np.lib.stride_tricks.sliding_window_view(data, SIZE)[at[chosen]].tobytes()
                    rows.append(_row(bucket, chunk, CONTEXT, _joined(text, pack(at[chosen], np.ones(len(chosen), np.int64), owner[chosen]))))
            yield _batch(rows)

    wanted = asked.join(chunks, "chunk").repartition(partitions(asked.sparkSession), "chunk").sortWithinPartitions("chunk")
    return wanted.select("bucket", "chunk", "pack", "path").mapInArrow(run, PACKED)


def _joined(text: bytes, packed: bytes) -> bytes:
    squeezed = zlib.compress(text, 1)
    return len(squeezed).to_bytes(4, "little") + squeezed + packed


def resolve_windows(rows: DataFrame) -> DataFrame:
    """Per bucket: the suffixes that the contexts' windows begin, in order, and those whose longest previous factor is long enough."""

    def run(batches):
        for bucket, table in runs(batches, "bucket"):
            if bucket < 0:
                yield from (b.select(["bucket", "chunk", "kind", "pack"]) for b in table.to_batches())
                continue
            texts, chunk, start, owner, at = [], [], [], [], 0
            for number, data in zip(table.column("chunk").to_pylist(), table.column("pack").to_pylist(), strict=True):
                size = int.from_bytes(data[:4], "little")
                first, n, ids = unpack(data[4 + size :], np.int64, np.int64, np.int64)
                text = zlib.decompress(data[4 : 4 + size])
                length = n + SIZE - 1
                begin = at + np.cumsum(length) - length
                of = np.repeat(np.arange(len(n)), n)
                step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                texts.append(text)
                start.append(np.stack([begin[of] + step, first[of] + step]))
                owner.append(ids[of])
                chunk.append(np.full(len(of), number))
                at += len(text)
            joined = np.frombuffer(b"".join(texts), np.uint8)
            (begin, place), owner, chunk = np.concatenate(start, axis=1), np.concatenate(owner), np.concatenate(chunk)
            found = np.flatnonzero(longest_previous(np.lib.stride_tricks.sliding_window_view(joined, SIZE), begin, owner) >= SIZE)
            out = []
            for _, chosen in _by_bucket(np.unique(chunk[found], return_inverse=True)[1]) if len(found) else []:
                mine = np.unique(place[found[chosen]])
                out.append(_row(bucket, chunk[found[chosen[0]]], DONE, pack(mine, np.ones_like(mine))))
            yield _batch(out)

    keyed = rows.repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket")
    return keyed.mapInArrow(run, PACKED)


def removed_spans(docs: DataFrame, keep_text: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row (and kept, its remaining bytes, if keep_text).

    Null texts count as empty; texts shorter than SIZE bytes lose nothing; texts of any length are taken whole, with a chunk
    of their own past chunk_bytes. Rows of one doc_id, repeated or not, are not earlier than each other; rows with a null
    doc_id come after all others, and are not earlier than each other. Strings are judged on the input, not on what is
    left. Empty tables give no rows; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    spark, uri = docs.sparkSession, shared_dir(docs.sparkSession, "texts")
    buckets = 2 * partitions(spark)
    chunks = write_chunks(docs, uri, chunk_bytes)
    first = materialize(resolve_classes(chunk_runs(chunks.repartition(partitions(spark), "chunk"), uri, buckets)), "classes")
    asked = first.where(f"kind = {ASK}").select("bucket", "chunk", "pack")
    second = materialize(resolve_windows(contexts(asked, chunks, uri, buckets)), "windows")
    done = first.where(f"kind <> {ASK}").unionByName(second).select("chunk", "pack")
    every = chunks.select("chunk", "path", F.lit(None).cast("binary").alias("pack")).unionByName(done.select("chunk", F.lit(None).cast("string").alias("path"), "pack"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def run(batches):
        for _, table in runs(batches, "chunk"):
            path = next(x for x in table.column("path").to_pylist() if x)
            ids, known, bounds, data = read_chunk(uri, path)
            change = np.zeros(len(data) + 1, np.int32)
            for packed in table.column("pack").to_pylist():
                if packed is not None:
                    at, n = unpack(packed, np.int64, np.int64)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + n + SIZE - 1, -1)
            gone = np.cumsum(change[:-1], out=change[:-1]) > 0
            total = np.concatenate([np.zeros(1, np.int32), np.cumsum(gone, dtype=np.int32)]) if len(gone) < 2**31 else np.concatenate([[0], np.cumsum(gone)])
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            inner = bounds[:-1][bounds[:-1] < len(data)]
            edge[inner] = gone[inner]
            edges = np.concatenate([np.zeros(1, total.dtype), np.cumsum(edge, dtype=total.dtype)])
            kept = data[~gone].tobytes()
            keep_bounds = bounds - total[bounds]
            parts = [kept[a:b] for a, b in zip(keep_bounds, keep_bounds[1:], strict=False)]
            columns = [pa.array(ids, mask=~known), pa.array(np.diff(bounds)), pa.array(np.diff(total[bounds]).astype(np.int64)), pa.array(np.diff(edges[bounds]).astype(np.int64)), pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())]
            columns += [pa.array(parts, pa.binary())] * keep_text
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(columns)])

    keyed = every.repartition(partitions(spark), "chunk").sortWithinPartitions("chunk")
    return keyed.mapInArrow(run, schema)
