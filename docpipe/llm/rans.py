"""Token archives: files of token ids under a static range asymmetric numeral system (rANS).

File: groups, each of a magic, a frequency table that all the group's blocks share, and the blocks. A block holds whole documents, decodes on
its own, interleaves LANES rANS states (token t belongs to lane t mod LANES), and has a crc32 of its ids, a crc32 of its
bytes and checkpoints (lane states and place in the payload) from which decoding can begin inside the block. Files are
named in the order of the documents; the manifest table names the files and blocks of successful task attempts only.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docpipe.llm import spans, tokens
from docpipe.llm.common import bounded_batches, file_system, make_dir, materialize, partitions, shared_dir, slices, text_or_empty

MAGIC = b"DPRANS01"
BITS = 18
LANES = 4096
BLOCK_TOKENS = 1 << 20
#: Tokens that share a frequency table and are held at a time; a file holds many such groups.
GROUP_TOKENS = 1 << 22
CHECKPOINT_STEPS = 128
LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<IIIIIIII")


class CorruptBlock(ValueError):
    """A checksum of a table or block does not fit its bytes."""


def frequencies(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positive integers in proportion to positive counts that sum to 2**bits, or to more where there are more symbols."""
    bits = max(bits, (2 * len(counts)).bit_length())
    total = 1 << bits
    if not len(counts):
        return np.zeros(0, np.int64)
    out = np.maximum(1, counts.astype(np.float64) * total / counts.sum()).astype(np.int64)
    while (excess := int(out.sum()) - total) > 0:
        order = np.argsort(-out, kind="stable")[: max(1, excess)]
        order = order[out[order] > 1]
        out[order] -= np.minimum(out[order] - 1, max(1, excess // max(1, len(order))))
        if out.sum() < total:
            break
    out[int(np.argmax(out))] += total - int(out.sum())
    return out


def table_bits(freq: np.ndarray) -> int:
    """Whose power of two the frequencies sum to."""
    return max(0, int(freq.sum()).bit_length() - 1)


def encode_lanes(index: np.ndarray, freq: np.ndarray, start: np.ndarray, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """The final states, the 32-bit words in the decoder's order, and checkpoints (step, place, states)."""
    f, c, bits = freq[index].astype(np.uint64), start[index].astype(np.uint64), table_bits(freq)
    limit = f << np.uint64(63 - bits)
    state, chunks, marks, written = np.full(lanes, LOW, np.uint64), [], [], 0
    for step in reversed(range(-(-len(index) // lanes))):
        part = slice(step * lanes, min(len(index), (step + 1) * lanes))
        x = state[: part.stop - part.start]
        over = x >= limit[part]
        if over.any():
            chunks.append((x[over] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            written += len(chunks[-1])
            x[over] >>= np.uint64(32)
        quotient = x // f[part]
        x[:] = (quotient << np.uint64(bits)) + (x - quotient * f[part]) + c[part]
        if step and step % every == 0:
            marks.append((step, written, state.copy()))
    words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, np.uint32)
    return state, words, [(step, len(words) - at, x) for step, at, x in reversed(marks)]


def decode_lanes(n: int, state: np.ndarray, words: np.ndarray, freq: np.ndarray, start: np.ndarray, slots: np.ndarray, first_step: int = 0, at: int = 0, last_step: int | None = None) -> np.ndarray:
    """Symbol indexes of the steps from first_step up to last_step, of a block of n tokens."""
    lanes, steps = len(state), -(-n // max(1, len(state)))
    bits = table_bits(freq)
    last_step = steps if last_step is None else min(last_step, steps)
    state, f, c, mask = state.copy(), freq.astype(np.uint64), start.astype(np.uint64), np.uint64((1 << bits) - 1)
    out = np.empty(max(0, min(n, last_step * lanes) - first_step * lanes), np.int32)
    for step in range(first_step, last_step):
        x = state[: min(n, (step + 1) * lanes) - step * lanes]
        slot = x & mask
        k = slots[slot]
        out[(step - first_step) * lanes : (step - first_step) * lanes + len(x)] = k
        x[:] = f[k] * (x >> np.uint64(bits)) + slot - c[k]
        low = np.flatnonzero(x < LOW)
        x[low] = (x[low] << np.uint64(32)) | words[at : at + len(low)]
        at += len(low)
    return out


def pack_block(ids: np.ndarray, symbols: np.ndarray, freq: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, counts: np.ndarray) -> bytes:
    start = np.cumsum(freq) - freq
    lanes = max(1, min(LANES, len(ids) // 64))
    place = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 1, np.int32)
    place[symbols] = np.arange(len(symbols))
    state, words, marks = encode_lanes(place[ids], freq, start, lanes=lanes)
    directory = zlib.compress(doc_ids.astype("<i8").tobytes() + known.astype("u1").tobytes() + counts.astype("<u4").tobytes(), 1)
    body = directory + state.astype("<u8").tobytes() + b"".join(struct.pack("<II", step, at) + x.astype("<u8").tobytes() for step, at, x in marks) + words.astype("<u4").tobytes()
    return HEAD.pack(len(ids), len(doc_ids), lanes, len(words), len(marks), len(directory), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def unpack_block(data: bytes, symbols: np.ndarray, freq: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, whether each is known (not null), counts and all ids; CorruptBlock if a checksum fails."""
    n, docs, lanes, n_words, n_marks, n_dir, ids_crc, body_crc = HEAD.unpack_from(data)
    body = data[HEAD.size :]
    if zlib.crc32(body) != body_crc:
        raise CorruptBlock("block bytes")
    plain = zlib.decompress(body[:n_dir])
    doc_ids, known, counts = np.frombuffer(plain, "<i8", docs), np.frombuffer(plain, "u1", docs, 8 * docs), np.frombuffer(plain, "<u4", docs, 9 * docs)
    state = np.frombuffer(body, "<u8", lanes, n_dir)
    words = np.frombuffer(body, "<u4", n_words, n_dir + 8 * lanes + n_marks * (8 + 8 * lanes))
    ids = symbols[decode_lanes(n, state, words, freq, np.cumsum(freq) - freq, slots)]
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise CorruptBlock("block ids")
    return doc_ids, known.astype(bool), counts, ids


def decode_from(data: bytes, step: int, symbols: np.ndarray, freq: np.ndarray, slots: np.ndarray) -> tuple[int, np.ndarray]:
    """Decodes a block from the last checkpoint at or before `step`: the first token's place and the ids from there on.

    The block's bytes are checked, its ids can't be, as they are not all decoded; CorruptBlock if the check fails.
    """
    n, _, lanes, n_words, n_marks, n_dir, _, body_crc = HEAD.unpack_from(data)
    if zlib.crc32(memoryview(data)[HEAD.size :]) != body_crc:
        raise CorruptBlock("block bytes")
    at = HEAD.size + n_dir
    words = np.frombuffer(data, "<u4", n_words, at + 8 * lanes + n_marks * (8 + 8 * lanes))
    best = (0, 0, np.frombuffer(data, "<u8", lanes, at))
    for i in range(n_marks):
        here = at + 8 * lanes + i * (8 + 8 * lanes)
        mark, place = struct.unpack_from("<II", data, here)
        if mark <= step:
            best = (mark, place, np.frombuffer(data, "<u8", lanes, here + 8))
    return best[0] * lanes, symbols[decode_lanes(n, best[2], words, freq, np.cumsum(freq) - freq, slots, first_step=best[0], at=best[1])]


def pack_table(symbols: np.ndarray, freq: np.ndarray) -> bytes:
    plain = zlib.compress(symbols.astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 6)
    return MAGIC + struct.pack("<III", len(symbols), len(plain), zlib.crc32(plain)) + plain


def unpack_table(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, frequencies, and the symbol index of each slot."""
    k, size, crc = struct.unpack_from("<III", data, len(MAGIC))
    plain = data[len(MAGIC) + 12 : len(MAGIC) + 12 + size]
    if data[: len(MAGIC)] != MAGIC or zlib.crc32(plain) != crc:
        raise CorruptBlock("file table")
    both = np.frombuffer(zlib.decompress(plain), "<u4").astype(np.int64)
    return both[:k], both[k:], np.repeat(np.arange(k, dtype=np.int32), both[k:])


class ByteBPE:
    """The byte-level tokenizer: pre-tokens are cut in numpy, the library's model encodes those not yet seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.specials = [x["content"] for x in tokens.read_model(path)["added_tokens"]]
        tokens.read_model.cache_clear()
        merge = self.whole.model.tokenize
        self.pieces = tokens.PieceCache(lambda pieces: [[x.id for x in merge(tokens.letters_of(piece))] for piece in pieces])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        special = {i for i, text in enumerate(texts) if any(s in text for s in self.specials)}
        plain = ["" if i in special else text for i, text in enumerate(texts)]
        codes, offsets = spans.code_points(plain)
        starts, ends = tokens.glued_pieces(codes, offsets)
        ids, counts = self.pieces.ids(codes, starts, ends, plain)
        bounds = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, offsets)]
        return [np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32) if i in special else ids[bounds[i] : bounds[i + 1]] for i, text in enumerate(texts)]


@cache
def byte_model(path: str) -> ByteBPE:
    return ByteBPE(path)


BLOCKS = "part int, block int, path string, at long, size long, n_tokens long, n_docs long, table_at long, table_size long"


def write_archive(docs: DataFrame, tokenizer: str, end_id: int = 0, uri: str | None = None) -> DataFrame:
    """Tokenizes doc_id and text, appends end_id to each document and writes archive files in ascending doc_id order.

    Returns the manifest, a row per block. Null texts count as empty (only the end id); null doc_ids come first; rows of
    one doc_id stand by a hash of their text, then by text, so many rows of one id, or without one, are spread over
    tasks. Empty tables give no blocks; other columns are not read. A range shuffle orders the documents; each task writes
    a file of its own, holding GROUP_TOKENS ids (or one longer document) at a time. A retried task writes under a new name,
    and the manifest, written by Spark, holds the names of committed attempts only.
    """
    spark = docs.sparkSession
    bounded_batches(docs.sparkSession)
    uri = uri or shared_dir(spark, "tokens")
    make_dir(uri)

    def run(batches):
        from pyspark import TaskContext

        part, bpe, system, base = TaskContext.get().partitionId(), byte_model(tokenizer), *file_system(uri)
        path = f"{base}/part-{part:06d}-{uuid.uuid4().hex}.rans"
        out, at, made = None, 0, 0
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []

        def group() -> pa.RecordBatch:
            nonlocal out, at, made
            out = out or system.open_output_stream(path, compression=None)
            symbols, counts = np.unique(np.concatenate(held), return_counts=True)
            freq = frequencies(counts)
            table, table_at = pack_table(symbols, freq), at
            out.write(table)
            at += len(table)
            sizes = np.array([len(x) for x in held])
            edges = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // BLOCK_TOKENS, prepend=-1, append=2**62))
            rows = []
            for a, b in zip(edges, edges[1:], strict=False):
                known = np.array([d is not None for d in doc_ids[a:b]])
                block = pack_block(np.concatenate(held[a:b]), symbols, freq, np.array([d or 0 for d in doc_ids[a:b]], np.int64), known, sizes[a:b])
                out.write(block)
                rows.append((part, made, path, at, len(block), int(sizes[a:b].sum()), int(b - a), table_at, len(table)))
                at, made = at + len(block), made + 1
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in rows], schema)

        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("path", pa.string()), *((name, pa.int64()) for name in ("at", "size", "n_tokens", "n_docs", "table_at", "table_size"))])
        total = 0
        for batch, texts in slices(batches, "text", 1_000_000):
            end = np.array([end_id], np.uint32)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), bpe.encode(texts), strict=True):
                held.append(np.concatenate([ids, end]))
                doc_ids.append(doc_id)
                total += len(ids) + 1
                if total >= GROUP_TOKENS:
                    yield group()
                    held.clear()
                    doc_ids.clear()
                    total = 0
        if held:
            yield group()
        if out is not None:
            out.close()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text"))
    keyed = rows.withColumn("__h", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(partitions(spark), "doc_id", "__h").sortWithinPartitions("doc_id", "__h", "text").drop("__h")
    return materialize(ordered.mapInArrow(run, BLOCKS), "manifest").withColumn("uri", F.lit(uri))


@lru_cache(8)
def _table(uri: str, path: str, at: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    with file_system(uri)[0].open_input_file(path) as f:
        return unpack_table(f.read_at(size, at))


def read_archive(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and token_ids, decoded from the files.

    A manifest without blocks gives no rows; a block whose checksum fails is an error.
    """
    order = ["part", "block"]
    files = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row per task that wrote
    before, total = {}, 0
    for row in files:
        before[row["part"]] = total
        total += row["n"]
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    base = manifest.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "part int, base long")
    blocks = manifest.join(base, "part").withColumn("start", F.col("base") + F.coalesce(within, F.lit(0)))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                table = _table(row["uri"], row["path"], row["table_at"], row["table_size"])
                with file_system(row["uri"])[0].open_input_file(row["path"]) as f:
                    doc_ids, known, counts, ids = unpack_block(f.read_at(row["size"], row["at"]), *table)
                ends = np.cumsum(counts.astype(np.int64))
                raw = ids.astype("<u4")
                parts = [raw[e - n : e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                columns = [pa.array(doc_ids, mask=~known), pa.array(row["start"] + ends - counts, pa.int64()), pa.array(counts.astype(np.int64)), pa.array([zlib.crc32(x.tobytes()) for x in parts], pa.int64())]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(raw.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*columns, lists], ["doc_id", "start", "n_tokens", "ids_crc32", "token_ids"])

    wide = blocks.select(*order, "path", "at", "size", "table_at", "table_size", "uri", "start").repartition(partitions(manifest.sparkSession), *order)
    return wide.sortWithinPartitions("path", "at").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, token_ids array<int>")


def token_archive(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes the archive of `docs` and reads it back: see write_archive for nulls, repeats and order."""
    return read_archive(write_archive(docs, tokenizer, end_id))
