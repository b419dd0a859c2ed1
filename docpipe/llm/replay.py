"""Byte-level BPE by replaying the merges over a corpus of words.

The words that a slice of texts adds to what is known are one corpus. An inverted index leads from what a pair of
neighbours merges into, its rank, to the places of such pairs in all words. The ranks are taken in order; each merges
the pairs that are still there and looks only at the two new neighbours of each.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docpipe.llm import spans, tokens
from docpipe.llm.common import bounded_batches, slices, text_or_empty


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file of lines of a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@cache
def pattern_classes() -> np.ndarray:
    """Classes of code points as the splitting library's own expressions see them, which may know other Unicode versions."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.full(0x110000, spans.OTHER, np.uint8)
    for kind, pattern in ((spans.LETTER, r"\p{L}"), (spans.NUMBER, r"\p{N}"), (spans.WHITE, r"\s")):
        held = tiktoken.Encoding(f"class {kind}", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        table[np.frombuffer(bytes(held.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = kind
    table[32] = spans.SPACE
    return table


class MergeReplay:
    """A vocabulary of ranks (every byte is a token): encoding of many texts at once, and decoding."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        self.texts = [b""] * self.size
        for token, rank in ranks.items():
            self.texts[rank] = token
        #: left * size + right of two tokens that together are a token, to its rank
        self.pairs = {ranks[token[:i]] * self.size + ranks[token[i:]]: rank for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.first = np.full(1 << 16, -1, np.int64)  # ranks of pairs of bytes
        for token, rank in ranks.items():
            if len(token) == 2:
                self.first[token[0] << 8 | token[1]] = rank
        self.pieces = tokens.PieceCache(self.encode_pieces)

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Each piece's ids; a piece that is a token takes its rank, whether merges lead to it or not."""
        words = [piece.encode() for piece in pieces]
        whole = [self.ranks.get(word) for word in words]
        merged = iter(self.replay([word for word, rank in zip(words, whole, strict=True) if rank is None]))
        return [next(merged) if rank is None else [rank] for rank in whole]

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The ids that the merges leave of each word (none empty).

        A word's merges follow in the order of ranks, equal ones from the left. A merge may make a pair of a rank that has
        passed; such pairs stand beside it and are merged at once, before the next place of the rank at hand. So each word
        sees the order that it would see alone. In all n bytes there are at most n merges, each of which looks at two pairs.
        """
        data = np.frombuffer(b"".join(words), np.uint8)
        n, size, pairs = len(data), self.size, self.pairs
        ends = np.cumsum([len(word) for word in words], dtype=np.int64)
        token = array("q", np.append(self.single[data], -size * size).tobytes())  # the last is no token and pairs with none
        follow = np.arange(1, n + 2)
        ahead = np.arange(-1, n)
        follow[ends - 1] = n
        ahead[(ends - np.diff(ends, prepend=0))] = n
        after, before = array("q", follow.tobytes()), array("q", ahead.tobytes())
        rank_at = self.first[data[:-1].astype(np.int64) << 8 | data[1:]] if n > 1 else np.zeros(0, np.int64)
        rank_at[ends[:-1] - 1] = -1
        places = np.flatnonzero(rank_at >= 0)
        places = places[np.argsort(rank_at[places], kind="stable")]
        present, starts = np.unique(rank_at[places], return_index=True)
        index: dict[int, list[int]] = {rank: part.tolist() for rank, part in zip(present.tolist(), np.split(places, starts[1:]), strict=True)} if len(present) else {}
        order = list(index)
        heapify(order)
        get = pairs.get

        while order:
            rank = heappop(order)
            at = index.pop(rank)
            at.sort()
            for i in at:
                if get(token[i] * size + token[after[i]]) != rank:
                    continue
                now, place, todo = rank, i, []
                while True:
                    gone = after[place]
                    right, left = after[gone], before[place]
                    token[place], token[gone] = now, -1
                    after[place] = right
                    before[right] = place
                    for new, where in ((get(token[left] * size + now), left), (get(now * size + token[right]), place)):
                        if new is None:
                            continue
                        if new <= rank:
                            heappush(todo, (new, where))
                        elif new in index:
                            index[new].append(where)
                        else:
                            index[new] = [where]
                            heappush(order, new)
                    while todo and get(token[todo[0][1]] * size + token[after[todo[0][1]]]) != todo[0][0]:
                        heappop(todo)
                    if not todo:
                        break
                    now, place = heappop(todo)
        left = np.frombuffer(token, np.int64)[:n]
        kept = left >= 0
        bounds = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])].tolist()
        ids = left[kept].tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Each text's ids."""
        codes, offsets = spans.code_points(texts)
        starts, ends = tokens.glued_pieces(codes, offsets, pattern_classes())
        ids, counts = self.pieces.ids(codes, starts, ends, texts)
        total = np.concatenate([[0], np.cumsum(counts)])
        bounds = total[np.searchsorted(starts, offsets)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield ids[a:b]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.texts.__getitem__, ids.tolist()))


@cache
def model(path: str) -> MergeReplay:
    return MergeReplay(read_ranks(path))


def encode_decode(docs: DataFrame, ranks: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of doc_id and text and, if keep_ids, token_ids and decoded (bytes).

    Null texts count as empty; an empty text has no ids and decodes to nothing. Repeated rows stay repeated, null ids stay,
    empty tables give no rows; other columns of `docs` are dropped, so their names can't clash. One narrow pass without a
    shuffle: a task replays the merges over the words of a slice of texts that it has not met yet, and keeps a bounded
    number of them. A word without end, as in texts without spaces, takes time n log n and about 100 bytes for each of its own.
    """
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>, decoded binary" * keep_ids

    def run(batches):
        bpe = model(ranks)
        for batch, texts in slices(batches, "text", 1_000_000):
            rows: list[list] = [[], [], [], [], []]
            for ids in bpe.encode(texts):
                data = bpe.decode(ids)
                rows[0].append(len(ids))
                rows[1].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                rows[2].append(hashlib.sha256(data).hexdigest())
                if keep_ids:
                    rows[3].append(ids.astype(np.int32))
                    rows[4].append(data)
            columns = [batch.column("doc_id"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
            if keep_ids:
                columns += [pa.array(rows[3], pa.list_(pa.int32())), pa.array(rows[4], pa.binary())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)
