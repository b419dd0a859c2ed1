"""Pre-tokens of byte-level tokenizers for many texts at once, and a bounded cache from pre-token to ids.

Both tokenizer files split texts into runs of letters, of numbers and of other characters, with the seven English
contractions; one glues a leading space to a run and keeps white space, the other drops it and cuts numbers singly.
The bounds come from character classes in numpy; only pre-tokens new to the cache are made strings and encoded.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cache
from itertools import chain, repeat

import numpy as np
import pandas as pd

from docpipe.llm import spans

# The contractions in the tokenizers' patterns.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def _contracted(codes: np.ndarray, kind: np.ndarray, start: np.ndarray, glued: np.ndarray, text_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Apostrophes that begin a contraction, and its length."""
    n = len(codes)
    at = np.flatnonzero((codes == ord("'")) & start[:n] & ~glued)
    at = at[at + 1 < n]
    at = at[(kind[at + 1] == spans.LETTER) & ~text_start[at + 1]]
    length = np.zeros(len(at), np.int64)
    for word in CONTRACTIONS:
        fits = at + len(word) <= n
        for i, c in enumerate(word):
            fits &= codes[np.minimum(at + i, n - 1)] == ord(c)
            if i > 1:
                fits &= ~start[np.minimum(at + i, n - 1)]
        length[fits] = len(word)
    return at[length > 0], length[length > 0]


def glued_pieces(codes: np.ndarray, offsets: np.ndarray, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pre-tokens that hold every character, where one space joins the run after it."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = (spans.classes() if classes is None else classes)[codes]
    blank = (kind == spans.SPACE) | (kind == spans.WHITE)
    group = np.where(blank, spans.SPACE, kind)
    text_start = np.zeros(n + 1, bool)
    text_start[offsets] = True
    text_start[n] = True
    run = np.ones(n + 1, bool)
    run[1:n] = (group[1:] != group[:-1]) | text_start[1:n]
    glued = np.zeros(n, bool)  # characters before which a space of the same pre-token stands
    start = run.copy()
    last = np.flatnonzero(blank & run[1:] & ~text_start[1:])  # last white space before a run
    single = kind[last] == spans.SPACE
    start[last] = True
    start[last[single] + 1] = False
    glued[last[single] + 1] = True
    at, length = _contracted(codes, kind, run, glued, text_start)
    start[at + 1] = False
    start[at + length] = True
    begin = np.flatnonzero(start[:n])
    return begin, np.append(begin[1:], n)


def bare_pieces(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pre-tokens without white space, where each number character stands alone."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = spans.classes()[codes]
    blank = (kind == spans.SPACE) | (kind == spans.WHITE)
    group = np.where(blank, spans.SPACE, kind)
    text_start = np.zeros(n + 1, bool)
    text_start[offsets] = True
    start = np.ones(n + 1, bool)
    start[1:n] = (group[1:] != group[:-1]) | (kind[1:] == spans.NUMBER) | text_start[1:n]
    at, length = _contracted(codes, kind, start, np.zeros(n, bool), text_start)
    start[at + 1] = False
    start[at + length] = True
    begin = np.flatnonzero(start[:n])
    end = np.append(begin[1:], n)
    keep = ~blank[begin]
    return begin[keep], end[keep]


def told_apart(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, of: np.ndarray, first: np.ndarray, most: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Groups of pieces with equal hashes (of: a piece's group, first: a group's first piece) made groups of equal contents.

    Every piece is compared with its group's first, in blocks of about `most` code points; those that differ get groups of
    their own.
    """
    lengths = ends - starts
    model = first[of]
    differs = lengths != lengths[model]
    rest = np.flatnonzero(~differs & (model != np.arange(len(of))))
    total = np.cumsum(lengths[rest])
    for block in np.split(rest, np.searchsorted(total, np.arange(most, total[-1], most))) if len(rest) else ():
        if not len(block):
            continue
        n = lengths[block]
        begin = np.cumsum(n) - n
        step = np.arange(begin[-1] + n[-1]) - np.repeat(begin, n)
        unlike = codes[np.repeat(starts[block], n) + step] != codes[np.repeat(starts[model[block]], n) + step]
        differs[block] = np.logical_or.reduceat(unlike, begin)
    odd = np.flatnonzero(differs)
    if not len(odd):
        return of, first
    of, more, known = of.copy(), [], {}
    for i in odd.tolist():
        content = codes[starts[i] : ends[i]].tobytes()
        if content not in known:
            known[content] = len(first) + len(more)
            more.append(i)
        of[i] = known[content]
    return of, np.concatenate([first, np.array(more, first.dtype)])


class PieceCache:
    """Ids of pre-tokens by their text, in one growing array; emptied when it holds `most` pre-tokens, or fifty times as many
    ids (a bound on memory, not on the input)."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = 200_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.flat, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def ids(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens one after another, and each pre-token's count of ids."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        of, keys = pd.factorize(spans.hashes(codes, starts, ends))
        first = np.zeros(len(keys), np.int64)
        first[of[::-1]] = np.arange(len(of))[::-1]
        of, first = told_apart(codes, starts, ends, of, first)
        joined = "".join(texts)
        pieces = [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        if len(self.slots) > self.most or len(self.flat) > 50 * self.most:
            self.clear()
        slot = np.fromiter(map(self.slots.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(slot < 0)
        if len(new):
            unseen = [pieces[i] for i in new.tolist()]
            found = self.encode(unseen)
            slot[new] = np.arange(len(self.slots), len(self.slots) + len(new))
            self.slots.update(zip(unseen, slot[new].tolist(), strict=True))
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.uint32, int(self.bounds[-1]) - len(self.flat))])
        mine = slot[of]
        at = self.bounds[mine]
        counts = self.bounds[mine + 1] - at
        where = np.repeat(at - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return self.flat[where], counts


@cache
def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself where printable, else 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def letters_of(piece: str) -> str:
    return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(byte_letters())


@cache
def letter_bytes() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_letters())}


@cache
def read_model(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)
