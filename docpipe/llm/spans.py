"""Words of many texts at once: code points in one array, word bounds from character classes, and hashes of the words.

A word's hash is a polynomial over its code points modulo 2**64, from prefix sums, then mixed; so no word is made a
Python string unless it is new to a cache.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache, lru_cache

import numpy as np

LETTER, NUMBER, OTHER, SPACE, WHITE = 1, 2, 3, 4, 5
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
LONGEST = 1 << 20


@cache
def classes() -> np.ndarray:
    """By code point: letter, number, other, the space itself, other white space."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for code in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = LETTER
        elif kind == "N":
            table[code] = NUMBER
        elif kind == "Z":
            table[code] = WHITE
    table[[9, 10, 11, 12, 13, 0x85]] = WHITE
    table[32] = SPACE
    return table


@lru_cache(4)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points one after another, and where each text starts (with the end as the last)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each codes[start:end]; equal for equal contents wherever they stand."""
    size = 1 << max(20, int(len(codes)).bit_length())
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(BASE, size)[: len(codes)], out=total[1:])
    return mix((total[ends] - total[starts]) * powers(INVERSE, size)[starts] + (ends - starts).astype(np.uint64))


def word_bounds(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters and numbers (lower-cased text is expected); never across texts.

    Any other character ends a word, combining marks among them; a run without spaces, as in Chinese or Thai, is one word.
    """
    kind = classes()[codes]
    inside = np.concatenate([[False], (kind == LETTER) | (kind == NUMBER), [False]])
    first = np.zeros(len(codes) + 1, bool)
    first[offsets] = True
    edge = inside[1:] & (~inside[:-1] | first)
    last = inside[:-1] & (~inside[1:] | first)
    return np.flatnonzero(edge), np.flatnonzero(last)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words in order, and where each text's begin."""
    codes, offsets = code_points([t.lower() for t in texts])
    starts, ends = word_bounds(codes, offsets)
    return hashes(codes, starts, ends), np.searchsorted(starts, offsets)


def grams(single: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `words` words, with repeats, in order, and where each text's begin; shorter texts have none."""
    n = np.diff(at)
    with np.errstate(over="ignore"):
        joined = np.zeros(max(0, len(single) - words + 1), np.uint64)
        for i in range(words):
            joined = joined * np.uint64(BASE) + single[i : i + len(joined)]
    many = np.maximum(n - words + 1, 0)
    keep = np.zeros(len(single) + 1, np.int64)
    np.add.at(keep, at[:-1][many > 0], 1)
    np.add.at(keep, (at[:-1] + many)[many > 0], -1)
    return mix(joined[np.cumsum(keep)[: len(joined)] > 0]), np.concatenate([[0], np.cumsum(many)])


def shingles(texts: list[str], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `words` lower-cased words, with repeats, in order, and where each text's begin.

    A text with fewer words, but at least one, has one shingle: all its words.
    """
    single, at = word_hashes(texts)
    whole, edges = grams(single, at, words)
    n, many = np.diff(at), np.diff(edges)
    short = np.flatnonzero((many == 0) & (n > 0))
    if not len(short):
        return whole, edges
    bounds = np.concatenate([[0], np.cumsum(np.where((many == 0) & (n > 0), 1, many))])
    out = np.empty(bounds[-1], np.uint64)
    mask = np.ones(len(out), bool)
    mask[bounds[short]] = False
    out[mask] = whole
    for i in short:
        value = 0
        for x in single[at[i] : at[i + 1]].tolist():
            value = (value * BASE + x) % (1 << 64)
        out[bounds[i]] = mix(np.array([value + 0x5BD1 * int(n[i])], np.uint64))[0]
    return out, bounds
