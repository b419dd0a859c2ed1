"""Periodic runs of words by bit-parallel lags.

Word ids of many texts lie one after another, a separator behind each text, and every bit of the ids is a plane: one big
integer. At a lag, planes are XORed with themselves shifted, and the mismatches of all planes are ORed; what is left
zero are words equal to the one a lag further on. ANDing the matches with themselves, shifted by 1, 2, 4 and so on, leaves
only the beginnings of stretches that are long enough for a run.

Lags below SHORT are tried over all texts at once. A run of a longer lag repeats whole grams of words, so lags from k to
2k - 1 are tried only where a gram of k words comes again within 2k words: long texts cost what their repeats cost.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docpipe.llm.common import bounded_batches, slices, text_or_empty

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Lags that are tried everywhere; a power of two, above half of LEAST.
SHORT = 16
#: A run's least length in words, and in periods.
LEAST, PERIODS = 12, 2
#: Planes that are looked at between two tests whether a match that is long enough is left.
PLANES = 3


def long_stretches(bits: int, least: int) -> int:
    """The bits at which a stretch of at least `least` set bits begins or goes on with as many to come."""
    have = 1
    while have < least and bits:
        step = min(have, least - have)
        bits &= bits >> step
        have += step
    return bits


def planes(ids: np.ndarray) -> list[int]:
    """The ids' bits as big integers, one for each binary digit; bit i of each belongs to word i."""
    return [int.from_bytes(np.packbits((ids >> b) & 1, bitorder="little").tobytes(), "little") for b in range(max(1, int(ids.max(initial=0)).bit_length()))]


def edges_of(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the stretches of set bits."""
    size = (bits.bit_length() + 7) // 8
    flat = np.unpackbits(np.frombuffer(bits.to_bytes(size, "little"), np.uint8), bitorder="little")
    step = np.diff(flat.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1


def stretches_at(word_planes: list[int], borders: int, n: int, lag: int) -> Iterator[tuple[int, int]]:
    """Start and end of each longest stretch with the lag as a period that is long enough for a run."""
    least = max(LEAST - lag, (PERIODS - 1) * lag)
    if n - lag < least:
        return
    inside = (1 << (n - lag)) - 1
    unlike, left = borders | borders >> lag, 0
    for at in range(0, len(word_planes), PLANES):
        for plane in word_planes[at : at + PLANES]:
            unlike |= plane ^ (plane >> lag)
        left = long_stretches(inside & ~unlike, least)
        if not left:
            return
    first, last = edges_of(left)
    yield from zip(first.tolist(), (last + least + lag).tolist(), strict=True)


def grams_doubled(ids: np.ndarray, live: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of grams of 2k words from those of k words (ids at the places `live`, in order), and their places.

    Only places whose gram of k words occurs again can have one of 2k words that does.
    """
    at = np.full(n + 1, -1, np.int64)
    at[live] = ids
    later = at[np.minimum(live + k, n)]
    both = later >= 0
    live, pair = live[both], ids[both] * (int(ids.max(initial=0)) + 1) + later[both]
    _, new, count = np.unique(pair, return_inverse=True, return_counts=True)
    again = count[new] > 1
    return new[again], live[again]


def next_places(ids: np.ndarray, live: np.ndarray) -> np.ndarray:
    """How far from each live place its gram comes again; a number beyond all distances where it doesn't."""
    order = np.argsort(ids, kind="stable")
    gap = np.full(len(ids), np.iinfo(np.int64).max)
    same = ids[order[1:]] == ids[order[:-1]]
    gap[order[:-1][same]] = (live[order[1:]] - live[order[:-1]])[same]
    return gap


def periodic_runs(ids: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """start, end, smallest period of every run in the texts ids[bounds[t] : bounds[t + 1] - 1]; the last place of each text
    is a separator, whose id is not used.

    A stretch that some lag leaves and a smaller lag has left before is the same run with a multiple of its period. Two runs
    with different smallest periods p and q share fewer than p + q words. So within a known run whose period is below k, no
    run of a lag from k to 2k - 1 can match at a place 4k or more from both of its ends, nor lie between an end that is its
    text's and the other one: such places are left out.
    """
    n = len(ids)
    found: dict[tuple[int, int], int] = {}
    if n < LEAST:
        return []
    separators = bounds[1:] - 1
    lone = np.zeros(n, np.int64)
    lone[separators] = 1
    borders = planes(lone)[0]
    everywhere = planes(ids)
    longest = int(np.diff(bounds).max()) - 1
    for lag in range(1, min(SHORT, longest)):
        for run in stretches_at(everywhere, borders, n, lag):
            found.setdefault(run, lag)
    words = ids.copy()
    words[separators] = ids.max() + 1 + np.arange(len(separators))
    gram, live, k = words, np.arange(n), 1
    text_of = None
    while 2 * k <= longest // 2 or k < SHORT:
        gram, live = grams_doubled(gram, live, n, k)
        k *= 2
        if not len(live):
            break
        if k < SHORT or PERIODS * k > longest:
            continue
        near = next_places(gram, live) < 2 * k
        places = live[near]
        if not len(places):
            continue
        if text_of is None:
            text_of = np.repeat(np.arange(len(separators)), np.diff(bounds))
        known = np.array([(a, b) for (a, b), p in found.items() if p < k], np.int64).reshape(-1, 2)
        begin, end = bounds[text_of[known[:, 0]]], separators[text_of[known[:, 0]]]
        low = np.where(known[:, 0] == begin, known[:, 0], known[:, 0] + 4 * k)
        high = np.where(known[:, 1] == end, known[:, 1] - 1, known[:, 1] - 4 * k)
        deep = np.zeros(n + 1, np.int64)
        np.add.at(deep, low[low <= high], 1)
        np.add.at(deep, high[low <= high] + 1, -1)
        places = places[np.cumsum(deep)[places] == 0]
        if not len(places):
            continue
        new = np.flatnonzero(np.diff(places, prepend=-2) > 1)
        first, last = places[new], places[np.append(new[1:], len(places)) - 1]
        tail = separators.copy()  # where the longest known run up to each text's end begins
        to_end = known[:, 1] == end
        np.minimum.at(tail, text_of[known[to_end, 0]], known[to_end, 0])
        kept = first < tail[text_of[first]]
        first, last = first[kept], last[kept]
        if not len(first):
            continue
        stop = np.minimum(last + 3 * k, separators[text_of[last]])
        cut = np.flatnonzero(np.append(True, first[1:] >= np.maximum.accumulate(stop)[:-1]))
        for a, b in zip(first[cut].tolist(), np.maximum.reduceat(stop, cut).tolist(), strict=True):
            part = np.unique(ids[a:b], return_inverse=True)[1]
            here = np.flatnonzero(lone[a:b])
            part_planes, part_borders = planes(part), planes(lone[a:b])[0] if len(here) else 0
            for lag in range(k, min(2 * k, (b - a) // PERIODS + 1)):
                for start, to in stretches_at(part_planes, part_borders, b - a, lag):
                    start, to = a + start, a + to
                    if (start == 0 or words[start - 1] != words[start - 1 + lag]) and words[to] != words[to - lag]:  # else a piece of a run that is left out
                        found.setdefault((start, to), lag)
    return sorted((a, b, lag) for (a, b), lag in found.items())


def looped(words: list[str], doc_id: int | None) -> list[str]:
    """The words after the rewriting that the report asks for: where crc32 of the id ends in 0, a tail repeats its beginning."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * ((n - a) // p + 1))[: n - a]


def of_texts(texts: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    """start, length, period of all runs of each text (a list of words), by start, then period."""
    number: dict[str, int] = {}
    counts = np.array([len(words) + 1 for words in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    ids = np.zeros(bounds[-1], np.int64)
    for words, at in zip(texts, bounds.tolist(), strict=False):
        ids[at : at + len(words)] = [number.setdefault(word, len(number)) for word in words]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    runs = periodic_runs(ids, bounds)
    owners = np.searchsorted(bounds, [a for a, _, _ in runs], "right") - 1
    for (a, b, period), t in zip(runs, owners.tolist(), strict=True):
        out[t].append((a - int(bounds[t]), b - a, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
MORE = ", runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def periodic(docs: DataFrame, rewrite: bool = False, keep_text: bool = True) -> DataFrame:
    """Each row's runs of repeating words: doc_id, their number, the longest one (ties: smallest start, then period), hashes of
    all runs and of the text without repeats and, if keep_text, both themselves.

    A run is a stretch of words with a smallest period that occurs at least twice in it, of at least twelve words, and that
    can't be made longer on either side. rewrite: first loop the tails of a tenth of the texts, for tests and reports (rows
    without an id are left alone). Null and empty texts and texts of white space have no words, no runs and an empty rest;
    repeated rows stay repeated, empty tables give no rows, other columns are not read. One narrow pass, no shuffle; a text
    of any length is one row, with time by its repeats (see the module).
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch, texts in slices(batches, "text", 1_000_000):
            split = [WORDS.findall(text) for text in texts]
            if rewrite:
                split = [looped(words, doc_id) for words, doc_id in zip(split, batch.column("doc_id").to_pylist(), strict=True)]
            rows: list[list] = [[] for _ in range(9)]
            for words, runs in zip(split, of_texts(split), strict=True):
                start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
                rest = " ".join(collapsed(words, runs))
                exponent = 1000 * length // period if runs else None
                values = (len(runs), start, length, period, exponent, sha("".join(f"{a},{n},{p}\n" for a, n, p in runs)), sha(rest))
                for column, value in zip(rows, values, strict=False):
                    column.append(value)
                if keep_text:
                    rows[7].append([{"start": a, "length": n, "period": p} for a, n, p in runs])
                    rows[8].append(rest)
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string()]
            names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]
            columns = [batch.column("doc_id"), *(pa.array(c, kind) for c, kind in zip(rows[: 9 if keep_text else 7], kinds, strict=False))]
            yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, SCHEMA + MORE * keep_text)
