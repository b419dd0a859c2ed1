"""The PNG codec: all colour types, depths and filters, damaged files, resizing."""

from __future__ import annotations

import struct
import time
import zlib

import numpy as np
import pytest

from docpipe.sources import images, png
from docpipe.sources.png import CHANNELS, SIGNATURE, PngCodec

CODEC = PngCodec()


def part(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def filtered(rows: np.ndarray, kinds: list[int], step: int) -> bytes:
    """Rows of bytes with filters, one byte after another."""
    out, before = [], [0] * rows.shape[1]
    for kind, row in zip(kinds, rows.tolist(), strict=True):
        line = [kind]
        for i, x in enumerate(row):
            a, b, c = (row[i - step] if i >= step else 0), before[i], (before[i - step] if i >= step else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((x - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out.append(bytes(line))
        before = row
    return b"".join(out)


def written(rows: np.ndarray, width: int, depth: int, colour: int, kinds: list[int], extra: bytes = b"") -> bytes:
    step = max(1, CHANNELS[colour] * depth // 8)
    data = zlib.compress(filtered(rows, kinds, step))
    return SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), depth, colour, 0, 0, 0)) + extra + part(b"IDAT", data[:9]) + part(b"IDAT", data[9:]) + part(b"IEND", b"")


@pytest.mark.parametrize("colour", [0, 2, 4, 6])
@pytest.mark.parametrize("depth", [8, 16])
def test_filters(colour, depth):
    rng = np.random.default_rng(colour)
    rows = rng.integers(0, 256, (23, 11 * CHANNELS[colour] * depth // 8))
    for kinds in ([k % 5 for k in range(23)], [k % 3 for k in range(23)], [4] * 23):
        image = CODEC.open(written(rows, 11, depth, colour, kinds))
        want = rows[:, :: depth // 8].reshape(23, 11, CHANNELS[colour])
        assert image.dtype == np.uint8 and (image == want).all()


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_few_bits(depth):
    values = np.random.default_rng(depth).integers(0, 1 << depth, (6, 13))
    bits = ((values[:, :, None] >> np.arange(depth - 1, -1, -1)) & 1).reshape(6, -1)
    rows = np.packbits(bits, axis=1).astype(int)
    gray = CODEC.open(written(rows, 13, depth, 0, [0, 1, 2, 3, 4, 0]))
    assert (gray[:, :, 0] == values * 255 // ((1 << depth) - 1)).all()
    palette = np.random.default_rng(9).integers(0, 256, (1 << depth, 3)).astype(np.uint8)
    assert (CODEC.open(written(rows, 13, depth, 3, [0] * 6, part(b"PLTE", palette.tobytes()))) == palette[values]).all()
    clear = CODEC.open(written(rows, 13, depth, 3, [0] * 6, part(b"PLTE", palette.tobytes()) + part(b"tRNS", b"\x05")))
    assert (clear[:, :, 3] == np.where(values == 0, 5, 255)).all()


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_round_trip(channels):
    image = np.random.default_rng(channels).integers(0, 256, (17, 9, channels)).astype(np.uint8)
    assert (CODEC.open(CODEC.png(image)) == image).all()
    assert CODEC.rgb(image).shape == (17, 9, 3) and CODEC.size(image) == (9, 17)


def test_resizing():
    """Flat images stay flat; a slope stays one; a checkerboard shrinks to gray; details beyond the size are smoothed away."""
    for value in (0, 7, 255):
        assert (CODEC.resized(np.full((20, 30, 3), value, np.uint8), 45, 11) == value).all()
    slope = np.tile(np.arange(0, 200, 2, dtype=np.uint8)[None, :, None], (10, 1, 3))
    large = CODEC.resized(slope, 150, 15)
    assert (np.diff(large[7, 6:-6, 0].astype(int)) >= 0).all() and abs(int(large[7, 75, 0]) - 100) <= 2
    board = (np.indices((64, 64)).sum(0) % 2 * 255).astype(np.uint8)[:, :, None]
    small = CODEC.resized(board, 16, 16)
    assert small.shape == (16, 16, 1) and np.abs(small[3:-3, 3:-3].astype(int) - 127).max() <= 3
    one = CODEC.resized(np.array([[[10], [20]]], np.uint8), 1, 1)
    assert one.shape == (1, 1, 1) and one[0, 0, 0] == 15


def test_damage():
    good = CODEC.png(np.zeros((5, 5, 3), np.uint8))
    for bad in (b"", b"GIF89a", good[:20], good[:-30], good.replace(b"IDAT", b"IDAX"), SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", 5, 5, 8, 2, 0, 0, 1)) + part(b"IDAT", zlib.compress(b"0" * 80)), SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", 10**6, 10**6, 8, 2, 0, 0, 0)) + part(b"IDAT", b"x")):
        with pytest.raises((ValueError, zlib.error)):
            CODEC.open(bad)


def test_steps_on_images():
    """Both steps on real images: enlarged by half in colour, shrunk to the longest side, small ones as they are."""
    gray = CODEC.png(np.full((40, 60, 2), 9, np.uint8))
    assert CODEC.open(images.enlarged(CODEC, gray)).shape == (60, 90, 3)
    assert CODEC.open(images.shrunk(CODEC, CODEC.png(np.zeros((30, 2000, 1), np.uint8)))).shape == (15, 1024, 1)
    assert CODEC.open(images.shrunk(CODEC, gray)).shape == (40, 60, 2)
    assert CODEC.open(images.enlarged(CODEC, gray, 0.001)).shape == (40, 60, 3)


def test_a_page_in_seconds():
    page = np.random.default_rng(1).integers(0, 256, (1100, 850, 3)).astype(np.uint8)
    began = time.perf_counter()
    assert CODEC.open(images.enlarged(CODEC, CODEC.png(page))).shape == (1650, 1275, 3)
    assert time.perf_counter() - began < 30


def test_rows_that_need_no_row_by_row_loop():
    """Filters of one direction in any order, against a loop over bytes; pages of one size share their weights."""
    rng = np.random.default_rng(5)
    for step, width in ((1, 7), (3, 4), (4, 1)):
        raw, kinds = rng.integers(0, 256, (40, step * width), dtype=np.uint8), rng.choice([0, 1, 2, 2, 2, 9], 40).astype(np.uint8)
        want = np.zeros((41, step * width), np.int64)
        for r in range(40):
            for c in range(step * width):
                want[r + 1, c] = (int(raw[r, c]) + {1: want[r + 1, c - step] if c >= step else 0, 2: want[r, c]}.get(int(kinds[r]), 0)) % 256
        before = raw.copy()
        assert (png.unfiltered(raw, kinds, step) == want[1:]).all() and (raw == before).all()
    page = rng.integers(0, 256, (30, 20, 3), dtype=np.uint8)
    png.kept_band.cache_clear()
    first = png.stretched(page, 45, 0)
    assert (png.stretched(page, 45, 0) == first).all() and png.kept_band.cache_info().hits == 1
    png.stretched(np.zeros((3000, 2, 1), np.uint8), 4000, 0)
    assert png.kept_band.cache_info().currsize == 1
