"""PNG images in numpy alone: an image codec that needs no image library.

Images are arrays of height, width and channels (1 gray, 2 gray and alpha, 3 colour, 4 colour and alpha), eight bits each.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type; type 3 are places in a palette.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
COLOURS = {1: 0, 2: 4, 3: 2, 4: 6}
#: How many source pixels on either side count for a resized one, before shrinking widens it.
LOBES = 3
MOST_PIXELS = 1 << 28


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(name + body):
            raise ValueError("damaged chunk")
        yield name, body
        at += 12 + size


def unfiltered(raw: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes without their filters. Each byte depends on the ones to the left, above and above left, `step` bytes make a
    pixel: pixels on a diagonal depend on earlier diagonals only, so a diagonal is worked out at once."""
    rows, width = raw.shape[0], raw.shape[1] // step
    if not ((kinds == 3) | (kinds == 4)).any():  # no byte needs both directions at once; sums of bytes wrap
        plain = raw.reshape(rows, width, step).copy()
        side = kinds == 1
        if side.any():
            plain[side] = np.cumsum(plain[side], axis=1, dtype=np.uint8)
        edges = np.flatnonzero(np.diff(kinds == 2, prepend=False, append=False)).reshape(-1, 2)
        for first, end in edges.tolist():  # runs of rows that add the row above
            above = max(0, first - 1)
            plain[first:end] = np.cumsum(plain[above:end], axis=0, dtype=np.uint8)[first - above :]
        return plain.reshape(rows, -1)
    out = np.zeros((rows + 1, width + 1, step), np.int32)  # a row above and a pixel to the left, all zero
    source = raw.reshape(rows, width, step).astype(np.int32)
    for d in range(rows + width - 1):
        r = np.arange(max(0, d - width + 1), min(rows, d + 1))
        c = d - r
        left, up, corner = out[r + 1, c], out[r, c + 1], out[r, c]
        guess = left + up - corner
        near = [np.abs(guess - x) for x in (left, up, corner)]
        paeth = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], up, corner))
        kind = kinds[r][:, None]
        add = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, paeth], 0)
        out[r + 1, c + 1] = (source[r, c] + add) & 255
    return out[1:, 1:].reshape(rows, -1).astype(np.uint8)


def band(size: int, to: int, begin: int, end: int) -> tuple[int, int, np.ndarray]:
    """Which of `size` source rows count for the rows from begin to end of `to`, and their weights."""
    stretch = max(size / to, 1.0)
    reach = LOBES * stretch + 1
    low, high = max(0, int(begin * size / to - reach)), min(size, int(end * size / to + reach) + 1)
    x = ((np.arange(low, high)[None, :] + 0.5) - (np.arange(begin, end)[:, None] + 0.5) * (size / to)) / stretch
    w = np.where(np.abs(x) < LOBES, np.sinc(x) * np.sinc(x / LOBES), 0.0)
    return low, high, w / w.sum(1, keepdims=True)


#: Pages of a file are mostly of one size. Only small weights are kept, 32 MB at most.
kept_band = lru_cache(256)(band)
KEPT_CELLS = 1 << 14


def stretched(image: np.ndarray, to: int, axis: int) -> np.ndarray:
    """The image with `to` rows (axis 0) or columns (1): each is a mean of those around its place, weighted by a windowed sinc
    that is as wide as LOBES pixels of the coarser image on either side."""
    moved = np.moveaxis(image.astype(np.float64), axis, 0)
    size = moved.shape[0]
    weights = kept_band if size * to <= KEPT_CELLS else band
    out = np.empty((to, *moved.shape[1:]))
    for begin in range(0, to, 256):  # only a band of the weights is not zero
        end = min(to, begin + 256)
        low, high, w = weights(size, to, begin, end)
        out[begin:end] = np.tensordot(w, moved[low:high], 1)
    return np.clip(np.rint(np.moveaxis(out, 0, axis)), 0, 255).astype(np.uint8)


class PngCodec:
    """An ImageCodec for PNG: all colour types and depths, not interlaced; depths past eight bits are cut to eight."""

    def open(self, data: bytes) -> np.ndarray:
        if data[:8] != SIGNATURE:
            raise ValueError("not a PNG image")
        head, palette, clear, packed = None, None, b"", []
        for name, body in chunks(data):
            if name == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif name == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif name == b"tRNS":
                clear = body
            elif name == b"IDAT":
                packed.append(body)
        if head is None or not packed:
            raise ValueError("no image in it")
        width, height, depth, colour, _, _, interlaced = head
        if interlaced or colour not in CHANNELS or not 0 < width * height <= MOST_PIXELS:
            raise ValueError("an interlaced, unknown or too large image")
        channels = CHANNELS[colour]
        line = (width * channels * depth + 7) // 8
        inflate = zlib.decompressobj()
        raw = inflate.decompress(b"".join(packed), (line + 1) * height)
        if len(raw) < (line + 1) * height:
            raise ValueError("too little data")
        table = np.frombuffer(raw, np.uint8).reshape(height, line + 1)
        step = max(1, channels * depth // 8)
        flat = unfiltered(table[:, 1:], table[:, 0], step)
        if depth == 16:
            flat = flat[:, ::2]
        elif depth < 8:
            bits = np.unpackbits(flat, axis=1)[:, : width * depth].reshape(height, width, depth)
            flat = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2).astype(np.uint8)
            flat = flat if colour == 3 else (flat.astype(np.int32) * 255 // ((1 << depth) - 1)).astype(np.uint8)
        image = flat.reshape(height, width, channels)
        if colour != 3:
            return image
        if palette is None or image.max() >= len(palette):
            raise ValueError("a colour that the palette lacks")
        if not clear:
            return palette[image[:, :, 0]]
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
        return np.concatenate([palette, alpha[:, None]], 1)[image[:, :, 0]]

    def size(self, image: np.ndarray) -> tuple[int, int]:
        return image.shape[1], image.shape[0]

    def rgb(self, image: np.ndarray) -> np.ndarray:
        """In three colours; what lies behind clear pixels shows."""
        return image[:, :, :3] if image.shape[2] >= 3 else np.repeat(image[:, :, :1], 3, 2)

    def resized(self, image: np.ndarray, width: int, height: int) -> np.ndarray:
        if width < 1 or height < 1:
            raise ValueError("an image of no pixels")
        return stretched(stretched(image, width, 1), height, 0)

    def png(self, image: np.ndarray) -> bytes:
        height, width, channels = image.shape
        rows = image.reshape(height, -1)
        lines = np.full((height, rows.shape[1] + 1), 2, np.uint8)  # each row less the one above
        lines[:, 1:] = rows
        lines[1:, 1:] -= rows[:-1]
        part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
        return SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, COLOURS[channels], 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes(), 9)) + part(b"IEND", b"")


@dataclass(frozen=True)
class PngPages:
    """A PageReader of files that are one PNG image."""

    def pages(self, content: bytes, dpi: int) -> Iterator[bytes]:
        yield content

    def count(self, content: bytes) -> int:
        return 1
