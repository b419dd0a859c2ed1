"""Page images before recognition and before a vision model: colour, size and encoding, through an image codec.

The codec is a plug-in; PillowCodec is one where that library is installed.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame

from docpipe.sources.plugins import PageReader

ENLARGE = 1.5
#: Resolution of the page that a vision model sees, and its longest side in pixels.
VISION_DPI, LONGEST_SIDE = 300, 1024


class ImageCodec(Protocol):
    def open(self, data: bytes) -> Any: ...

    def size(self, image: Any) -> tuple[int, int]: ...

    def rgb(self, image: Any) -> Any: ...

    def resized(self, image: Any, width: int, height: int) -> Any: ...

    def png(self, image: Any) -> bytes: ...


class PillowCodec:
    """Images of the Pillow library, if that is installed."""

    def __init__(self) -> None:
        from PIL import Image

        self.library = Image

    def open(self, data: bytes) -> Any:
        import io

        return self.library.open(io.BytesIO(data))

    def size(self, image: Any) -> tuple[int, int]:
        return image.size

    def rgb(self, image: Any) -> Any:
        return image if image.mode == "RGB" else image.convert("RGB")

    def resized(self, image: Any, width: int, height: int) -> Any:
        return image.resize((width, height), self.library.Resampling.LANCZOS)

    def png(self, image: Any) -> bytes:
        import io

        out = io.BytesIO()
        image.save(out, format="PNG", optimize=True)
        return out.getvalue()


def enlarged(codec: ImageCodec, data: bytes, scale: float = ENLARGE) -> bytes:
    """The image in RGB, enlarged; if it can't be enlarged, in RGB as it is. Data that is no image is an error."""
    image = codec.rgb(codec.open(data))
    try:
        width, height = codec.size(image)
        return codec.png(codec.resized(image, int(width * scale), int(height * scale)))
    except Exception:  # noqa: BLE001  recognition goes on with what there is
        return codec.png(image)


def shrunk(codec: ImageCodec, data: bytes, longest: int = LONGEST_SIDE) -> bytes:
    """The image as PNG, its longer side at most `longest`; smaller ones keep their size."""
    image = codec.open(data)
    width, height = codec.size(image)
    ratio = min(longest / width, longest / height)
    return codec.png(codec.resized(image, int(width * ratio), int(height * ratio)) if ratio < 1 else image)


def prepared_pages(pages: DataFrame, codec: Callable[[], ImageCodec], scale: float = ENLARGE) -> DataFrame:
    """`pages` (doc_id, page_no, image, error) with images in RGB and enlarged, before recognition.

    Pages without an image stay as they are; an image that can't be read is null with an error.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = codec()

        def one(image: bytes | None, error: str | None) -> tuple[bytes | None, str | None]:
            if image is None:
                return None, error
            try:
                return enlarged(held, bytes(image), scale), error
            except Exception as e:  # noqa: BLE001  a page's failure is data
                return None, f"{type(e).__name__}: {e}"

        for part in parts:
            done = [one(*x) for x in zip(part["image"], part["error"], strict=True)]
            yield part.assign(image=[image for image, _ in done], error=[error for _, error in done])

    return pages.select("doc_id", "page_no", "image", "error").mapInPandas(run, "doc_id string, page_no int, image binary, error string")


def vision_images(files: DataFrame, reader: Callable[[], PageReader], codec: Callable[[], ImageCodec], dpi: int = VISION_DPI, longest: int = LONGEST_SIDE) -> DataFrame:
    """doc_id (path), image (base64 of a PNG), error: the first page of each file, for a vision model.

    A file without pages, or one that can't be read, is a row with an error. Later pages are never read.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, held = reader(), codec()
        for part in parts:
            rows = []
            for row in part.itertuples():
                try:
                    first = next(iter(source.pages(row.content, dpi)), None)
                    if first is None:
                        raise ValueError("no pages")
                    rows.append((row.path, base64.b64encode(shrunk(held, first, longest)).decode(), None))
                except Exception as e:  # noqa: BLE001  a file's failure is data
                    rows.append((row.path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "image", "error"])

    return files.select("path", "content").mapInPandas(run, "doc_id string, image string, error string")
