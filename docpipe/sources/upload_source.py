"""Uploads as a Spark data source: pages of documents, in batch and as a stream.

    spark.dataSource.register(UploadPages)
    spark.read.format("uploads").option("reader", "docpipe.sources.plugins:TextPages").load(folder)

The driver lists names and sizes. Small files are packed into partitions of about `splitBytes`; of a longer file each
partition reads a share of the pages. Refused files are rows with a reason, of which no content is read. What the schema does
not ask for is not made: without `image` no page is drawn, and without `page_no` no content is read.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from itertools import islice
from typing import Any

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docpipe.sources.uploads import MAX_BYTES

COLUMNS = ("path", "modified", "length", "page_no", "image", "reason", "error")
SCHEMA = "path string, modified timestamp, length long, page_no int, image binary, reason string, error string"
#: Bytes of images after which a task passes a batch on.
BATCH_BYTES = 8 << 20
#: Tasks of a scan, at most.
MOST_TASKS = 1000


def refusal(path: str, length: int, max_bytes: int) -> str | None:
    """As uploads.rejection, on the driver."""
    name = path.rpartition("/")[2]
    return "no name" if not name else "not a pdf" if not name.lower().endswith(".pdf") else "too large" if length > max_bytes else None


@dataclass(frozen=True)
class Upload:
    path: str
    length: int
    millis: int  # when it was last changed
    reason: str | None = None


@dataclass
class Pages(InputPartition):
    """Files, and which share of their pages (part of parts)."""

    files: tuple[Upload, ...]
    part: int = 0
    parts: int = 1

    def __post_init__(self) -> None:
        super().__init__(None)


def planned(files: list[Upload], split: int, contents: bool) -> list[Pages]:
    """Partitions of about `split` bytes; refused files, and all files if no contents are wanted, weigh next to nothing."""
    out, held, size = [], [], 0
    for f in files:
        weight = f.length if contents and f.reason is None else 1 << 10
        if weight > split:
            parts = -(-weight // split)
            out += [Pages((f,), i, parts) for i in range(parts)]
            continue
        if held and size + weight > split:
            out.append(Pages(tuple(held)))
            held, size = [], 0
        held.append(f)
        size += weight
    return [*out, Pages(tuple(held))] if held else out


@dataclass
class Share(InputPartition):
    """What one task reads, in order."""

    pages: tuple[Pages, ...]

    def __post_init__(self) -> None:
        super().__init__(None)


def shares(pages: list[Pages], most: int) -> list[Share]:
    """All of `pages`, neighbours together, in at most `most` tasks of about as many each: a task costs time of its own."""
    n = min(most, len(pages))
    return [Share(tuple(pages[len(pages) * i // n : len(pages) * (i + 1) // n])) for i in range(n)]


class _Scan:
    """What batch and stream share: options, listing, reading of a partition."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.uri = options["path"]
        self.max_bytes, self.split = int(options.get("maxbytes", MAX_BYTES)), int(options.get("splitbytes", 8 << 20))
        self.tasks = max(1, int(options.get("tasks", MOST_TASKS)))
        self.dpi, self.most = int(options.get("dpi", 200)), int(options["pages"]) if "pages" in options else None
        self.source, self.schema = options.get("reader"), schema
        if unknown := set(schema.names) - set(COLUMNS):
            raise ValueError(f"uploads have no columns {sorted(unknown)}")
        self.by_page = bool({"page_no", "image", "error"} & set(schema.names))
        if self.by_page and not self.source:
            raise ValueError("option reader has to name a page reader, as module:Class")

    def system(self) -> tuple[pafs.FileSystem, str]:
        uri = "file://" + self.uri[5:] if self.uri.startswith("file:/") and not self.uri.startswith("file://") else self.uri
        return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)

    def listed(self) -> list[Upload]:
        """All files below the path, by time and name; hidden ones are none."""
        system, base = self.system()
        found = system.get_file_info(pafs.FileSelector(base, recursive=True))
        files = [f for f in found if f.is_file and not f.base_name.startswith((".", "_"))]
        made = [Upload(f.path, f.size, 0 if f.mtime is None else int(f.mtime.timestamp() * 1000), refusal(f.path, f.size, self.max_bytes)) for f in files]
        return sorted(made, key=lambda f: (f.millis, f.path))

    def page_reader(self) -> Any:
        module, _, name = self.source.partition(":")
        return getattr(importlib.import_module(module), name)()

    def rows(self, partition: Pages) -> Iterator[dict]:
        system = self.system()[0]
        reader = self.page_reader() if self.by_page else None
        for f in partition.files:
            base = {"path": f.path, "modified": datetime.fromtimestamp(f.millis / 1000, timezone.utc), "length": f.length, "reason": f.reason}
            if f.reason is not None or not self.by_page:
                yield base
                continue
            page_no = -1
            try:
                with system.open_input_file(f.path) as stream:
                    content = stream.read()
                counted = getattr(reader, "count", None)
                n = counted(content) if counted else sum(1 for _ in reader.pages(content, self.dpi)) if partition.parts > 1 else None
                begin, end = (0, n) if n is None or partition.parts == 1 else (n * partition.part // partition.parts, n * (partition.part + 1) // partition.parts)
                end = self.most if end is None else end if self.most is None else min(end, self.most)
                page_no = begin - 1
                for page_no, image in enumerate(islice(reader.pages(content, self.dpi), begin, end), begin):
                    yield base | {"page_no": page_no, "image": image}
            except Exception as e:  # noqa: BLE001  a file's failure is data
                if partition.part == 0 or page_no >= 0:
                    yield base | {"page_no": page_no + 1, "error": f"{type(e).__name__}: {e}"}

    def batches(self, share: Share | None) -> Iterator[pa.RecordBatch]:
        schema, held, size = to_arrow_schema(self.schema), [], 0  # Spark reads no partition as None
        for row in (row for pages in (share.pages if share else ()) for row in self.rows(pages)):
            held.append(row)
            size += len(row.get("image") or b"") + 200
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in schema.names} for r in held], schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in schema.names} for r in held], schema)


class UploadReader(DataSourceReader):
    def __init__(self, scan: _Scan):
        self.scan = scan

    def partitions(self) -> Sequence[InputPartition]:
        return shares(planned(self.scan.listed(), self.scan.split, self.scan.by_page), self.scan.tasks)

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return self.scan.batches(partition)


class UploadStreamReader(DataSourceStreamReader):
    """An offset is the time and name of the last file taken; files that get an older time than it later on are not seen."""

    def __init__(self, scan: _Scan):
        self.scan = scan

    def initialOffset(self) -> dict:
        return {"millis": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self.scan.listed()
        return {"millis": files[-1].millis, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        after, to = ((x["millis"], x["path"]) for x in (start, end))
        return shares(planned([f for f in self.scan.listed() if after < (f.millis, f.path) <= to], self.scan.split, self.scan.by_page), self.scan.tasks)

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return self.scan.batches(partition)

    def commit(self, end: dict) -> None:
        pass


class UploadPages(DataSource):
    """path: a folder. reader: module:Class of a PageReader (with an optional count(content)). maxBytes, splitBytes, tasks (at most), dpi; pages:
    how many of each file's first pages, all by default. A schema of some of the columns reads no more than they need."""

    @classmethod
    def name(cls) -> str:
        return "uploads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> UploadReader:
        return UploadReader(_Scan({k.lower(): v for k, v in self.options.items()}, schema))

    def streamReader(self, schema: StructType) -> UploadStreamReader:
        return UploadStreamReader(_Scan({k.lower(): v for k, v in self.options.items()}, schema))
