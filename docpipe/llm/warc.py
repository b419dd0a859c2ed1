"""WARC archives: a writer of gzip members, one record each, with revisit records, and a salvage reader.

The reader trusts nothing: a member has to inflate with a right checksum and hold records, each with a version line, a
right Content-Length and a block and payload that fit their digests (SHA-256, SHA-1 or MD5, in hex or base32; the payload
of an HTTP response is the body behind its headers). After a failed check it searches for the next gzip member or version
line that passes, goes on from there, and logs the bytes between as a quarantined gap with the reason. Members that hold
several records, or break off, are searched for version lines in what they inflate to, so sound records before and after
the damage come back.

Reading costs time in proportion to the file, whatever it holds: the places of the next marks are remembered, false ones
are refused after a few bytes, and what a record or member may hold is bounded (`most`).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpipe.llm.common import file_system, make_dir, materialize, shared_dir

VERSION = b"WARC/1.1"
MEMBER = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
CHUNK = 1 << 20
FILE_BYTES = 32 << 20
#: Bytes that a header may have, and a record or an inflated member, where the list of files does not say more; larger ones
#: are quarantined.
HEADER_BYTES, MOST_BYTES = 1 << 16, 256 << 20
#: Bytes of a member (its own header: names, comments) before the first one that it inflates to.
MEMBER_HEADER = 1 << 11
VERSION_LINE = re.compile(rb"WARC/1\.[0-9]+\r\n")
ALGORITHMS = {"sha256": hashlib.sha256, "sha-256": hashlib.sha256, "sha1": hashlib.sha1, "sha-1": hashlib.sha1, "md5": hashlib.md5}
SMALLEST = 100  # bytes of payload from which equal payloads are revisited
RECORDS = "path string, offset long, length long, record_type string, record_id string, target_uri string, refers_to_id string, warc_date string, payload_digest string, payload_bytes long, payload binary, problem string"


class Bad(ValueError):
    """A record that fails a check."""


def record_bytes(record_type: str, record_id: str, uri: str, digest: str, payload: bytes, size: int, refers_to: str | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record, as it stands in an archive before compression. Revisits have no block; their payload's size is a field."""
    fields = [("WARC-Type", record_type), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", " ".join(uri.split())), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(size))]
    if record_type == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers_to}>")]
        payload = b""
    else:
        fields.append(("Content-Type", "text/html; charset=utf-8"))
    fields.append(("Content-Length", str(len(payload))))
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + payload + END


def parse_header(head: bytes) -> dict[str, str]:
    """The fields of a record's header, without the empty line that ends it; Bad at the first line that is none."""
    version = VERSION_LINE.match(head + b"\r\n")
    if not version:
        raise Bad("no version line")
    fields: dict[str, str] = {}
    at, name = version.end(), ""
    while at < len(head):
        stop = head.find(b"\r\n", at)
        line, at = head[at : stop if stop >= 0 else len(head)], stop + 2 if stop >= 0 else len(head)
        text = line.decode("utf-8", "replace")
        if line[:1] in (b" ", b"\t") and name:  # a folded line goes on with the field before
            fields[name] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise Bad("field without colon")
        fields[name] = value.strip()
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdigit() and len(size) < 19):
        raise Bad("no content length")
    return fields


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """The block, or the body behind the headers of an HTTP message."""
    if not fields.get("content-type", "").lower().startswith("application/http"):
        return block
    stop = block.find(END)
    return block[stop + 4 :] if stop >= 0 else b""


def unchunked(body: bytes) -> bytes | None:
    """A body without its chunked transfer coding; None if it has none."""
    out, at = [], 0
    while True:
        stop = body.find(b"\r\n", at, at + 64)
        size = body[at:stop].split(b";")[0].strip() if stop >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,8}", size):
            return None
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(body[stop + 2 : stop + 2 + n])
        at = stop + 4 + n


def fits(digest: str, data: bytes) -> bool:
    """Whether data has the digest (algorithm:value, hex or base32); one of an unknown algorithm says nothing."""
    name, colon, value = digest.partition(":")
    make = ALGORITHMS.get(name.strip().lower())
    if not colon or make is None:
        return True
    found, value = make(data).digest(), value.strip()
    return value.lower() == found.hex() or value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=")


def check_digests(fields: dict[str, str], block: bytes) -> None:
    if not fits(fields.get("warc-block-digest", ""), block):
        raise Bad("block does not fit its digest")
    digest = fields.get("warc-payload-digest", "")
    if digest and fields.get("warc-type") in ("response", "resource", "conversion"):
        payload = payload_of(fields, block)
        if not fits(digest, payload):
            plain = unchunked(payload) if payload is not block else None
            if plain is None or not fits(digest, plain):
                raise Bad("payload does not fit its digest")


def proven(fields: dict[str, str]) -> bool:
    """Whether a sound record carries a digest that was checked."""
    names = ["warc-block-digest", *(["warc-payload-digest"] if fields.get("warc-type") in ("response", "resource", "conversion") else [])]
    return any(fields.get(name, "").partition(":")[0].strip().lower() in ALGORITHMS for name in names)


class Window:
    """Reads of a file by place, through a buffer, so that searching forward never holds the whole file.

    The place of the next mark of each kind is remembered: searches from ever later places read the file once.
    """

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""
        self.next: dict[bytes, int] = {}

    def read(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.at, self.held = at, self.file.read_at(min(max(n, CHUNK), self.size - at), at)
        return self.held[at - self.at : at - self.at + n]

    def find(self, what: bytes, at: int) -> int:
        """The first place of `what` from `at` on, the file's size if there is none; `at` must not go back."""
        if self.next.get(what, -1) < at:
            self.next[what] = self._search(what, at)
        return self.next[what]

    def _search(self, what: bytes, at: int) -> int:
        while at < self.size:
            if not self.at <= at < self.at + len(self.held) - len(what):
                self.read(at, CHUNK)
            found = self.held.find(what, at - self.at)
            if found >= 0:
                return self.at + found
            if self.at + len(self.held) >= self.size:
                break
            at = self.at + len(self.held) - len(what) + 1
        return self.size


class Text:
    """A Window's reads and searches over bytes that are held."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)
        self.next: dict[bytes, int] = {}

    def read(self, at: int, n: int) -> bytes:
        return self.data[at : at + n]

    def find(self, what: bytes, at: int) -> int:
        if self.next.get(what, -1) < at:
            found = self.data.find(what, at)
            self.next[what] = self.size if found < 0 else found
        return self.next[what]


def plain_record(window: Window | Text, at: int, most: int, header: int) -> tuple[dict[str, str], bytes, int]:
    """Fields, block and whole size of the uncompressed record at a place; Bad if a check fails.

    The cheap checks come first: the block is read only if the bytes behind it are those that end a record.
    """
    if not VERSION_LINE.match(window.read(at, 16)):
        raise Bad("no version line")
    stop = window.find(END, at)
    if stop >= window.size:
        raise Bad("no end of header")
    if stop - at > header:
        raise Bad("header too long")
    fields = parse_header(window.read(at, stop - at))
    size = int(fields["content-length"])
    if size > most:
        raise Bad(f"record of more than {most} bytes")
    if window.read(stop + 4 + size, 4) != END:
        raise Bad("block shorter or longer than its content length")
    block = window.read(stop + 4, size)
    check_digests(fields, block)
    return fields, block, stop + 8 + size - at


def member(window: Window, at: int, most: int) -> tuple[bytes, int, str | None]:
    """What the gzip member at a place inflates to, its size in the file, and what is wrong with it, if anything.

    The first bytes decide whether it is one: a false mark costs a few hundred bytes, not a search.
    """
    inflate, out, here, total, problem = zlib.decompressobj(wbits=31), [], at, 0, None
    while not inflate.eof:
        data = window.read(here, 1 << 16 if total else 1 << 9)
        if not data:
            problem = "member cut short"
            break
        here += len(data)
        while data and problem is None and not inflate.eof:
            try:
                part = inflate.decompress(data, 1 << 20)
            except zlib.error as e:
                problem = f"member does not inflate: {e}"
                break
            out.append(part)
            total += len(part)
            data = inflate.unconsumed_tail
            if total > most:
                problem = f"member of more than {most} bytes"
        if problem:
            break
        if here - at > MEMBER_HEADER and not total:
            problem = "member holds nothing"
            break
        if total and len(out) <= 2 and not (head := b"".join(out)[:7]).startswith(b"WARC/1."[: len(head)]):
            problem = "member holds no version line"
            break
    return b"".join(out), here - len(inflate.unused_data) - at, problem


Found = tuple[int, int, dict[str, str], bytes, str | None]


def salvage(window: Window, most: int = MOST_BYTES, header: int = HEADER_BYTES) -> Iterator[Found]:
    """Place, size, fields and block of each sound record, and place, size and reason of each quarantined gap, in order.

    Records of one member have its place; the first has its size, the others 0, so sizes always sum up to the file's. Of a
    member that breaks off the proven records have size 0, and the gap begins at the member.
    """
    at, gap, reason = 0, None, None
    while at < window.size:
        step, found = 0, []
        try:
            if window.read(at, 3) == MEMBER:
                data, size, problem = member(window, at, most)
                if problem != "member holds no version line":
                    held = list(salvage(Text(data), most, header)) if data else []
                    found = [x for x in held if x[4] is None and (problem is None or proven(x[2]))]
                    problem = problem or next((x[4] for x in held if x[4] is not None), None if found else "member holds no record")
                if problem is None:
                    step = size
                else:
                    # past a member that inflates to its end the next mark is behind it, whatever its bytes look like
                    raise Bad(problem)
            else:
                fields, block, step = plain_record(window, at, most, header)
                found = [(at, step, fields, block, None)]
        except Bad as e:
            if gap is None:
                gap, reason = at, str(e)
        if step and gap is not None:
            yield gap, at - gap, {}, b"", reason
            gap = None
        for i, (_, _, fields, block, _) in enumerate(found):
            yield at, step if i == 0 else 0, fields, block, None
        at = at + step if step else min(window.find(MEMBER, at + 1), window.find(b"WARC/1.", at + 1))
    if gap is not None:
        yield gap, window.size - gap, {}, b"", reason


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def read_records(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """Records and gaps of the archives in `files` (uri, path): a task reads whole files, through bounded buffers.

    Where `files` has them, header_bytes and record_bytes say how large a file's headers and records get: those are read
    whatever `most` says, as the writer's own list knows no bound on a url or a page.

    A gap is a row with record_type "gap", its place, length and `problem`; all else about it is null. Records of more than
    `most` bytes, and members that inflate to more, are gaps. Empty files, and a table without files, give no rows; a file
    listed twice is read twice. Records of other kinds (warcinfo, request ...) come as they are; payloads of HTTP messages
    are their bodies. Other columns are not read.
    """

    def run(batches):
        columns: list[list] = [[] for _ in range(12)]
        held = 0
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), *((c, pa.string()) for c in ("record_type", "record_id", "target_uri", "refers_to_id", "warc_date", "payload_digest")), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("problem", pa.string())])
        for batch in batches:
            for row in batch.to_pylist():
                record, header = max(most, row.get("record_bytes") or 0), max(HEADER_BYTES, row.get("header_bytes") or 0)
                with file_system(row["uri"])[0].open_input_file(row["path"]) as f:
                    for at, size, fields, block, problem in salvage(Window(f, f.size()), record, header):
                        digest, payload = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None, payload_of(fields, block)
                        length = fields.get("warc-payload-length", "") if fields.get("warc-type") == "revisit" else ""
                        values = (row["path"], at, size, "gap" if problem else fields.get("warc-type"), _bare(fields.get("warc-record-id")), fields.get("warc-target-uri"), _bare(fields.get("warc-refers-to")), fields.get("warc-date"), digest, None if problem else int(length) if length.isascii() and length.isdigit() and len(length) < 19 else len(payload), None if problem else payload, problem)
                        for column, value in zip(columns, values, strict=True):
                            column.append(value)
                        held += len(block) + 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                            columns, held = [[] for _ in range(12)], 0
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return files.select("uri", "path", *(c for c in ("header_bytes", "record_bytes") if c in files.columns)).mapInArrow(run, RECORDS)


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_digest, record_type and refers_to: which page of equal payloads is the response.

    That with the smallest page_id (all rows of that id, if repeated); pages without an id only where no other is. Only
    digests that occur again are joined back, as an ordinary skew-splittable join.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"), F.sha2(payload.cast("binary"), 256).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    again = rows.where(F.col("payload_bytes") >= SMALLEST).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("payload_digest", "first")
    again = materialize(again, "again")
    joined = rows.join(again, "payload_digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "html", "payload_digest", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_pages(pages: DataFrame, uri: str | None = None) -> DataFrame:
    """Writes an archive of pages (page_id, url, html) and returns its files: uri, path, n_records, header_bytes and
    record_bytes (of the largest header and record).

    Each task writes files of its own, of up to FILE_BYTES and one record more; a retried task writes new names, and the
    list, written by Spark, holds those of committed attempts. Null html is an empty payload, a null url is empty.
    """
    uri = uri or shared_dir(pages.sparkSession, "warc")
    make_dir(uri)

    def run(batches):
        system, base = file_system(uri)
        out = path = None
        size = n = header = record = 0

        def close():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([path]), *(pa.array([x], pa.int64()) for x in (n, header, record))], ["uri", "path", "n_records", "header_bytes", "record_bytes"])

        for batch in batches:
            names = batch.schema.names
            for values in zip(*(batch.column(name).to_pylist() for name in names), strict=True):
                row = dict(zip(names, values, strict=True))
                if out is None:
                    path, size, n, header, record = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0, 0, 0
                    out = system.open_output_stream(path, compression=None)
                data = record_bytes(row["record_type"], f"urn:page:{row['page_id']}", row["url"] or "", row["payload_digest"], row["html"].encode("utf-8", "surrogatepass"), row["payload_bytes"], f"urn:page:{row['refers_to']}")
                header, record = max(header, data.index(END)), max(record, len(data))
                squeeze = zlib.compressobj(4, wbits=31)
                packed = squeeze.compress(data) + squeeze.flush()
                out.write(packed)
                size, n = size + len(packed), n + 1
                if size >= FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return materialize(with_revisits(pages).mapInArrow(run, "uri string, path string, n_records long, header_bytes long, record_bytes long"), "warc-files")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes the pages as an archive and reads its records back, with page_id and refers_to from the record ids.

    Null html is an empty payload, a null url is empty, a null page_id stays null; of repeated ids every row has its record.
    Empty tables give no rows; other columns are not read. A gap in an archive that was just written is an error: no record
    is lost in silence.
    """
    damage = F.raise_error(F.concat(F.lit("damaged archive: "), "path", F.lit(" at "), F.col("offset").cast("string"), F.lit(": "), "problem"))
    records = read_records(write_pages(pages)).where(F.when(F.col("record_type") == "gap", damage.cast("boolean")).otherwise(F.lit(True)))
    number = lambda name: F.expr(f"try_cast(substring({name}, 10) as bigint)")  # noqa: E731  after urn:page:
    return records.withColumns({"page_id": number("record_id"), "refers_to": number("refers_to_id")})


ORACLE = """
with p as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, payload_digest,
  case when first is not null and first <> page_id then 'revisit' else 'response' end as record_type,
  case when first <> page_id then first end as refers_to
from p left join f using (payload_digest)
"""
