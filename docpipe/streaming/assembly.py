"""Documents put together from a stream of their pages, in whatever order those come."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docpipe.functions.text import document_text
from docpipe.streaming.feed import ROCKS

#: Columns of the stream of pages. n_pages may be null where it isn't known yet.
PAGES = "doc_id string, page_no int, n_pages int, text string, ts timestamp"
RAW = "doc_id string, event string, n_pages int, missing array<int>, pages array<struct<page_no: int, text: string>>"


class Gather(StatefulProcessor):
    """State of a document: its pages, and whether it was sent.

    It is sent with event `complete` once its pages 0 to n_pages - 1 are there, or `partial` when the deadline after its first
    page has passed. A page that comes after that is sent alone, as `late`; one that was there before is passed over. State
    goes `keep` milliseconds after the document was due.
    """

    def __init__(self, wait: int, keep: int):
        self.wait, self.keep = wait, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getListState("pages", "page_no int, text string")
        self.about = handle.getValueState("about", "n_pages int, due long, sent boolean, seen array<int>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.about.get() if self.about.exists() else None
        n_pages, due, sent, seen = (held[0], held[1], held[2], set(held[3])) if held else (None, None, False, set())
        new, out = [], []
        if held and not sent and timerValues.getCurrentWatermarkInMs() >= due:  # its timer is about to run out
            out = [self.row(key, "partial", n_pages, seen, self.listed())]
            self.pages.clear()
            self.handle.registerTimer(due + self.keep)
            sent = True
        for r in rows:
            if due is None or (not sent and r["ms"] + self.wait < due):
                due = r["ms"] + self.wait
                self.handle.registerTimer(due)
            if r["n_pages"] is not None:
                n_pages = max(n_pages or 0, r["n_pages"])
            if r["page_no"] in seen:
                continue
            seen.add(r["page_no"])
            new.append((r["page_no"], r["text"]))
        if sent:
            out += [self.row(key, "late", n_pages, seen, [page]) for page in new]
        elif n_pages is not None and seen >= set(range(n_pages)):
            out = [self.row(key, "complete", n_pages, seen, [*self.listed(), *new])]
            self.pages.clear()
            sent = True
        elif new:
            self.pages.appendList(new)
        self.about.update((n_pages, due, sent, sorted(seen)))
        yield from out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if not self.about.exists():
            return
        n_pages, due, sent, seen = self.about.get()
        now = expiredTimerInfo.getExpiryTimeInMs()
        if sent and now >= due + self.keep:
            self.about.clear()
        elif now >= due:
            self.handle.registerTimer(due + self.keep)
            if not sent:
                self.about.update((n_pages, due, True, seen))
                held = self.listed()
                self.pages.clear()
                yield self.row(key, "partial", n_pages, set(seen), held)

    def listed(self) -> list[tuple]:
        return [tuple(p) for p in self.pages.get()] if self.pages.exists() else []

    @staticmethod
    def row(key: Any, event: str, n_pages: int | None, seen: set[int], pages: list[tuple]) -> Row:
        missing = sorted(set(range(n_pages or 0)) - seen)
        return Row(doc_id=key[0], event=event, n_pages=n_pages, missing=missing, pages=[Row(page_no=n, text=t) for n, t in sorted(pages, key=lambda p: p[0])])


def assembled(pages: DataFrame, late: str = "1 minute", wait_seconds: int = 600, keep_seconds: int = 3600) -> DataFrame:
    """doc_id, event, n_pages, missing, page_no, text from a stream of pages (PAGES), in append mode.

    text is layout.document_text of the pages that are there: in order, blank ones dropped, an empty line between; of a late
    page its own, with its page_no. Pages without a number or time are passed over. Needs the RocksDB provider of states, and
    goes on from its checkpoint after a restart.
    """
    name = "spark.sql.streaming.stateStore.providerClass"
    if pages.sparkSession.conf.get(name, None) != ROCKS:
        raise ValueError(f"{name} has to be {ROCKS}")
    keyed = pages.where("page_no is not null and ts is not null").withWatermark("ts", late).select("doc_id", "page_no", "n_pages", F.coalesce("text", F.lit("")).alias("text"), "ts", F.unix_millis("ts").alias("ms"))
    made = keyed.groupBy("doc_id").transformWithState(Gather(wait_seconds * 1000, keep_seconds * 1000), RAW, "append", "eventTime")
    return made.select("doc_id", "event", "n_pages", "missing", F.when(F.col("event") == "late", F.get("pages", F.lit(0))["page_no"]).alias("page_no"), document_text(F.col("pages")).alias("text"))
