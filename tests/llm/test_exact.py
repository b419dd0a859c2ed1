"""Inputs past former bounds: words whose hashes collide, long urls, large pages, many secrets, runs in several threads."""

from __future__ import annotations

import threading
import time
import zlib

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docpipe.llm import bpe, common, rans, secrets, spans, warc
from docpipe.llm.queries import BYTE_BPE, WORD_BPE
from tests.llm import brute


def thue_morse(letters: str, size: int) -> str:
    word = [0]
    while len(word) < size:
        word += [1 - x for x in word]
    return "".join(letters[i] for i in word)


def test_words_with_one_hash(spark):
    """Two words that hash alike, in one batch and in two, get the library's ids each."""
    one, two = thue_morse("ab", 4096), thue_morse("ba", 4096)
    codes, offsets = spans.code_points([one, two])
    assert len(set(spans.hashes(codes, offsets[:-1], offsets[1:]).tolist())) == 1
    texts = [f"{one} {two}", two, one, f"{two} x {one} {two}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    held = Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
    for r in bpe.encode_decode(docs, public_tokenizers.path(WORD_BPE)).collect():
        assert r["token_ids"] == held.encode(texts[r["doc_id"]], add_special_tokens=False).ids
    held = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE))
    for r in rans.token_archive(docs, public_tokenizers.path(BYTE_BPE)).collect():
        assert r["token_ids"] == [*held.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0]


def test_pages_of_any_size(spark, monkeypatch):
    """A url of 70 KB, and pages past the bound of the reader, come back whole."""
    monkeypatch.setattr(warc, "MOST_BYTES", 10_000)
    monkeypatch.setattr(warc.read_records, "__defaults__", (10_000,))
    url = "data:text/plain," + "x" * 70_000
    pages = spark.createDataFrame([(1, url, "a" * 50_000), (2, "http://a/", "a" * 50_000), (3, url, None), (4, "http://b/", "b" * 200)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.archive_pages(pages).collect()}
    assert {i: (r["record_type"], r["payload_bytes"], r["refers_to"]) for i, r in got.items()} == {1: ("response", 50_000, None), 2: ("revisit", 50_000, 1), 3: ("response", 0, None), 4: ("response", 200, None)}
    assert got[1]["target_uri"] == url and got[1]["payload_digest"] == brute.sha("a" * 50_000)


def test_gap_is_an_error_for_every_reader(spark, monkeypatch):
    """Also where the caller asks for no column that tells of it."""
    def cut(pages, write=warc.write_pages):
        files = write(pages)
        for r in files.collect():
            system, _ = common.file_system(r["uri"])
            with system.open_input_file(r["path"]) as f:
                data = f.read()
            with system.open_output_stream(r["path"], compression=None) as f:
                f.write(data[:-20])
        return files

    monkeypatch.setattr(warc, "write_pages", cut)
    pages = spark.createDataFrame([(1, "http://a/", "a" * 500)], "page_id long, url string, html string")
    try:
        warc.archive_pages(pages).select("page_id").collect()
    except Exception as e:  # noqa: BLE001  whatever Spark wraps it in
        assert "damaged archive" in str(e)
    else:
        raise AssertionError("no error")


def test_lengths_of_responses_are_counted(spark, tmp_path):
    """A length field that lies about a response's payload is not believed."""
    record = warc.record_bytes("response", "urn:page:1", "http://a/", brute.sha("abc"), b"abc", 999, None)
    (tmp_path / "a.warc.gz").write_bytes(zlib.compress(record, wbits=31))
    files = spark.createDataFrame([(f"file://{tmp_path}", f"{tmp_path}/a.warc.gz")], "uri string, path string")
    assert [r["payload_bytes"] for r in warc.read_records(files).collect()] == [3]


def test_many_secrets_in_linear_time(spark):
    """Texts of thousands of secrets: spans equal the plain search, and twice as many take about twice as long."""
    took = {}
    for n in (255, 256, 257, 10_000, 20_000, 40_000):
        text = "token=abcdefgh secret: x " * n
        began = time.perf_counter()
        row = secrets.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        took[n] = time.perf_counter() - began
        assert row["n_assign"] == n and row["spans"] == brute.listed(brute.secrets(text))
    assert took[40_000] < 2.5 * took[20_000] + 2, took


def test_folders_belong_to_their_thread(spark):
    """A run that drops what it made leaves alone what another made meanwhile."""
    rows = spark.range(5)
    mark, other = common.made(), []
    mine = common.materialize(rows, "mine")
    thread = threading.Thread(target=lambda: other.append(common.materialize(rows.withColumn("x", F.lit(1)), "other")))
    thread.start()
    thread.join()
    common.drop_since(spark, mark)
    assert other[0].count() == 5
    try:
        mine.count()
    except Exception as e:  # noqa: BLE001
        assert "mine" in str(e)
    else:
        raise AssertionError("still there")
