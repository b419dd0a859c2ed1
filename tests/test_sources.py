"""Image steps, the served model, answer repair and the result sink."""

from __future__ import annotations

import base64
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from docpipe.functions import jsonx
from docpipe.plans import invoice
from docpipe.sources import images, plugins, served
from docpipe.streaming import results


class TextCodec:
    """Images as texts "width height mode"."""

    def open(self, data):
        width, height, mode = data.decode().split()
        return int(width), int(height), mode

    def size(self, image):
        return image[:2]

    def rgb(self, image):
        return (*image[:2], "RGB")

    def resized(self, image, width, height):
        if image[0] == 13:
            raise MemoryError("too large")
        return width, height, image[2]

    def png(self, image):
        return " ".join(map(str, image)).encode()


def test_pages_are_prepared(spark):
    pages = spark.createDataFrame([("a", 0, b"101 200 L", None), ("a", 1, b"13 20 CMYK", None), ("a", 2, b"what", None), ("b", 0, None, "unreadable")], "doc_id string, page_no int, image binary, error string")
    got = {(r["doc_id"], r["page_no"]): (r["image"], r["error"]) for r in images.prepared_pages(pages, TextCodec).collect()}
    assert got[("a", 0)] == (b"151 300 RGB", None)
    assert got[("a", 1)] == (b"13 20 RGB", None)  # it can't be enlarged, so it stays as large as it is
    assert got[("a", 2)][0] is None and got[("a", 2)][1].startswith("ValueError")
    assert got[("b", 0)] == (None, "unreadable")


def test_vision_images(spark):
    files = spark.createDataFrame([("a", b"2048 512 L\f9 9 L"), ("b", b"800 600 L"), ("c", b"what"), ("d", b"500 4096 RGB")], "path string, content binary")
    got = {r["doc_id"]: r for r in images.vision_images(files, plugins.TextPages, TextCodec).collect()}
    assert [base64.b64decode(got[x]["image"]) for x in "abd"] == [b"1024 256 L", b"800 600 L", b"125 1024 RGB"]
    assert got["c"]["image"] is None and got["c"]["error"]


@pytest.fixture(scope="module")
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def do_GET(self):
            self.reply(200, json.dumps({"models": [{"name": "tiny:1b"}]}))

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body)
            if self.path == "/api/pull":
                return self.reply(200, '{"status":"success"}' if body["name"] == "other" else '{"error":"no such model"}')
            if body["prompt"] == "fail":
                return self.reply(503, "busy")
            if body["prompt"] == "empty":
                return self.reply(200, '{"done":true}')
            return self.reply(200, '{"response":"{\\"currency\\":"}\nnot json\n\n[1]\n{"response":"\\"EUR\\"}"}\n{"done":true}\n{"response":"late"}')

        def reply(self, code, text):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(text.encode())

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_address[1]}", seen
    http.shutdown()


def test_served_model(spark, server):
    url, seen = server
    prompts = spark.createDataFrame([(x, "full", x) for x in ("ok", "fail", "empty")], "doc_id string, kind string, prompt string")
    done = plugins.completions(prompts, lambda: served.ServedModel(url, "tiny"))
    got = {r["doc_id"]: (r["response"], r["error"]) for r in done.collect()}
    assert got["ok"] == ('{"currency":"EUR"}', None)
    assert got["fail"][0] is None and "503: busy" in got["fail"][1] and "empty answer" in got["empty"][1]
    assert all(x["format"] == "json" and x["options"] == served.TEXT_OPTIONS and x["stream"] for x in seen)
    assert served.ServedModel(url, "tiny").complete("look", b"png") == '{"currency":"EUR"}'
    assert seen[-1]["images"] == [base64.b64encode(b"png").decode()] and "format" not in seen[-1]
    assert served.ServedModel(url, "tiny:latest").ensure() is True
    assert served.ServedModel(url, "other").ensure() is False and seen[-1] == {"name": "other"}
    with pytest.raises(served.ModelError):
        served.ServedModel(url, "absent").ensure()


def test_answers_are_repaired(spark):
    cases = {
        '{"currency":"EUR","seller":{"name":"A B': {"currency": "EUR", "seller": {"name": "A B"}},
        '{"currency":"EUR",}': {"currency": "EUR"},
        '{"a":[1,2,{"b":"c"': {"a": [1, 2, {"b": "c"}]},
        '{"a":1,"b"': {"a": 1},
        '{"a":1,"b":': {"a": 1},
        'so: {"a":"x\\"y"} and more': {"a": 'x"y'},
        "none at all": None,
        '{"a":1]': {"a": 1},
    }
    for text, want in cases.items():
        got = jsonx.close_open_ends(text)
        assert (None if got is None else json.loads(got)) == want, text
    rows = spark.createDataFrame([(i, "full", t) for i, t in enumerate(cases)], "doc_id long, kind string, response string")
    plain = {r["doc_id"]: r["parse_error"] for r in invoice.parsed(rows).collect()}
    mended = {r["doc_id"]: r for r in invoice.parsed(rows, repair=jsonx.close_open_ends).collect()}
    assert plain[0] and not mended[0]["parse_error"] and mended[0]["header"]["currency"] == "EUR" and mended[0]["header"]["seller"]["name"] == "A B"
    assert mended[6]["parse_error"] and not mended[5]["parse_error"]

    def fails(text):
        raise RuntimeError(text)

    assert invoice.parsed(rows, repair=fails).where("parse_error").count() == invoice.parsed(rows).where("parse_error").count()


def test_results_are_upserted(spark, tmp_path):
    path = f"file://{tmp_path}/results"
    rows = lambda *x: spark.createDataFrame(list(x), "id string, value int, note string")
    results.write_batch(rows(("a", 1, "x"), ("b", 1, None)), path, 0)
    results.write_batch(rows(("a", 2, None), ("c", 5, "z"), ("c", 5, "z")), path, 1)
    results.write_batch(rows(("a", 3, "y"), ("c", 5, "z"), ("c", 5, "z")), path, 1)  # the batch is written again
    results.batch_writer(path)(rows(("d", 7, "w")), 2)
    assert sorted(map(tuple, results.latest(spark, path).select("id", "value", "note").collect())) == [("a", 3, "y"), ("b", 1, None), ("c", 5, "z"), ("d", 7, "w")]


def test_long_files_come_in_batches(spark, monkeypatch):
    monkeypatch.setattr(plugins, "BATCH_WORDS", 10)
    files = spark.createDataFrame([("a", b"one two\fthree four five\f\f" + b"w " * 50), ("b", b"x")], "path string, content binary")
    found = plugins.recognized_words(plugins.page_images(files, plugins.TextPages), plugins.TextWords)
    assert {tuple(r) for r in found.groupBy("doc_id", "page_no").agg(F.count("value")).collect()} == {("a", 0, 2), ("a", 1, 3), ("a", 3, 50), ("b", 0, 1)}
