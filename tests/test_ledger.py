"""The ledger of answers, against a server that counts its calls."""

from __future__ import annotations

import json
import os
import threading
import time
from collections import Counter
from functools import partial
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from docpipe.sources.ledger import Calls, ResponseLedger, ask
from docpipe.sources.served import ModelError, ServedModel

QUICK = Calls(in_flight=1, wait=0.01, flush_rows=1)


@pytest.fixture
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802  the name is the base class's
            prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["prompt"]
            with held.lock:
                held.counts[prompt] += 1
                held.flying += 1
                held.most = max(held.most, held.flying)
                n = held.counts[prompt]
            time.sleep(held.delay)
            code = 400 if prompt.startswith("wrong") else 500 if prompt.startswith("shaky") and n < 3 or prompt.startswith("dead") else 200
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps({"response": f"answer to {prompt}", "done": True}).encode())
            with held.lock:
                held.flying -= 1

        def log_message(self, *_):
            pass

    held = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    held.lock, held.counts, held.flying, held.most, held.delay = threading.Lock(), Counter(), 0, 0, 0.0
    threading.Thread(target=held.serve_forever, daemon=True).start()
    yield held
    held.shutdown()


class Mortal(ServedModel):
    """Dies with its worker at the sixth call."""

    calls = 0

    def complete(self, prompt, image=None):
        type(self).calls += 1
        if type(self).calls > 5:
            os._exit(1)
        return super().complete(prompt, image)


def prompts(spark, texts):
    return spark.createDataFrame([(str(i), "full", t) for i, t in enumerate(texts)], "doc_id string, kind string, prompt string").withColumn("key", F.lit("clash"))


def url(server) -> str:
    return f"http://127.0.0.1:{server.server_port}"


def test_a_killed_job_goes_on_where_it_was(spark, server, tmp_path):
    """The worker dies after five answers; the next run asks for the others only, and a third one for none."""
    ledger = ResponseLedger(spark, f"file://{tmp_path}/ledger")
    table = prompts(spark, [f"q{i}" for i in range(12)])
    with pytest.raises(Exception, match="Python worker|crashed|failed"):
        ledger.complete(table, partial(Mortal, url(server), "m"), "m", calls=QUICK, tasks=1)
    assert sum(server.counts.values()) == 5 and ledger.rows().count() == 5
    for _ in range(2):
        rows = ledger.complete(table, partial(ServedModel, url(server), "m"), "m", calls=QUICK).collect()
        assert {r["prompt"]: r["response"] for r in rows} == {f"q{i}": f"answer to q{i}" for i in range(12)}
        assert server.counts == Counter({f"q{i}": 1 for i in range(12)})
    assert len(rows) == 12 and all(r["key"] == "clash" for r in rows)


def test_retries_failures_and_repeats(spark, server, tmp_path):
    """Shaky calls are tried again, wrong ones not; equal prompts are one question; failures are asked again next time."""
    ledger = ResponseLedger(spark, f"file://{tmp_path}/ledger")
    table = prompts(spark, ["shaky", "wrong", "dead", "same", "same", None, ""])
    calls = Calls(in_flight=3, attempts=3, wait=0.01, flush_rows=2)
    got = {r["doc_id"]: (r["response"], r["error"] and r["error"][:15], r["attempts"]) for r in ledger.complete(table, partial(ServedModel, url(server), "m"), "m", calls=calls).collect()}
    assert got == {"0": ("answer to shaky", None, 3), "1": (None, "ModelError: 400", 1), "2": (None, "ModelError: 500", 3), "3": ("answer to same", None, 1), "4": ("answer to same", None, 1), "5": (None, None, None), "6": ("answer to ", None, 1)}
    assert server.counts == Counter({"shaky": 3, "wrong": 1, "dead": 3, "same": 1, "": 1})
    ledger.complete(table, partial(ServedModel, url(server), "m"), "m", calls=calls)
    assert server.counts == Counter({"shaky": 3, "wrong": 2, "dead": 6, "same": 1, "": 1})
    ledger.complete(table.where("prompt = 'same'"), partial(ServedModel, url(server), "other"), "other", calls=calls)
    assert server.counts["same"] == 2


def test_calls_in_flight_are_bounded(spark, server, tmp_path):
    server.delay = 0.03
    ledger = ResponseLedger(spark, f"file://{tmp_path}/ledger")
    ledger.complete(prompts(spark, [f"q{i}" for i in range(30)]), partial(ServedModel, url(server), "m"), "m", calls=Calls(in_flight=3), tasks=1)
    assert 1 < server.most <= 3


def test_compaction(spark, server, tmp_path):
    ledger = ResponseLedger(spark, f"file://{tmp_path}/ledger")
    table = prompts(spark, [f"q{i}" for i in range(9)])
    before = sorted(map(tuple, ledger.complete(table, partial(ServedModel, url(server), "m"), "m", calls=QUICK).collect()))
    assert ledger.compact() == 9 and ledger.rows().count() == 9
    assert sorted(map(tuple, ledger.complete(table, partial(ServedModel, url(server), "m"), "m", calls=QUICK).collect())) == before
    assert sum(server.counts.values()) == 9
    assert ResponseLedger(spark, f"file://{tmp_path}/none").compact() == 0


def test_images_are_part_of_the_question(spark, server, tmp_path):
    ledger = ResponseLedger(spark, f"file://{tmp_path}/ledger")
    table = spark.createDataFrame([("1", "full", "look", bytearray(b"a")), ("2", "full", "look", bytearray(b"b")), ("3", "full", "look", bytearray(b"a")), ("4", "full", "look", None)], "doc_id string, kind string, prompt string, png binary")
    rows = ledger.complete(table, partial(ServedModel, url(server), "m"), "m", image="png", calls=QUICK).collect()
    assert server.counts == Counter({"look": 3}) and all(r["response"] == "answer to look" for r in rows)


def test_pauses_grow():
    class Down:
        def complete(self, prompt, image=None):
            raise TimeoutError("slow")

    began = time.perf_counter()
    assert ask(Down(), "x", None, Calls(attempts=4, wait=0.05)) == (None, "TimeoutError: slow", 4)
    assert time.perf_counter() - began >= 0.35
    assert ModelError("x", 429).retryable and ModelError("x").retryable and not ModelError("x", 404).retryable
