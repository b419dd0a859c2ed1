"""The tolerant JSON reader, and the bracket scan over whole batches."""

from __future__ import annotations

import json
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docpipe.functions import jsonx
from docpipe.functions.repair import repair_json
from docpipe.plans import invoice

CASES = [
    ('{"a": 1}', {"a": 1}), ("{'a': 'x', 'b': \"it's\"}", {"a": "x", "b": "it's"}), ("{a: 1, b: two words, c: true}", {"a": 1, "b": "two words", "c": True}),
    ('{"a": 1 "b": "x" "c": ["y" "z"] "d": {"e": null}}', {"a": 1, "b": "x", "c": ["y", "z"], "d": {"e": None}}), ('{"a": 1, // note\n "b": /* x, y */ 2, # end\n}', {"a": 1, "b": 2}),
    ('Sure: {"a": {"b": [1,2,],},} Hope {"this": 1} helps', {"a": {"b": [1, 2]}}), ('{"a": "x", "b": [{"c": "d", "e": "f', {"a": "x", "b": [{"c": "d", "e": "f"}]}), ('{"a": "x", "b": [{"c": "d", "e"', {"a": "x", "b": [{"c": "d"}]}),
    ('{"a" "x", "b" 2}', {"a": "x", "b": 2}), ('{"a": True, "b": None, "c": NaN, "d": undefined}', {"a": True, "b": None, "c": None, "d": None}), ('{"a": "Seller "best" 3", "b": "say "hi", he said", "c": 5}', {"a": 'Seller "best" 3', "b": 'say "hi", he said', "c": 5}),
    ('{"a": "text, "b": 1}', {"a": "text", "b": 1}), ('{"a": [1, 2}, "b": 3', {"a": [1, 2]}), ('{"a": {"b": 1], "c": 2}', {"a": {"b": 1, "c": 2}}), ('{"a": [{"b": 1}, {"b": 2}, "c": 3}', {"a": [{"b": 1}, {"b": 2}], "c": 3}),
    ("{“a”: “x”, ‘b’: ‘y’}", {"a": "x", "b": "y"}), ('{"a": "l1\nl2\tq", "b": "\\x \\u00e9 \\ud83d\\ude00"}', {"a": "l1\nl2\tq", "b": "x é \U0001f600"}), ('{"a":1,"b":2,"a":3}', {"b": 2, "a": 3}), ('{"a: 1, "b": 2}', {"a": 1, "b": 2}),
    ("{a:1,,b:2,:c:3}", {"a": 1, "b": 2, "c": 3}), ('{"a"=>1, b = 2}', {"a": 1, "b": 2}), ('{"u": http://x.y/z, "t": 12:30, "n": 1.234,56}', {"u": "http://x.y/z", "t": "12:30", "n": "1.234,56"}), ("{\"x:y\": 'z'}", {"x:y": "z"}),
    ('{"a": [1, 2, ...], "b": ...}', {"a": [1, 2]}), ('{"n": 007, "p": .5, "r": -1.5e3}', {"n": "007", "p": ".5", "r": -1500.0}), ("{", {}), ('{"a":}', {}), ('{"a": Seller 3", "b": 1}', {"a": "Seller 3", "b": 1}), ('{"a": {"b": 1}} }', {"a": {"b": 1}}),
    ('{"a": 1, {"b": 2}, "c": 3}', {"a": 1, "c": 3}),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_damage(text, want):
    assert json.loads(repair_json(text)) == want


def test_nothing_to_read():
    assert repair_json(None) is None and repair_json("") is None and repair_json("no object [1]") is None


def value(rng: random.Random, depth: int = 0):
    kind = rng.randrange(8 if depth < 4 else 6)
    if kind == 0:
        return rng.choice([True, False, None])
    if kind == 1:
        return rng.choice([0, -5, 3.25, 1e30, 10**12])
    if kind < 6:
        return "".join(rng.choice("ab \"'{}[],:\\/#\n\té\U0001f600.-5") for _ in range(rng.randrange(12)))
    return [value(rng, depth + 1) for _ in range(rng.randrange(4))] if kind == 6 else an_object(rng, depth + 1)


def an_object(rng: random.Random, depth: int = 0) -> dict:
    return {"".join(rng.choice("abc d_\"'é:,{") for _ in range(rng.randrange(1, 6))): value(rng, depth) for _ in range(rng.randrange(5))}


def test_sound_objects_stay_what_they_are():
    rng = random.Random(3)
    for i in range(3000):
        held = an_object(rng)
        assert json.loads(repair_json("x " + json.dumps(held, ensure_ascii=i % 2 == 0, indent=None if i % 3 else 1))) == held


def test_any_damage_gives_an_object():
    rng = random.Random(4)
    for _ in range(5000):
        text = list(json.dumps(an_object(rng)))
        for _ in range(rng.randrange(1, 5)):
            at, how = rng.randrange(len(text) + 1), rng.random()
            if how < 0.4:
                text[at : at + 1] = []
            elif how < 0.8:
                text[at:at] = [rng.choice("{}[],:\"'\\ /#a1")]
            else:
                del text[at:]
        made = repair_json("".join(text))
        assert made is None or isinstance(json.loads(made), dict)


@pytest.mark.parametrize("part", ["[", '{"a":', '" ', '"a", ', '\\"', ",", "a:", '"k": "v", ', '"k":1,', "a b c ", "/* ", "#\n", "{[", '"\n', '"a, "b": ', "' a", '"k",'])
def test_linear(part):
    """Twice the text takes about twice the time, whatever it repeats."""
    took = []
    for n in (20_000, 40_000):
        began = time.process_time()
        repair_json('{"x": ' + part * n)
        took.append(time.process_time() - began)
    assert took[1] < 3 * took[0] + 0.1


def test_repair_in_a_plan(spark):
    """Sound answers go by untouched, damaged ones are mended, empty ones are errors; the rest of the row is as it was."""
    rows = [(1, "full", '{"invoice_number": "1", "invoice_data": [{"name": "}", "net": 5}]} and more'), (2, "full", "```json\n{invoice_number: '2', invoice_data: [{name: x net: 7}]\n```"), (3, "full", "nothing"), (4, "full", None), (5, "full", "")]
    got = {r["doc_id"]: (r["header"]["invoice_number"], [(i["name"], i["net"]) for i in r["items"]], r["parse_error"]) for r in invoice.parsed(spark.createDataFrame(rows, "doc_id long, kind string, response string"), repair=repair_json).collect()}
    assert got == {1: ("1", [("}", "5")], False), 2: ("2", [("x", "7")], False), 3: ("", [], True), 4: ("", [], True), 5: ("", [], True)}


def test_bracket_scan_like_the_loop(spark):
    """Escaped quotes, nested strings, texts of several bytes a letter, nulls and slices of arrays."""
    rng = random.Random(6)
    texts = [None if rng.random() < 0.05 else "".join(rng.choice('{}"\\ab é\U0001f600{}') for _ in range(rng.randrange(25))) for _ in range(20_000)]
    texts += ['{"a": "}\\\\"} x', '\\{"a"}', '{\\"}"}', "", "{", "}{}", '"{"}', '{"a": {"b": "\\"}"}} {', "x" * 50 + "{}"]
    want = [jsonx.balanced_span(t) for t in texts]
    held = pa.array(texts, pa.string())
    assert jsonx.balanced_spans(held).to_pylist() == want
    assert jsonx.balanced_spans(held.slice(777, 3000)).to_pylist() == want[777:3777]
    assert jsonx.balanced_spans(pa.array([], pa.string())).to_pylist() == [] and jsonx.balanced_spans(pa.array([None, None], pa.string())).to_pylist() == [None, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").repartition(3)
    assert {r["i"]: r["s"] for r in df.select("i", jsonx.balanced_object(F.col("t")).alias("s")).collect()} == dict(enumerate(want))
