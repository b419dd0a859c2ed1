
from __future__ import annotations

import itertools
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from docpipe.functions import currency, dates, jsonx, numeric, prices, text, triples
from docpipe.plans.prompts import extraction_prompt
from docpipe.schema import check_mode


def values(spark, fn, inputs, kind="string"):
    df = spark.createDataFrame([(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(inputs)], "i int, " + (kind if " " in kind else f"c {kind}")).coalesce(1)
    columns = [F.col(name) for name in df.columns[1:]]
    return [r[0] for r in df.orderBy("i").select(fn(*columns)).collect()]


def test_clean_numeric(spark):
    cases = {"1.234,56": "1234.56", "1 234,56 Ft": "1234.56", "": "", None: "", "1.2345": "12345", "1,234.56": "1.23456", "1,234,567": "1.234.567", "10-20": "10-20", "-5,5 EUR": "-5.5", "0": "0", "abc": "", "1 244,00": "1244.00"}
    assert values(spark, numeric.clean_numeric, list(cases)) == list(cases.values())


def test_net_gross(spark):
    cases = {("10", "5"): True, ("5", "10"): False, ("0", "-1"): False, ("x", "5"): False, (None, "5"): False, ("10,5 Ft", "9,0"): True, ("-5", "-10"): False}
    assert values(spark, numeric.swapped_net_gross, list(cases), "n string, g string") == list(cases.values())


def test_unit_price(spark):
    cases = {("4", "773.69", "294.76"): "73.69", ("4", "73.69", "294.76"): "73.69", ("", "773.69", "294.76"): "773.69", ("4", "7.69", "294.76"): "7.69", ("1", "x", "2"): "x", (None, "1.00", "2"): "1.00"}
    assert values(spark, numeric.fix_unit_price, list(cases), "q string, u string, n string") == list(cases.values())


def test_quantity(spark):
    cases = {("1", "10.00", "30.00"): "3", ("1", "10.00", "34.00"): "1", ("", "10.00", "20.00"): "2", ("2", "10.00", "30.00"): "2", ("1", "0", "30"): "1", ("x", "10", "30"): "x", ("1", None, "30"): "1"}
    assert values(spark, numeric.fix_quantity, list(cases), "q string, u string, n string") == list(cases.values())


def test_dates(spark):
    cases = {"2024-01-15": "2024-01-15", "2025. 01. 10.": "2025-01-10", "2025 / 1 / 9": "2025-01-09", "15.01.2024": "2024-01-15", "13/02/2024": "2024-02-13", "02/13/2024": "2024-02-13", "20240115": "2024-01-15", "2024-02-31": "2024-02-31", "soon": "soon", "": "", None: "", "2025.01.10.": "2025.01.10."}
    assert values(spark, dates.normalize_date, list(cases)) == list(cases.values())
    assert values(spark, lambda c: dates.normalize_date(c, fixed=True), ["2025.01.10."]) == ["2025-01-10"]


def test_currency(spark):
    assert values(spark, currency.detect_currency, ["5 EUR", "€ 1 $ 2", "", None, "10 Ft", "Kč Kč", "10 eur $ $ $"]) == ["EUR", "EUR", "HUF", "HUF", "HUF", "CZK", "USD"]
    assert values(spark, currency.normalize_currency, ["ft", " euro ", "$", "chf", " chf", "", None]) == ["HUF", "EUR", "USD", "CHF", " CHF", "", ""]


def test_fold(spark):
    assert values(spark, text.fold_accents, ["Összesen fizetendő", "áfa ČŁ", None]) == ["Osszesen fizetendo", "afa ČŁ", None]
    assert values(spark, text.nfkd_fold, ["Órák ﬁ", None]) == ["orak fi", ""]
    once = values(spark, text.fold_accents, ["éÉőŰ"])
    assert values(spark, text.fold_accents, once) == once


def test_clean_text(spark):
    cases = {"1 244,00": "1244,00", "1 244": "1244", "1236,00236,00": "1236,00 236,00", "a\n\n  b  \n": "a\nb", "Privacy Policy\nok": "ok", "Privacy Policy 2024-01-02": "Privacy Policy 2024-01-02", None: "", "1\n336,00": "1336,00"}
    assert values(spark, text.clean_text, list(cases)) == list(cases.values())


def test_barcode(spark):
    assert values(spark, text.is_barcode, ["4744183012622", "123", "1234-5678", "", None]) == [True, False, True, False, False]


def test_table_lines(spark):
    assert values(spark, text.table_lines, ["a\r\n b \n\n\x1cc d", None]) == [["a", "b", "c", "d"], []]


def test_balanced():
    assert jsonx.balanced_span('x {"a": "}{", "b": {"c": "\\""}} y}') == '{"a": "}{", "b": {"c": "\\""}}'
    assert jsonx.balanced_span('{"a": 1') is None and jsonx.balanced_span("none") is None and jsonx.balanced_span(None) is None


def test_json(spark):
    whole = '{"seller":{"name":"S"},"buyer":"x","currency":null,"invoice_data":[{"name":1,"net":true},"no",{"gross":"5"}]}'
    got = values(spark, jsonx.parse_response, [whole, "nothing", None])
    assert got[0]["header"]["seller"]["name"] == "S" and got[0]["header"]["buyer"]["name"] == "" and got[0]["header"]["currency"] == "None"
    assert [(i["name"], i["net"], i["gross"]) for i in got[0]["items"]] == [("1", "True", ""), ("", "", "5")]
    assert got[1]["parse_error"] and got[1]["items"] == [] and got[2]["parse_error"]
    fixed = values(spark, lambda c: jsonx.parse_response(c, "fixed"), [whole])
    assert fixed[0]["header"]["currency"] == ""
    assert values(spark, jsonx.strip_fence, ["```json\n{}\n```", "{}", "``` {} "]) == ["{}", "{}", "``` {} "]
    assert values(spark, jsonx.largest_object, ["{a} {b{c}} {d"]) == ["{b{c}}"]


def test_modes():
    assert check_mode("fixed") and not check_mode("parity")
    with pytest.raises(ValueError):
        check_mode("other")


def test_prompts(spark):
    long = "5 EUR " + "x" * 3000
    got = [values(spark, lambda c, kind=kind: extraction_prompt(c, kind), [long])[0] for kind in ("metadata", "items", "full")]
    assert [p.count("x" * 1000) for p in got] == [1, 3, 1] and all('"EUR"' in p for p in got)
    with pytest.raises(ValueError):
        extraction_prompt(F.lit(""), "other")


RATES = [Decimal(x) for x in ("0", "0.05", "0.18", "0.27")]


def plain_score(u, n, g, vat, q):
    low = Decimal("0.01")
    signs = [v for v in (u, n, g) if abs(v) > low]
    if min(u, n, g) < 0 < max(u, n, g):
        return None
    if any(v > 0 for v in signs) and any(v < 0 for v in signs):
        return None
    a, b, c = (-u, -n, -g) if any(v < 0 for v in signs) else (u, n, g)
    if a > b + low or b > c + low:
        return None
    off = [abs((n * (1 + r)).quantize(Decimal("0.01"), "ROUND_HALF_UP") - g) for r in ([vat] if vat is not None else RATES)]
    out = Decimal(0)
    if abs(q - 1) < low:
        out += -100 if abs(u - n) < low else abs(u - n) * 10
    if min(off) <= Decimal("0.5"):
        out -= 50 if vat is not None else 30
    else:
        out += min(off) * (20 if vat is not None else 10)
    return out + (g - u) / 10


def plain_best(amounts, vat, q):
    doubt = [i for i, p in enumerate(amounts) if 100 <= abs(p) < 1000 and max(map(abs, amounts)) >= 900]
    best = None
    for number, choice in enumerate(itertools.product((0, 1), repeat=len(doubt))):
        held = list(amounts)
        for i, more in zip(doubt, choice, strict=True):
            held[i] += more * (1000 if held[i] >= 0 else -1000)
        for i, j, k in itertools.combinations_with_replacement(range(len(held)), 3):
            for u, n, g in itertools.permutations((held[i], held[j], held[k])):
                score = plain_score(u, n, g, vat, q)
                if score is not None and (best is None or (score, number, i, j, k, u, n, g) < best):
                    best = (score, number, i, j, k, u, n, g)
    return best


def test_best_triple(spark):
    rng, rows = random.Random(6), []
    for _ in range(60):
        n = rng.randint(2, 5)
        amounts = [Decimal(rng.choice((1, 1, 1, -1)) * rng.choice((rng.randint(100, 99999), 120000, 50000))) / 100 for _ in range(n)]
        if rng.random() < 0.3:
            amounts = [abs(a) for a in amounts]
        amounts = [a.quantize(Decimal("0.01")) for a in amounts]
        rows.append((amounts, rng.choice((None, Decimal("0.27"), Decimal("0.05"))), Decimal(rng.choice((1, 2)))))
    rows.append(([Decimal("123456789012.50"), Decimal("123456789012.50"), Decimal("156790121.37")], Decimal("0.27"), Decimal(1)))
    texts = [(" ".join(map(str, a)).replace(".", ","), v, q) for a, v, q in rows]
    df = spark.createDataFrame([(i, t, v, q) for i, (t, v, q) in enumerate(texts)], "i int, t string, v decimal(18,6), q decimal(18,4)")
    c = prices.price_candidates(F.col("t"), "fixed").withField("vat_percent", F.col("v"))
    got = [r["b"] for r in prices.with_best_triple(df.withColumn("c", c), "c", F.col("q"), "b").orderBy("i").collect()]
    for r, (amounts, vat, q) in zip(got, rows, strict=True):
        want = plain_best(amounts, vat, q) if len(amounts) >= 3 else None
        assert (None if r is None else tuple(r)) == want, (amounts, vat, q)


def units(x: Decimal) -> int:
    return int(x * 10_000)


def test_best_triple_in_pairs():
    """The pair search against all triples of all sets: small and equal amounts, signs within a cent, ambiguous ones that exclude each other."""
    rng = random.Random(12)
    for case in range(300):
        n = rng.randint(3, 6)
        pool = [Decimal(x) / 100 for x in (rng.choice(((-2, -1, 0, 1, 2, 3), (10000, 110000, 20000, 120000, 95000, 15000), (-10000, -110000, -90000, 12700, 10000), (500, 501, 635, 1000, 1270, 90000))))]
        amounts = [rng.choice(pool) for _ in range(n)]
        vat, q = rng.choice((None, Decimal("0.27"), Decimal("0.05"))), Decimal(rng.choice((1, 2)))
        doubt = [int(100 <= abs(p) < 1000 and max(map(abs, amounts)) >= 900) for p in amounts]
        for kind in (np.int64, object):
            got = triples.best_rows(np.array([[units(a) for a in amounts]], kind), np.array([doubt]), np.array([int((vat or 0) * 1_000_000)], kind), np.array([vat is not None]), np.array([q == 1]))[0]
            want = plain_best(amounts, vat, q)
            assert got == (None if want is None else (int(want[0] * 1_000_000), *want[1:5], *map(units, want[5:]))), (case, amounts, vat, q)


@pytest.mark.parametrize("share", [0, 0.2])
def test_best_triple_of_many_prices(share):
    """500 prices in a row: in time and bounded memory."""
    import time
    import tracemalloc

    rng = np.random.default_rng(4)
    prices_ = np.unique(rng.integers(100_000, 9_000_000_000, 600))[:500].reshape(1, -1)
    doubt = (rng.random((1, 500)) < share).astype(np.int64)
    tracemalloc.start()
    began = time.perf_counter()
    found = triples.best_rows(prices_, doubt, np.array([270_000]), np.array([True]), np.array([True]))[0]
    took, peak = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found and found[5] == found[6] and took < 10 and peak < 200e6


def test_candidates(spark):
    line = "Organic Shop Body Scrub 4744183012622 1 1244,00 1244,00 27% 336,00 1580,00"
    parity, fixed = (values(spark, lambda c, m=m: prices.price_candidates(c, m), [line, None, "5% -3,5"]) for m in ("parity", "fixed"))
    assert [float(p) for p in parity[0]["prices"]] == [336.0, 1580.0] and float(parity[0]["vat_percent"]) == 12.44
    assert [float(p) for p in fixed[0]["prices"]] == [1244.0, 1244.0, 336.0, 1580.0] and float(fixed[0]["vat_percent"]) == 0.27
    assert fixed[0]["ambiguous"] == [2] and fixed[1]["prices"] == [] and [float(p) for p in fixed[2]["prices"]] == [-3.5]


def test_estimate(spark):
    assert values(spark, numeric.estimated_seconds, [0, 1000, None], "long") == [75.0, 105.0, 75.0]
