"""The ten queries over whole small tables, against the libraries, brute force or DuckDB."""

from __future__ import annotations

import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docpipe.llm import pii, queries
from tests.llm import brute

Q = queries.queries()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def ids_of(docs, name):
    held = Tokenizer.from_file(public_tokenizers.path(name))
    return held, {i: held.encode(t or "", add_special_tokens=False).ids for i, t in docs}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = Q[name](spark, sf)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]})").fetchall()
    assert Counter(tuple(r) for r in got.select(columns).collect()) == Counter(want)
    assert want


def test_op1_brute(spark, sf, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r["doc_id"], r["item_id"], r["n_item_shingles"], r["n_shared"]) for r in Q["op1_containment"](spark, sf).collect()}
    assert got == brute.contained(docs, items)


def test_op3(spark, sf, docs):
    held, want = ids_of(docs, queries.WORD_BPE)
    for r in Q["op3_bpe_round_trip"](spark, sf).collect():
        ids = want.pop(r["doc_id"])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == brute.sha(np.array(ids, "<u4").tobytes())
        assert r["decoded_sha256"] == brute.sha(held.decode(ids, skip_special_tokens=False))
    assert not want


def test_op5(spark, sf, docs):
    _, want = ids_of(docs, queries.BYTE_BPE)
    got, start = {r["doc_id"]: r for r in Q["op5_rans_tokens"](spark, sf).collect()}, 0
    assert got.keys() == want.keys()
    for doc_id in sorted(want):
        ids = [*want[doc_id], 0]
        r = got[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op6(spark, docs):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = Q["op6_attention_mil"](spark, sf).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    known = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(known) > 50
    assert sum(a == b for a, b in known) / len(known) > 0.9


def test_op7(spark, sf, docs):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in Q["op7_lpf"](spark, sf).collect()}
    assert got == brute.removed(docs)


def test_op8(spark, sf, docs):
    got = {r["doc_id"]: r["class_id"] for r in Q["op8_bagminhash"](spark, sf).collect()}
    assert got == brute.classes(docs)


def added(text, base, trees):
    """Proposals by likelihood, each compared with all chosen ones and all base spans."""
    found = [s for s in dict.fromkeys(sorted(pii.proposals(text), key=lambda s: (s[0], s[1], pii.KINDS.index(s[2])))) if not any(s[0] < b and a < s[1] for a, b, _ in base)]
    p = trees.probability(np.array([pii.features(text, s) for s in found])).tolist() if found else []
    out = []
    for q, s in sorted(zip(p, found, strict=True), key=lambda z: -z[0]):
        if q >= trees.thresholds[s[2]] and not any(s[0] < b and a < s[1] for a, b, _ in out):
            out.append(s)
    return out


def test_op9(spark):
    """All spans, base and added, of every document; some are added."""
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows, trees, n_added = {r["doc_id"]: r for r in Q["op9_pii"](spark, sf).collect()}, pii.fitted(table), 0
    docs = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
    assert len(rows) == len(docs)
    for doc_id, text in docs:
        want, r = brute.pii(text), rows[doc_id]
        assert r["base_sha256"] == brute.sha(brute.listed(want))
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[2] == k for s in want) for k in ("email", "ip", "card", "phone")]
        more = added(text or "", want, trees)
        n_added += len(more)
        assert r["spans"] == brute.listed(sorted([*want, *more], key=lambda s: (s[0], pii.KINDS.index(s[2]))))
    assert n_added >= 2


def test_op10(spark, sf, docs):
    rows = {r["doc_id"]: r for r in Q["op10_secrets"](spark, sf).collect()}
    assert len(rows) == len(docs)
    for doc_id, text in docs:
        want, r = brute.secrets(text), rows[doc_id]
        assert r["base_sha256"] == brute.sha(brute.listed(want))
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[2] == k for s in want) for k in ("assign", "access", "hex")]
        assert {f"{k}:{a}:{b}" for a, b, k in want} <= set(r["spans"].split(","))
