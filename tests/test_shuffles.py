"""What queries of whole documents shuffle: numbers and names of items, once, keys of orders, answers; no texts made of items."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import pytest

from docpipe.plans import catalog, inputs


@pytest.fixture
def plain_plans(spark):
    """Plans as large tables have them: no small side is broadcast, and exchanges stand where they are planned."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def exchanges(df) -> list[str]:
    """Keys of the exchanges that are not reused."""
    return sorted(re.findall(r"- Exchange hashpartitioning\((\w+?)#", df._jdf.queryExecution().executedPlan().toString()))


def test_items_like_sql(spark, sf):
    want, got = inputs.run(spark, sf, inputs.ITEMS), inputs.items(spark, sf)
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_greedy_shuffles_items_once(spark, sf, plain_plans):
    assert exchanges(catalog.queries()["match_greedy"](spark, sf)) == ["doc_id", "doc_id", "l_partkey", "p_partkey"]


@pytest.fixture
def small_shares(spark):
    """Shuffles of many partitions that are coalesced by size, differently for each."""
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "12k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_greedy_over_coalesced_shares(spark, sf, small_shares):
    rows = catalog.queries()["match_greedy"](spark, sf).collect()
    assert len(rows) == inputs.table(spark, sf, "lineitem").count()
    assert all(r["line_idx"] == 2 * r["item_no"] for r in rows)


def test_process_shuffles_what_it_is_given(spark, sf, plain_plans):
    """Items as in matching, orders and customers for the answers, answers, keys of orders, and finished invoices without
    columns that the query leaves out."""
    done = catalog.queries()["process_invoices"](spark, sf)
    assert exchanges(done) == ["c_custkey", "doc_id", "doc_id", "doc_id", "doc_id", "l_partkey", "o_custkey", "p_partkey"]
    last = done._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning(doc_id", 1)[1].split("\n")[1]
    assert "ObjectHashAggregate" in last and "invoice_number" in last and "seller" not in last and "unit_price" not in last


def test_process_over_coalesced_shares(spark, sf, small_shares):
    con = duckdb.connect()
    for name in inputs.TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    columns = ["id", "invoice_number", "issue_date", "currency", "n_items", "total_net", "total_gross", "n_warnings", "parse_error"]
    rounded = lambda rows: Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    want = con.execute(f"select {', '.join(columns)} from ({catalog.oracle_sql()['process_invoices']}) q").fetchall()
    assert rounded(catalog.queries()["process_invoices"](spark, sf).select(columns).collect()) == rounded(want)


def test_answers_of_a_document_are_chosen_by_kind(spark):
    """A metadata answer's header, an items answer's items, each else a full one's; any answer's error; lines of all texts in order."""
    from docpipe.plans import invoice

    full, meta, items = '{"invoice_number":"f","currency":"EUR","invoice_data":[{"name":"old","net":"1"}]}', '{"invoice_number":"m","invoice_data":[{"name":"no"}]}', '{"invoice_number":"i","invoice_data":[{"name":"pear","quantity":"1","unit_price":"7","net":"7","gross":"7"},{"name":"fig","net":"2","currency":"USD"}]}'
    rows = [("a", "full", full), ("a", "metadata", meta), ("a", "items", items), ("b", "full", full), ("b", "items", "broken"), ("c", "items", items), ("d", None, full), (None, "full", full), ("e", "metadata", meta), ("e", "full", full)]
    texts = [("a", "x\npear 7,00"), ("a", "y"), ("z", "pear 7,00"), ("e", None)]
    done = invoice.process(spark.createDataFrame(rows, "doc_id string, kind string, response string"), spark.createDataFrame(texts, "doc_id string, table_text string"))
    got = {r["id"]: (r["invoice_number"], [i["name"] for i in r["invoice_data"]], r["currency"], r["n_items"], r["parse_error"]) for r in done.collect()}
    assert got == {"a": ("m", ["pear", "fig"], "USD", 2, False), "b": ("f", [], "EUR", 0, True), "c": ("", ["pear", "fig"], "USD", 2, False), "d": ("", [], "HUF", 0, False), None: ("f", ["old"], "EUR", 1, False), "e": ("m", ["old"], "HUF", 1, False)}


def test_scores_shuffle_items_once(spark, sf, plain_plans):
    assert exchanges(catalog.queries()["match_score"](spark, sf)) == ["doc_id", "doc_id", "l_partkey", "p_partkey"]


def test_scores_over_coalesced_shares(spark, sf, small_shares):
    con = duckdb.connect()
    for name in inputs.TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    columns = ["doc_id", "item_no", "line_idx", "score"]
    want = con.execute(f"select {', '.join(columns)} from ({catalog.oracle_sql()['match_score']}) q").fetchall()
    assert Counter(map(tuple, catalog.queries()["match_score"](spark, sf).select(columns).collect())) == Counter(want)


def test_scores_with_names_folded_before(spark, tmp_path):
    """Names of other letters, folded for each part, score like names and lines that are folded where they stand."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from docpipe.operators.matching import match_scores
    from docpipe.plans import catalog_prices

    names = ["Élan tea", "ΟΔΟΣ Total", "ﬁg pear", "plain pear", "ÖSSZESEN x", "a½ set", None]
    n = len(names)
    tables = {
        "part": {"p_partkey": list(range(n)), "p_name": pa.array(names, pa.string())},
        "orders": {"o_orderkey": [1, 2, 3]},
        "lineitem": {"l_orderkey": [1] * n + [2] * n, "l_partkey": list(range(n)) * 2, "l_suppkey": [0] * 2 * n, "l_linenumber": list(range(n)) * 2, "l_quantity": [2.0] * 2 * n, "l_extendedprice": [10.0 + i for i in range(2 * n)], "l_discount": [0.1] * 2 * n, "l_tax": [0.05] * 2 * n},
    }
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), tmp_path / f"{name}.parquet")
    sf_dir = str(tmp_path)
    want = match_scores(inputs.run(spark, sf_dir, catalog_prices.MATCH_ITEMS), inputs.run(spark, sf_dir, catalog_prices.MATCH_LINES))
    got = catalog_prices.matches(spark, sf_dir)
    assert got.dtypes == want.dtypes and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert got.where("score > 10").count() >= 2 * (n - 1)
