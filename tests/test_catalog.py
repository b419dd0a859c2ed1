"""Every registered query of the library's own operators, against DuckDB where there is SQL."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import pytest

from docpipe.plans import catalog
from docpipe.plans.inputs import TABLES

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) and math.isfinite(value) else value


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = duck.execute(f"select * from ({ORACLES[name]}) q")
    assert sorted(x[0] for x in want.description) == columns
    want = duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({ORACLES[name]}) q").fetchall()
    mine = Counter(tuple(map(plain, r)) for r in got.select(columns).collect())
    other = Counter(tuple(map(plain, r)) for r in want)
    assert want
    assert mine == other, (list((mine - other).items())[:3], list((other - mine).items())[:3])
