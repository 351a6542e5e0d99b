"""Every query with SQL gives what DuckDB gives; the others run."""

from __future__ import annotations

from decimal import Decimal

import duckdb
import pytest

from spanwright.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal | float):
        return float(f"{float(v):.9g}")
    return str([plain(x) for x in v]) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in catalogue.ORACLES:
        assert got
        return
    r = duck.sql(catalogue.ORACLES[name])
    names = [d[0] for d in r.description]
    want = sorted((tuple(plain(dict(zip(names, x, strict=True))[c]) for c in columns) for x in r.fetchall()), key=str)
    assert got == want
