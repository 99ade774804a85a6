"""Every registered query of the library against DuckDB on the smallest tables."""

from __future__ import annotations

import datetime as dt
import math

import duckdb
import pytest

from tessera.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, oracle, name):
    frame = QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    if name not in ORACLE_SQL:
        assert got
        return
    result = oracle.sql(ORACLE_SQL[name])
    assert sorted(result.columns) == columns
    want = sorted((tuple(plain(dict(zip(result.columns, r, strict=True))[c]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
