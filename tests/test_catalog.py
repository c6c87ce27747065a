"""Every registered query runs; those with SQL give the same rows in DuckDB."""

import datetime
import decimal
import math

import duckdb
import pytest

from gridloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v + 0.0:.9g}" if v else "0"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, datetime.datetime | datetime.date):
        return v.isoformat()
    return "null" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    got = catalog.queries()[name](spark, sf_dir)
    want = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    theirs = sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())
    assert len(mine) == len(theirs)
    bad = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", sorted(catalog.queries().keys() - catalog.oracle_sql().keys()))
def test_runs_without_sql(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0
