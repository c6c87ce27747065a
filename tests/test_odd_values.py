"""Queries over small tables of odd values give the rows of their SQL."""

import math

import duckdb

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalars as sc
from gridloom.operators import distances as ds
from gridloom.plans import catalog


def said(rows, columns):
    """Rows in order, floats to nine digits; infinite values, NaN and null stay apart."""
    plain = lambda v: f"{v + 0.0:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(tuple(plain(r[c]) for c in columns) for r in rows)


def same_as_sql(spark, tmp_path, name, **tables):
    with duckdb.connect() as con:
        for table, rows in tables.items():
            rows.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        found = con.sql(catalog.oracle_sql()[name])
        columns, want = found.columns, [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]
    got = catalog.queries()[name](spark, str(tmp_path))
    assert sorted(got.columns) == sorted(columns)
    assert said(got.collect(), columns) == said(want, columns)
    return want


def test_overflow_flags_where_the_product_passes_64_bits(spark, tmp_path):
    keys = [0, 1, 9223, 9224, 119_999, -1, -9224, -18_446, -18_447, -20_000, 2**63 - 1, -(2**63), None]
    rows = [(k, size) for k, size in zip(keys, [1, 30, 31, 50, -31, None, *range(7)], strict=True)]
    want = same_as_sql(spark, tmp_path, "overflow_flags", part=spark.createDataFrame(rows, "p_partkey long, p_size int"))
    assert {r["adds_over"] for r in want} == {True, False}


def priced(spark, paths):
    """Events of users whose values follow ``paths``."""
    rows = [(u, v) for u, path in enumerate(paths) for v in path]
    made = spark.createDataFrame([(k, u, v) for k, (u, v) in enumerate(rows)], "event_id long, user_id long, value double")
    return made.selectExpr("*", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, event_id div 2) AS ts")


#: Zeros of both signs before and after other values, a null, values below zero and beyond all.
ODD = [(0.0, 0.0, 5.0, 0.0, 2.0), (-0.0, 3.0, -0.0, -3.0, 0.0, -0.0), (1.0, None, 0.0, None), (4.0, -2.0, -2.0, 1.0), (math.inf, 1.0, math.inf, math.inf), (math.nan, 2.0, math.nan, 0.0)]


def test_returns_of_zeros(spark, tmp_path):
    """Nor is 57.63 / 6.4 - 1 a half at six digits."""
    want = same_as_sql(spark, tmp_path, "returns", events=priced(spark, [*ODD, (6.4, 57.63)]))
    assert {str(r["log"]) for r in want} >= {"inf", "-inf", "nan", "None"}


@pytest.mark.parametrize("paths", [ODD, [(2.0, 2.0, 2.0)], [(0.0, 1.0), (1.0, 2.0, 2.5)], [(1.0,)], [(1.0, 1.1, 1.3), (1.0, None, 7.0, 2.0)]])
def test_uncentred_r2_of_zeros(spark, tmp_path, paths):
    """Returns that are infinite, all zero, none, or plain."""
    same_as_sql(spark, tmp_path, "uncentered_return_r2", events=priced(spark, paths))


def test_rounded_as_sql(spark):
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(size=2000), (rng.integers(-(10**6), 10**6, 4000) + 0.5) / 1e4, 57.63 / 6.4 - 1, 1e305, 2**52 + 0.5, 0.49999999999999994, -0.0, math.inf, -math.inf, math.nan]
    df = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", *[sc.rounded(F.col("x"), n).alias(f"y{n}") for n in (2, 4, 6)])
    with duckdb.connect() as con:
        for r in df.collect():
            for n in (2, 4, 6):
                assert repr(r[f"y{n}"] + 0.0) == repr(con.execute(f"SELECT round(?::DOUBLE, {n})", [r.x]).fetchone()[0] + 0.0), (r, n)


@pytest.mark.parametrize("name", ["l1_queries", "l2sq_queries", "signed_queries"])
def test_distances_of_odd_vectors(spark, tmp_path, name):
    """Nulls for vectors and in them, none in common, other lengths, no places, NaN, and keys that are null or negative."""
    vectors = [[1.0, 2.5, -3.0], None, [], [4.0], [None, 1.0, 7.0], [5.0, None, None, 2.0], [math.nan, 1.0, 1.0], [1e-9, -0.0, 0.00005], [None, None, None], [0.1, 0.2, 0.3]]
    keys = [0, 50, -50, 100, 150, 7, 200, 250, 300, None]
    df = spark.createDataFrame(list(zip(keys, vectors, strict=True)), "vec_id long, embedding array<float>")
    want = same_as_sql(spark, tmp_path, name, embeddings=df)
    assert len(want) == 80 and any(r["distance"] is None for r in want)


def test_outer_sum_of_odd_values(spark, tmp_path):
    rows = [(0, 1.005), (50, None), (-50, -1.005), (3, math.inf), (100, -math.inf), (None, 2.0), (150, 0.00005)]
    same_as_sql(spark, tmp_path, "outer_sum", supplier=spark.createDataFrame(rows, "s_suppkey long, s_acctbal double"))


def test_pairs_are_dealt_to_tasks(spark, monkeypatch):
    """One file's rows are one task's no more; blocks of both sides meet once."""
    monkeypatch.setattr(ds, "TASK_PAIRS", 2000)
    monkeypatch.setattr(ds, "TASK_QUERIES", 40)
    monkeypatch.setattr(ds, "ROW_BLOCK", 16)
    monkeypatch.setattr(ds, "QUERY_BLOCK", 8)
    df = spark.range(200).coalesce(1).selectExpr("id AS k", "array(double(id), 1.0D) AS x", "double(id) AS v")
    want = {(q, i) for q in range(0, 200, 2) for i in range(200)}
    for out, of in ((ds.to_queries(df, df.where("k % 2 = 0"), "k", "x", ds.l1), lambda q, i: abs(q - i)), (ds.outer_sum(df, df.where("k % 2 = 0"), "k", "v", "distance"), lambda q, i: q + i)):
        rows = out.withColumn("task", F.spark_partition_id()).collect()
        assert {(r.q, r.id) for r in rows} == want and len(rows) == len(want)
        assert all(r.distance == of(r.q, r.id) for r in rows)
        assert len({r.task for r in rows}) > 5


def test_sell_product_of_odd_values(spark, tmp_path):
    """Null quantities and balances, parts without lines, lines without part or supplier, columns of several blocks and below zero."""
    rows = [(0, 1, 2.0), (0, 1, None), (0, 2, 3.0), (1, 1, None), (2, 7, 4.0), (3, 3, 5.0), (3, 5000, 6.0), (4, 5000, 1.5), (9, 1, 1.0), (None, 1, 1.0), (5, None, 1.0), (6, -1, 2.0), (6, -4097, 3.0), (6, 4095, 4.0), (6, 1, 8.0)]
    lineitem = spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_quantity double")
    supplier = spark.createDataFrame([(1, 10.5), (2, -3.25), (3, None), (5000, 100.0), (-1, 7.0), (-4097, 11.0), (4095, 13.0)], "s_suppkey long, s_acctbal double")
    want = same_as_sql(spark, tmp_path, "sell_product", lineitem=lineitem, supplier=supplier, part=spark.range(7).withColumnRenamed("id", "p_partkey"))
    assert len(want) == 7
