"""Lookups in irregular intervals and products on stored chunks, against plain Python and NumPy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import intervals as iv
from gridloom.operators import sparse as sp


def brute(rows, points):
    """(id, before, after) for each (id, key, x), from points (key, at, y)."""
    out = []
    for i, k, x in rows:
        own = [p for p in points if p[0] == k and p[1] is not None]
        down = [p for p in own if x is not None and p[1] <= x]
        up = [p for p in own if x is not None and p[1] > x]
        out.append((i, max(down)[1:] if down else None, min(up)[1:] if up else None))
    return out


@pytest.fixture
def split(spark):
    """Five partitions, whatever their size."""
    own = {"spark.sql.shuffle.partitions": "5", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("partitions", [1, 7])
def test_bracketed_against_brute_force(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rng = random.Random(partitions)
        points = [(rng.choice(["a", "b", None]), rng.choice([None, *np.round(np.linspace(0, 9, 19), 1).tolist()]), rng.randint(0, 5)) for _ in range(60)]
        rows = [(i, rng.choice(["a", "b", "none", None]), rng.choice([None, round(rng.uniform(-1, 10), 1)])) for i in range(200)]
        rows += [(1000 + i, "a", 4.5) for i in range(300)]  # a hot place
        rows += rows[:5]
        df = spark.createDataFrame([(*r, "p", [1]) for r in rows], "id long, key string, x double, _point string, before array<int>")
        df = df.withColumnRenamed("before", "_row")
        found = iv.bracketed(df, F.col("x"), spark.createDataFrame(points, "key string, at double, y int"), "at", ["key"])
        assert found.columns == ["id", "key", "x", "_point", "_row", "before", "after"]
        got = [(r.id, tuple(r.before) if r.before else None, tuple(r.after) if r.after else None) for r in found.collect()]
        assert ordered(got) == ordered(brute(rows, points))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 3)


def test_a_hot_interval_is_spread(spark, split):
    """Ten thousand rows of one place do not land in one range."""
    df = spark.range(10_000).withColumn("x", F.lit(2.5))
    points = spark.createDataFrame([(0.0, 1), (2.0, 7), (3.0, 9)], "at double, y int")
    found = iv.as_of(df, F.col("x"), points, "at")
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert found.where("at = 2.0 and y = 7").count() == 10_000
    assert len(sizes) >= 3 and max(sizes) < 6_000


def test_interpolation_between_irregular_points(spark):
    at = np.array([0.0, 0.1, 1.0, 7.0, 7.5])
    y = np.array([1.0, 5.0, 2.0, -3.0, 0.0])
    x = np.array([-0.5, 0.0, 0.05, 0.1, 0.9, 1.0, 3.3, 7.2, 7.5, 8.0])
    points = spark.createDataFrame([(float(a), float(b)) for a, b in zip(at, y, strict=True)], "at double, y double")
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = {r.x: r.y for r in iv.interpolated_between(df, F.col("x"), points, "at", "y").collect()}
    for v in x:
        assert got[v] is None if v < 0 or v > 7.5 else np.isclose(got[v], np.interp(v, at, y))


def test_empty_tables(spark):
    points = spark.createDataFrame([], "at double, y int")
    df = spark.createDataFrame([(1, 2.0)], "id long, x double")
    assert [tuple(r) for r in iv.as_of(df, F.col("x"), points, "at").collect()] == [(1, 2.0, None, None)]
    assert iv.as_of(df.limit(0), F.col("x"), points, "at").count() == 0


# -- stored chunks


def matrix(spark, entries):
    return spark.createDataFrame(entries, "i long, j long, v double")


@pytest.mark.parametrize("c, sigma, block, width", [(8, 1, 4096, 1024), (4, 16, 7, 3), (1, 1, 2, 1), (3, 5, 64, 10)])
def test_sell_product_equals_the_dense_one(spark, c, sigma, block, width):
    rng = np.random.default_rng(c)
    dense = np.where(rng.random((37, 50)) < 0.2, rng.normal(size=(37, 50)), 0)
    dense[5] = rng.normal(size=50)  # a row without a gap
    dense[9] = 0
    a = matrix(spark, [(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense), strict=True)])
    x = rng.normal(size=50)
    chunks, lanes = sp.sell(a, spark.range(37).toDF("i"), c, sigma, block, width)
    sizes = chunks.select("chunk", "block", "part", "width", F.size("columns").alias("n"), F.size("values").alias("m")).collect()
    assert all(r.n == r.m == r.width * c <= c * width for r in sizes)
    assert chunks.select(F.sum(F.size(F.filter("columns", lambda k: k >= 0)))).first()[0] == (dense != 0).sum()
    xs = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x) if k != 3] + [(3, None)], "j long, x double")
    got = {r.i: r.v for r in sp.sell_spmv(chunks, lanes, xs, c, block).collect()}
    x[3] = 0
    assert len(got) == 37 and np.allclose([got[k] for k in range(37)], dense @ x)


def test_a_row_of_a_million_entries(spark, split):
    """No array and no window holds the row; the products agree."""
    n = 1_000_000
    a = spark.range(n).selectExpr("0L AS i", "id AS j", "double(id % 5) AS v").union(spark.range(3).selectExpr("id + 1 AS i", "id AS j", "2.0D AS v"))
    x = spark.range(n).selectExpr("id AS j", "double(id % 3) AS x")
    chunks, lanes = sp.sell(a, spark.range(4).toDF("i"), 8, 32)
    longest, = chunks.select(F.max(F.size("columns"))).first()
    assert longest <= 8 * 1024
    want = {r.i: r.v for r in sp.spmv(a, x).collect()}
    assert {r.i: r.v for r in sp.sell_spmv(chunks, lanes, x).collect()} == want
    parts = sp.csr_parts(a)
    assert parts.select(F.max(F.size("entries"))).first()[0] <= sp.PART and parts.where("i = 0").count() == -(-n // sp.PART)
    placed = sp.position_in_row(a)
    assert placed.where("i = 0 and place <> j").count() == 0 and placed.count() == n + 3
    sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 3


def test_sell_of_nothing(spark):
    chunks, lanes = sp.sell(matrix(spark, []), spark.range(2).toDF("i"))
    assert chunks.count() == 0
    assert {tuple(r) for r in sp.sell_spmv(chunks, lanes, spark.createDataFrame([], "j long, x double")).collect()} == {(0, 0.0), (1, 0.0)}
