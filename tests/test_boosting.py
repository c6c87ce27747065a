"""Boosted trees against the same growth over NumPy arrays, and beside Spark's own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import boosting as bo


def plain(x, y, edges, rounds, depth, rate, least=1.0, penalty=1.0):
    """[(tree, number, feature, threshold)] of all splits, and the margins, by trying every cut of every node."""
    margin, out = np.zeros(len(y)), []
    for tree in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        score = lambda m: g[m].sum() ** 2 / (h[m].sum() + penalty)
        todo, add = [(1, np.ones(len(y), bool), 0)], np.zeros(len(y))
        while todo:
            n, own, level = todo.pop()
            best = (1e-12, None)
            for f in range(x.shape[1]) if level < depth else ():
                for e in edges[f]:
                    right = own & (x[:, f] > e)
                    left = own & ~(x[:, f] > e)
                    if min(h[left].sum(), h[right].sum()) >= least and score(left) + score(right) - score(own) > best[0] + 1e-12:
                        best = (score(left) + score(right) - score(own), (f, e, left, right))
            if best[1] is None:
                add[own] = -rate * g[own].sum() / (h[own].sum() + penalty)
            else:
                f, e, left, right = best[1]
                out.append((tree, n, f, e))
                todo += [(2 * n, left, level + 1), (2 * n + 1, right, level + 1)]
        margin += add
    return sorted(out), margin


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 4)).round(2)
    x[:40, 2] = np.nan
    y = ((x[:, 0] > 0.3) ^ (np.nan_to_num(x[:, 2], nan=-9) > 0.5) | (rng.random(400) < 0.1)).astype(float)
    return x, y


def frame(spark, x, y):
    rows = [(*(None if np.isnan(v) else float(v) for v in r), int(t)) for r, t in zip(x, y, strict=True)]
    return spark.createDataFrame([*rows, (1.0, 1.0, 1.0, 1.0, None)], "a double, b double, c double, d double, y int")


def test_same_splits_as_over_arrays(spark, data, tmp_path):
    x, y = data
    edges = [np.quantile(np.nan_to_num(x[:, k], nan=0), [0.2, 0.4, 0.6, 0.8]).round(2).tolist() for k in range(4)]
    df = frame(spark, x, y)
    fit = bo.boost(df, ["a", "b", "c", "d"], "y", rounds=3, depth=3, rate=0.75, edges=edges)
    low = np.where(np.isnan(x), -np.inf, x)  # a null goes left
    want, margin = plain(low, y, edges, 3, 3, 0.75)
    assert sorted((n.tree, n.number, n.feature, n.threshold) for n in fit.nodes if n.feature >= 0) == want
    got = [r.m for r in df.where("y is not null").select(fit.margin().alias("m")).collect()]
    assert np.allclose(got, margin, atol=1e-9)
    fit.save(spark, str(tmp_path / "fit"))
    again = bo.Boosted.load(spark, str(tmp_path / "fit"))
    assert [r.p for r in df.select(again.probability().alias("p")).collect()] == [r.p for r in df.select(fit.probability().alias("p")).collect()]


def test_accuracy_beside_sparks_own(spark, data):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    x, y = data
    df = frame(spark, np.nan_to_num(x, nan=-9), y).where("y is not null")
    fit = bo.boost(df, ["a", "b", "c", "d"], "y", rounds=6, depth=3)
    right = df.select(F.avg(((fit.margin() > 0).cast("int") == F.col("y")).cast("double"))).first()[0]
    vectors = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="v").transform(df)
    other = GBTClassifier(featuresCol="v", labelCol="y", maxDepth=3, maxIter=6).fit(vectors).transform(vectors)
    theirs = other.select(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
    assert right > 0.9 and right >= theirs - 0.03


def test_nothing_and_one_class(spark):
    df = spark.createDataFrame([], "a double, y int")
    assert [n.weight for n in bo.boost(df, ["a"], "y", rounds=1).nodes] == [0.0]
    ones = spark.createDataFrame([(float(k), 1) for k in range(10)], "a double, y int")
    fit = bo.boost(ones, ["a"], "y", rounds=2)
    assert all(n.feature < 0 and n.weight > 0 for n in fit.nodes)


def test_query_is_right_on_held_out_rows(spark, sf_dir):
    from gridloom.plans.catalog import queries

    rows = queries()["boosted_trees_quality"](spark, sf_dir).collect()
    held = [r for r in rows if r.held_out and r.quality is not None]
    always = max(sum(r.quality for r in held), sum(1 - r.quality for r in held)) / len(held)
    assert sum(r.predicted == r.quality for r in held) / len(held) >= max(0.8, always)
