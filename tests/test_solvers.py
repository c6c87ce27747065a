"""Conjugate gradients, Newton and deep-halo stencils against NumPy."""

import numpy as np
import pytest

from gridloom.operators import grid as gd
from gridloom.operators import solvers as sv
from gridloom.sources import matrices as mx


def cells(field):
    return [(i, j, float(v)) for (i, j), v in np.ndenumerate(field)]


def dense(rows, shape, value):
    out = np.full(shape, np.nan)
    for r in rows:
        out[r.i, r.j] = r[value]
    return out


def poisson(n, diagonal):
    a = diagonal * np.eye(n * n)
    for i in range(n):
        for j in range(n):
            for x, y in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)):
                if 0 <= x < n and 0 <= y < n:
                    a[i * n + j, x * n + y] = -1
    return a


@pytest.mark.parametrize("tile", [512, 5])
def test_cg_on_a_grid(spark, monkeypatch, tile):
    monkeypatch.setattr(gd.neighbours, "__defaults__", (tile,))
    n, b = 16, np.random.default_rng(1).normal(size=(16, 16))
    df = spark.createDataFrame(cells(b), "i long, j long, b double")
    found, steps, norm = sv.conjugate_gradient(df, sv.stencil_product(4.0), tolerance=1e-9)
    want = np.linalg.solve(poisson(n, 4.0), b.ravel()).reshape(n, n)
    assert np.allclose(dense(found.collect(), (n, n), "x"), want, atol=1e-8)
    assert norm < 1e-9 and 30 <= steps <= 70


def test_cg_on_a_cube_with_a_known_answer(spark):
    """The 27-point matrix times ones, so the solution is one everywhere."""
    a = mx.stencil_matrix(spark, 5)
    b = a.groupBy("i").agg({"v": "sum"}).toDF("i", "b")
    found, steps, norm = sv.conjugate_gradient(b, sv.matrix_product(a), tolerance=1e-8)
    x = np.array([r.x for r in found.collect()])
    assert len(x) == 125 and np.allclose(x, 1.0, atol=1e-7) and norm < 1e-8 and steps <= 15


def test_cg_reports_failure(spark):
    df = spark.createDataFrame(cells(np.ones((6, 6))), "i long, j long, b double")
    with pytest.raises(sv.NotConverged):
        sv.conjugate_gradient(df, sv.stencil_product(4.0), most=2)
    with pytest.raises(sv.NotConverged):
        sv.conjugate_gradient(df, lambda s: s.withColumn("w", s.r * 0.0))


def test_cg_of_nothing(spark):
    df = spark.createDataFrame([], "i long, j long, b double")
    found, steps, norm = sv.conjugate_gradient(df, sv.stencil_product(4.0))
    assert found.count() == 0 and steps == 0 and norm == 0.0


def newton(old, alpha, dxs):
    """The same solution by Newton steps on the dense Jacobian."""
    n, u = len(old), old.copy()
    for _ in range(30):
        p = np.pad(u, 1)
        f = -(4 + alpha) * u + p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] + alpha * old + dxs * u * (1 - u)
        if np.sqrt((f * f).sum()) < 1e-12:
            break
        u -= np.linalg.solve(-poisson(n, 4 + alpha) + dxs * np.diag((1 - 2 * u).ravel()), f.ravel()).reshape(n, n)
    return u


@pytest.mark.parametrize("tile", [512, 3])
def test_newton_on_one_tile_and_on_many(spark, monkeypatch, tile):
    monkeypatch.setattr(gd.neighbours, "__defaults__", (tile,))
    old = 0.5 * np.random.default_rng(2).random((8, 8))
    found, outer, inner = sv.implicit_step(spark.createDataFrame(cells(old), "i long, j long, v double"), 2.0, 0.4, tolerance=1e-7)
    assert np.allclose(dense(found.collect(), old.shape, "v"), newton(old, 2.0, 0.4), atol=1e-6)
    assert 1 <= outer <= 5 and inner >= outer


def test_newton_reports_failure(spark):
    df = spark.createDataFrame(cells(np.full((4, 4), 0.5)), "i long, j long, v double")
    with pytest.raises(sv.NotConverged):
        sv.implicit_step(df, 2.0, 0.4, newtons=0)
    with pytest.raises(sv.NotConverged):
        sv.implicit_step(df, 2.0, 0.4, cgs=1)


def stepped(field, dt, steps):
    v, known = np.where(np.isnan(field), 0, field), ~np.isnan(field)
    p = np.pad(known, 1)
    change = known & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    for _ in range(steps):
        q = np.pad(v, 1)
        v = np.where(change, v + dt * (q[:-2, 1:-1] + q[2:, 1:-1] + q[1:-1, :-2] + q[1:-1, 2:] - 4 * v), v)
    return np.where(known, v, np.nan)


@pytest.mark.parametrize("tile, depth, steps", [(512, 8, 100), (7, 3, 20), (4, 8, 9), (1, 1, 3), (16, 16, 5)])
def test_deep_halo_equals_single_steps(spark, tile, depth, steps):
    field = np.random.default_rng(3).normal(size=(23, 18))
    rows = cells(field)
    rows = [(i, j, None if (i, j) == (9, 9) else v) for i, j, v in rows if (i, j) not in ((4, 4), (22, 17))]  # a null and two absent cells
    field[9, 9] = field[4, 4] = field[22, 17] = np.nan
    out = gd.diffusion(spark.createDataFrame(rows, "i int, j long, v double"), 0.1, steps, depth, tile)
    got = out.collect()
    assert len(got) == len(rows) and out.dtypes == [("i", "int"), ("j", "bigint"), ("v", "double")]
    assert {(r.i, r.j) for r in got if r.v is None} == {(9, 9)}
    assert np.allclose(dense([r for r in got if r.v is not None], field.shape, "v"), stepped(field, 0.1, steps), equal_nan=True, atol=1e-12)


def test_a_hundred_steps_take_thirteen_shuffles(spark):
    df = spark.createDataFrame(cells(np.ones((3, 3))), "i long, j long, v double")
    plan = gd.diffusion(df, 0.1, 100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 13


def test_deep_halo_refuses_a_repeated_cell(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0)], "i long, j long, v double")
    with pytest.raises(Exception, match="more than once"):
        gd.diffusion(df).collect()
    assert gd.diffusion(df.limit(0)).count() == 0


def test_lorenz_against_numpy(spark):
    starts = [(0, 1.0, 2.0, 3.0), (1, -5.0, 4.0, 20.0)]
    got = {r.id: r for r in gd.lorenz(spark.createDataFrame([*starts, (2, None, 1.0, 1.0)], "id long, x double, y double, z double"), 1.0, 100).collect()}

    def slope(u):
        x, y, z = u
        return np.array([10 * (y - x), x * (28 - z) - y, x * y - 8 / 3 * z])

    for k, *u in starts:
        u, total, h = np.array(u), np.zeros(3), 0.01
        for _ in range(100):
            total += u
            a = slope(u)
            b = slope(u + h / 2 * a)
            c = slope(u + h / 2 * b)
            u = u + h / 6 * (a + 2 * b + 2 * c + slope(u + h * c))
        assert np.allclose([got[k].mean_x, got[k].mean_y, got[k].mean_z], total / 100, rtol=1e-9)
    assert got[2].mean_x is None
