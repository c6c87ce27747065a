"""Stencils on grids (i, j, v): diffusion, heat, the residual of reaction-diffusion; trajectories."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows and columns of a tile of the grid, which one task holds.
TILE = 512
#: Steps that a tile makes for one shuffle.
DEPTH = 8
SIDES = ("west", "east", "south", "north")


def neighbours(grid: DataFrame, tile: int = TILE) -> DataFrame:
    """``grid`` with north, south, west and east values; null beyond the grid.

    Tiles get a border of one cell from those around them, so both directions
    are ordered after a single shuffle by tile. Cells are numbered from 0; rows
    that share a cell are neighbours of one another in no stated order.
    """
    i, j, size = F.col("i"), F.col("j"), F.lit(tile)
    ti, tj = F.expr(f"i div {tile}"), F.expr(f"j div {tile}")
    near = F.struct(ti.alias("_ti"), tj.alias("_tj"), F.lit(True).alias("_own"))
    beside = [
        F.when(on, F.struct((ti + a).alias("_ti"), (tj + b).alias("_tj"), F.lit(False).alias("_own")))
        for on, a, b in ((i % size == 0, -1, 0), (i % size == tile - 1, 1, 0), (j % size == 0, 0, -1), (j % size == tile - 1, 0, 1))
    ]
    # Few cells lie at a border: the others are one row each without looking at four cases.
    inner = (i % size).between(1, tile - 2) & (j % size).between(1, tile - 2)
    places = F.when(inner, F.array(near)).otherwise(F.array_compact(F.array(near, *beside)))
    placed = grid.select("*", F.inline(places)).repartition("_ti", "_tj")
    along_i, along_j = Window.partitionBy("_ti", "_tj", "j").orderBy("i"), Window.partitionBy("_ti", "_tj", "i").orderBy("j")
    made = placed.withColumns({"west": F.lag("v").over(along_i), "east": F.lead("v").over(along_i)}).withColumns(
        {"south": F.lag("v").over(along_j), "north": F.lead("v").over(along_j)}
    )
    return made.where("_own").drop("_ti", "_tj", "_own")


def _dense(rows: pa.Table, i0: int, j0: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of the cells of a square, and which cells have one."""
    i, j = rows.column("i").to_numpy() - i0, rows.column("j").to_numpy() - j0
    value, known = np.zeros((side, side)), np.zeros((side, side), bool)
    value[i, j] = rows.column("v").fill_null(0.0).to_numpy()
    known[i, j] = rows.column("v").is_valid().to_numpy(zero_copy_only=False)
    return value, known


def diffusion(grid: DataFrame, dt: float = 0.1, steps: int = 1, depth: int = DEPTH, tile: int = TILE) -> DataFrame:
    """(i, j, v) after ``steps`` of v + dt * (sum of neighbours - 4 v); a cell without four neighbours stays.

    A tile takes a border ``depth`` cells deep from those around it and makes
    that many steps by itself, in which the border goes stale cell by cell; so
    there is one shuffle for each ``depth`` steps. Cells are whole numbers, each
    met once (a repeated cell is an error); a null value is no neighbour and
    stays null; an empty grid stays empty.
    """
    done = 0
    while done < steps:
        now = min(depth, steps - done, tile)
        grid = _diffused(grid, dt, now, tile)
        done += now
    return grid


def _diffused(grid: DataFrame, dt: float, steps: int, tile: int) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in grid.schema}

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        i0, j0 = (k.as_py() * tile - steps for k in key)
        side = tile + 2 * steps
        i, j = rows.column("i").to_numpy(), rows.column("j").to_numpy()
        if len(np.unique((i - i0) * side + (j - j0))) < len(i):
            raise ValueError(f"a cell of tile {[k.as_py() for k in key]} comes more than once")
        value, known = _dense(rows, i0, j0, side)
        change = known[1:-1, 1:-1] & known[:-2, 1:-1] & known[2:, 1:-1] & known[1:-1, :-2] & known[1:-1, 2:]
        for _ in range(steps):
            inner = value[1:-1, 1:-1]
            around = value[:-2, 1:-1] + value[2:, 1:-1] + value[1:-1, :-2] + value[1:-1, 2:]
            value[1:-1, 1:-1] = np.where(change, inner + dt * (around - 4 * inner), inner)
        own = (i - i0 >= steps) & (i - i0 < steps + tile) & (j - j0 >= steps) & (j - j0 < steps + tile)
        i, j = i[own], j[own]
        out = value[i - i0, j - j0]
        return pa.table({"i": i, "j": j, "v": pa.array(out, mask=~known[i - i0, j - j0])}).cast(pa.schema([rows.schema.field(c) if c != "v" else pa.field("v", pa.float64()) for c in ("i", "j", "v")]))

    def near(c: str) -> list[Column]:
        own = F.floor(F.col(c) / tile)
        return [F.when(F.pmod(c, F.lit(tile)) < steps, own - 1), own, F.when(F.pmod(c, F.lit(tile)) >= tile - steps, own + 1)]

    tiles = F.array_compact(F.array(*[F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("_ti"), b.alias("_tj"))) for a in near("i") for b in near("j")]))
    placed = grid.select("i", "j", F.col("v").cast("double").alias("v"), F.inline(tiles))
    # A tile beyond the grid, with a border alone, would give no cell.
    return placed.groupBy("_ti", "_tj").applyInArrow(run, f"i {kinds['i']}, j {kinds['j']}, v double")


def heat(grid: DataFrame, dx: float, alpha: float = 1.0, steps: int = 1) -> DataFrame:
    """Explicit heat steps with dt = dx^2 / (5 alpha): gamma = alpha dt / dx^2 = 1/5."""
    return diffusion(grid, alpha * (dx * dx / (5 * alpha)) / (dx * dx), steps)


def energy(grid: DataFrame, dx: float) -> DataFrame:
    return grid.agg((F.sum("v") * dx * dx).alias("energy"))


def residual(grid: DataFrame, old: str, alpha: float, dxs: float, border: float | dict[str, Column] = 0.0) -> DataFrame:
    """(i, j, s): -(4 + alpha) v + neighbours + alpha * old + dxs * v (1 - v).

    ``border`` is the value beyond the grid, or the border vectors: an expression
    of i or j for each of west, east, south and north.
    """
    return residual_of(neighbours(grid), old, alpha, dxs, border).select("i", "j", F.col("residual").alias("s"))


def residual_of(around: DataFrame, old: str, alpha: float, dxs: float, border: float | dict[str, Column] = 0.0) -> DataFrame:
    """Rows of ``neighbours`` with ``residual``."""
    v = F.col("v")
    beyond = border if isinstance(border, dict) else {k: F.lit(border) for k in SIDES}
    total = sum((F.coalesce(F.col(k), x) for k, x in beyond.items()), F.lit(0.0))
    return around.withColumn("residual", -(4 + alpha) * v + total + alpha * F.col(old) + dxs * v * (1 - v))


def circle(i: Column, j: Column, centre: tuple[float, float], radius: float, inside: float = 0.1) -> Column:
    return F.when((i - centre[0]) ** 2 + (j - centre[1]) ** 2 < radius**2, inside).otherwise(0.0)


def lorenz(starts: DataFrame, time: float = 4.0, per_unit: int = 250, sigma: float = 10.0, beta: float = 8.0 / 3.0, rho: float = 28.0) -> DataFrame:
    """(id, mean_x, mean_y, mean_z) of each trajectory from starts(id, x, y, z), by fourth-order Runge-Kutta.

    The steps are folded by array functions, so a trajectory is an expression of
    its row; a null start gives null means.
    """
    h, n = 1.0 / per_unit, int(time * per_unit)
    point = lambda x, y, z: F.struct(x.alias("x"), y.alias("y"), z.alias("z"))
    bound = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  a name for a value that is used more than once
    moved = lambda u, k, s: point(*(u[c] + s * k[c] for c in "xyz"))
    slope = lambda u: point(sigma * (u["y"] - u["x"]), u["x"] * (rho - u["z"]) - u["y"], u["x"] * u["y"] - beta * u["z"])
    slope_at = lambda u, k, s: bound(moved(u, k, s), slope)

    def step(state: Column, _: Column) -> Column:
        u = state["u"]
        last = lambda a, b, c, d: F.struct(
            point(*(u[k] + h / 6 * (a[k] + 2 * b[k] + 2 * c[k] + d[k]) for k in "xyz")).alias("u"), point(*(state["sum"][k] + u[k] for k in "xyz")).alias("sum")
        )
        return bound(slope(u), lambda a: bound(slope_at(u, a, h / 2), lambda b: bound(slope_at(u, b, h / 2), lambda c: bound(slope_at(u, c, h), lambda d: last(a, b, c, d)))))

    begin = F.struct(point(*(F.col(c).cast("double") for c in "xyz")).alias("u"), point(*(F.when(F.col(c).isNotNull(), 0.0) for c in "xyz")).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(n)), begin, step, lambda s: s["sum"])
    return starts.select("id", total.alias("total")).select("id", *[(F.col("total")[c] / n).alias(f"mean_{c}") for c in "xyz"])
