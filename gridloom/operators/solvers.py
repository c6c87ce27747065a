"""Krylov and Newton iterations whose vectors are tables.

A step is one job: the vectors are updated row by row, the product is made (for
a stencil with one shuffle), and two scalar sums come back with the write of the
new state to the shared folder, which also cuts the lineage. A lost executor
costs tasks of one step.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gridloom.operators import grid as gd
from gridloom.operators import sparse as sp
from gridloom.session import delete, kept_dir, stored

Product = Callable[[DataFrame], DataFrame]
_VECTORS = ("x", "r", "p", "s", "w")


class NotConverged(ArithmeticError):
    """An iteration has not reached its tolerance in the steps allowed."""


def _sums(df: DataFrame) -> tuple[DataFrame, str, float, float]:
    """``df`` stored, where, and the sums of r * r and w * r."""
    seen = Observation()
    kept, path = stored(df.observe(seen, F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("w") * F.col("r")).alias("wr")))
    found = seen.get
    return kept, path, found["rr"] or 0.0, found["wr"] or 0.0


def conjugate_gradient(system: DataFrame, product: Product, tolerance: float = 1e-6, most: int = 200) -> tuple[DataFrame, int, float]:
    """``system`` with the solution ``x`` of A x = b, the steps taken and the residual's norm.

    ``system`` has a right side ``b`` and whatever ``product`` needs; ``product``
    adds ``w`` = A r to rows that have ``r``. A must be symmetric and definite.
    The two sums of a step belong to one pass (the recurrences of Chronopoulos
    and Gear), so a step reads and writes the state once. Raises NotConverged
    after ``most`` steps, or where A proves indefinite. The result lies in the
    shared folder until ``session.clean_up``. An empty table gives no row; a null
    in ``b`` counts as nothing in the sums and leaves a null ``x``.
    """
    own = system.columns
    zero = F.lit(0.0)
    state = product(system.withColumns({"x": zero, "r": F.col("b"), "p": zero, "s": zero}))
    state, path, rr, wr = _sums(state.select(*own, *_VECTORS))
    alpha, before, steps = 0.0, 0.0, 0
    while math.sqrt(rr) >= tolerance:
        beta = rr / before if steps else 0.0
        curve = wr - beta * rr / alpha if steps else wr
        if steps >= most or not curve or not math.isfinite(rr + wr):
            delete(system.sparkSession, path)
            raise NotConverged(f"conjugate gradients: norm {math.sqrt(rr)} after {steps} steps")
        alpha, before = rr / curve, rr
        ahead = state.withColumns({"p": F.col("r") + beta * F.col("p"), "s": F.col("w") + beta * F.col("s")}).drop("w")
        ahead = ahead.withColumns({"x": F.col("x") + alpha * F.col("p"), "r": F.col("r") - alpha * F.col("s")})
        old = path
        state, path, rr, wr = _sums(product(ahead).select(*own, *_VECTORS))
        delete(system.sparkSession, old)
        steps += 1
    place = kept_dir(system.sparkSession)
    state.select(*own, "x").write.parquet(place)
    found = system.sparkSession.read.schema(state.select(*own, "x").schema).parquet(place)
    delete(system.sparkSession, path)
    return found, steps, math.sqrt(rr)


def stencil_product(diagonal: float) -> Product:
    """w = diagonal * r less the four neighbours' r, on a grid (i, j) with zeros beyond it."""

    def product(state: DataFrame) -> DataFrame:
        around = sum((F.coalesce(F.col(k), F.lit(0.0)) for k in gd.SIDES), F.lit(0.0))
        return gd.neighbours(state.withColumn("v", F.col("r"))).withColumn("w", diagonal * F.col("r") - around).drop("v", *gd.SIDES)

    return product


def matrix_product(matrix: DataFrame) -> Product:
    """w = A r for ``matrix(i, j, v)`` and rows that have their number ``i``."""

    def product(state: DataFrame) -> DataFrame:
        x = state.select(F.col("i").alias("j"), F.col("r").alias("x"))
        made = sp.spmv(matrix, x).select(F.col("i").alias("_row"), F.col("v").alias("_sum"))
        return state.join(made, state.i == made["_row"], "left").withColumn("w", F.coalesce("_sum", F.lit(0.0))).drop("_row", "_sum")

    return product


def implicit_step(
    grid: DataFrame, alpha: float, dxs: float, tolerance: float = 1e-6, newtons: int = 50, cgs: int = 200, eps: float = 1e-8, inner: float = 1e-4
) -> tuple[DataFrame, int, int]:
    """(i, j, v): the grid after one implicit reaction-diffusion step, with the Newton and the inner steps taken.

    v solves residual(v) = 0 with the values of ``grid(i, j, v)`` as the old
    ones and zeros beyond it. Each Newton step solves for the change by
    conjugate gradients, whose product with the Jacobian is the difference
    quotient of the residual. They work on the residual divided by its norm, so
    that the quotient's step has one size, and end at ``inner`` of it; Newton
    ends where the norm itself is below ``tolerance``. Raises NotConverged as
    they do.
    """
    spark = grid.sparkSession
    state, path = stored(grid.select("i", "j", "v", F.col("v").alias("old")))
    total = 0

    def quotient(rows: DataFrame) -> DataFrame:
        moved = rows.withColumns({"at": F.col("v"), "v": F.col("v") + eps * F.col("r")})
        there = gd.residual_of(gd.neighbours(moved), "old", alpha, dxs)
        return there.withColumns({"w": (F.col("residual") - F.col("f")) / eps, "v": F.col("at")}).drop("at", "residual", *gd.SIDES)

    for k in range(newtons + 1):
        right = gd.residual_of(gd.neighbours(state), "old", alpha, dxs).select("i", "j", "v", "old", F.col("residual").alias("f"))
        seen = Observation()
        kept, place = stored(right.observe(seen, F.sum(F.col("f") * F.col("f")).alias("ff")))
        delete(spark, path)
        state, path = kept, place
        norm = math.sqrt(seen.get["ff"] or 0.0)
        if norm < tolerance:
            out = kept_dir(spark)
            state.select("i", "j", "v").write.parquet(out)
            delete(spark, path)
            return spark.read.schema(grid.select("i", "j", "v").schema).parquet(out), k, total
        if k == newtons:
            break
        solved, steps, _ = conjugate_gradient(state.withColumn("b", F.col("f") / norm), quotient, inner, cgs)
        total += steps
        state = solved.select("i", "j", (F.col("v") - norm * F.col("x")).alias("v"), "old")
    delete(spark, path)
    raise NotConverged(f"Newton: {newtons} steps")
