"""Lookups in irregular intervals: rows meet the points around them in one order of both.

Rows and points lie in ranges of that order (``blocks``); a window gives each row
the last point of its range before it, and one point for each range and key is
carried over from the ranges before. There is no step width, no cross join, and
an interval that holds very many rows is spread over ranges like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.blocks import carried, key_blocks


def bracketed(df: DataFrame, x: Column, points: DataFrame, at: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with structs ``before`` and ``after``: the points with the greatest ``at`` up to ``x``, and the least beyond it.

    ``points`` gives the struct's fields, all its columns but those of ``by``,
    whose values must equal the row's (a null equals a null). Of points that
    share their place the one that is greatest by its other columns is before a
    row, the least one after it. Rows below all points have no ``before``, above
    all no ``after``; a null ``x`` has neither, and points without a place are
    left out. Repeated rows each come back.
    """
    fields = [c for c in points.columns if c not in by]
    key = F.struct(*[F.col(c).alias(f"k{n}") for n, c in enumerate(by)], F.lit(0).alias("k"))
    point = F.struct(F.col(at).alias("_place"), *[F.col(c) for c in fields if c != at])
    kind = dict(points.dtypes)[at]
    own = points.where(F.col(at).isNotNull()).select(key.alias("_key"), F.col(at).alias("_place"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_salt"), point.alias("_point"))
    rows = df.select(key.alias("_key"), x.cast(kind).alias("_place"), F.lit(1).alias("_kind"), F.xxhash64(*_hashed(df)).alias("_salt"), F.struct(*df.columns).alias("_row"))
    both = own.unionByName(rows, allowMissingColumns=True)
    # The salt alone tells rows of one place apart, so that a range need not hold all of them.
    blocks = key_blocks(both, "_key", ["_place", "_kind", "_salt", "_point"])
    ahead = lambda w: {
        "_before": F.last("_last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "_after": F.first("_first", True).over(w.rowsBetween(1, Window.unboundedFollowing)),
    }
    out = carried(blocks, "_key", [F.max("_point").alias("_last"), F.min("_point").alias("_first")], ahead)
    near = Window.partitionBy("_key", "_block").rowsBetween(Window.unboundedPreceding, 0)
    up, down = ["_place", "_kind", "_point"], [F.desc("_place"), F.desc("_kind"), F.desc("_point")]
    before = F.coalesce(F.last("_point", True).over(near.orderBy(*up)), F.col("_before"))
    after = F.coalesce(F.last("_point", True).over(near.orderBy(*down)), F.col("_after"))
    known = F.col("_place").isNotNull()
    out = out.withColumns({"_b": F.when(known, before), "_a": F.when(known, after)}).where("_kind = 1")
    named = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c)["_place"].alias(at), *[F.col(c)[f].alias(f) for f in fields if f != at]))
    return out.select("_row.*", named("_b").alias("before"), named("_a").alias("after"))


def _hashed(df: DataFrame) -> list[str]:
    """Columns that a hash takes: maps are left out."""
    return [c for c, t in df.dtypes if "map<" not in t and t != "variant"] or [F.lit(0)]


def as_of(df: DataFrame, x: Column, points: DataFrame, at: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with the columns of the last point up to ``x``, null where there is none."""
    found = bracketed(df, x, points, at, by).drop("after")
    return found.select(*df.columns, *[F.col("before")[c].alias(c) for c in points.columns if c not in by])


def interpolated_between(df: DataFrame, x: Column, points: DataFrame, at: str, y: str, name: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """``df`` with the value at ``x`` on the line between the points (``at``, ``y``) around it.

    At a point it is the point's own value, the greatest one where a place is
    met more than once; outside the points it is null.
    """
    found = bracketed(df.withColumn("_x", x.cast("double")), F.col("_x"), points.select(*by, F.col(at).cast("double").alias(at), y), at, by)
    a, b = F.col("before"), F.col("after")
    value = F.when(a[at] == F.col("_x"), a[y]).otherwise(a[y] + (F.col("_x") - a[at]) / (b[at] - a[at]) * (b[y] - a[y]))
    return found.withColumn(name, value).select(*df.columns, name)
