"""Seeded synthetic rows; the same for a seed, whatever the partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import polyval


def hashed_uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a hash of the key."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) / float(1 << 52)


def hashed_normal(key: Column, seed: int) -> Column:
    """A standard normal number, by the Box-Muller transform of two hashes."""
    radius = F.sqrt(-2 * F.log(1 - hashed_uniform(key, seed)))
    return radius * F.cos(2 * F.pi() * hashed_uniform(key, seed + 1))


def whole_numbers(spark: SparkSession, n: int, top: int = 100, seed: int = 1) -> DataFrame:
    """(idx, x) with whole x from 0 to ``top``."""
    return spark.range(n).select(F.col("id").alias("idx"), F.floor(hashed_uniform(F.col("id"), seed) * (top + 1)).cast("int").alias("x"))


def noisy_polynomial(spark: SparkSession, n: int, coefficients: Sequence[float], sigma: float, seed: int = 1) -> DataFrame:
    """(x, y) with x in [-1, 1) and normal noise on the polynomial."""
    x = 2 * hashed_uniform(F.col("id"), seed) - 1
    rows = spark.range(n).select("id", x.alias("x"))
    return rows.select("x", (polyval(F.col("x"), coefficients) + sigma * hashed_normal(F.col("id"), seed + 2)).alias("y"))


def price_paths(spark: SparkSession, paths: int, steps: int, drift: float, volatility: float, seed: int = 1) -> DataFrame:
    """(path, t, x): geometric Brownian motion from 1, a path being one array of running sums."""
    key = lambda t: F.col("id") * steps + t
    dt = 1.0 / steps
    move = lambda t: (drift - volatility**2 / 2) * dt + volatility * dt**0.5 * hashed_normal(key(t), seed)
    moves = spark.range(paths).select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), move)).alias("t", "move"))
    upto = Window.partitionBy("id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return moves.select(F.col("id").alias("path"), (F.col("t") + 1).alias("t"), F.exp(F.sum("move").over(upto)).alias("x"))
