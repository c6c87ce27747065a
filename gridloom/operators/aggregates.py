"""Reductions, histograms, order statistics, metrics and standardisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import quotient


def dot(x: Column, y: Column) -> Column:
    return F.sum(x * y)


def norm2(x: Column) -> Column:
    return F.sqrt(F.sum(x * x))


def histogram(df: DataFrame, column: str, top: int) -> DataFrame:
    """Counts of the values 0..top, empty bins included."""
    counts = df.where(F.col(column).between(0, top)).groupBy(F.col(column).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    bins = df.sparkSession.range(top + 1).withColumnRenamed("id", "bin")
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def log_bucket(value: Column, last: int) -> Column:
    """0 for 0, 1 for 1, then nine buckets a decade: v > 1 goes by the first digit of v - 1.

    Digits come from the decimal form of the whole number, so no logarithm is
    rounded; values beyond bucket ``last`` go there. Negative values give null.
    """
    digits = (value.cast("long") - 1).cast("string")
    at = 1 + 9 * (F.length(digits) - 1) + F.substring(digits, 1, 1).cast("int")
    at = F.when(value.cast("long") <= 1, value.cast("int")).otherwise(at)
    return F.when(value >= 0, F.least(at, F.lit(last)))


def log_histogram(df: DataFrame, value: Column, buckets: int = 29) -> DataFrame:
    counts = df.select(log_bucket(value, buckets - 1).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def kth_smallest(df: DataFrame, group: str, value: str, k: Column, bins: int = 4096) -> DataFrame:
    """(group, value at place k): places count from 0, ``k`` is an expression over the count ``n``.

    Values fall into equal ranges between a group's extremes. The range that
    holds the place is found from the counts, and only its values are ordered.
    """
    rows = df.where(F.col(value).isNotNull())
    ends = rows.groupBy(F.col(group).alias("_g")).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("n"))
    ends = ends.withColumn("_k", k)
    placed = rows.join(ends, F.col(group).eqNullSafe(F.col("_g")))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(width <= 0, 0).otherwise(F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1)))
    placed = placed.select(group, value, "_k", at.cast("int").alias("_bin"))
    counts = placed.groupBy(group, "_k", "_bin").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_bin")) - F.col("_n")
    chosen = counts.withColumn("_before", before).where((F.col("_before") <= F.col("_k")) & (F.col("_k") < F.col("_before") + F.col("_n")))
    chosen = chosen.select(F.col(group).alias("_cg"), F.col("_bin").alias("_cbin"), (F.col("_k") - F.col("_before")).alias("_in"))
    near = placed.join(chosen, F.col(group).eqNullSafe(F.col("_cg")) & (F.col("_bin") == F.col("_cbin")))
    # Rows of one value are counted together, so ties do not pile up either.
    ties = near.groupBy(group, value, "_in").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(group).orderBy(value))
    return ties.withColumn("_upto", upto).where("_upto - _n <= _in AND _in < _upto").select(group, value)


def statistics(df: DataFrame, group: str, value: str) -> DataFrame:
    """min, max, avg, population std, cv and upper median of each group."""
    v = F.col(value)
    base = df.groupBy(group).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("avg"), F.stddev_pop(v).alias("std"))
    base = base.withColumn("cv", F.try_divide("std", "avg"))
    median = kth_smallest(df, group, value, F.floor(F.col("n") / 2)).select(F.col(group).alias("_m"), F.col(value).alias("upper_median"))
    return base.join(median, F.col(group).eqNullSafe(F.col("_m")), "left").drop("_m")


def confusion(df: DataFrame, true: Column, pred: Column, classes: Sequence[int]) -> DataFrame:
    """A row for each true class, a column for each prediction; zeros where none."""
    both = df.select(true.alias("true"), pred.alias("pred"))
    counts = both.groupBy("true").agg(*[F.count_if(F.col("pred") == c).alias(f"pred_{c}") for c in classes])
    rows = df.sparkSession.createDataFrame([(int(c),) for c in classes], "true int")
    return rows.join(counts, "true", "left").select("true", *[F.coalesce(f"pred_{c}", F.lit(0)).alias(f"pred_{c}") for c in classes])


def accuracy(true: Column, pred: Column) -> Column:
    return F.avg((true == pred).cast("double"))


def regression_metrics(y: Column, p: Column, eps: float = 0.0) -> dict[str, Column]:
    """mse, mae, half-SSE and R2, in one pass: SStot from the variance, as large means would cancel in sums of squares."""
    rss = F.sum((y - p) ** 2)
    tss = F.var_pop(y) * F.count(y)
    return {
        "mse": F.avg((y - p) ** 2),
        "mae": F.avg(F.abs(y - p)),
        "half_sse": rss / 2,
        "r2": 1 - F.try_divide(rss, tss + eps),
    }


def uncentred_r2(y: Column, p: Column) -> Column:
    """Where all y are zero it is -inf, or NaN if p has no error either."""
    return 1 - quotient(F.sum((y - p) ** 2), F.sum(y * y))


def compared(x: Column, reference: Column, tolerance: float) -> dict[str, Column]:
    """How many differ by more than the relative tolerance, and the largest relative error."""
    error = F.abs(F.try_divide(x - reference, reference))
    error = F.when(reference == 0, F.when(x == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))).otherwise(error)
    return {"n_differ": F.count_if(error > tolerance), "max_error": F.max(error), "max_abs": F.max(F.abs(x - reference))}


def affine_check(df: DataFrame, idx: str, value: str, slope: float, constant: float, tolerance: float = 0.0) -> DataFrame:
    """One row: rows, and how many of them are not slope * idx + constant within the tolerance; a null value is not."""
    off = F.abs(F.col(value) - (F.lit(slope) * F.col(idx) + F.lit(constant)))
    return df.agg(F.count("*").alias("n"), F.count_if(F.coalesce(off > tolerance, F.lit(True))).alias("n_wrong"))


def squared_deviation(x: Column, before: Column) -> Column:
    return F.sum((x - before) ** 2)


def standardised(df: DataFrame, column: str, how: str = "pop", fit: Column | None = None, name: str = "z") -> DataFrame:
    """(x - mean) / std, or / max abs deviation for ``how`` "max_abs".

    The statistics come from the rows of ``fit``, or from all; they are one row.
    """
    x = F.col(column)
    rows = df if fit is None else df.where(fit)
    if how == "max_abs":
        stats = rows.agg(F.avg(x).alias("_mean"), F.max(x).alias("_hi"), F.min(x).alias("_lo"))
        stats = stats.select("_mean", F.greatest(F.col("_hi") - F.col("_mean"), F.col("_mean") - F.col("_lo")).alias("_scale"))
    else:
        stats = rows.agg(F.avg(x).alias("_mean"), (F.stddev_pop(x) if how == "pop" else F.stddev_samp(x)).alias("_scale"))
    return df.crossJoin(F.broadcast(stats)).withColumn(name, F.try_divide(x - F.col("_mean"), F.col("_scale"))).drop("_mean", "_scale")


def moments(df: DataFrame, x: Column, y: Column, degree: int) -> DataFrame:
    """One row: n, the sums of x**p up to 2 * degree and of x**p * y up to degree, in one pass."""
    xs = [F.sum(x**p).alias(f"x{p}") for p in range(1, 2 * degree + 1)]
    return df.agg(F.count("*").alias("n"), *xs, *[F.sum(x**p * y).alias(f"x{p}y") for p in range(degree + 1)])


def argmax(array: Column) -> Column:
    """Place of the first largest element, from 0."""
    return F.array_position(array, F.array_max(array)) - 1
