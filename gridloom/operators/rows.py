"""Row selection, relabelling, splits and reshaping."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import uniform
from gridloom.operators.blocks import running
from gridloom.operators.sequences import group_position


def select(df: DataFrame, idx: str, predicate: Column, position: str = "position") -> DataFrame:
    """Rows that meet ``predicate``, with their place among them in the order of ``idx``."""
    kept = df.where(predicate)
    return running(kept, idx, F.lit(1).cast("long"), position).withColumn(position, F.col(position) - 1)


def all_of(df: DataFrame, predicate: Column) -> DataFrame:
    """One row: whether every row meets ``predicate`` (true without rows), and whether there is none."""
    return df.agg(F.coalesce(F.bool_and(predicate), F.lit(True)).alias("all_of"), (F.count("*") == 0).alias("empty"))


def decimate(df: DataFrame, idx: str, k: int, start: int = 0) -> DataFrame:
    """Every k-th position from ``start``, numbered anew."""
    kept = df.where((F.col(idx) >= start) & ((F.col(idx) - start) % k == 0))
    return kept.withColumn(idx, F.floor((F.col(idx) - start) / k).cast("long"))


def relabel(df: DataFrame, column: str, classes: Sequence[int], name: str = "label") -> DataFrame:
    """Rows of the given classes, numbered from 0 in their order."""
    label = reduce(lambda out, kv: out.when(F.col(column) == kv[1], kv[0]), list(enumerate(classes))[1:], F.when(F.col(column) == classes[0], 0))
    return df.where(F.col(column).isin(list(classes))).withColumn(name, label)


def iloc(df: DataFrame, columns: slice | int) -> DataFrame:
    names = df.columns[columns]
    return df.select(names if isinstance(names, list) else [names])


def split_by_stride(df: DataFrame, idx: str) -> DataFrame:
    """Even positions train; of the odd ones every second tests, the rest validate."""
    at = F.col(idx) % 4
    return df.withColumn("split", F.when(at % 2 == 0, "train").when(at == 1, "test").otherwise("valid"))


def split_contiguous(df: DataFrame, idx: str, shares: dict[str, float], size: int) -> DataFrame:
    """Consecutive shares of ``size`` positions, in order; the last takes what is left."""
    names, upto, out = list(shares), 0.0, None
    for k in names[:-1]:
        upto += shares[k]
        test = F.col(idx) < F.lit(int(round(size * upto, 6)))
        out = F.when(test, k) if out is None else out.when(test, k)
    return df.withColumn("split", out.otherwise(names[-1]) if out is not None else F.lit(names[-1]))


def split_random(df: DataFrame, key: str, train: float, seed: int = 0) -> DataFrame:
    """A split by a digest of the key: the same at every run and in any engine, whatever the partitions."""
    at = uniform(F.col(key), f"/{seed}")
    return df.withColumn("split", F.when(at < train, "train").otherwise("test"))


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Rows in the order of a digest of the key; equal keys by the key."""
    return df.orderBy(uniform(F.col(key), f"/{seed}"), key)


def shuffled_places(df: DataFrame, key: str, seed: int = 0, name: str = "place") -> DataFrame:
    """``df`` with each row's place from 0 in the order of ``shuffled``, without one task that holds all."""
    drawn = df.withColumns({"_one": F.lit(0), "_draw": uniform(F.col(key), f"/{seed}")})
    return group_position(drawn, "_one", ["_draw", key], name).drop("_one", "_draw")


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return df.select("*", *[(F.col(column) == v).cast("int").alias(f"{column}_{v}") for v in values]).drop(column)


def one_hot_array(df: DataFrame, column: str, size: int, name: str = "target") -> DataFrame:
    return df.withColumn(name, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: (k == F.col(column)).cast("int")))


def nested(df: DataFrame, key: str, columns: Sequence[str], rows: int = 1_000) -> DataFrame:
    """(key, parallel arrays of the columns, in their order) in parts of ``rows`` at most, so no array grows with its key."""
    part = F.floor(F.monotonically_increasing_id() / rows)
    made = df.select(key, *columns, part.alias("_part")).groupBy(key, "_part").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_t"))
    return made.select(key, *[F.col(f"_t.{c}").alias(c) for c in columns])


def zipped(df: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """A row for each place of parallel arrays."""
    keys = [c for c in df.columns if c not in arrays]
    return df.select(*keys, F.explode(F.arrays_zip(*arrays)).alias("_z")).select(*keys, *[F.col(f"_z.{a}").alias(a) for a in arrays])


def mirrored(coo: DataFrame) -> DataFrame:
    """A symmetric matrix from one triangle: off-diagonal entries come again as (j, i)."""
    flipped = coo.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return coo.select("i", "j", "v").unionByName(flipped)


def reshaped(df: DataFrame, idx: str, columns: int | Column) -> DataFrame:
    """Row-major places (i, j) of linear positions."""
    n = F.lit(columns) if isinstance(columns, int) else columns
    return df.withColumn("i", F.floor(F.col(idx) / n).cast("long")).withColumn("j", (F.col(idx) % n).cast("long"))


def chunked(df: DataFrame, idx: str, size: int, chunks: int) -> DataFrame:
    """``chunks`` equal parts of ``size`` positions, which they must divide."""
    if size % chunks:
        raise ValueError("chunks do not divide the rows")
    return df.withColumn("chunk", F.floor(F.col(idx) / (size // chunks)).cast("int"))


def batched(df: DataFrame, idx: str, rows: int) -> DataFrame:
    return df.withColumn("batch", F.floor(F.col(idx) / rows).cast("long"))


def ring(df: DataFrame, counter: str, capacity: int) -> DataFrame:
    """What a ring buffer of ``capacity`` holds at the end: the latest row of each slot."""
    slot = df.withColumn("slot", (F.col(counter) % capacity).cast("int"))
    latest = slot.groupBy("slot").agg(F.max_by(F.struct(*df.columns), counter).alias("_row"))
    return latest.select("slot", "_row.*")


def union_all(parts: Sequence[DataFrame], axis: str | None = None) -> DataFrame:
    """Rows of all parts; with ``axis`` a column tells the part, as stacking does."""
    tagged = [p if axis is None else p.withColumn(axis, F.lit(k)) for k, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, tagged)


def mapped(df: DataFrame, columns: Sequence[str], f: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({c: f(F.col(c)) for c in columns})


def aligned(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of both sides by ``key``; an error unless each key of either side is once on the other."""
    sides = a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    if not sides.groupBy(key).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b")).where("_a <> 1 OR _b <> 1").isEmpty():
        raise ValueError(f"the sides do not match by {key}")
    return a.join(b, key)


def filled(df: DataFrame, column: str, value: float) -> DataFrame:
    return df.withColumn(column, F.lit(float(value)))


def copied(df: DataFrame, column: str, name: str, factor: float = 1.0) -> DataFrame:
    """``column`` under another name, scaled."""
    return df.withColumn(name, F.col(column) if factor == 1.0 else F.lit(float(factor)) * F.col(column))
