"""Sequences in blocks: windows over a whole order without one task holding it.

Rows carry a position, a long. A block is a range of positions;
each row also goes to the blocks whose rows look back or ahead to it,
so a window within a block sees all that it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import shared_dir

BLOCK = 100_000


def in_blocks(df: DataFrame, idx: str, before: int, after: int, make: Callable[[Window], dict[str, Column]], block: int = BLOCK) -> DataFrame:
    """``df`` with window columns over ``idx``, positions being dense from 0.

    ``make`` gets a window spec by block and position, and returns the columns;
    they may look ``before`` rows back and ``after`` rows ahead. A null position,
    one met twice, or one missing before or after which rows look is an error
    when the rows are made, as a row at the end of a block would miss its neighbour.
    """
    own = F.floor(F.col(idx) / block)
    at = F.when(F.col(idx) >= 0, F.col(idx)).otherwise(F.raise_error(F.lit(f"{idx} is null or negative")).cast("long"))
    df = df.withColumn(idx, at)
    first, last = F.floor((F.col(idx) - after) / block), F.floor((F.col(idx) + before) / block)
    placed = df.withColumn("_block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    spec = Window.partitionBy("_block").orderBy(idx)
    made = placed.select("*", *[c.alias(k) for k, c in make(spec).items()], F.lag(idx).over(spec).alias("_before"))
    # The first row that a block sees has no neighbour to be held against.
    gap = (F.col(idx) - F.col("_before") != 1) | (F.col("_before").isNull() & (F.col(idx) > 0) & F.lit(before > 0))
    sound = F.when(gap, F.raise_error(F.concat(F.lit(f"{idx} is not dense at "), F.col(idx))).cast("boolean")).otherwise(True)
    return made.where(F.col("_block") == own).where(sound).drop("_block", "_before")


def running(df: DataFrame, idx: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """``df`` with the sum of ``value`` up to and at each position.

    Sums within blocks are windows; only a total for each block is summed in
    one order.
    """
    placed = df.withColumn("_block", F.floor(F.col(idx) / block)).withColumn("_value", value)
    totals = placed.groupBy("_block").agg(F.sum("_value").alias("_total"))
    ahead = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("_block").alias("_of"), F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_ahead"))
    within = F.sum("_value").over(Window.partitionBy("_block").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0))
    out = placed.withColumn("_within", within).join(totals, F.col("_block") == F.col("_of"))
    return out.withColumn(name, F.coalesce("_within", F.lit(0)) + F.col("_ahead")).drop("_block", "_value", "_of", "_ahead", "_within")


def in_key_order(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``df`` in ranges of (key, order): partitions follow one another, and a hot key has many."""
    return df.repartitionByRange(F.col(key), *[F.col(c) for c in order])


def key_blocks(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``df`` with ``_block``, a range of (key, order) of limited size; blocks ascend.

    Ranges come from a sample and may differ when they are made again, so rows
    are written with their block to the shared folder.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    placed = in_key_order(df, key, order).withColumn("_block", F.spark_partition_id())
    placed.write.parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def carried(blocks: DataFrame, key: str, totals: Sequence[Column], make: Callable[[Window], dict[str, Column]]) -> DataFrame:
    """``blocks`` with what each key's blocks before a row's own carry over.

    ``totals`` are aggregates of a key's rows of one block; ``make`` gets a
    window over a key's blocks in order.
    """
    each = blocks.groupBy(key, "_block").agg(*totals)
    spec = Window.partitionBy(key).orderBy("_block")
    each = each.select(F.col(key).alias("_of"), F.col("_block").alias("_at"), *[c.alias(k) for k, c in make(spec).items()])
    return blocks.join(each, F.col(key).eqNullSafe(F.col("_of")) & (F.col("_block") == F.col("_at"))).drop("_of", "_at")
