"""Distances of a stated query set to all rows, in blocks.

Both sides are gathered into blocks of vectors; a task sees one pair of blocks
at a time and makes its distances together. The pairs are dealt to tasks by
their number, as they grow with the product of both sides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_BLOCK = 64
ROW_BLOCK = 512
#: Pairs of vectors that a task makes, about, and query vectors that it holds at most.
TASK_PAIRS, TASK_QUERIES = 1 << 24, 1 << 14

#: Puts the shares of pairs of places into its third argument.
Share = Callable[[np.ndarray, np.ndarray, np.ndarray], None]


def _wide(v: str) -> Column:
    return F.col(v).cast("array<double>")


def l1(x: np.ndarray, y: np.ndarray, out: np.ndarray) -> None:
    np.abs(np.subtract(x, y, out=out), out=out)


def l2_squared(x: np.ndarray, y: np.ndarray, out: np.ndarray) -> None:
    np.square(np.subtract(x, y, out=out), out=out)


def signed_difference(x: np.ndarray, y: np.ndarray, out: np.ndarray) -> None:
    """Sum of x - y, without square or absolute value."""
    np.subtract(x, y, out=out)


def inner(x: np.ndarray, y: np.ndarray, out: np.ndarray) -> None:
    np.multiply(x, y, out=out)


def _dealt(left: DataFrame, right: DataFrame, rows: int, queries: int) -> DataFrame:
    """Each row of ``left`` with each of ``right``, of which a task holds a bounded part; neither side is broadcast."""
    parts = max(1, -(-queries // TASK_QUERIES))
    tasks = max(1, -(-rows * queries // parts // TASK_PAIRS))
    return left.repartition(tasks).crossJoin(right.repartition(parts).hint("shuffle_replicate_nl"))


def _blocked(df: DataFrame, key: str, vector: str, size: int, names: tuple[str, str, str]) -> DataFrame:
    """(keys, flat, width) for each block of at most ``size`` vectors, one after another in ``flat``, those that are shorter or null with nulls at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        for batch in batches:
            for begin in range(0, len(batch), size):
                keys, vectors = (batch.column(k).slice(begin, size) for k in range(2))
                n = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                width, flat = int(n.max()), vectors.flatten()
                if (n < width).any():
                    at = (np.cumsum(n) - n)[:, None] + np.arange(width)
                    flat = flat.take(pa.array(at.ravel(), mask=(np.arange(width) >= n[:, None]).ravel()))
                yield pa.RecordBatch.from_arrays([one(keys), one(flat), pa.array([width], pa.int32())], names=list(names))

    kind = df.schema[key].dataType.simpleString()
    schema = f"{names[0]} array<{kind}>, {names[1]} array<double>, {names[2]} int"
    return df.select(F.col(key).alias("key"), _wide(vector).alias("vector")).mapInArrow(run, schema)


def _summed(x: pa.Array, y: pa.Array, n: int, m: int, share: Share) -> tuple[np.ndarray, np.ndarray | None]:
    """The shares of n vectors of x with m of y summed place by place, and which pairs have no place in both (None: all have)."""
    a, b = (np.ascontiguousarray(v.to_numpy(zero_copy_only=False).reshape(k, -1).T) for v, k in ((x, n), (y, m)))
    total, part = np.zeros((n, m)), np.empty((n, m))
    if not (x.null_count or y.null_count) and len(a) == len(b) > 0:
        for p, q in zip(a, b, strict=True):
            share(p[:, None], q[None, :], part)
            total += part
        return total, None
    held = [v.is_valid().to_numpy(zero_copy_only=False).reshape(k, -1).T for v, k in ((x, n), (y, m))]
    met = np.zeros((n, m), bool)
    for p, q, u, v in zip(a, b, *held, strict=False):
        both = u[:, None] & v[None, :]
        share(p[:, None], q[None, :], part)
        np.add(total, part, out=total, where=both)
        met |= both
    return total, ~met


def to_queries(rows: DataFrame, queries: DataFrame, key: str, vector: str, share: Share, name: str = "distance") -> DataFrame:
    """(q, id, distance) of each query with each row.

    The distance is the sum, in order, of the shares of the places at which both
    vectors have a value; null if there are none.
    """
    left = _blocked(rows, key, vector, ROW_BLOCK, ("ids", "x", "wx"))
    right = _blocked(queries, key, vector, QUERY_BLOCK, ("qs", "y", "wy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x, qs, y in zip(*(batch.column(c) for c in ("ids", "x", "qs", "y")), strict=True):
                n, m = len(qs), len(ids)
                d, none = _summed(y.values, x.values, n, m, share)
                q, i = qs.values.take(pa.array(np.repeat(np.arange(n), m))), ids.values.take(pa.array(np.tile(np.arange(m), n)))
                yield pa.RecordBatch.from_arrays([q, i, pa.array(d.ravel(), mask=None if none is None else none.ravel())], names=["q", "id", name])

    kinds = [df.schema[key].dataType.simpleString() for df in (queries, rows)]
    met = _dealt(left, right, rows.count(), queries.count())
    return met.mapInArrow(run, f"q {kinds[0]}, id {kinds[1]}, {name} double")


def l2_by_norms(rows: DataFrame, queries: DataFrame, key: str, vector: str, name: str = "distance") -> DataFrame:
    """Squared L2 as |x|^2 + |y|^2 - 2 x.y, a matrix product for each pair of blocks.

    Both sides are gathered into blocks of vectors of one length, ROW_BLOCK rows
    and QUERY_BLOCK queries; a task sees one pair of blocks at a time. Absolute
    values are taken, so that no -0 remains. Keys are longs.
    """
    left = _gathered(rows, key, vector, ROW_BLOCK).select(F.col("keys").alias("ids"), F.col("flat").alias("x"))
    right = _gathered(queries, key, vector, QUERY_BLOCK).select(F.col("keys").alias("qs"), F.col("flat").alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, x, qs, y in zip(pdf["ids"], pdf["x"], pdf["qs"], pdf["y"], strict=True):
                a, b = np.reshape(x, (len(ids), -1)), np.reshape(y, (len(qs), -1))
                d = np.abs((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T))
                yield pd.DataFrame({"q": np.tile(qs, len(ids)), "id": np.repeat(ids, len(qs)), name: d.ravel()})

    return left.crossJoin(right).mapInPandas(run, f"q long, id long, {name} double")


def _gathered(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(keys, flat) for each block of about ``size`` vectors, one after another in ``flat``."""
    n = max(1, -(-df.count() // size))
    placed = df.select(F.col(key).cast("long").alias("k"), _wide(vector).alias("x"), F.pmod(F.xxhash64(key), F.lit(n)).alias("_b"))
    got = placed.groupBy("_b").agg(F.collect_list(F.struct("k", "x")).alias("g"))
    return got.select(F.col("g.k").alias("keys"), F.flatten(F.col("g.x")).alias("flat"))


def outer_sum(rows: DataFrame, queries: DataFrame, key: str, value: str, name: str = "total") -> DataFrame:
    """The table of x_q + x_i for the query set; its blocks are arrays, so that a row meets QUERY_BLOCK of them at once."""
    base = rows.select(F.col(key).alias("id"), F.col(value).cast("double").alias("_x"))
    own = queries.select(F.struct(F.col(key).alias("q"), F.col(value).cast("double").alias("x")).alias("_q"), F.pmod(F.xxhash64(key), F.lit(1 << 20)).alias("_h"))
    n = queries.count()
    blocks = own.groupBy((F.col("_h") % max(1, -(-n // QUERY_BLOCK))).alias("_b")).agg(F.collect_list("_q").alias("_queries"))
    met = _dealt(base, blocks, rows.count(), n).select("id", "_x", F.explode("_queries").alias("_q"))
    return met.select("_q.q", "id", (F.col("_q.x") + F.col("_x")).alias(name))
