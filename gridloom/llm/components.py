"""Connected components of an edge table by alternating star contractions.

Each round hangs every neighbour of a node on the least node around it, first
for larger neighbours, then for smaller ones; the number of rounds grows with
the logarithm of a component's size. Minima are pre-aggregated before their
shuffle, and they return to the edges by an equi-join whose large keys Spark
may split, so a node with very many edges does not fill one task. At most
SMALL edges are done in one task, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import discard, durable


#: Edges that one task takes; more go through rounds.
SMALL = 8192


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of the nodes 0..n-1 the least one that it reaches over the edges (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _in_one_task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batches = list(found)
    u, v = (np.concatenate([b.column(k).to_numpy() for b in batches] or [np.zeros(0, np.int64)]) for k in (0, 1))
    nodes, at = np.unique(np.r_[u, v], return_inverse=True)
    root = least_reached(len(nodes), at[: len(u)], at[len(u) :])
    hung = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[hung]), pa.array(nodes[root[hung]])], names=["node", "component"])


def _larger_to_least(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    hung = both.join(least, both.u == least.k).where("v > u")
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _smaller_to_least(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    key = least.select(F.col("u").alias("k"), "m")
    hung = edges.join(key, edges.u == key.k).where("v <> m")
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges(u, v)``, roots left out.

    The result is durable. ``component`` is the least node that ``node`` reaches. Self-loops are
    ignored; an empty edge table gives an empty result.
    """
    flat = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    flat = durable(flat)
    if flat.count() <= SMALL:
        found = durable(flat.coalesce(1).mapInArrow(_in_one_task, "node long, component long"))
        discard(flat)
        return found
    mark = None
    for _ in range(max_rounds):
        now = tuple(flat.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first())
        if now == mark or not now[0]:
            found = durable(flat.select(F.col("u").alias("node"), F.col("v").alias("component")))
            discard(flat)
            return found
        mark, before = now, flat
        flat = durable(_smaller_to_least(_larger_to_least(flat).distinct()).distinct())
        discard(before)
    raise RuntimeError("components did not settle")
