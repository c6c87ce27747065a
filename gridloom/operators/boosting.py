"""Gradient-boosted trees on many features, grown level by level from sums.

Features are cut into bins once. For each level of a tree one aggregation sums
gradient and curvature of the logistic loss for every (node, feature, bin);
these sums, whose number does not depend on the rows, give the level's splits.
The margins are written once a tree, so no lineage grows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import delete, stored


@dataclass(frozen=True)
class Node:
    """A split (``feature`` <= ``threshold`` goes left, to 2 * number, as does a null) or a leaf's ``weight``."""

    tree: int
    number: int
    feature: int
    threshold: float
    weight: float


@dataclass
class Boosted:
    features: list[str]
    nodes: list[Node]

    def margin(self) -> Column:
        """The sum of the trees' weights; its logistic is the probability."""
        by = {(n.tree, n.number): n for n in self.nodes}

        def value(tree: int, number: int) -> Column:
            n = by[tree, number]
            if n.feature < 0:
                return F.lit(n.weight)
            x = F.col(self.features[n.feature])
            return F.when(x > n.threshold, value(tree, 2 * number + 1)).otherwise(value(tree, 2 * number))

        return sum((value(t, 1) for t in sorted({n.tree for n in self.nodes})), F.lit(0.0))

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(n.tree, n.number, n.feature, self.features[n.feature] if n.feature >= 0 else None, n.threshold, n.weight) for n in self.nodes]
        spark.createDataFrame(rows, "tree int, number int, feature int, name string, threshold double, weight double").coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Boosted:
        rows = spark.read.parquet(path).orderBy("tree", "number").collect()
        names = {r.feature: r.name for r in rows if r.feature >= 0}
        features = [names.get(k, "") for k in range(max(names, default=-1) + 1)]
        return Boosted(features, [Node(r.tree, r.number, r.feature, r.threshold, r.weight) for r in rows])


def bin_edges(df: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """At most ``bins`` - 1 cuts of each feature, by quantiles within a thousandth of the rows."""
    found = df.approxQuantile(list(features), [k / bins for k in range(1, bins)], 0.001)
    return [sorted({x for x in own if np.isfinite(x)}) for own in found]


def _split(sums: np.ndarray, least: float, penalty: float) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best cut after a bin; sums are (feature, bin, gradient and curvature).

    Of equal gains the first feature and bin are taken. Each side must have
    ``least`` curvature.
    """
    best = (0.0, -1, -1)
    whole = sums[0].sum(axis=0)
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + penalty)
    for f, own in enumerate(sums):
        left = own.cumsum(axis=0)[:-1]
        gain = score(left) + score(whole - left) - score(whole)
        gain[(left[:, 1] < least) | (whole[1] - left[:, 1] < least)] = -np.inf
        if len(gain) and gain.max() > best[0] + 1e-12:
            best = (float(gain.max()), f, int(gain.argmax()))
    return best


def boost(
    df: DataFrame, features: Sequence[str], label: str, rounds: int = 20, depth: int = 6, rate: float = 0.75, bins: int = 32, least: float = 1.0, penalty: float = 1.0, edges: list[list[float]] | None = None
) -> Boosted:
    """Trees for the probability that ``label`` is 1, by the logistic loss.

    A level of a tree is one job, whose result has a row for each node, feature
    and bin. Null features lie in the lowest bin, as in the tree; rows whose
    label is null are left out. Ties in gain go to the first feature and bin. An
    empty table, or one class alone, gives trees of one leaf.
    """
    spark = df.sparkSession
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(features)])
    edges = bin_edges(rows, [f"x{k}" for k in range(len(features))], bins) if edges is None else edges
    wide = 1 + max(map(len, edges), default=0)
    # NaN is greater than all numbers, here and in the tree's comparison.
    place = [sum((F.coalesce(F.col(f"x{k}") > e, F.lit(False)).cast("int") for e in own), F.lit(0)).cast("int") for k, own in enumerate(edges)]
    state, path = stored(rows.select("y", F.array(*place).alias("bins"), F.lit(0.0).alias("margin")))
    nodes: list[Node] = []
    for tree in range(rounds):
        p = 1 / (1 + F.exp(-F.col("margin")))
        splits: dict[int, tuple[int, int]] = {}
        weights: dict[int, float] = {}
        open_nodes = [1]
        for level in range(depth + 1):
            if not open_nodes:
                break
            here = state.select(_node(splits).alias("node"), "bins", (p - F.col("y")).alias("g"), (p * (1 - p)).alias("h")).where(F.col("node").isin(open_nodes))
            cells = here.select("node", F.posexplode("bins").alias("f", "b"), "g", "h").groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            sums = {n: np.zeros((max(1, len(edges)), wide, 2)) for n in open_nodes}
            for r in cells.collect():
                sums[r.node][r.f, r.b] = r.g, r.h
            following = []
            for n in open_nodes:
                gain, f, b = _split(sums[n], least, penalty) if level < depth else (0.0, -1, -1)
                if f < 0:
                    g, h = sums[n][0].sum(axis=0)
                    weights[n] = float(-rate * g / (h + penalty))
                else:
                    splits[n] = (f, b)
                    following += [2 * n, 2 * n + 1]
            open_nodes = following
        nodes += [Node(tree, n, f, edges[f][b], 0.0) for n, (f, b) in splits.items()] + [Node(tree, n, -1, 0.0, w) for n, w in weights.items()]
        moved = F.element_at(F.create_map(*[F.lit(x) for n, w in weights.items() for x in (n, w)]), _node(splits))
        old = path
        state, path = stored(state.withColumn("margin", F.col("margin") + moved))
        delete(spark, old)
    delete(spark, path)
    return Boosted(list(features), nodes)


def _node(splits: dict[int, tuple[int, int]], number: int = 1) -> Column:
    """The number of the node of a tree so far that a row's bins lead to."""
    if number not in splits:
        return F.lit(number)
    f, b = splits[number]
    return F.when(F.get("bins", F.lit(f)) > b, _node(splits, 2 * number + 1)).otherwise(_node(splits, 2 * number))
