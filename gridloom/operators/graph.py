"""Out-degrees and PageRank over an edge table (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gridloom.session import delete, keep, stored

DAMPING = 0.85


def out_degree(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Edges out of each node, repeats counted; zeros for the rest of ``nodes(id)``."""
    counts = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return counts if nodes is None else nodes.join(counts, "id", "left").fillna(0, ["degree"])


def pagerank_step(scaled: DataFrame, state: DataFrame) -> DataFrame:
    """The next state(id, z, x), and x before as ``old``.

    ``scaled`` is (src, dst, w) with w = p / out-degree, repeated edges added;
    z is (1 - p) / n, or 1 / n for nodes without an edge out. The jump term is
    one number, summed over all nodes; z rides along, so it needs no join.
    """
    jump = state.agg(F.sum(F.col("z") * F.col("x")).alias("jump"))
    sent = scaled.join(state.select(F.col("id").alias("src"), "x"), "src")
    moved = sent.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("x")).alias("in"))
    out = state.select("id", "z", F.col("x").alias("old")).join(moved, "id", "left").crossJoin(F.broadcast(jump))
    return out.select("id", "z", (F.coalesce("in", F.lit(0.0)) + F.col("jump")).alias("x"), "old")


def prepared(edges: DataFrame, nodes: DataFrame, n: int, p: float = DAMPING) -> tuple[DataFrame, DataFrame]:
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    weight = edges.groupBy("src", "dst").agg(F.count("*").alias("m")).join(degree, "src")
    scaled = weight.select("src", "dst", (F.lit(p) * F.col("m") / F.col("degree")).alias("w"))
    z = nodes.join(degree.withColumnRenamed("src", "id"), "id", "left")
    z = z.select("id", F.when(F.col("degree").isNull(), F.lit(1.0 / n)).otherwise(F.lit((1 - p) / n)).alias("z"))
    return scaled, z


def pagerank(
    edges: DataFrame, nodes: DataFrame, p: float = DAMPING, tolerance: float = 1e-9, max_steps: int = 200, steps: int | None = None
) -> tuple[DataFrame, int, float]:
    """((id, x), iterations, last norm): iterates until the change is within the tolerance.

    With ``steps`` it makes so many iterations. Each one is a job that writes its
    small vector to the shared folder, from which the norm comes back, so plans
    and recomputation stay bounded; the last one stays until
    ``session.clean_up``. Edges are shuffled by the join of each step, in which
    Spark may split a node with very many of them.
    """
    spark, n = edges.sparkSession, nodes.count()
    scaled, z = prepared(edges, nodes, n, p)
    scaled = scaled.persist()
    state, path = stored(z.select("id", "z", F.lit(1.0 / max(n, 1)).alias("x")))
    norm, done = float("inf"), 0
    while done < (max_steps if steps is None else steps) and n:
        seen = Observation()
        old = path
        ahead = pagerank_step(scaled, state)
        state, path = stored(ahead.observe(seen, F.sum((F.col("x") - F.col("old")) ** 2).alias("moved")).drop("old"))
        delete(spark, old)
        done += 1
        norm = (seen.get["moved"] or 0.0) ** 0.5
        if steps is None and norm <= tolerance:
            break
    scaled.unpersist()
    keep(path)
    return state.select("id", "x"), done, norm
