"""Sparse matrices, graphs, grids and distances over the tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalars import rounded
from gridloom.operators import distances as ds
from gridloom.operators import graph as gr
from gridloom.operators import grid as gd
from gridloom.operators import rows as rw
from gridloom.operators import sequences as sq
from gridloom.operators import solvers as sv
from gridloom.operators import sparse as sp
from gridloom.plans.registry import query
from gridloom.session import keep, kept_dir, stored
from gridloom.sources import bricks as bk
from gridloom.sources import matrices as mx
from gridloom.sources.tables import table


def _part_supplier(spark: SparkSession, sf: str) -> DataFrame:
    return sp.coo(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey", "l_quantity")


_A = "(SELECT l_partkey AS i, l_suppkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


@query(
    "SELECT l_partkey AS i, round(sum(l_quantity * s_acctbal), 2) AS y FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_partkey"
)
def spmv_part_supplier(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_quantity").alias("v"))
    x = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("j"), F.col("s_acctbal").alias("x"))
    return sp.spmv(a, x).select("i", F.round("v", 2).alias("y"))


@query(
    f"SELECT p_partkey AS i, round(coalesce(sum(v * s_acctbal), 0), 2) AS y FROM part LEFT JOIN ({_A[1:-1]}) ON i = p_partkey LEFT JOIN supplier ON j = s_suppkey GROUP BY p_partkey"
)
def sell_product(spark: SparkSession, sf: str) -> DataFrame:
    """The product on SELL-8-32 chunks stored as arrays."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("i"))
    x = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("j"), F.col("s_acctbal").alias("x"))
    # The rows' lengths and their cells are both read from it.
    a, path = stored(_part_supplier(spark, sf))
    keep(path)
    chunks, lanes = sp.sell(a, rows, 8, 32)
    return sp.sell_spmv(chunks, lanes, x).select("i", F.round("v", 2).alias("y"))


@query(f"SELECT i, j // 64 AS part, count(*) AS n, string_agg(j, ',' ORDER BY j) AS columns, round(sum(v), 2) AS total FROM {_A} GROUP BY 1, 2")
def csr_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The arrays of compressed rows, in stretches of 64 columns."""
    rows = sp.csr_parts(_part_supplier(spark, sf), 64)
    total = F.aggregate("entries", F.lit(0.0), lambda s, e: s + e["v"])
    said = F.array_join(F.transform("entries", lambda e: e["j"].cast("string")), ",")
    return rows.select("i", "part", F.size("entries").cast("long").alias("n"), said.alias("columns"), F.round(total, 2).alias("total"))


@query(
    f"SELECT p_partkey AS i, round(p_retailprice + 3 * coalesce(s, 0), 2) AS y FROM part LEFT JOIN"
    f" (SELECT i, sum(v * s_acctbal) AS s FROM {_A} a JOIN supplier ON j = s_suppkey GROUP BY i) ON i = p_partkey"
)
def spmv_accumulated(spark: SparkSession, sf: str) -> DataFrame:
    """y + 3 A x, as three calls that add to y give."""
    x = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("j"), F.col("s_acctbal").alias("x"))
    y = table(spark, sf, "part").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("v"))
    return sp.spmv(_part_supplier(spark, sf), x, y, 3).select("i", F.round("v", 2).alias("y"))


_PROFILE = (
    "SELECT p.{key} AS {out}, coalesce(n, 0) AS n, coalesce(nnz, 0) AS nnz, lo, hi, first, last, coalesce(1 + greatest(0, k - first) + greatest(0, last - k), 0)"
    " AS bandwidth FROM {rows} p LEFT JOIN (SELECT {k} AS k, count(*) AS n, count(*) FILTER (v <> 0) AS nnz, min(abs(v)) AS lo, max(abs(v)) AS hi,"
    f" min({{other}}) AS first, max({{other}}) AS last FROM {_A} GROUP BY 1) a ON a.k = p.{{key}}"
)


def _named(df: DataFrame, key: str, other: str) -> DataFrame:
    return df.select(
        key, "n", "nnz", F.col("min_abs").alias("lo"), F.col("max_abs").alias("hi"), F.col(f"min_{other}").alias("first"), F.col(f"max_{other}").alias("last"), "bandwidth"
    )


@query(_PROFILE.format(key="p_partkey", out="i", rows="part", k="i", other="j"))
def matrix_row_profile(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("i"))
    return _named(sp.row_profile(_part_supplier(spark, sf), rows), "i", "j")


@query(_PROFILE.format(key="s_suppkey", out="j", rows="supplier", k="j", other="i"))
def matrix_col_profile(spark: SparkSession, sf: str) -> DataFrame:
    columns = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("j"))
    return _named(sp.column_profile(_part_supplier(spark, sf), columns), "j", "i")


_SQUARE = "(SELECT l_partkey % n AS i, l_suppkey AS j, sum(l_quantity) AS v FROM lineitem, (SELECT count(*) AS n FROM supplier) GROUP BY 1, 2)"


def _square(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "supplier").count()
    return sp.coo(table(spark, sf, "lineitem"), F.col("l_partkey") % n, "l_suppkey", "l_quantity")


@query(f"WITH s AS {_SQUARE} SELECT a.i, a.j FROM s a LEFT JOIN s b ON a.i = b.j AND a.j = b.i WHERE b.i IS NULL")
def symmetry_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    return sp.unmatched(_square(spark, sf))


@query(f"WITH s AS {_SQUARE} SELECT i, j, v FROM s WHERE i >= j UNION ALL SELECT j AS i, i AS j, v FROM s WHERE i > j")
def mirror_union(spark: SparkSession, sf: str) -> DataFrame:
    return rw.mirrored(_square(spark, sf).where("i >= j"))


@query(f"SELECT p_partkey AS i, coalesce(n, 0) AS count, (sum(coalesce(n, 0)) OVER (ORDER BY p_partkey) - coalesce(n, 0))::BIGINT AS ptr FROM part LEFT JOIN (SELECT i, count(*) AS n FROM {_A} GROUP BY i) ON i = p_partkey")
def csr_row_ptr(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("i"))
    return sq.row_pointers(_part_supplier(spark, sf), rows)


@query(f"SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY j) - 1 AS place FROM {_A}")
def csr_position(spark: SparkSession, sf: str) -> DataFrame:
    return sp.position_in_row(_part_supplier(spark, sf)).select("i", "j", F.col("place").cast("long").alias("place"))


_LEN = f"(SELECT p_partkey AS i, coalesce(n, 0) AS n FROM part LEFT JOIN (SELECT i, count(*) AS n FROM {_A} GROUP BY i) ON i = p_partkey)"


def _lengths(spark: SparkSession, sf: str) -> DataFrame:
    return sp.lengths(_part_supplier(spark, sf), table(spark, sf, "part").select(F.col("p_partkey").alias("i")))


@query(f"SELECT i, n, (i // 32) * 32 + row_number() OVER (PARTITION BY i // 32 ORDER BY n DESC, i) - 1 AS position FROM {_LEN}")
def sellcs_blocksort(spark: SparkSession, sf: str) -> DataFrame:
    return sq.block_sorted(_lengths(spark, sf), 32)


_CHUNKS = (
    "(SELECT position // 8 AS chunk, max(n) AS length FROM (SELECT n, (i // 32) * 32 + row_number() OVER"
    f" (PARTITION BY i // 32 ORDER BY n DESC, i) - 1 AS position FROM {_LEN}) GROUP BY 1)"
)


@query(f"SELECT chunk, length, (8 * (sum(length) OVER (ORDER BY chunk) - length))::BIGINT AS ptr FROM {_CHUNKS}")
def sellcs_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return sp.sell_chunks(_lengths(spark, sf), 8, 32)


@query(
    f"SELECT count(*) AS chunks, (8 * sum(length))::BIGINT AS stored, any_value(nnz) AS nnz, round(100.0 * (8 * sum(length) - any_value(nnz)) / any_value(nnz), 6) AS fill_percent"
    f" FROM {_CHUNKS}, (SELECT sum(n)::BIGINT AS nnz FROM {_LEN})"
)
def sellcs_fill_in(spark: SparkSession, sf: str) -> DataFrame:
    return sp.sell_fill(_lengths(spark, sf), 8, 32).withColumn("fill_percent", F.round("fill_percent", 6))


@query(f"SELECT max(n) AS width, max(n) * count(*) AS stored, sum(n)::BIGINT AS nnz, round(100.0 * (max(n) * count(*) - sum(n)) / sum(n), 6) AS fill_percent FROM {_LEN}")
def ell_fill_in(spark: SparkSession, sf: str) -> DataFrame:
    return sp.ell_fill(_lengths(spark, sf)).withColumn("fill_percent", F.round("fill_percent", 6))


@query(
    "SELECT round(r, 6) AS per_row, round(b, 6) AS beta, round((12 + 8 / r + 20 / r) / 2, 6) AS csr_best, round((12 + 8 + 20 / r) / 2, 6) AS csr_worst,"
    " round((12 / b + 8 / r + 16 / r) / 2, 6) AS padded_best, round((12 / b + 8 + 16 / r) / 2, 6) AS padded_worst"
    f" FROM (SELECT sum(n)::DOUBLE / count(*) AS r, sum(n)::DOUBLE / (max(n) * count(*)) AS b FROM {_LEN})"
)
def code_balance(spark: SparkSession, sf: str) -> DataFrame:
    lengths = _lengths(spark, sf)
    stats = lengths.agg(F.count("*").alias("rows"), F.sum("n").alias("nnz"), (F.max("n") * F.count("*")).alias("stored"))
    out = sp.code_balance(stats)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"SELECT count(*) FILTER (v <> 0) AS nnz, round(count(*) / (any_value(r) * any_value(c)), 8) AS density FROM {_A}, (SELECT count(*)::DOUBLE AS r FROM part), (SELECT count(*)::DOUBLE AS c FROM supplier)")
def matrix_density(spark: SparkSession, sf: str) -> DataFrame:
    r, c = table(spark, sf, "part").count(), table(spark, sf, "supplier").count()
    return sp.density(_part_supplier(spark, sf), r, c).select("nnz", F.round("density", 8).alias("density"))


@query(f"SELECT i, n_nationkey AS j, round(sum(a.v * s_acctbal), 2) AS v FROM {_A} a JOIN supplier ON a.j = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2")
def gemm_part_nation(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_nationkey").alias("j"), F.col("s_acctbal").alias("v"))
    return sp.gemm(_part_supplier(spark, sf), b).select("i", "j", F.round("v", 2).alias("v"))


@query("SELECT s_suppkey AS idx, s_acctbal AS v FROM supplier")
def permutation_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Scattered to the order of account balances and gathered back."""
    x = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_acctbal").alias("v"))
    n = x.count()
    there = x.select("idx", F.pmod(F.col("idx") + n // 2, F.lit(n)).alias("new_idx"))
    back = there.select(F.col("new_idx").alias("idx"), F.col("idx").alias("new_idx"))
    return sp.permuted(sp.permuted(x, there), back)


@query(f"SELECT i, j, v FROM {_A}")
def matrix_market_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The matrix as a MatrixMarket file set in the shared folder, and read back."""
    a = _part_supplier(spark, sf)
    rows, cols = a.agg(F.max("i") + 1, F.max("j") + 1).first()
    path = kept_dir(spark)
    mx.write_matrix(a, path, rows, cols)
    return mx.read_matrix_set(spark, path)


def _side(spark: SparkSession, sf: str) -> int:
    return max(2, round(table(spark, sf, "part").count() ** (1 / 3)))


_N = "(SELECT greatest(2, round(count(*) ** (1.0 / 3)))::BIGINT AS n FROM part)"
_CELL = "(SELECT c.id, c.id % n AS x, (c.id // n) % n AS y, c.id // (n * n) AS z, n FROM (SELECT unnest(range((SELECT n * n * n FROM " + _N + "))) AS id) c, " + _N + ")"
_STEPS = "(SELECT unnest([-1, 0, 1]) AS d)"


@query(
    f"SELECT id AS i, id + a.d + n * b.d + n * n * c.d AS j, CASE WHEN a.d = 0 AND b.d = 0 AND c.d = 0 THEN 26.0 ELSE -1.0 END::DOUBLE AS v"
    f" FROM {_CELL}, {_STEPS} a, {_STEPS} b, {_STEPS} c WHERE x + a.d BETWEEN 0 AND n - 1 AND y + b.d BETWEEN 0 AND n - 1 AND z + c.d BETWEEN 0 AND n - 1"
)
def hpcg_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The 27-point matrix of a cube with about a point for each part."""
    return mx.stencil_matrix(spark, _side(spark, sf))


# -- graphs

_NODES = "(SELECT count(*) AS n FROM part)"
_EDGES = "(SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem)"


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Part keys as nodes; an edge for each line item, from its supplier's number to its part's.

    Supplier numbers are a first stretch of the part numbers; the other nodes have no edge out.
    """
    edges = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return edges, table(spark, sf, "part").select(F.col("p_partkey").alias("id"))


@query(f"SELECT p_partkey AS id, coalesce(d, 0) AS degree FROM part LEFT JOIN (SELECT src, count(*) AS d FROM {_EDGES} GROUP BY src) ON src = p_partkey")
def out_degree(spark: SparkSession, sf: str) -> DataFrame:
    return gr.out_degree(*_graph(spark, sf))


def _pagerank_sql(steps: int) -> str:
    sql = (
        f"WITH e AS (SELECT * FROM {_EDGES}), d AS (SELECT src, count(*) AS d FROM e GROUP BY src),"
        " w AS (SELECT e.src, dst, sum(0.85::DOUBLE / d) AS w FROM e JOIN d ON e.src = d.src GROUP BY 1, 2),"
        f" z AS (SELECT p_partkey AS id, CASE WHEN d IS NULL THEN 1.0::DOUBLE / n ELSE 0.15::DOUBLE / n END AS z FROM part LEFT JOIN d ON src = p_partkey, {_NODES}),"
        f" x0 AS (SELECT id, 1.0::DOUBLE / n AS x FROM z, {_NODES})"
    )
    for k in range(steps):
        sql += (
            f", x{k + 1} AS (SELECT z.id, coalesce(m, 0) + (SELECT sum(z.z * x) FROM z JOIN x{k} USING (id)) AS x FROM z LEFT JOIN"
            f" (SELECT dst, sum(w * x) AS m FROM w JOIN x{k} ON src = id GROUP BY dst) ON dst = z.id)"
        )
    return sql + f" SELECT id, round(x, 9) AS x FROM x{steps}"


@query(_pagerank_sql(5))
def pagerank_k5(spark: SparkSession, sf: str) -> DataFrame:
    ranks, _, _ = gr.pagerank(*_graph(spark, sf), steps=5)
    return ranks.select("id", F.round("x", 9).alias("x"))


@query()
def pagerank_converged(spark: SparkSession, sf: str) -> DataFrame:
    ranks, steps, norm = gr.pagerank(*_graph(spark, sf))
    return ranks.select("id", "x", F.lit(steps).alias("steps"), F.lit(norm).alias("norm"))


# -- grids: customers laid out by rows, about as many rows as columns

_WIDE = "(SELECT greatest(1, ceil(sqrt(count(*))))::BIGINT AS w FROM customer)"
_GRID = f"(SELECT c_custkey // w AS i, c_custkey % w AS j, c_acctbal AS v FROM customer, {_WIDE})"


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer")
    wide = max(1, math.ceil(math.sqrt(customers.count())))
    return rw.reshaped(customers, "c_custkey", wide).select("i", "j", F.col("c_acctbal").alias("v"))


def _stepped(source: str, dt: float) -> str:
    around = "lag(v) OVER a + lead(v) OVER a + lag(v) OVER b + lead(v) OVER b"
    return (
        f"SELECT i, j, coalesce(v + {dt}::DOUBLE * ({around} - 4 * v), v) AS v FROM {source}"
        " WINDOW a AS (PARTITION BY j ORDER BY i), b AS (PARTITION BY i ORDER BY j)"
    )


@query("SELECT i, j, round(v, 4) AS v FROM (" + _stepped("(" + _stepped(_GRID, 0.1) + ")", 0.1) + ")")
def diffusion_2(spark: SparkSession, sf: str) -> DataFrame:
    return gd.diffusion(_grid(spark, sf), 0.1, 2).select("i", "j", F.round("v", 4).alias("v"))


@query("SELECT round(sum(v) * 0.01 * 0.01, 6) AS energy FROM (" + _stepped(_GRID, 0.2) + ")")
def heat_energy(spark: SparkSession, sf: str) -> DataFrame:
    return gd.energy(gd.heat(_grid(spark, sf), 0.01), 0.01).select(F.round("energy", 6).alias("energy"))


@query(
    "SELECT i, j, round(-5 * v + coalesce(lag(v) OVER a, 0) + coalesce(lead(v) OVER a, 0) + coalesce(lag(v) OVER b, 0) + coalesce(lead(v) OVER b, 0)"
    f" + o + 0.5 * v * (1 - v), 6) AS s FROM (SELECT i, j, v / 10000 AS v, v / 20000 AS o FROM {_GRID})"
    " WINDOW a AS (PARTITION BY j ORDER BY i), b AS (PARTITION BY i ORDER BY j)"
)
def residual_once(spark: SparkSession, sf: str) -> DataFrame:
    grid = _grid(spark, sf).select("i", "j", (F.col("v") / 10000).alias("v"), (F.col("v") / 20000).alias("o"))
    return gd.residual(grid, "o", 1.0, 0.5).select("i", "j", F.round("s", 6).alias("s"))


@query(
    "SELECT i, j, round(-5 * v + coalesce(lag(v) OVER a, 0.1 * j) + coalesce(lead(v) OVER a, 0.2 * j) + coalesce(lag(v) OVER b, 0.3 * i) + coalesce(lead(v) OVER b, 0.4 * i)"
    f" + v / 2 + 0.5 * v * (1 - v), 6) AS s FROM (SELECT i, j, v / 10000 AS v FROM {_GRID}) WINDOW a AS (PARTITION BY j ORDER BY i), b AS (PARTITION BY i ORDER BY j)"
)
def residual_borders(spark: SparkSession, sf: str) -> DataFrame:
    """The residual with a border vector on each side."""
    grid = _grid(spark, sf).select("i", "j", (F.col("v") / 10000).alias("v"), (F.col("v") / 20000).alias("o"))
    border = {"west": 0.1 * F.col("j"), "east": 0.2 * F.col("j"), "south": 0.3 * F.col("i"), "north": 0.4 * F.col("i")}
    return gd.residual(grid, "o", 1.0, 0.5, border).select("i", "j", F.round("s", 6).alias("s"))


@query(f"SELECT i, j, v FROM {_GRID} WHERE v IS NOT NULL")
def bov_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The grid written as bricks of a few rows and read back."""
    grid, root = _grid(spark, sf), kept_dir(spark)
    size = grid.agg(F.max("i") + 1, F.max("j") + 1).first()
    return bk.read_bov(spark, bk.write_bov(grid, root, "grid", *(size if size[0] is not None else (0, 0)), brick_cells=200))


@query(f"SELECT i, j, CASE WHEN (i - 5.0) ** 2 + (j - 5.0) ** 2 < 9 THEN 0.1 ELSE 0.0 END::DOUBLE AS u FROM {_GRID}")
def circle_start(spark: SparkSession, sf: str) -> DataFrame:
    return _grid(spark, sf).select("i", "j", gd.circle(F.col("i"), F.col("j"), (5.0, 5.0), 3.0).alias("u"))


_AROUND = "coalesce(lag(v) OVER a, 0) + coalesce(lead(v) OVER a, 0) + coalesce(lag(v) OVER b, 0) + coalesce(lead(v) OVER b, 0)"
_OVER = "WINDOW a AS (PARTITION BY j ORDER BY i), b AS (PARTITION BY i ORDER BY j)"


@query(
    f"WITH RECURSIVE g AS (SELECT i, j, v / 10000 AS o FROM {_GRID}), t AS (SELECT 0 AS k, i, j, o, 0.0::DOUBLE AS v FROM g UNION ALL"
    f" SELECT k + 1, i, j, o, (o + {_AROUND}) / 8 FROM t WHERE k < 60 {_OVER}) SELECT i, j, round(v, 5) AS x FROM t WHERE k = 60"
)
def cg_grid(spark: SparkSession, sf: str) -> DataFrame:
    """8 x less its neighbours is the customers' balance, solved by conjugate gradients over the table."""
    system = _grid(spark, sf).select("i", "j", (F.col("v") / 10000).alias("b"))
    solved, _, _ = sv.conjugate_gradient(system, sv.stencil_product(8.0), tolerance=1e-11)
    return solved.select("i", "j", F.round("x", 5).alias("x"))


@query(
    f"WITH RECURSIVE g AS (SELECT i, j, 0.1 * abs(v) / 10000 AS o FROM {_GRID}), t AS (SELECT 0 AS k, i, j, o, o AS v FROM g UNION ALL"
    f" SELECT k + 1, i, j, o, ({_AROUND} + 4 * o + 0.1 * v * (1 - v)) / 8 FROM t WHERE k < 60 {_OVER}) SELECT i, j, round(v, 4) AS v FROM t WHERE k = 60"
)
def newton_grid(spark: SparkSession, sf: str) -> DataFrame:
    """One implicit reaction-diffusion step of the customers' grid, by Newton and conjugate gradients over the table."""
    start = _grid(spark, sf).select("i", "j", (0.1 * F.abs("v") / 10000).alias("v"))
    found, _, _ = sv.implicit_step(start, 4.0, 0.1, tolerance=1e-9)
    return found.select("i", "j", F.round("v", 4).alias("v"))


@query(
    f"WITH RECURSIVE t AS (SELECT 0 AS k, i, j, v FROM {_GRID} UNION ALL SELECT k + 1, i, j, coalesce(v + 0.1::DOUBLE * (lag(v) OVER a + lead(v) OVER a + lag(v) OVER b"
    f" + lead(v) OVER b - 4 * v), v) FROM t WHERE k < 40 {_OVER}) SELECT i, j, round(v, 4) AS v FROM t WHERE k = 40"
)
def diffusion_40(spark: SparkSession, sf: str) -> DataFrame:
    """Forty steps in five shuffles."""
    return gd.diffusion(_grid(spark, sf), 0.1, 40).select("i", "j", F.round("v", 4).alias("v"))


_SLOPES = """
  SELECT id, n, x, y, z, sx, sy, sz, 10 * (y - x) AS kax, x * (28 - z) - y AS kay, x * y - 8.0::DOUBLE / 3 * z AS kaz FROM t WHERE n < 1000"""


def _stage(source: str, of: str, to: str, h: str) -> str:
    x, y, z = (f"({c} + {h} * {of}{c})" for c in "xyz")
    return f"SELECT *, 10 * ({y} - {x}) AS {to}x, {x} * (28 - {z}) - {y} AS {to}y, {x} * {y} - 8.0::DOUBLE / 3 * {z} AS {to}z FROM ({source})"


_LORENZ = _stage(_stage(_stage(_SLOPES, "ka", "kb", "0.002::DOUBLE"), "kb", "kc", "0.002::DOUBLE"), "kc", "kd", "0.004::DOUBLE")


@query(
    "WITH RECURSIVE t AS (SELECT s_suppkey AS id, 0 AS n, s_acctbal / 1000 AS x, (s_suppkey % 7 - 3)::DOUBLE AS y, 20 + (s_suppkey % 5)::DOUBLE AS z,"
    " 0.0::DOUBLE AS sx, 0.0::DOUBLE AS sy, 0.0::DOUBLE AS sz FROM supplier UNION ALL SELECT id, n + 1,"
    + ", ".join(f"{c} + 0.004::DOUBLE / 6 * (ka{c} + 2 * kb{c} + 2 * kc{c} + kd{c})" for c in "xyz")
    + f", sx + x, sy + y, sz + z FROM ({_LORENZ})) SELECT id, round(sx / 1000, 4) AS mean_x, round(sy / 1000, 4) AS mean_y, round(sz / 1000, 4) AS mean_z FROM t WHERE n = 1000"
)
def lorenz_means(spark: SparkSession, sf: str) -> DataFrame:
    """A trajectory for each supplier, of 1,000 steps as an expression of its row."""
    key = F.col("s_suppkey")
    starts = table(spark, sf, "supplier").select(key.alias("id"), (F.col("s_acctbal") / 1000).alias("x"), (key % 7 - 3).cast("double").alias("y"), (20 + key % 5).cast("double").alias("z"))
    return gd.lorenz(starts).select("id", *[F.round(f"mean_{c}", 4).alias(f"mean_{c}") for c in "xyz"])


# -- distances of every fiftieth vector to all

_PAIRS = (
    "SELECT q.vec_id AS q, b.vec_id AS id, round({}, 4) AS distance FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0) q,"
    " (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b"
)
_EACH = "list_sum(list_transform(list_zip(q.e, b.e), lambda z: {}))"


def _distances(spark: SparkSession, sf: str, f) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    out = f(rows, rows.where("vec_id % 50 = 0"))
    return out.select("q", "id", rounded(F.col("distance"), 4).alias("distance"))


@query(_PAIRS.format(_EACH.format("abs(z[1] - z[2])")))
def l1_queries(spark: SparkSession, sf: str) -> DataFrame:
    return _distances(spark, sf, lambda a, q: ds.to_queries(a, q, "vec_id", "embedding", ds.l1))


@query(_PAIRS.format(_EACH.format("(z[1] - z[2]) ** 2")))
def l2sq_queries(spark: SparkSession, sf: str) -> DataFrame:
    return _distances(spark, sf, lambda a, q: ds.to_queries(a, q, "vec_id", "embedding", ds.l2_squared))


@query(_PAIRS.format(_EACH.format("(z[1] - z[2]) ** 2")))
def l2sq_by_norms(spark: SparkSession, sf: str) -> DataFrame:
    return _distances(spark, sf, lambda a, q: ds.l2_by_norms(a, q, "vec_id", "embedding"))


@query(_PAIRS.format(_EACH.format("z[1] - z[2]")))
def signed_queries(spark: SparkSession, sf: str) -> DataFrame:
    return _distances(spark, sf, lambda a, q: ds.to_queries(a, q, "vec_id", "embedding", ds.signed_difference))


@query("SELECT q.s_suppkey AS q, b.s_suppkey AS id, round(q.s_acctbal + b.s_acctbal, 4) AS distance FROM (SELECT * FROM supplier WHERE s_suppkey % 50 = 0) q, supplier b")
def outer_sum(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier")
    out = ds.outer_sum(rows, rows.where("s_suppkey % 50 = 0"), "s_suppkey", "s_acctbal", "distance")
    return out.select("q", "id", rounded(F.col("distance"), 4).alias("distance"))
