"""Sparse matrices as (i, j, v) rows: profiles, layouts, products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.blocks import running
from gridloom.operators.sequences import block_sorted

#: Columns in a stretch of a row that one array or window holds.
PART = 65_536


def coo(df: DataFrame, i: str | Column, j: str | Column, v: str | Column) -> DataFrame:
    """A matrix from rows; entries of the same place are added."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return df.groupBy(c(i).cast("long").alias("i"), c(j).cast("long").alias("j")).agg(F.sum(c(v)).alias("v"))


def spmv(a: DataFrame, x: DataFrame, y: DataFrame | None = None, times: int = 1) -> DataFrame:
    """(i, v) of y + times * A x for x(j, x); rows of y without entries stay.

    Rows are summed where they are before the shuffle; the join is left to
    Spark, which broadcasts x if it is small.
    """
    out = a.join(x, "j").groupBy("i").agg((times * F.sum(F.col("v") * F.col("x"))).alias("v"))
    if y is None:
        return out
    return out.unionByName(y.select("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))


def gemm(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 0.0, c: DataFrame | None = None) -> DataFrame:
    """alpha A B + beta C; A's columns meet B's rows."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("n"), F.col("v").alias("w"))
    out = a.join(right, a.j == right.k).groupBy("i", F.col("n").alias("j")).agg((alpha * F.sum(F.col("v") * F.col("w"))).alias("v"))
    if c is None:
        return out
    return out.unionByName(c.select("i", "j", (beta * F.col("v")).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))


def row_profile(a: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Entries, non-zeros, extremes and bandwidth of each row; empty rows if ``rows(i)`` is given."""
    out = a.groupBy("i").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("v") != 0).alias("nnz"),
        F.min(F.abs("v")).alias("min_abs"),
        F.max(F.abs("v")).alias("max_abs"),
        F.min("j").alias("min_j"),
        F.max("j").alias("max_j"),
    )
    reach = 1 + F.greatest(F.lit(0), F.col("i") - F.col("min_j")) + F.greatest(F.lit(0), F.col("max_j") - F.col("i"))
    out = out.withColumn("bandwidth", reach)
    if rows is None:
        return out
    return rows.join(out, "i", "left").fillna(0, ["n", "nnz", "bandwidth"])


def transposed(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def column_profile(a: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    named = None if columns is None else columns.select(F.col("j").alias("i"))
    out = row_profile(transposed(a), named)
    return out.withColumnsRenamed({"i": "j", "min_j": "min_i", "max_j": "max_i"})


def unmatched(a: DataFrame) -> DataFrame:
    """Places (i, j) whose mirror (j, i) has no entry; none if the pattern is symmetric."""
    own = a.select("i", "j").distinct()
    return own.join(own.select(F.col("j").alias("i"), F.col("i").alias("j")), ["i", "j"], "left_anti")


def density(a: DataFrame, rows: int, columns: int) -> DataFrame:
    return a.agg(F.count_if(F.col("v") != 0).alias("nnz"), (F.count("*") / F.lit(float(rows) * columns)).alias("density"))


def csr(a: DataFrame) -> DataFrame:
    """(i, entries): each row's columns and values in order."""
    return a.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("entries"))


def ell(a: DataFrame, width: int) -> DataFrame:
    """(i, columns, values): rows padded to ``width`` with column 0 and value 0; longer rows are an error."""
    size = F.size("entries")
    checked = csr(a).withColumn("entries", F.when(size > width, F.raise_error(F.lit("row longer than the width"))).otherwise(F.col("entries")))
    pad = lambda x, zero: F.concat(x, F.array_repeat(zero, (F.lit(width) - size).cast("int")))
    return checked.select(
        "i", pad(F.col("entries.j"), F.lit(0).cast("long")).alias("columns"), pad(F.col("entries.v"), F.lit(0.0)).alias("values")
    )


def ell_fill(lengths: DataFrame) -> DataFrame:
    """One row: width, stored elements, non-zeros and fill-in in per cent of the non-zeros."""
    out = lengths.agg(F.max("n").alias("width"), F.count("*").alias("rows"), F.sum("n").alias("nnz"))
    stored = F.col("width") * F.col("rows")
    return out.select("width", stored.alias("stored"), "nnz", (100.0 * F.try_divide(stored - F.col("nnz"), F.col("nnz"))).alias("fill_percent"))


def sell_chunks(lengths: DataFrame, c: int = 8, sigma: int = 1) -> DataFrame:
    """(chunk, length, ptr) of SELL-C-sigma: the longest row of each chunk of C, and where it begins."""
    chunks = block_sorted(lengths, sigma).groupBy(F.floor(F.col("position") / c).alias("chunk")).agg(F.max("n").alias("length"))
    placed = running(chunks, "chunk", F.col("length") * c, "upto")
    return placed.select("chunk", "length", (F.col("upto") - F.col("length") * c).alias("ptr"))


def sell_fill(lengths: DataFrame, c: int = 8, sigma: int = 1) -> DataFrame:
    stored = sell_chunks(lengths, c, sigma).agg(F.count("*").alias("chunks"), F.sum(F.col("length") * c).alias("stored"))
    nnz = lengths.agg(F.sum("n").alias("nnz"))
    fill = 100.0 * F.try_divide(F.col("stored") - F.col("nnz"), F.col("nnz"))
    return stored.crossJoin(nnz).select("chunks", "stored", "nnz", fill.alias("fill_percent"))


def code_balance(stats: DataFrame, value_bytes: int = 8, index_bytes: int = 4) -> DataFrame:
    """Bytes a flop of CSR, at best and at worst reuse of x, and of padded layouts.

    ``stats`` has one row with rows, nnz and stored. Alpha is 1/nnz-per-row at
    best and 1 at worst; beta is the share of stored elements in use.
    """
    per_row = F.col("nnz") / F.col("rows")
    beta = F.col("nnz") / F.col("stored")
    csr_cost = lambda alpha: (value_bytes + index_bytes + value_bytes * alpha + (2 * value_bytes + index_bytes) / per_row) / 2
    pad_cost = lambda alpha: ((value_bytes + index_bytes) / beta + value_bytes * alpha + 2 * value_bytes / per_row) / 2
    return stats.select(
        per_row.alias("per_row"),
        beta.alias("beta"),
        csr_cost(1 / per_row).alias("csr_best"),
        csr_cost(F.lit(1.0)).alias("csr_worst"),
        pad_cost(1 / per_row).alias("padded_best"),
        pad_cost(F.lit(1.0)).alias("padded_worst"),
    )


def permuted(x: DataFrame, permutation: DataFrame) -> DataFrame:
    """x(idx, v) with positions replaced through permutation(idx, new_idx)."""
    return x.join(permutation, "idx").select(F.col("new_idx").alias("idx"), "v")


def lengths(a: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    n = a.groupBy("i").agg(F.count("*").alias("n"))
    return n if rows is None else rows.join(n, "i", "left").fillna(0, ["n"])


def position_in_row(a: DataFrame, columns: int = PART) -> DataFrame:
    """``a`` with ``place``, from 0 in the order of the columns of each row; places (i, j) are met once.

    A row is ordered in stretches of ``columns`` columns, and only a count for
    each stretch is ordered over the whole row.
    """
    stretch = F.expr(f"j div {columns}")
    placed = a.withColumn("_part", stretch).withColumn("_within", F.row_number().over(Window.partitionBy("i", stretch).orderBy("j")) - 1)
    counts = a.groupBy("i", stretch.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("i").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("i").alias("_i"), F.col("_part").alias("_of"), F.coalesce(before, F.lit(0)).alias("_ahead"))
    out = placed.join(counts, (placed.i == counts["_i"]) & (placed["_part"] == counts["_of"]))
    return out.withColumn("place", F.col("_within") + F.col("_ahead")).drop("_part", "_within", "_i", "_of", "_ahead")


def csr_parts(a: DataFrame, columns: int = PART) -> DataFrame:
    """(i, part, entries): each row's columns and values in order, an array for each stretch of ``columns`` columns.

    As a place is met once, no array is longer than that, however long a row is.
    """
    return a.groupBy("i", F.expr(f"j div {columns}").alias("part")).agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("entries"))


# -- the product on stored chunks


def _stretch(column: str, size: int) -> Column:
    """The number of the stretch of ``size`` whole numbers that a long lies in, also below zero."""
    return F.expr(f"({column} - pmod({column}, {size})) div {size}")


_CHUNK = "chunk long, block long, part int, width int, columns array<int>, values array<double>"


def sell(a: DataFrame, rows: DataFrame, c: int = 8, sigma: int = 1, block: int = 4096, width: int = 1024) -> tuple[DataFrame, DataFrame]:
    """SELL-C-sigma with its cells: (chunk, block, part, width, columns, values), and the rows' places (i, position).

    Rows of ``rows(i)``, numbered from 0, are ordered by length in blocks of
    ``sigma`` and stored ``c`` to a chunk. The cells of a chunk are parted by
    blocks of ``block`` columns and then ``width`` to a lane, so that an array
    has ``c * width`` cells at most, however long a row is. Cell k belongs to
    lane k % c; a column is counted in its block, and -1 fills up a lane.
    """
    lanes = block_sorted(lengths(a, rows), sigma).select("i", "position")
    cells = a.join(lanes, "i").where("v IS NOT NULL AND j IS NOT NULL").select("position", "j", F.col("v").cast("double").alias("v"))

    def packed(position: np.ndarray, j: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        (chunk, lane), (of, column) = np.divmod(position, c), np.divmod(j, block)
        by = np.lexsort((column, lane, of, chunk))
        chunk, of, lane, column, v = (x[by] for x in (chunk, of, lane, column, v))
        fresh = np.r_[True, (chunk[1:] != chunk[:-1]) | (of[1:] != of[:-1])]
        begins = np.flatnonzero(fresh | np.r_[True, lane[1:] != lane[:-1]])
        part, at = np.divmod(np.arange(len(v)) - np.repeat(begins, np.diff(np.r_[begins, len(v)])), width)
        parts = int(part.max()) + 1
        names, own = np.unique((np.cumsum(fresh) - 1) * parts + part, return_inverse=True)
        wide = np.zeros(len(names), np.int64)
        np.maximum.at(wide, own, at + 1)
        begin = np.cumsum(wide * c) - wide * c
        columns, values = np.full(int((wide * c).sum()), -1, np.int32), np.zeros(int((wide * c).sum()))
        k = begin[own] + at * c + lane
        columns[k], values[k] = column, v
        ends = pa.array(np.r_[begin, len(columns)].astype(np.int32))
        arrays = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (columns, values)]
        group, place = np.divmod(names, parts)
        group = np.flatnonzero(fresh)[group]
        kept = [chunk[group], of[group], place.astype(np.int32), wide.astype(np.int32)]
        return pa.RecordBatch.from_arrays([*map(pa.array, kept), *arrays], names=["chunk", "block", "part", "width", "columns", "values"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packs whole groups; the last of a batch, of ``c * block`` cells at most, waits for the next one."""
        held = None
        for batch in batches:
            found = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            held = found if held is None else [np.concatenate(x) for x in zip(held, found, strict=True)]
            chunk, of = held[0] // c, held[1] // block
            last = np.flatnonzero((chunk[1:] != chunk[:-1]) | (of[1:] != of[:-1]))
            if len(last):
                end = last[-1] + 1
                yield packed(*(x[:end] for x in held))
                held = [x[end:] for x in held]
        if held is not None and len(held[0]):
            yield packed(*held)

    # Groups lie together, so none is gathered in memory on its way.
    group = _stretch("position", c), _stretch("j", block)
    grouped = cells.repartition(*group).sortWithinPartitions(*group)
    return grouped.mapInArrow(fill, _CHUNK), lanes


def sell_spmv(chunks: DataFrame, lanes: DataFrame, x: DataFrame, c: int = 8, block: int = 4096) -> DataFrame:
    """(i, v) of A x for ``sell``'s chunks and x(j, x); a missing or null x counts as 0, rows without cells have 0.

    x is gathered in blocks of ``block`` values, the bytes of an array each, which
    meet the chunks of their columns; a chunk's lanes are summed as columns of
    one array.
    """
    gathered = x.where("x IS NOT NULL AND j IS NOT NULL").groupBy(_stretch("j", block).alias("block")).agg(F.collect_list(F.struct(F.expr(f"int(pmod(j, {block}))").alias("at"), F.col("x").cast("double").alias("x"))).alias("xs"))

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_of, xs in zip(batch.column("block"), batch.column("xs"), strict=True):
                # The column -1 is the last place, a zero; its value is zero too.
                own = np.zeros(block + 1)
                own[xs.values.field(0).to_numpy()] = xs.values.field(1).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([block_of.as_py()], pa.int64()), pa.array([own.tobytes()], pa.binary())], names=["block", "xs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk, sums = batch.column("chunk").to_numpy(), []
            for columns, values, xs in zip(batch.column("columns"), batch.column("values"), batch.column("xs"), strict=True):
                own = np.frombuffer(xs.as_buffer())
                sums.append((values.values.to_numpy() * own[columns.values.to_numpy()]).reshape(-1, c).sum(axis=0))
            place = (chunk[:, None] * c + np.arange(c)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.concatenate(sums) if sums else np.zeros(0))], names=["position", "v"])

    cells = gathered.mapInArrow(filled, "block long, xs binary")
    # A batch ends by its bytes, so few x blocks stay beside their chunks.
    partial = chunks.join(cells, "block").select("chunk", "columns", "values", "xs").mapInArrow(run, "position long, v double")
    total = partial.groupBy("position").agg(F.sum("v").alias("v"))
    return lanes.join(total, "position", "left").select("i", F.coalesce("v", F.lit(0.0)).alias("v"))
