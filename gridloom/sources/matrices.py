"""Matrix files and generators: MatrixMarket text, packed binary, stencils."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The header of the packed format, nine 8-byte fields.
_FIELDS = ("endian", "version", "size", "rows", "cols", "nnz", "index_bytes", "value_bytes", "flags")
_LITTLE, _VERSION, _SYMMETRIC = 1, 1, 1
_FIELD_TYPES = {"real", "integer"}
#: What ``read_any_matrix`` reads besides, and how the mirrored entry follows from the given one.
_ALL_FIELDS = {"real", "integer", "pattern", "complex"}
_MIRRORED = {"symmetric": (1, 1), "skew-symmetric": (-1, -1), "hermitian": (1, -1)}
#: Entries of one packed file, about.
PACKED_ENTRIES = 1 << 20


class MatrixError(ValueError):
    pass


def check_index_fit(rows: int, columns: int, entries: int, bits: int = 32) -> None:
    """Raises unless every row, column and place among the entries fits a signed index of ``bits``."""
    if max(rows, columns, entries) > 2 ** (bits - 1) - 1:
        raise MatrixError(f"{rows} x {columns} with {entries} entries does not fit {bits}-bit indices")


def header(spark: SparkSession, path: str, any_field: bool = False) -> dict:
    """rows, cols, nnz, field and symmetry of a MatrixMarket file.

    Only coordinate matrices of real or integer values, general or symmetric,
    are read; others are refused. With ``any_field`` pattern and complex ones are
    read too, and the other symmetries that fit the field.
    """
    lines = spark.read.text(path)
    first = lines.first()
    words = (first[0] if first else "").split()
    if len(words) < 3 or words[0] != "%%MatrixMarket" or words[1:3] != ["matrix", "coordinate"]:
        raise MatrixError("not a coordinate matrix")
    field = words[3] if len(words) > 3 else "real"
    symmetry = words[4] if len(words) > 4 else "general"
    fits = field in _ALL_FIELDS and (
        symmetry in ("general", "symmetric")
        or (symmetry == "skew-symmetric" and field != "pattern")
        or (symmetry == "hermitian" and field == "complex")
    )
    if not fits or not (any_field or (field in _FIELD_TYPES and symmetry in ("general", "symmetric"))):
        raise MatrixError(f"{field} {symmetry} matrices are not read")
    sizes = lines.where(~F.col("value").startswith("%") & (F.trim("value") != "")).first()
    try:
        rows, cols, nnz = (int(x) for x in sizes[0].split())
    except (TypeError, ValueError) as e:
        raise MatrixError("no size line") from e
    return {"rows": rows, "cols": cols, "nnz": nnz, "field": field, "symmetry": symmetry}


def read_matrix(spark: SparkSession, path: str, checked: bool = True) -> DataFrame:
    """(i, j, v) from 0 of a MatrixMarket file, symmetric ones mirrored.

    With ``checked``, places out of bounds, repeated places and a wrong number
    of entries are errors; that costs one more pass.
    """
    head = header(spark, path)
    lines = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    lines = lines.withColumn("_line", F.monotonically_increasing_id())
    sizes = lines.agg(F.min("_line")).first()[0]
    return _entries(lines.where(F.col("_line") != sizes), head, checked)


def read_any_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v, im) from 0 of a MatrixMarket file of any field.

    A pattern has v = 1; ``im`` is the imaginary part, 0 but in complex matrices.
    The other triangle is added with the sign or conjugate of the symmetry. A
    line that is not an entry of the field, a place met twice, or a wrong number of
    entries is an error.
    """
    head = header(spark, path, any_field=True)
    lines = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    lines = lines.withColumn("_line", F.monotonically_increasing_id())
    sizes = lines.agg(F.min("_line")).first()[0]
    parts = F.split(F.trim("value"), r"\s+")
    value = lambda k: F.get(parts, F.lit(k)).try_cast("double")
    v = F.lit(1.0) if head["field"] == "pattern" else value(2)
    im = value(3) if head["field"] == "complex" else F.lit(0.0)
    place = lambda k: F.get(parts, F.lit(k)).try_cast("long") - 1
    body = lines.where(F.col("_line") != sizes).select(place(0).alias("i"), place(1).alias("j"), v.alias("v"), im.alias("im"))
    inside = F.col("i").between(0, head["rows"] - 1) & F.col("j").between(0, head["cols"] - 1)
    n, right = body.agg(F.count("*"), F.count_if(inside & F.col("v").isNotNull() & F.col("im").isNotNull())).first()
    if (n, right) != (head["nnz"], head["nnz"]):
        raise MatrixError(f"{n} entries of {head['nnz']}, {n - right} of them wrong")
    if not body.groupBy("i", "j").count().where("count > 1").isEmpty():
        raise MatrixError("repeated entry")
    if head["symmetry"] in _MIRRORED:
        real, imaginary = _MIRRORED[head["symmetry"]]
        flipped = body.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), (real * F.col("v")).alias("v"), (imaginary * F.col("im")).alias("im"))
        body = body.unionByName(flipped)
    return body


def read_matrix_set(spark: SparkSession, path: str, checked: bool = True) -> DataFrame:
    """A matrix that ``write_matrix`` wrote, as ``read_matrix`` gives it."""
    return _entries(spark.read.text(f"{path}/entries"), header(spark, f"{path}/header"), checked)


def _entries(lines: DataFrame, head: dict, checked: bool) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    body = lines.select((parts[0].cast("long") - 1).alias("i"), (parts[1].cast("long") - 1).alias("j"), parts[2].cast("double").alias("v"))
    if checked:
        out = ~F.col("i").between(0, head["rows"] - 1) | ~F.col("j").between(0, head["cols"] - 1) | F.col("v").isNull()
        n, bad = body.agg(F.count("*"), F.count_if(out)).first()
        if n != head["nnz"] or bad:
            raise MatrixError(f"{n} entries of {head['nnz']}, {bad} out of bounds")
        if not body.groupBy("i", "j").count().where("count > 1").isEmpty():
            raise MatrixError("repeated entry")
    if head["symmetry"] == "symmetric":
        flipped = body.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
        body = body.unionByName(flipped)
    return body


def write_matrix(coo: DataFrame, path: str, rows: int, cols: int) -> None:
    """MatrixMarket text in parts: ``header``, and ``entries`` written by all tasks at once.

    The header followed by the entries, in any order, is the usual single file.
    """
    head = [("%%MatrixMarket matrix coordinate real general",), (f"{rows} {cols} {coo.count()}",)]
    coo.sparkSession.createDataFrame(head, "value string").coalesce(1).write.text(f"{path}/header")
    coo.select(F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, F.col("v")).alias("value")).write.text(f"{path}/entries")


def pack_matrix(rows: int, cols: int, i: np.ndarray, j: np.ndarray, v: np.ndarray, symmetric: bool = False) -> bytes:
    """The packed binary form: header, 32-bit indices from 0, then doubles."""
    head = (_LITTLE, _VERSION, 72, rows, cols, len(v), 4, 8, _SYMMETRIC if symmetric else 0)
    return struct.pack("<9Q", *head) + i.astype("<i4").tobytes() + j.astype("<i4").tobytes() + v.astype("<f8").tobytes()


def unpack_matrix(content: bytes) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """Header, rows, columns and values; either byte order, comment lines before it passed over."""
    at = 0
    while content[at : at + 1] == b"%":
        at = content.index(b"\n", at) + 1
    for order in "<>":
        head = dict(zip(_FIELDS, struct.unpack_from(f"{order}9Q", content, at), strict=True))
        if head["endian"] == _LITTLE:
            break
    if head["endian"] != _LITTLE or head["version"] != _VERSION or (head["index_bytes"], head["value_bytes"]) != (4, 8):
        raise MatrixError("not a packed matrix")
    n, start = head["nnz"], at + 72
    if len(content) < start + 16 * n:
        raise MatrixError("packed matrix is cut short")
    i = np.frombuffer(content, f"{order}i4", n, start)
    j = np.frombuffer(content, f"{order}i4", n, start + 4 * n)
    return head, i.astype(np.int64), j.astype(np.int64), np.frombuffer(content, f"{order}f8", n, start + 8 * n).astype(float)


def write_packed(coo: DataFrame, root: str, name: str, rows: int, cols: int) -> int:
    """Writes ``coo(i, j, v)`` as packed files of about PACKED_ENTRIES entries under ``root``; how many.

    An entry's file follows from a hash of its place, so a hot row is spread and
    a task that runs again writes the same file. ``root`` must be a folder that
    pyarrow can open and all executors share.
    """
    from pyarrow import fs

    n = coo.count()
    check_index_fit(rows, cols, 0)
    files = max(1, -(-n // PACKED_ENTRIES))

    def write(part: pd.DataFrame) -> pd.DataFrame:
        k = int(part["file"].iloc[0])
        part = part.sort_values(["i", "j"])
        store, folder = fs.FileSystem.from_uri(root)
        with store.open_output_stream(f"{folder}/{name}_{k:06d}.bmtx") as out:
            out.write(pack_matrix(rows, cols, part["i"].to_numpy(), part["j"].to_numpy(), part["v"].to_numpy()))
        return pd.DataFrame({"file": [k]})

    store, folder = fs.FileSystem.from_uri(root)
    store.create_dir(folder, recursive=True)
    placed = coo.select("i", "j", F.col("v").cast("double").alias("v"), F.pmod(F.xxhash64("i", "j"), F.lit(files)).cast("int").alias("file"))
    return placed.groupBy("file").applyInPandas(write, "file int").count()


def write_edges(edges: DataFrame, path: str) -> None:
    """Text edges ``i j`` from 1 in the order of their columns; part files follow one another."""
    edges.orderBy("j", "i").select(F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1).alias("value")).write.text(path)


def read_edges(spark: SparkSession, path: str, checked: bool = True) -> DataFrame:
    """(i, j) from 0 of text edges ``i j`` from 1; columns without an edge are allowed.

    With ``checked``, edges whose columns do not ascend, in the order of the
    files' names and lines, are an error, as are lines that are not edges. Each
    split of a file gives its first and last column and whether it ascends, and
    only these, a row a split, are put in one order.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split(F.trim("value"), r"\s+")
    place = lambda k: F.get(parts, F.lit(k)).try_cast("long") - 1
    edges = lines.select(place(0).alias("i"), place(1).alias("j"), F.size(parts).alias("_n"))
    if checked:
        wrong = F.col("i").isNull() | F.col("j").isNull() | (F.col("i") < 0) | (F.col("j") < 0) | (F.col("_n") != 2)
        if bad := edges.agg(F.count_if(wrong)).first()[0]:
            raise MatrixError(f"{bad} lines are not edges")

        def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list | None = None  # file, start, first, last, ascending
            for pdf in batches:
                for (file, start), own in pdf.groupby(["file", "start"], sort=False)["j"]:
                    j = own.to_numpy()
                    up = bool((j[1:] >= j[:-1]).all())
                    if held and held[:2] == [file, start]:
                        held[3:] = [j[-1], held[4] and up and held[3] <= j[0]]
                        continue
                    if held:
                        yield pd.DataFrame([held], columns=["file", "start", "first", "last", "up"])
                    held = [file, start, j[0], j[-1], up]
            if held:
                yield pd.DataFrame([held], columns=["file", "start", "first", "last", "up"])

        placed = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), place(1).alias("j"))
        splits = placed.mapInPandas(ends, "file string, start long, first long, last long, up boolean")
        before = F.lag("last").over(Window.orderBy("file", "start"))
        if not splits.withColumn("before", before).where("NOT up OR before > first").isEmpty():
            raise MatrixError("columns do not ascend")
    return edges.select("i", "j")


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """(file, i, j, v) of packed matrix files, one task a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                head, i, j, v = unpack_matrix(bytes(content))
                out = pd.DataFrame({"file": name, "i": i, "j": j, "v": v})
                if head["flags"] & _SYMMETRIC:
                    flipped = out[out.i != out.j].rename(columns={"i": "j", "j": "i"})[["file", "i", "j", "v"]]
                    out = pd.concat([out, flipped])
                yield out

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, i long, j long, v double")


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """(file, time, i, j, v) of raw grids: two 64-bit sizes, the time, then doubles by rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                nx, ny, time = struct.unpack_from("<QQd", content)
                k = np.arange(nx * ny)
                yield pd.DataFrame({"file": name, "time": time, "i": k // ny, "j": k % ny, "v": np.frombuffer(content, "<f8", nx * ny, 24)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, time double, i long, j long, v double")


def stencil_matrix(spark: SparkSession, nx: int, ny: int | None = None, nz: int | None = None) -> DataFrame:
    """The 27-point matrix of an nx x ny x nz grid: 26 on the diagonal, -1 for each neighbour."""
    ny = nx if ny is None else ny
    nz = ny if nz is None else nz
    points = spark.range(nx * ny * nz).select(
        F.col("id").alias("i"), (F.col("id") % nx).alias("x"), (F.floor(F.col("id") / nx) % ny).alias("y"), F.floor(F.col("id") / (nx * ny)).alias("z")
    )
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for c in (-1, 0, 1) for b in (-1, 0, 1) for a in (-1, 0, 1)])
    near = points.select("i", "x", "y", "z", F.explode(steps).alias("s"))
    inside = (F.col("x") + F.col("s.a")).between(0, nx - 1) & (F.col("y") + F.col("s.b")).between(0, ny - 1) & (F.col("z") + F.col("s.c")).between(0, nz - 1)
    j = F.col("i") + F.col("s.a") + nx * F.col("s.b") + nx * ny * F.col("s.c")
    return near.where(inside).select("i", j.alias("j"), F.when(j == F.col("i"), 26.0).otherwise(-1.0).alias("v"))


def stencil_entries(nx: int, ny: int, nz: int) -> int:
    return (3 * nx - 2) * (3 * ny - 2) * (3 * nz - 2)


def diagonal_system(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    """A with i + 1 on the diagonal, and x with the same values."""
    a = spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), (F.col("id") + 1.0).alias("v"))
    return a, spark.range(n).select(F.col("id").alias("j"), (F.col("id") + 1.0).alias("x"))


def random_matrix(spark: SparkSession, n: int, per_row: int, seed: int = 0) -> DataFrame:
    """1..per_row distinct columns a row with whole values in [-n, n]; the same for a seed."""
    count = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(per_row)) + 1
    column = lambda k: F.pmod(F.xxhash64(F.lit(seed + 1), "id", k), F.lit(n))
    columns = F.array_distinct(F.transform(F.sequence(F.lit(1).cast("long"), count), column))
    rows = spark.range(n).select(F.col("id").alias("i"), F.explode(columns).alias("j"))
    return rows.withColumn("v", (F.pmod(F.xxhash64(F.lit(seed + 2), "i", "j"), F.lit(2 * n + 1)) - n).cast("double"))
