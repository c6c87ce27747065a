import gzip
import math
import struct

import numpy as np
import pytest

from gridloom.operators import sparse as sp
from gridloom.sources import bricks as bk
from gridloom.sources import matrices as mx
from gridloom.sources import tables as tb
from gridloom.streaming.micro_batches import map_files


def put(tmp_path, text, name="a.mtx"):
    (tmp_path / name).write_text(text)
    return f"file://{tmp_path}/{name}"


def rows(df):
    return sorted(tuple(r) for r in df.select("i", "j", "v").collect())


def test_matrix_text(spark, tmp_path):
    path = put(tmp_path, "%%MatrixMarket matrix coordinate real general\n% note\n\n3 4 2\n1 1 2.5\n  3   4 -1e3\n")
    assert mx.header(spark, path) == {"rows": 3, "cols": 4, "nnz": 2, "field": "real", "symmetry": "general"}
    assert rows(mx.read_matrix(spark, path)) == [(0, 0, 2.5), (2, 3, -1000.0)]


def test_symmetric_body_is_mirrored(spark, tmp_path):
    body = "".join(f"{i} 1 {i}\n" for i in range(1, 11))
    path = put(tmp_path, f"%%MatrixMarket matrix coordinate integer symmetric\n10 10 10\n{body}")
    a = mx.read_matrix(spark, path)
    assert a.count() == 19 and sp.unmatched(a).count() == 0


@pytest.mark.parametrize("banner", ["%%MatrixMarket xmatrix coordinate real", "%%MatrixMarket matrix xcoordinate real", "%%MatrixMarket matrix coordinate complex", "%%MatrixMarket matrix coordinate pattern general", "%%MatrixMarket matrix coordinate real skew-symmetric", ""])
def test_headers_refused(spark, tmp_path, banner):
    with pytest.raises(mx.MatrixError):
        mx.header(spark, put(tmp_path, banner + "\n1 1 1\n1 1 1\n"))


@pytest.mark.parametrize("body", ["4 1 1\n1 1 1\n", "0 1 1\n1 1 1\n", "1 1 1\n", "1 1 1\n1 1 2\n"])
def test_bodies_refused(spark, tmp_path, body):
    with pytest.raises(mx.MatrixError):
        mx.read_matrix(spark, put(tmp_path, "%%MatrixMarket matrix coordinate real general\n3 3 2\n" + body))


def test_packed_matrix(spark, tmp_path):
    i, j, v = np.array([0, 1, 2]), np.array([0, 0, 2]), np.array([1.0, 2.0, 3.0])
    content = mx.pack_matrix(3, 3, i, j, v, symmetric=True)
    (tmp_path / "m.bmtx").write_bytes(b"% note\n" + content)
    assert rows(mx.read_packed(spark, f"file://{tmp_path}/m.bmtx")) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 2.0), (2, 2, 3.0)]
    swapped = struct.pack(">9Q", *struct.unpack_from("<9Q", content)) + i.astype(">i4").tobytes() + j.astype(">i4").tobytes() + v.astype(">f8").tobytes()
    assert [x.tolist() for x in mx.unpack_matrix(swapped)[1:]] == [[0, 1, 2], [0, 0, 2], [1.0, 2.0, 3.0]]
    for bad in (content[:-1], b"\0" * 80):
        with pytest.raises(mx.MatrixError):
            mx.unpack_matrix(bad)


def test_grid_file(spark, tmp_path):
    (tmp_path / "g.bin").write_bytes(struct.pack("<QQd", 2, 3, 0.5) + np.arange(6.0).tobytes())
    got = mx.read_grid(spark, f"file://{tmp_path}/g.bin").collect()
    assert sorted((r.i, r.j, r.v) for r in got) == [(k // 3, k % 3, float(k)) for k in range(6)] and got[0].time == 0.5


def test_stencil_matrix(spark):
    a = mx.stencil_matrix(spark, 5).cache()
    assert a.count() == 2197 == mx.stencil_entries(5, 5, 5)
    p = sp.row_profile(a).toPandas()
    assert (p.n.min(), p.n.max()) == (8, 27) and math.isclose(p.n.mean(), 17.576) and math.isclose(p.n.std(ddof=0), 5.83816957616)
    assert (p.bandwidth.min(), p.bandwidth.max()) == (32, 63) and math.isclose(p.bandwidth.mean(), 50.6)
    assert sp.unmatched(a).count() == 0
    x = spark.range(125).selectExpr("id AS j", "id + 1.0D AS x")
    y = {r.i: r.v for r in sp.spmv(a, x).collect()}
    assert [y[k] for k in range(3)] == [-105.0, -150.0, -135.0] and sum(y.values()) == 74214
    assert math.isclose(math.sqrt(sum(v * v for v in y.values())), 10069.119127312)


@pytest.mark.parametrize(("c", "sigma", "chunks", "stored", "fill"), [(8, 1, 16, 2760, 25.6258534365), (8, 32, 16, 2472, 12.5170687301), (32, 32, 4, 3168, 44.1966317706), (32, 128, 4, 2400, 9.2398725535)])
def test_chunked_layout(spark, c, sigma, chunks, stored, fill):
    got = sp.sell_fill(sp.lengths(mx.stencil_matrix(spark, 5)), c, sigma).first()
    assert (got.chunks, got.stored) == (chunks, stored) and math.isclose(got.fill_percent, fill, rel_tol=1e-9)


def test_padded_layout(spark):
    a = mx.stencil_matrix(spark, 5)
    assert math.isclose(sp.ell_fill(sp.lengths(a)).first().fill_percent, 53.6185707783, rel_tol=1e-9)
    wide = sp.ell(a, 27)
    assert wide.selectExpr("min(size(columns)) = 27 AND max(size(values)) = 27").first()[0]
    with pytest.raises(Exception, match="longer than the width"):
        sp.ell(a, 8).collect()


def test_systems(spark):
    a, x = mx.diagonal_system(spark, 70)
    assert {r.i: r.v for r in sp.spmv(a, x).collect()} == {i: (i + 1.0) ** 2 for i in range(70)}
    r = mx.random_matrix(spark, 200, 9, seed=3).toPandas()
    assert not r.duplicated(["i", "j"]).any() and r.groupby("i").size().between(1, 9).all() and r.v.between(-200, 200).all()
    dense = np.zeros((200, 200))
    dense[r.i, r.j] = r.v
    xs = spark.range(200).selectExpr("id AS j", "id * 0.5D AS x")
    y = {q.i: q.v for q in sp.spmv(mx.random_matrix(spark, 200, 9, seed=3), xs).collect()}
    assert np.allclose([y[i] for i in range(200)], dense @ (np.arange(200) * 0.5))


def test_text_tables(spark, tmp_path):
    with gzip.open(tmp_path / "h.csv.gz", "wt") as f:
        f.write("1.0,0.5,2\n0.0,1.5,3\n")
    got = tb.labelled_csv(spark, f"file://{tmp_path}/h.csv.gz", 2).collect()
    assert sorted((r.label, tuple(r.features)) for r in got) == [(0.0, (1.5, 3.0)), (1.0, (0.5, 2.0))]
    (tmp_path / "n.txt").write_text("1 , 2\r\n3,4\r\n \r\n")
    assert sorted(map(tuple, tb.numbers(spark, f"file://{tmp_path}/n.txt", ["x", "y"]).collect())) == [(1.0, 2.0), (3.0, 4.0)]
    (tmp_path / "i.csv").write_text("idx,a\n0,5\n1,6\n")
    assert [tuple(r) for r in tb.indexed_csv(spark, f"file://{tmp_path}/i.csv", "idx int, a int").orderBy("a").collect()] == [(5,), (6,)]
    (tmp_path / "q.json").write_text('{"title":"t","context":"c","question":"q","answers":{"text":["a","b"],"answer_start":[1,2]}}\n')
    assert tb.questions(spark, f"file://{tmp_path}/q.json").first().answer_start == [1, 2]
    tb.write_vector(spark.range(3).selectExpr("id", "id * 0.5D AS v"), "id", "v", f"file://{tmp_path}/vec")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/vec").orderBy("value").collect()] == ["0.000000e+00", "1.000000e+00", "5.000000e-01"]


def test_days_are_pruned(spark, tmp_path):
    cells = spark.range(60).selectExpr("id % 3 AS day", "id DIV 10 AS y", "id % 10 AS x", "id * 1.0D AS v")
    tb.write_daily_cells(cells, f"file://{tmp_path}/days")
    one = tb.daily_cells(spark, f"file://{tmp_path}/days").where("day = 1")
    assert one.count() == 20 and "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().toString()


def test_micro_batches(spark, tmp_path):
    df = spark.range(100).withColumnRenamed("id", "x").repartition(4)
    df.write.parquet(f"file://{tmp_path}/in")
    args = (f"file://{tmp_path}/in", df.schema, lambda d: d.selectExpr("x * 2 AS y"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    assert map_files(spark, *args) == 4 and map_files(spark, *args) == 0
    assert spark.read.parquet(f"file://{tmp_path}/out").agg({"y": "sum"}).first()[0] == 9900


def test_generators(spark):
    from gridloom.functions.scalars import spline_basis
    from gridloom.sources import generators as gn

    a = gn.whole_numbers(spark, 2000, 100, 1)
    assert a.collect() == gn.whole_numbers(spark, 2000, 100, 1).repartition(5).orderBy("idx").collect()
    x = a.toPandas().x
    assert x.between(0, 100).all() and abs(x.mean() - 50) < 3
    p = gn.noisy_polynomial(spark, 4000, (0.5, 2.0), 0.1).toPandas()
    assert abs((p.y - 0.5 - 2 * p.x).std() - 0.1) < 0.01 and p.x.between(-1, 1).all()
    g = gn.price_paths(spark, 500, 20, 0.05, 0.2).toPandas()
    last = np.log(g[g.t == 20].x)
    assert len(g) == 10_000 and abs(last.std() - 0.2) < 0.02 and abs(last.mean() - 0.03) < 0.03
    from pyspark.sql import functions as F

    rows = spark.range(20).select((F.col("id") / 20 + 0.5).alias("x"))
    sums = rows.select(F.aggregate(spline_basis(F.col("x"), [-3.0, -2.0, -1.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0]), F.lit(0.0), lambda u, v: u + v).alias("s")).collect()
    assert np.allclose([r.s for r in sums], 1.0)


def test_index_fit():
    mx.check_index_fit(2**31 - 1, 5, 7)
    for n in ((2**31, 1, 1), (1, 2**31, 1), (1, 1, 2**31)):
        with pytest.raises(mx.MatrixError):
            mx.check_index_fit(*n)


def test_bov_bricks_and_plain_files(spark, tmp_path):
    rows = [(i, j, float(10 * i + j)) for i in range(5) for j in range(3) if (i, j) != (2, 1)]
    df = spark.createDataFrame([*rows, (2, 1, None)], "i long, j long, v double")
    header = bk.write_bov(df, f"file://{tmp_path}", "g", 5, 3, brick_cells=6)
    assert sorted(tuple(r) for r in bk.read_bov(spark, header).collect()) == rows
    data = b"".join(p.read_bytes() for p in sorted(tmp_path.glob("g_*.bin")))
    assert len(data) == 8 * 15
    (tmp_path / "one.bin").write_bytes(data)
    (tmp_path / "one.bov").write_text("TIME: 0.0\nDATA_FILE: one.bin\nDATA_SIZE: 3 5 1\nDATA_FORMAT: DOUBLE\nVARIABLE: phi\nDATA_ENDIAN: LITTLE\n")
    assert sorted(tuple(r) for r in bk.read_bov(spark, f"file://{tmp_path}/one.bov").collect()) == rows


def test_bov_keeps_nan_and_refuses_what_does_not_fit(spark, tmp_path):
    nan = float("nan")
    rows = [(0, 0, nan), (0, 1, 1.0), (2, 1, nan), (3, 0, float("inf"))]
    df = spark.createDataFrame(rows, "i int, j int, v double")
    got = bk.read_bov(spark, bk.write_bov(df, f"file://{tmp_path}/a", "g", 4, 2, brick_cells=4)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows))
    for more, said in (((4, 0, 1.0), "outside"), ((0, 2, 1.0), "outside"), ((-1, 0, 1.0), "outside"), ((0, 1, 2.0), "more than once")):
        with pytest.raises(Exception, match=said):
            bk.write_bov(df.union(spark.createDataFrame([more], df.schema)), f"file://{tmp_path}/b", "g", 4, 2, brick_cells=4)
        assert not (tmp_path / "b" / "g.bov").exists()
    empty = bk.write_bov(df.limit(0), f"file://{tmp_path}/c", "g", 4, 2)
    assert bk.read_bov(spark, empty).count() == 0


def test_bov_plans_byte_ranges(spark, tmp_path):
    """A brick of any size is many tasks, and a filter on rows reads their bytes alone."""
    big = bk.Header(2_000_000, 300, 2_000_000, "one.bin")  # one file of 4.8 GB
    reader = bk.BovReader("file:///none", big, bk.SPLIT_CELLS)
    every = reader.partitions()
    assert len(every) > 100 and sum(p.rows for p in every) == big.rows and max(p.bytes(300) for p in every) <= 8 * bk.SPLIT_CELLS
    assert all(a.first + a.rows == b.first and a.offset + a.bytes(300) == b.offset for a, b in zip(every, every[1:], strict=False))
    assert sum(p.bytes(300) for p in bk.BovReader("file:///none", big, bk.SPLIT_CELLS, 1000, 1009).partitions()) == 8 * 300 * 10
    df = spark.range(5000).selectExpr("id div 50 AS i", "id % 50 AS j", "double(id) AS v")
    header = bk.write_bov(df, f"file://{tmp_path}", "g", 100, 50, brick_cells=1000)
    read = bk.read_bov(spark, header, split_cells=200)
    assert read.rdd.getNumPartitions() == 25
    some = bk.read_bov(spark, header, 40, 43, split_cells=200)
    assert some.rdd.getNumPartitions() == 1
    assert sorted(tuple(r) for r in some.where("v % 2 = 0").collect()) == sorted(tuple(r) for r in df.where("i >= 40 and i < 44 and v % 2 = 0").collect())
    assert sorted(tuple(r) for r in read.where("i in (3, 97)").collect()) == sorted(tuple(r) for r in df.where("i in (3, 97)").collect())
    assert read.where("i = 200").count() == bk.read_bov(spark, header, 200, 300).count() == 0 and read.count() == 5000
    (tmp_path / "g_00002.bin").write_bytes(b"x" * 100)
    with pytest.raises(Exception, match="ends before row"):
        read.count()


def test_any_field(spark, tmp_path):
    read = lambda text: sorted(tuple(r) for r in mx.read_any_matrix(spark, put(tmp_path, text)).collect())
    banner = "%%MatrixMarket matrix coordinate "
    assert read(banner + "pattern symmetric\n2 2 2\n1 1\n2 1\n") == [(0, 0, 1.0, 0.0), (0, 1, 1.0, 0.0), (1, 0, 1.0, 0.0)]
    assert read(banner + "complex hermitian\n2 2 1\n2 1 3 4\n") == [(0, 1, 3.0, -4.0), (1, 0, 3.0, 4.0)]
    assert read(banner + "real skew-symmetric\n3 3 1\n3 1 2.5\n") == [(0, 2, -2.5, 0.0), (2, 0, 2.5, 0.0)]
    wrong = ["pattern skew-symmetric\n1 1 0\n", "real hermitian\n1 1 0\n", "complex general\n1 1 1\n1 1 2\n", "real general\n2 2 1\n1 x 1\n", "real general\n2 2 2\n1 1 1\n1 1 2\n"]
    for text in wrong:
        with pytest.raises(mx.MatrixError):
            read(banner + text)


def test_packed_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mx, "PACKED_ENTRIES", 40)
    a = spark.range(150).selectExpr("id % 3 AS i", "id AS j", "id / 2 AS v")
    assert mx.write_packed(a, f"file://{tmp_path}/p", "a", 3, 150) == 4
    assert rows(mx.read_packed(spark, f"file://{tmp_path}/p/a_*.bmtx")) == rows(a)
    with pytest.raises(mx.MatrixError):
        mx.write_packed(a, f"file://{tmp_path}/q", "a", 2**31, 150)


def test_edge_files(spark, tmp_path):
    edges = spark.range(500).selectExpr("id * 7 % 90 AS i", "id % 40 + 5 AS j").distinct()
    path = f"file://{tmp_path}/e"
    mx.write_edges(edges.repartition(5), path)
    got = mx.read_edges(spark, path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, edges.collect()))
    assert mx.read_edges(spark, put(tmp_path, "", "none.txt")).count() == 0
    for text in ("1 2\n1 1\n", "1 2 3\n", "0 1\n", "1 x\n"):
        with pytest.raises(mx.MatrixError):
            mx.read_edges(spark, put(tmp_path, text, "bad.txt"))
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.txt").write_text("1 1\n2 3\n")
    (tmp_path / "two" / "b.txt").write_text("1 2\n" * 3)
    with pytest.raises(mx.MatrixError):
        mx.read_edges(spark, f"file://{tmp_path}/two")
    assert mx.read_edges(spark, f"file://{tmp_path}/two", checked=False).count() == 5
