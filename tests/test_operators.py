"""Golden values and invariants of operators that have no SQL form, or whose edges matter."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalars as sc
from gridloom.operators import aggregates as ag
from gridloom.operators import distances as ds
from gridloom.operators import graph as gr
from gridloom.operators import grid as gd
from gridloom.operators import models as md
from gridloom.operators import rows as rw
from gridloom.operators import sequences as sq
from gridloom.operators import sparse as sp
from gridloom.operators import text as tx
from gridloom.operators.blocks import in_blocks, running


def seq(spark, values):
    return spark.createDataFrame(list(enumerate(map(float, values))), "idx long, v double")


def test_blocks_agree_with_one_order(spark):
    values = [(7 * k) % 23 for k in range(57)]
    df = seq(spark, values)
    for block in (1, 5, 16, 1000):
        got = {r.idx: r.s for r in running(df, "idx", F.col("v"), "s", block).collect()}
        assert [got[k] for k in range(57)] == np.cumsum(values).tolist()
        make = lambda w: {"m": F.sum("v").over(w.rowsBetween(-3, 2)), "a": F.lag("v", 3).over(w), "b": F.lead("v", 2).over(w)}
        for r in in_blocks(df, "idx", 3, 2, make, block).collect():
            k = r.idx
            assert r.m == sum(values[max(0, k - 3) : k + 3])
            assert r.a == (values[k - 3] if k >= 3 else None) and r.b == (values[k + 2] if k + 2 < 57 else None)


def test_running_has_no_single_partition_of_rows(spark):
    plan = running(seq(spark, range(10)), "idx", F.col("v"), "s")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1  # of the block totals alone


def test_lag_matrix(spark):
    got = sq.lag_matrix(seq(spark, range(1, 16)), "idx", "v", 10).orderBy("idx").collect()
    assert len(got) == 4 and [got[0][f"lag_{k}"] for k in range(11, 0, -1)] + [got[0].target] == list(range(1, 13))


def test_sliding_history(spark):
    got = sq.sliding_history(seq(spark, range(8)), "idx", "v", 3, 1).orderBy("idx").collect()
    assert [(r.history, r.target) for r in got] == [([0, 1, 2], 4), ([1, 2, 3], 5), ([2, 3, 4], 6), ([3, 4, 5], 7)]


def test_blur_and_order(spark):
    got = sq.blur(seq(spark, [1, 0, 0, 0, 0, 1]), "idx", "v").orderBy("idx").collect()
    assert [r.v for r in got] == [1, 0.25, 0, 0, 0.25, 1]
    assert tuple(sq.is_sorted(seq(spark, [1, 1, 2]), "idx", ["v"]).first()) == (True, True)
    assert tuple(sq.is_sorted(seq(spark, [1, 3, 2]), "idx", ["v"]).first()) == (False, False)


def test_row_tools(spark):
    df = seq(spark, range(12))
    assert [r.position for r in rw.select(df, "idx", F.col("v") % 5 == 2).orderBy("idx").collect()] == [0, 1]
    assert [r.idx for r in rw.decimate(df, "idx", 4, 1).orderBy("idx").collect()] == [0, 1, 2]
    parts = rw.split_random(df, "idx", 0.5).groupBy("split").count().collect()
    assert sum(r["count"] for r in parts) == 12
    assert [r.target for r in rw.one_hot_array(df.limit(2), "idx", 3).orderBy("idx").collect()] == [[1, 0, 0], [0, 1, 0]]
    assert {r.chunk for r in rw.chunked(df, "idx", 12, 3).collect()} == {0, 1, 2}
    with pytest.raises(ValueError):
        rw.chunked(df, "idx", 12, 5)
    assert sorted((r.slot, r.idx) for r in rw.ring(df, "idx", 5).collect()) == [(0, 10), (1, 11), (2, 7), (3, 8), (4, 9)]
    assert rw.union_all([df, df], "part").select("part").distinct().count() == 2
    assert rw.batched(df, "idx", 5).agg(F.max("batch")).first()[0] == 2
    assert sorted(r.v for r in rw.shuffled(df, "idx").collect()) == list(range(12))
    m = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0)], "i long, j long, v double")
    assert sp.unmatched(rw.mirrored(m)).count() == 0 and rw.mirrored(m).count() == 3


def test_order_statistics(spark):
    df = spark.createDataFrame([("a", v) for v in (5.0, 1.0, 4.0, 2.0)] + [("b", 7.0), ("c", None)] + [("d", float(k % 7)) for k in range(100)], "g string, v double")
    got = {r.g: r.upper_median for r in ag.statistics(df, "g", "v").collect()}
    assert got == {"a": 4.0, "b": 7.0, "c": None, "d": 3.0}


def test_log_histogram(spark):
    counts = [r.n for r in ag.log_histogram(spark.range(1001), F.col("id"), 31).orderBy("bucket").collect()]
    assert counts == [1] * 11 + [10] * 9 + [100] * 9 + [0, 0]


def test_comparison_and_iris_scaling(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (0.0, 0.0), (1.0, 0.0)], "x double, y double")
    c = ag.compared(F.col("x"), F.col("y"), 1e-5)
    got = df.agg(*[v.alias(k) for k, v in c.items()]).first()
    assert (got.n_differ, got.max_error, got.max_abs) == (2, math.inf, 1.0)
    z = [r.z for r in ag.standardised(seq(spark, [1, 2, 6]), "v", "max_abs").orderBy("idx").collect()]
    assert np.allclose(z, [-2 / 3, -1 / 3, 1])


def test_pagerank_of_a_small_graph(spark):
    # Six pages; edges go from the second to the first.
    edges = [(2, 1), (6, 1), (1, 2), (2, 3), (2, 4), (3, 4), (3, 5), (3, 6), (1, 6)]
    df = spark.createDataFrame([(s, d) for d, s in edges], "src long, dst long")
    x, steps, norm = gr.pagerank(df, spark.range(1, 7))
    got = {r.id: r.x for r in x.collect()}
    assert math.isclose(sum(got.values()), 1.0, rel_tol=1e-9) and norm <= 1e-9 and steps < 200
    n, a = 6, np.zeros((6, 6))
    degree = np.zeros(6)
    for d, s in edges:
        a[d - 1, s - 1] += 1
        degree[s - 1] += 1
    z = np.where(degree > 0, 0.15 / n, 1.0 / n)
    a = 0.85 * a / np.where(degree > 0, degree, 1)
    v = np.full(n, 1.0 / n)
    for _ in range(steps):
        v = a @ v + z @ v
    assert np.allclose([got[k] for k in range(1, 7)], v, atol=1e-12)


def stencil(u, old, alpha, dxs):
    p = np.pad(u, 1)
    return -(4 + alpha) * u + p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] + alpha * old + dxs * u * (1 - u)


def test_diffusion_and_residual(spark):
    grid = spark.range(30).selectExpr("id DIV 6 AS j", "id % 6 AS i", "CASE WHEN id DIV 6 IN (0, 4) THEN 1.0D ELSE 0.0D END AS v")
    got = {(r.i, r.j): r.v for r in gd.diffusion(grid, 0.1, 2).collect()}
    rows = [[got[i, j] for i in range(1, 5)] for j in (1, 2, 3)]
    assert np.allclose(rows, [[0.17, 0.18, 0.18, 0.17], [0.02] * 4, [0.17, 0.18, 0.18, 0.17]])
    assert all(got[i, j] == (1.0 if j in (0, 4) else 0.0) for i in (0, 5) for j in range(5))
    field = np.random.default_rng(1).random((6, 6))
    cells = [(i, j, float(field[i, j]), float(field[i, j]) / 2) for i in range(6) for j in range(6)]
    df = spark.createDataFrame(cells, "i int, j int, v double, o double")
    s = {(r.i, r.j): r.s for r in gd.residual(df, "o", 1.5, 0.3).collect()}
    want = stencil(field, field / 2, 1.5, 0.3)
    assert all(math.isclose(s[i, j], want[i, j], rel_tol=1e-12, abs_tol=1e-12) for i in range(6) for j in range(6))


def test_distances(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0]), (2, [1.0, 1.0])], "k long, x array<double>")
    def table(f, how=ds.to_queries):
        out = how(df, df, "k", "x", f) if how is ds.to_queries else how(df, df, "k", "x")
        return {(r.q, r.id): r.distance for r in out.collect()}
    a, b, c, d = table(ds.l1), table(ds.l2_squared), table(ds.signed_difference), table(None, ds.l2_by_norms)
    assert (a[0, 1], a[0, 2], a[1, 2]) == (7, 2, 5) and (b[0, 1], b[0, 2], b[1, 2]) == (25, 2, 13)
    assert (c[0, 1], c[0, 2], c[1, 2]) == (-7, -2, 5) and d == b and len(a) == 9


def test_scalar_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("c")).first().c
    assert math.isclose(value(sc.newton(F.lit(1.5))), 0.8049501319758164, rel_tol=1e-12)
    assert np.allclose([value(sc.polyval(F.lit(x))) for x in (-1, -0.5, 0, 0.5, 1)], [0.115, 0.18875, 0.2, 0.22375, 0.335])
    assert value(sc.normalize_text(F.lit("The  CAT, an A-Team's\tthe theory!"))) == "cat ateams theory"
    dims = lambda s: tuple(value(c) for c in sc.dimensions(F.lit(s)).values())
    assert [dims(s) for s in ("5:6:7", "5:6", "5", "5x6:7")] == [(5, 6, 7), (5, 6, 6), (5, 5, 5), (5, 7, 7)]
    assert all(dims(s) == (None, None, None) for s in ("x5x6:7", "0", "-1:2", "", "3:0"))
    assert value(sc.span(F.lit("abcdef"), F.lit(2), F.lit(4))) == "cd" and value(sc.span(F.lit("abc"), F.lit(1), F.lit(99))) == "bc"
    assert value(sc.padded(F.array(F.lit(1), F.lit(2)), 4)) == [1, 2, 0, 0] and value(sc.mask(F.array(F.lit(9)), 3)) == [1, 0, 0]
    assert value(sc.masked(F.array(F.lit(5), F.lit(6)), F.array(F.lit(0), F.lit(1)))) == [6]
    assert value(sc.kronecker(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4)))) == [3, 4, 6, 8]
    big = F.lit(2**62)
    assert value(sc.adds_over(big, big)) and not value(sc.adds_over(F.lit(1), F.lit(2))) and value(sc.multiplies_over(big, F.lit(4)))
    assert np.allclose(value(sc.softmax(F.array(F.lit(1.0), F.lit(1.0)))), [0.5, 0.5])
    assert value(sc.tree_value(F.lit(3), (3, 1.0, 2.0))) == 2.0


def test_words_and_spans(spark):
    docs = spark.createDataFrame([("the then, a An",)], "text string")
    assert tx.trie_size(docs).first().nodes == 7
    assert {r.prefix: r.n for r in tx.prefixes(docs).collect()} == {"t": 0, "th": 0, "the": 1, "then": 1, "a": 1, "an": 1}
    text = "Ab,  c-d é1\n!!"
    toks = tx.tokens(spark.createDataFrame([("k", text), ("e", ""), ("n", None)], "key string, text string"), "key", "text").orderBy("place").collect()
    assert [r.token for r in toks] == ["Ab", ",", "c", "-", "d", "é1", "!", "!"]
    assert all(text[r.start : r.end] == r.token for r in toks) and [r.place for r in toks] == list(range(8))
    answers = spark.createDataFrame([("k", 1, 6), ("k", 3, 5)], "key string, answer_start int, answer_end int")
    frame = tx.tokens(spark.createDataFrame([("k", text)], "key string, text string"), "key", "text")
    got = tx.span_tokens(frame, answers.where("answer_start = 1"), "key").first()
    assert (got.start_token, got.end_token) == (0, 3)
    assert tx.span_tokens(frame, answers.where("answer_start = 3"), "key").count() == 0
    pairs = spark.createDataFrame([("The cat", "cat!"), ("a b b", "b b c"), ("", "")], "p string, t string")
    rows = pairs.select(tx.exact_match(F.col("p"), F.col("t")).alias("m"), tx.token_f1(F.col("p"), F.col("t")).alias("f")).collect()
    assert [r.m for r in rows] == [1, 0, 1] and np.allclose([r.f for r in rows], [1.0, 0.8, 1.0])


def test_descents():
    path = md.descend(lambda x: 3 * x * x - 4 * x, 2.0)
    assert len(path) == 17 and math.isclose(path[-1], 1.3334253508, rel_tol=1e-9)
    path = md.descend(lambda x: 3 * x * x - 4 * x, 2.0, 0.17, decay=1.0)
    assert len(path) == 6 and math.isclose(path[-1], 1.3308506741, rel_tol=1e-9)


def test_polynomial_fits(spark):
    x = np.linspace(-1, 1, 100)
    y = 0.2 + 0.01 * x + 0.025 * x**2 + 0.1 * x**3
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    assert np.allclose(md.fit_polynomial(df, F.col("x"), F.col("y"), 3), [0.2, 0.01, 0.025, 0.1])
    assert np.allclose(md.fit_polynomial(df, F.col("x"), F.col("y"), 3, 0.1), [0.1996443334, 0.0122074617, 0.0254587981, 0.0963346180])


def test_line_by_descent(spark):
    df = spark.createDataFrame([(float(k), 3.0 + 2.0 * k) for k in range(10)], "x double, y double")
    a, b, steps = md.batch_descent(df, F.col("x"), F.col("y"), 0.03, 1e-9)
    assert math.isclose(a, 3, rel_tol=1e-6) and math.isclose(b, 2, rel_tol=1e-6) and steps > 0
    one = df.withColumn("k", F.lit(1)).withColumn("o", F.col("x"))
    got = md.stochastic_descent(one, "k", ["o"], "x", "y", 0.01, 400).first()
    assert abs(got.a - 3) < 0.3 and abs(got.b - 2) < 0.1


def test_boosting(spark):
    df = spark.createDataFrame([(-1.0, 0.1), (-0.5, 0.1), (0.0, 0.2), (0.5, 0.1), (1.0, 0.1)], "x double, y double")
    one = md.boost(df, F.col("x"), F.col("y"), 1, 1)[0]
    assert one.split == 0.25 and math.isclose(one.left.value, 0.4 / 3) and math.isclose(one.right.value, 0.1)
    fitted = df.select("y", md.boosted(md.boost(df, F.col("x"), F.col("y"), 1, 2), F.col("x")).alias("p")).collect()
    assert np.allclose([r.y for r in fitted], [r.p for r in fitted])


def test_perceptron(spark):
    for gate in ([0, 0, 0, 1], [0, 1, 1, 1]):
        df = spark.createDataFrame([(a, b, gate[2 * a + b]) for a in (0, 1) for b in (0, 1)], "a int, b int, t int")
        w = md.perceptron(df, [F.col("a"), F.col("b")], F.col("t"), 0.5, 15)
        got = [int(w[0] * a + w[1] * b - w[2] > 0) for a in (0, 1) for b in (0, 1)]
        assert got == gate


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_of_the_library_does_not_import_llm():
    import re
    from pathlib import Path

    root = Path(__file__).parent.parent / "gridloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"gridloom\.llm|corpus_pipeline", p.read_text()), p


def test_hot_conversation_is_nested_in_parts(spark, tmp_path, monkeypatch):
    from gridloom.plans import basics

    rows = spark.range(6000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("conv_id"), (F.col("id") % 2500).alias("turn"), F.lit("same").alias("text"))
    rows = rows.unionByName(spark.sql("SELECT 1L AS conv_id, NULL AS turn, NULL AS text FROM range(3)"))
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    sizes, zipped = [], basics.rw.zipped
    monkeypatch.setattr(basics.rw, "zipped", lambda df, arrays: (sizes.append(df.agg(F.max(F.size("turn"))).first()[0]), zipped(df, arrays))[1])
    got = basics.explode_zip(spark, str(tmp_path)).select("conv_id", "turn", "text")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, rows.collect()))
    assert sizes[0] <= 1000


def hot(spark):
    """Two thirds of the rows in key 1, some in a null key; values and order with nulls and repeats."""
    key = F.when(F.col("id") % 3 > 0, 1).when(F.col("id") % 30 > 0, F.col("id") % 7 + 2)
    value = F.when(F.col("id") % 11 > 0, (F.col("id") * 37 % 101 / 50.0))
    return spark.range(3000).select(key.alias("k"), F.when(F.col("id") % 5 > 0, F.col("id") * 13 % 17).alias("o"), "id", value.alias("v"))


def by_key(spark):
    found = {}
    for r in sorted(hot(spark).collect(), key=lambda r: (r.o is not None, r.o or 0, r.id)):
        found.setdefault(r.k, []).append(r)
    return found


@pytest.fixture
def many_ranges(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_hot_key_windows_in_blocks(spark, many_ranges, monkeypatch):
    from gridloom.operators import blocks

    made = []
    key_blocks = blocks.key_blocks
    monkeypatch.setattr(sq, "key_blocks", lambda *a: (made.append(key_blocks(*a)), made[-1])[1])
    position = {r.id: r.position for r in sq.group_position(hot(spark), "k", ["o", "id"]).collect()}
    back = {r.id: r for r in sq.returns(hot(spark), "k", ["o", "id"], "v").collect()}
    path = {r.id: r.path for r in sq.price_path(hot(spark), "k", ["o", "id"], F.col("v") / 100).collect()}
    assert len(position) == len(path) == 3000
    for rows in by_key(spark).values():
        total, seen = 0.0, False
        for k, r in enumerate(rows):
            total, seen = total + (r.v or 0.0) / 100, seen or r.v is not None
            assert position[r.id] == k
            assert path[r.id] is None if not seen else math.isclose(path[r.id], math.exp(total), rel_tol=1e-9)
            lag = rows[k - 1].v if k else None
            assert (back[r.id].lag1 if r.id in back else None) == lag
    assert len(made) == 3
    for df in made:
        assert df.groupBy("k", "_block").count().agg(F.max("count")).first()[0] < 1000  # of 2,000 rows of key 1


def test_hot_key_descent_in_blocks(spark, many_ranges):
    df = hot(spark).withColumn("v", F.coalesce("v", F.lit(0.5))).withColumn("y", 1 + 2 * F.col("v") + F.col("id") % 4 / 10)
    for epochs in (1, 3):
        out = md.stochastic_descent(df, "k", ["o", "id"], "v", "y", 0.1, epochs)
        got = {None if r.k is None or r.k != r.k else r.k: r for r in out.collect()}
        want = by_key(spark)
        assert got.keys() == want.keys()
        for k, rows in want.items():
            a = b = 0.0
            for _ in range(epochs):
                cost = 0.0
                for r in sorted(rows, key=lambda r: (r.o is None, r.o or 0, r.id)):
                    u = 0.5 if r.v is None else r.v
                    e = a + b * u - (1 + 2 * u + r.id % 4 / 10)
                    cost += e * e / 2
                    a, b = a - 0.1 * e, b - 0.1 * e * u
            assert np.allclose([got[k].a, got[k].b, got[k].cost], [a, b, cost / len(rows)], rtol=1e-9)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "MapInArrow" in plan


def test_null_cells_have_anomalies(spark):
    df = spark.createDataFrame([(1, None, "a", 1.0), (2, None, "a", 3.0), (3, 5, None, 4.0), (4, None, None, 7.0), (5, 5, "a", 2.0), (6, 5, "a", None)], "id int, h int, t string, v double")
    got = {r.id: r.anomaly for r in md.cell_anomaly(df, ["h", "t"], "v").collect()}
    assert got == {1: -1.0, 2: 1.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: None}


def test_articles_and_white_space_beyond_ascii(spark):
    rows = [("An\u00e7ai the\u00e9 a\u00e7a", "an\u00e7ai the\u00e9 a\u00e7a"), ("the an a\u00a0b\u2003\u1680c\x1cd", "b c d"), ("\u2028A.the\u3000", "athe"), ("a_the", "athe")]
    df = spark.createDataFrame([(k, t, w) for k, (t, w) in enumerate(rows)], "k int, t string, want string")
    for r in df.select("want", sc.normalize_text(F.col("t")).alias("got")).collect():
        assert r.got == r.want
    assert spark.sql("SELECT 'x\u00a0\u00a0y ' AS t").select(sc.squeeze(F.col("t"))).first()[0] == "x y"


def test_r2_of_values_far_from_zero(spark):
    df = spark.range(1000).select((1e9 + F.col("id") % 7 / 10).alias("y"), (1e9 + F.col("id") % 7 / 10 + 0.001).alias("p"))
    y = np.arange(1000) % 7 / 10
    assert abs(df.agg(ag.regression_metrics(F.col("y"), F.col("p"))["r2"]).first()[0] - (1 - 1e-6 / y.var())) < 1e-6


def test_mini_batches_against_a_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), float(x), float(2 * x + 1 + e)) for k, x, e in zip(rng.integers(0, 3000, 9000), rng.random(9000), rng.normal(0, 0.1, 9000), strict=True)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0), (1, None, 1.0)], "k int, x double, y double")
    a = b = 0.0
    batches = {}
    for k, x, y in rows:
        batches.setdefault(k, []).append((x, y))
    for _ in range(2):
        for k in sorted(batches):
            x, y = np.array(batches[k]).T
            e = a + b * x - y
            a, b = a - 0.1 * e.mean() * 2, b - 0.1 * (e * x).mean() * 2
    got = md.mini_batch_descent(df, F.col("k"), F.col("x"), F.col("y"), 0.1, epochs=2).first()
    assert got.batches == len(batches) and np.allclose([got.a, got.b], [a, b])
    empty = md.mini_batch_descent(df.limit(0), F.col("k"), F.col("x"), F.col("y"), 0.1).first()
    assert tuple(empty) == (0.0, 0.0, 0)


def test_grid_tiles_agree_with_one(spark):
    df = spark.range(35).select(F.floor(F.col("id") / 7).alias("i"), (F.col("id") % 7).alias("j"), (F.col("id") * F.col("id") % 11).cast("double").alias("v"))
    rows = lambda n: sorted(map(repr, gd.neighbours(df, n).select("i", "j", "v", "west", "east", "south", "north").collect()))
    assert rows(512) == rows(1) == rows(3)
    west = {(r.i, r.j): r.west for r in gd.neighbours(df, 3).collect()}
    assert west[0, 2] is None and west[3, 2] == (16 * 16) % 11


def test_answer_spans_leave_out_what_cannot_be_found(spark):
    rows = [
        ("a", "One  two three.", "who?", "two", 4),  # found once white space is squeezed
        ("b", "One two", "who?", "two", 4),  # ends where the context does
        ("c", "One two three", "who?", "", 3),  # touches no token
        ("d", "One two three", "w " * 20, "two", 4),  # too long
        ("e", None, "who?", "two", 4),
    ]
    df = spark.createDataFrame(rows, "key string, context string, question string, answer string, start int")
    got = [tuple(r) for r in tx.answer_spans(df, "key", "context", "question", "answer", "start", 10).select("key", "start_token", "end_token", "n_context", "n_question").collect()]
    assert got == [("a", 1, 2, 4, 2)]
    assert tx.answer_spans(df.limit(0), "key", "context", "question", "answer", "start").count() == 0


def test_model_inputs_drop_longer_rows(spark):
    df = spark.createDataFrame([(1, [5, 6], [1, 7]), (2, [5] * 9, [1, 7])], "k int, c array<int>, q array<int>")
    got = tx.model_inputs(df, "c", "q", 5).collect()
    assert [(r.k, r.input_ids, r.token_type_ids, r.attention_mask) for r in got] == [(1, [5, 6, 7, 0, 0], [0, 0, 1, 0, 0], [1, 1, 1, 0, 0])]


def test_aligned_wants_the_same_keys(spark):
    a, b = spark.range(5).withColumn("a", F.lit(1)), spark.range(5).withColumn("b", F.lit(2))
    assert rw.aligned(a, b, "id").count() == 5
    for other in (b.where("id < 4"), b.union(b.limit(1)), spark.range(6).withColumn("b", F.lit(2))):
        with pytest.raises(ValueError, match="do not match"):
            rw.aligned(a, other, "id")


def test_logistic_model_goes_to_tasks_of_a_session_with_tags(spark):
    own = spark.newSession()
    own.addTag("watched")  # from now on the session can't be sent to a task
    df = own.createDataFrame([(k, k / 10, k % 3 / 3, int(k > 50)) for k in range(100)], "id long, a double, b double, label int")
    model, rows = md.logistic(df, ["a", "b"], "label", c=100.0)
    line = lambda r: model.intercept + model.coefficients[0] * r.a + model.coefficients[1] * r.b
    found = model.transform(rows).collect()
    assert len(found) == 100 and all(r.prediction == (line(r) > 0) for r in found)
    assert sum(r.prediction == r.label for r in found) > 95


@pytest.mark.parametrize("kind", ["linear", "logistic", "softmax"])
def test_hidden_layer_with_momentum_against_a_loop(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2))
    t = np.column_stack([x[:, 0] > 0, x[:, 0] <= 0]).astype(float)
    given = [(k, *map(float, a), *map(float, b)) for k, (a, b) in enumerate(zip(x, t, strict=True))]
    df = spark.createDataFrame([*given, (100, None, 1.0, 0.0, 1.0)], "k long, a double, b double, u double, v double")
    columns = [F.col(c) for c in "abuv"]
    got, errors = md.momentum_layers(df, columns[:2], columns[2:], F.col("k") % 4 == 0, 3, kind, 0.05, 0.9, 4, 3, -math.inf, 7)
    held = np.arange(60) % 4 == 0
    want = md.Layers.start(2, 3, 2, kind, 7)
    loss = lambda m: 0.5 * ((m.forward(x[~held])[1] - t[~held]) ** 2).sum()
    # The steps are those of a loop over one array.
    want_errors, n = [], 1 if kind == "logistic" else int((~held).sum())
    for _ in range(3):
        moves = np.zeros(got.w1.size + got.b1.size + got.w2.size + got.b2.size)
        for _ in range(4):
            moves = 0.9 * moves + 0.05 / n * want.sums(x[~held], t[~held])[:-1]
            at = 0
            for part in want.parts():
                part -= moves[at : at + part.size].reshape(part.shape)
                at += part.size
        want_errors.append(0.5 * ((want.forward(x[held])[1] - t[held]) ** 2).sum())
    for a, b in zip(got.parts(), want.parts(), strict=True):
        assert np.allclose(a, b)
    assert np.allclose(errors, want_errors)
    # Gradients of one output are those of the loss by differences.
    if kind != "softmax":
        flat, at = want.sums(x[~held], t[~held]), 0
        for part in want.parts():
            part.flat[0] += 1e-6
            up = loss(want)
            part.flat[0] -= 2e-6
            assert math.isclose((up - loss(want)) / 2e-6, flat[at], rel_tol=1e-4, abs_tol=1e-6)
            part.flat[0] += 1e-6
            at += part.size
        out = {r.k: r.z for r in df.select("k", got.column(columns[:2], 1).alias("z")).collect()}
        assert np.allclose([out[k] for k in range(60)], got.forward(x)[1][:, 1])


def test_backward_policy_against_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), float(a), float(b), float(r)) for k, a, b, r in zip(rng.integers(0, 4, 200), rng.random(200), rng.random(200), rng.random(200), strict=True)]
    df = spark.createDataFrame([*rows, (None, 0.1, 0.1, 0.1), (2, 0.1, 0.1, None)], "t int, a double, b double, r double")
    got = md.backward_policy(df, "t", F.array(F.lit(1.0), F.col("a"), F.col("b"), F.col("a")), 4, F.col("r"), 0.5)
    least, array = 0.0, np.array(rows)
    assert sorted(got) == [0, 1, 2]
    for t in (2, 1, 0):
        own = array[array[:, 0] == t]
        phi = np.column_stack([np.ones(len(own)), own[:, 1], own[:, 2], own[:, 1]])
        want = np.linalg.pinv(phi) @ (own[:, 3] + 0.5 * least)
        assert np.allclose(got[t], want, atol=1e-8)
        least = (phi @ want).min()
    assert md.backward_policy(df.limit(0), "t", F.array(F.lit(1.0)), 1, F.col("r"), 0.5) == {}


@pytest.mark.parametrize("places", [[0, 1, 2, 4, 5], [0, 1, 1, 2], [1, 2, 3], [0, 1, None], [-1, 0, 1]])
@pytest.mark.parametrize("block", [2, 100])
def test_blocks_refuse_places_that_are_not_dense(spark, places, block):
    df = spark.createDataFrame([(p, 1.0) for p in places], "idx long, v double")
    made = in_blocks(df, "idx", 1, 1, lambda w: {"a": F.lag("v").over(w)}, block)
    with pytest.raises(Exception, match="idx is"):
        made.collect()


def test_line_search_on_the_cubic():
    """f = x**3 - 2 x**2 + 2 from 2: the minimum 4/3 in few steps; then steps worked out by hand."""
    f, g = (lambda x: x**3 - 2 * x**2 + 2), (lambda x: 3 * x**2 - 4 * x)
    path = md.line_search(f, g, 2.0, first=0.25)
    # From 2 the slope is 4, and 1 is lower; from 1 it is -1, and 1.25 is lower.
    assert path[:3] == [2.0, 1.0, 1.25]
    assert len(path) < 12 and math.isclose(path[-1], 4 / 3, abs_tol=1e-4)
    # A step of 1 would pass the minimum of a parabola by as much as it was before it: the half of it is taken.
    assert md.line_search(lambda x: x * x, lambda x: 2 * x, 3.0) == [3.0, 0.0, 0.0]


def test_searched_descent_against_numpy(spark):
    rng = np.random.default_rng(5)
    x, y = rng.random(200), 3 + 2 * rng.random(200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0)], "x double, y double")
    missed = lambda p: p[0] + p[1] * F.col("x") - F.col("y")
    at, path = md.searched_descent(df, lambda p: missed(p) ** 2 / 2, lambda p: (missed(p), missed(p) * F.col("x")), (0.0, 0.0), first=2.0, most=15)
    a = b = 0.0
    loss = lambda a, b: ((a + b * x - y) ** 2).mean() / 2
    for step, value in path:
        e = a + b * x - y
        ga, gb = e.mean(), (e * x).mean()
        t = 2.0
        while loss(a - t * ga, b - t * gb) > loss(a, b) - 1e-4 * t * (ga * ga + gb * gb):
            t /= 2
        a, b = a - t * ga, b - t * gb
        assert t == step and math.isclose(loss(a, b), value, rel_tol=1e-9)
    assert len(path) == 15 and np.allclose(at, [a, b])
    assert md.searched_descent(df.limit(0), missed, lambda p: (missed(p), missed(p)), (7.0, 1.0)) == ([7.0, 1.0], [])
