"""Fits over the tables; rows of coefficients, predictions or scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import boosting as bo
from gridloom.operators import models as md
from gridloom.plans.registry import query
from gridloom.session import delete, shared_dir
from gridloom.sources.tables import table


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select((F.col("l_quantity") / 50).alias("x"), (F.col("l_extendedprice") / 10000).alias("y"), "l_orderkey", "l_linenumber", "l_suppkey")


_LINES_SQL = "(SELECT l_quantity / 50 AS x, l_extendedprice / 10000 AS y, l_orderkey FROM lineitem)"


def solved(system: str) -> str:
    """The solutions (s, i, c) of the systems (s, n, i, j, v), column n being the right side, by elimination."""
    return (
        f"WITH RECURSIVE g(s, n, k, i, j, v) AS (SELECT s, n, 0, i, j, v FROM ({system}) UNION ALL"
        " SELECT a.s, a.n, a.k + 1, a.i, a.j, CASE WHEN a.i = a.k THEN a.v / d.v ELSE a.v - q.v * p.v / d.v END FROM g a"
        " JOIN g p ON p.s = a.s AND p.i = a.k AND p.j = a.j JOIN g q ON q.s = a.s AND q.i = a.i AND q.j = a.k"
        " JOIN g d ON d.s = a.s AND d.i = a.k AND d.j = a.k WHERE a.k < a.n),"
        " solved AS (SELECT s, i, v AS c FROM g WHERE k = n AND j = n)"
    )


def _moments_sql(source: str, systems: str, ridge: str) -> str:
    """Normal equations of polynomials: ``systems`` (s, n) gives the number of coefficients of each."""
    return (
        f"SELECT s, n, i, j, sum(CASE WHEN j = n THEN x ** i * y ELSE x ** (i + j) END) + CASE WHEN i = j THEN {ridge} ELSE 0 END AS v FROM {source}, {systems},"
        " (SELECT unnest(range(9)) AS i), (SELECT unnest(range(9)) AS j) WHERE i < n AND j <= n GROUP BY s, n, i, j"
    )


@query(
    solved(_moments_sql(_LINES_SQL, "(SELECT unnest([0, 1]) AS s, 4 AS n)", "s / 10.0"))
    + " SELECT s / 10.0::DOUBLE AS ridge, i::INTEGER AS power, round(c, 6) AS coefficient FROM solved"
)
def ridge_fit(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf)
    fits = [(r, k, float(c)) for r in (0.0, 0.1) for k, c in enumerate(md.fit_polynomial(rows, F.col("x"), F.col("y"), 3, r))]
    return spark.createDataFrame(fits, "ridge double, power int, coefficient double").withColumn("coefficient", F.round("coefficient", 6))


@query(
    solved(
        _moments_sql(
            "(SELECT *, l_orderkey % 2 AS t FROM (SELECT l_quantity / 50 AS x, l_extendedprice / 10000 AS y, l_orderkey FROM lineitem))",
            "(SELECT 10 * t0 + d AS s, t0, d + 1 AS n FROM (SELECT unnest([0, 1]) AS t0), (SELECT unnest([1, 2, 3]) AS d))",
            "0",
        ).replace("WHERE i < n", "WHERE t = t0 AND i < n")
    )
    + f", e AS (SELECT s, t, any_value(y) AS y, sum(c * x ** i) AS p FROM (SELECT *, l_orderkey % 2 AS t, row_number() OVER () AS r FROM {_LINES_SQL}) JOIN solved ON t <> s // 10 GROUP BY s, t, r)"
    " SELECT degree, round(avg(error), 6) AS error FROM (SELECT (s % 10)::INTEGER AS degree, s, avg((y - p) ** 2) AS error FROM e GROUP BY s) GROUP BY degree"
)
def error_curve(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf)
    out = md.error_curve(rows, F.col("x"), F.col("y"), F.col("l_orderkey") % 2, 2, [1, 2, 3])
    return spark.createDataFrame(out, "degree int, error double").withColumn("error", F.round("error", 6))


@query()
def batch_descent(spark: SparkSession, sf: str) -> DataFrame:
    a, b, steps = md.batch_descent(_lines(spark, sf), F.col("x"), F.col("y"), 0.5, 1e-9)
    return spark.createDataFrame([(float(a), float(b), steps)], "constant double, slope double, steps long")


@query(
    f"WITH RECURSIVE l AS (SELECT x AS u, y AS v FROM {_LINES_SQL}), m AS (SELECT count(*)::DOUBLE AS n, sum(u) AS su, sum(v) AS sv, sum(u * u) AS suu, sum(u * v) AS suv, sum(v * v) AS svv FROM l),"
    " t AS (SELECT 0 AS k, 1.0::DOUBLE AS a, 1.0::DOUBLE AS b, 0.0::DOUBLE AS step UNION ALL SELECT k + 1, a - s * ga, b - s * gb, s FROM"
    " (SELECT k, a, b, ga, gb, list_filter(list_transform(range(24), lambda j: 4.0::DOUBLE * 0.5::DOUBLE ** j),"
    "   lambda s: ((n * (a - s * ga) ** 2 + suu * (b - s * gb) ** 2 + svv) / 2 + su * (a - s * ga) * (b - s * gb) - sv * (a - s * ga) - suv * (b - s * gb)) / n"
    "   <= ((n * a ** 2 + suu * b ** 2 + svv) / 2 + su * a * b - sv * a - suv * b) / n - 0.0001::DOUBLE * s * (ga ** 2 + gb ** 2))[1] AS s"
    "  FROM (SELECT k, a, b, m.*, (n * a + su * b - sv) / n AS ga, (su * a + suu * b - suv) / n AS gb FROM t, m WHERE k < 6)) WHERE s IS NOT NULL)"
    " SELECT k AS turn, round(step, 6) AS step, round(((n * a ** 2 + suu * b ** 2 + svv) / 2 + su * a * b - sv * a - suv * b) / n, 6) AS loss FROM t, m WHERE k > 0"
)
def searched_descent(spark: SparkSession, sf: str) -> DataFrame:
    """Six turns of a line's descent, the step of each found by a backtracking search over the items."""
    u, v = F.col("x"), F.col("y")
    missed = lambda p: p[0] + p[1] * u - v
    _, path = md.searched_descent(_lines(spark, sf), lambda p: missed(p) ** 2 / 2, lambda p: (missed(p), missed(p) * u), (1.0, 1.0), first=4.0, most=6)
    return spark.createDataFrame([(k + 1, round(t, 6), round(loss, 6)) for k, (t, loss) in enumerate(path)], "turn int, step double, loss double")


@query(
    "WITH RECURSIVE l AS (SELECT l_suppkey, l_quantity / 50 AS u, l_extendedprice / 10000 AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity / 50, l_extendedprice / 10000) AS k FROM lineitem),"
    " t AS (SELECT l_suppkey, 0::BIGINT AS k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM l WHERE k = 1 UNION ALL"
    " SELECT t.l_suppkey, l.k, a - 0.1::DOUBLE * (a + b * u - v), b - 0.1::DOUBLE * u * (a + b * u - v), c + (a + b * u - v) ** 2 / 2 FROM t JOIN l ON l.l_suppkey = t.l_suppkey AND l.k = t.k + 1)"
    " SELECT l_suppkey, round(a, 6) AS a, round(b, 6) AS b, round(c / k, 6) AS cost FROM t QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY k DESC) = 1"
)
def stochastic_descent(spark: SparkSession, sf: str) -> DataFrame:
    """A line for each supplier, row by row in the order of its items."""
    found = md.stochastic_descent(_lines(spark, sf), "l_suppkey", ["l_orderkey", "l_linenumber", "x", "y"], "x", "y", 0.1)
    return found.select("l_suppkey", *[F.round(c, 6).alias(c) for c in ("a", "b", "cost")])


@query()
def boosted_1d(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    trees = md.boost(rows, F.col("x"), F.col("y"), 3, 2)
    return rows.select("p_partkey", "x", "y", md.boosted(trees, F.col("x")).alias("predicted"))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", (F.log1p("n_chars") / 10).alias("a"), (F.size(F.split("text", "[#$%&*|!]")) / F.greatest("n_chars", F.lit(1))).alias("b"))
    return docs.join(table(spark, sf, "labels"), "doc_id")


@query()
def logistic_quality(spark: SparkSession, sf: str) -> DataFrame:
    model, rows = md.logistic(_features(spark, sf), ["a", "b"], "quality")
    return model.transform(rows).select("doc_id", "quality", F.col("prediction").cast("int").alias("predicted"))


@query()
def boosted_quality(spark: SparkSession, sf: str) -> DataFrame:
    model, rows = md.boosted_classifier(_features(spark, sf), ["a", "b"], "quality", 3, 0.75, 5)
    return model.transform(rows).select("doc_id", "quality", F.col("prediction").cast("int").alias("predicted"))


def _text_features(spark: SparkSession, sf: str) -> DataFrame:
    """Eight statistics of each labelled document's text."""
    t, n = F.col("text"), F.greatest(F.char_length("text"), F.lit(1))
    words = F.split(F.trim("text"), r"\s+")
    share = lambda pattern: F.regexp_count(t, F.lit(pattern)) / n
    docs = table(spark, sf, "documents").select(
        "doc_id", n.cast("double").alias("chars"), F.size(words).cast("double").alias("words"), (n / F.size(words)).alias("word_chars"), share("[#$%&*|<>]").alias("signs"), share("[0-9]").alias("digits"),
        share("[A-Z]").alias("capitals"), share("\n").alias("lines"), (F.size(F.array_distinct(words)) / F.size(words)).alias("distinct"),
    )
    return docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query()
def boosted_trees_quality(spark: SparkSession, sf: str) -> DataFrame:
    """The quality of labelled documents by trees on eight statistics of their texts, fitted on those whose id five does not divide."""
    rows = _text_features(spark, sf)
    fit = bo.boost(rows.where("doc_id % 5 <> 0"), [c for c in rows.columns if c not in ("doc_id", "quality")], "quality", rounds=5, depth=4)
    chance = F.round(fit.probability(), 6)
    return rows.select("doc_id", (F.col("doc_id") % 5 == 0).alias("held_out"), "quality", chance.alias("probability"), (chance >= 0.5).cast("int").alias("predicted"))


@query()
def hidden_layer_quality(spark: SparkSession, sf: str) -> DataFrame:
    model, rows = md.hidden_layer(_features(spark, sf), ["a", "b"], "quality", 4)
    return model.transform(rows).select("doc_id", "quality", F.col("prediction").cast("int").alias("predicted"))


@query()
def perceptron_quality(spark: SparkSession, sf: str) -> DataFrame:
    rows = _features(spark, sf)
    w = md.perceptron(rows, [F.col("a"), F.col("b") * 10], F.col("quality"), epochs=10)
    fires = F.lit(w[0]) * F.col("a") + F.lit(w[1]) * F.col("b") * 10 - F.lit(w[2]) > 0
    return rows.select("doc_id", "quality", fires.cast("int").alias("predicted"))


@query(
    solved(
        "SELECT 0 AS s, 3 AS n, i, j, sum(CASE WHEN j = 3 THEN x ** i * y ELSE x ** (i + j) END) + CASE WHEN i = j THEN 1e-9 ELSE 0 END AS v"
        f" FROM {_LINES_SQL}, (SELECT unnest(range(3)) AS i), (SELECT unnest(range(4)) AS j) GROUP BY i, j"
    )
    + " SELECT i::INTEGER AS feature, round(c, 6) AS weight FROM solved"
)
def least_squares_policy(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf)
    w = md.least_squares_policy(rows, "l_orderkey", F.array(F.lit(1.0), F.col("x"), F.col("x") ** 2), 3, F.col("y"))
    return spark.createDataFrame([(k, round(float(c), 6)) for k, c in enumerate(w)], "feature int, weight double")


@query(
    "WITH RECURSIVE b AS (SELECT row_number() OVER (ORDER BY batch) AS k, mx, my, mxx, mxy FROM (SELECT l_orderkey // 250 AS batch, avg(x) AS mx, avg(y) AS my, avg(x * x) AS mxx, avg(x * y) AS mxy"
    f" FROM {_LINES_SQL} GROUP BY batch)), w(k, a, b) AS (SELECT 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT w.k + 1, a - 0.6 * (a + b * mx - my), b - 0.6 * (a * mx + b * mxx - mxy)"
    " FROM w JOIN b ON b.k = w.k + 1) SELECT round(arg_max(a, k), 6) AS a, round(arg_max(b, k), 6) AS b, max(k) AS batches FROM w"
)
def mini_batches(spark: SparkSession, sf: str) -> DataFrame:
    """A line by descent over batches of 250 orders, one epoch."""
    fit = md.mini_batch_descent(_lines(spark, sf), F.floor(F.col("l_orderkey") / 250), F.col("x"), F.col("y"), 0.3)
    return fit.select(F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), "batches")


@query("SELECT p_partkey, round(a + s * p_size, 6) AS predicted FROM part, (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS s FROM (SELECT p_size AS x, p_retailprice AS y FROM part))")
def kept_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of a line whose coefficients were written and read back."""
    parts, path = table(spark, sf, "part"), shared_dir(spark)
    md.save_fit(spark, md.fit_polynomial(parts, F.col("p_size"), F.col("p_retailprice"), 1), path)
    a, b = md.load_fit(spark, path)
    delete(spark, path)
    return parts.select("p_partkey", F.round(F.lit(a) + F.lit(b) * F.col("p_size"), 6).alias("predicted"))


@query()
def momentum_quality(spark: SparkSession, sf: str) -> DataFrame:
    """A hidden layer with momentum, stopped early by a fifth of the documents."""
    rows = _features(spark, sf)
    inputs = [F.col("a"), F.col("b") * 10]
    layers, _ = md.momentum_layers(rows, inputs, [F.col("quality")], F.col("doc_id") % 5 == 0, 3, "linear", 0.1, most_rounds=5)
    return rows.select("doc_id", "quality", (layers.column(inputs) >= 0.5).cast("int").alias("predicted"))


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("x"), (F.col("l_discount") * 10).alias("a"), (F.col("l_extendedprice") / 1e5).alias("cost"))


@query(
    "WITH RECURSIVE q AS (SELECT l_linenumber AS t, l_quantity / 50 AS x, l_extendedprice / 100000 AS r FROM lineitem),"
    " f AS (SELECT t, regr_slope(r, x) AS s, regr_intercept(r, x) AS c, min(x) AS lo, max(x) AS hi FROM q GROUP BY t),"
    " w(t, c, s, least) AS (SELECT max(t)::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM f UNION ALL"
    " SELECT f.t, f.c + 0.1 * least, f.s, f.c + 0.1 * least + least(f.s * lo, f.s * hi) FROM w JOIN f ON f.t = w.t - 1)"
    " SELECT t AS step, round(c, 6) AS constant, round(s, 6) AS slope FROM w WHERE t < (SELECT max(t) FROM f)"
)
def policy_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Values of the lines of an order by backward induction, the line's number being the step."""
    found = md.backward_policy(_orders(spark, sf), "l_linenumber", F.array(F.lit(1.0), F.col("x")), 2, F.col("cost"), 0.1)
    return spark.createDataFrame([(t, round(w[0], 6), round(w[1], 6)) for t, w in found.items()], "step long, constant double, slope double")


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity / 50 < 0.25 THEN 0.0 WHEN l_quantity / 50 <= 0.75 THEN 0.5 ELSE 1.0 END::DOUBLE AS action FROM lineitem"
)
def best_actions(spark: SparkSession, sf: str) -> DataFrame:
    """The action of 0, 1/2 and 1 that is nearest to each line's quantity, by the least squared distance."""
    rows = _orders(spark, sf)
    action = md.best_action(lambda a: (F.col("x") - a) ** 2, [0.5, 0.0, 1.0])
    return rows.select("l_orderkey", "l_linenumber", action.alias("action"))
