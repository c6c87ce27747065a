"""Small models: fits from one aggregation, and loops over such aggregations.

What leaves the executors is a row of sums whose size depends on the model, not
on the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators.aggregates import moments
from gridloom.operators.blocks import in_key_order
from gridloom.session import delete, shared_dir, stored


def fit_polynomial(df: DataFrame, x: Column, y: Column, degree: int, ridge: float = 0.0) -> list[float]:
    """Least squares with a ridge on all coefficients, the constant included."""
    m = moments(df, x, y, degree).first()
    power = lambda p: m["n"] if p == 0 else m[f"x{p}"]
    a = np.array([[power(i + j) for j in range(degree + 1)] for i in range(degree + 1)], dtype=float)
    return np.linalg.solve(a + ridge * np.eye(degree + 1), np.array([m[f"x{p}y"] for p in range(degree + 1)], dtype=float)).tolist()


def mean_squared_error(y: Column, p: Column) -> Column:
    return F.avg((y - p) ** 2)


def error_curve(df: DataFrame, x: Column, y: Column, trial: Column, trials: int, degrees: Sequence[int], ridge: float = 0.0) -> list[tuple[int, float]]:
    """(degree, mean error on the other trials' rows): each trial fits on its own rows.

    Two scans: the moments of each trial up to the largest degree give all fits,
    then one row has all errors.
    """
    top = max(degrees)
    rows = df.select(trial.alias("_t"), x.alias("_x"), y.alias("_y")).where(F.col("_t").between(0, trials - 1))
    powers = [F.sum(F.col("_x") ** p).alias(f"x{p}") for p in range(2 * top + 1)]
    powers += [F.sum(F.col("_x") ** p * F.col("_y")).alias(f"x{p}y") for p in range(top + 1)]
    fits: dict[tuple[int, int], list[float]] = {}
    for m in rows.groupBy("_t").agg(*powers).collect():
        for k in degrees:
            a = np.array([[m[f"x{i + j}"] for j in range(k + 1)] for i in range(k + 1)], dtype=float)
            b = np.array([m[f"x{p}y"] for p in range(k + 1)], dtype=float)
            fits[m["_t"], k] = np.linalg.solve(a + ridge * np.eye(k + 1), b).tolist()
    missed = [
        mean_squared_error(F.when(F.col("_t") != t, F.col("_y")), sum((F.lit(v) * F.col("_x") ** i for i, v in enumerate(c)), F.lit(0.0))).alias(f"e{t}_{k}")
        for (t, k), c in fits.items()
    ]
    got = rows.agg(*missed).first() if missed else {}
    return [(k, float(np.mean([got[f"e{t}_{d}"] for t, d in fits if d == k]))) for k in degrees if missed]


def descend(gradient: Callable[[float], float], x: float, rate: float = 0.1, tolerance: float = 1e-4, decay: float = 0.0, most: int = 10_000) -> list[float]:
    """Points of a one-dimensional descent; with ``decay`` step k divides the rate by 1 + k * decay."""
    path = [x]
    for k in range(most):
        new = x - rate * gradient(x)
        path.append(new)
        rate /= 1 + k * decay
        if abs(new - x) <= tolerance:
            break
        x = new
    return path


#: Step sizes of a search: from the first downwards, each a share of the one before.
STEP_SIZES, STEP_SHARE = 24, 0.5
#: Armijo's share of the decrease that the slope promises.
DECREASE = 1e-4


def line_search(f: Callable[[float], float], gradient: Callable[[float], float], x: float, first: float = 1.0, tolerance: float = 1e-4, most: int = 1_000) -> list[float]:
    """Points of a one-dimensional descent that each time takes the largest step of a backtracking search.

    A step t is good where f(x - t g) <= f(x) - DECREASE * t * g**2. It ends
    where a step moves by ``tolerance`` at most, or none is good.
    """
    path = [x]
    for _ in range(most):
        g = gradient(x)
        good = [t for t in (first * STEP_SHARE**k for k in range(STEP_SIZES)) if f(x - t * g) <= f(x) - DECREASE * t * g * g]
        if not good:
            break
        new = x - good[0] * g
        path.append(new)
        if abs(new - x) <= tolerance:
            break
        x = new
    return path


def searched_descent(
    df: DataFrame, loss: Callable[[Sequence[Column]], Column], slope: Callable[[Sequence[Column]], Sequence[Column]], start: Sequence[float], first: float = 1.0, tolerance: float = 1e-6, most: int = 100
) -> tuple[list[float], list[tuple[float, float]]]:
    """(parameters, (step, loss) of each turn): descent on the mean of ``loss`` with a backtracking line search.

    ``loss`` and ``slope`` take parameters as columns and give a row's loss and
    its derivatives. A turn is two aggregations: the mean slope and loss, then
    the mean losses of all candidate steps together, of which the largest good
    one is taken (see ``line_search``). It ends where the slope's norm is
    ``tolerance`` at most or no step is good. Rows whose loss is null are left
    out; without rows the start comes back.
    """
    at, path = list(map(float, start)), []
    for _ in range(most):
        here = [F.lit(v) for v in at]
        now = df.agg(F.avg(loss(here)).alias("loss"), *[F.avg(s).alias(f"s{k}") for k, s in enumerate(slope(here))]).first()
        if now["loss"] is None:
            break
        g = [now[f"s{k}"] for k in range(len(at))]
        norm = math.fsum(v * v for v in g)
        if math.sqrt(norm) <= tolerance:
            break
        steps = [first * STEP_SHARE**k for k in range(STEP_SIZES)]
        there = [[v - t * d for v, d in zip(at, g, strict=True)] for t in steps]
        tried = df.agg(*[F.avg(loss([F.lit(v) for v in p])).alias(f"t{k}") for k, p in enumerate(there)]).first()
        good = [k for k, t in enumerate(steps) if tried[k] <= now["loss"] - DECREASE * t * norm]
        if not good:
            break
        at = there[good[0]]
        path.append((steps[good[0]], tried[good[0]]))
    return at, path


def batch_descent(df: DataFrame, x: Column, y: Column, rate: float, tolerance: float, start: tuple[float, float] = (1.0, 1.0), most: int = 1_000_000) -> tuple[float, float, int]:
    """(constant, slope, steps) of mean-gradient descent on y = a + b x, from one row of sums."""
    n, sx, sy, sxx, sxy = df.agg(F.count("*"), F.sum(x), F.sum(y), F.sum(x * x), F.sum(x * y)).first()
    if not n:
        return (*start, 0)
    a, b = start
    for k in range(most):
        ga, gb = (n * a + sx * b - sy) / n, (sx * a + sxx * b - sxy) / n
        if (ga * ga + gb * gb) ** 0.5 <= tolerance:
            return a, b, k
        a, b = a - rate * ga, b - rate * gb
    return a, b, most


def stochastic_descent(df: DataFrame, key: str, order: Sequence[str], x: str, y: str, rate: float, epochs: int = 1) -> DataFrame:
    """(key, a, b, cost) of row-by-row descent, a sequence of its own for each key.

    A row's error is linear in (a, b, 1) before it, so ordered rows compose to an
    affine map of (a, b) and a quadratic form for the cost. Each range of ordered
    rows gives one of them for each of its keys, and a key's few are applied in
    order, once an epoch.
    """
    key_type = df.schema[key].dataType.simpleString()
    forms = [f"m{k}" for k in range(12)]

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        made: list[list] = []
        held: list | None = None  # the key and place, rows, the linear forms of a and b, and the cost's six terms
        types = None

        def out() -> pa.RecordBatch:
            columns = [pa.array([r[0] for r in made], types)]
            columns += [pa.array([r[k] for r in made], t) for k, t in ((1, pa.int64()), (2, pa.int64()))]
            columns += [pa.array([r[k] for r in made], pa.float64()) for k in range(3, 15)]
            made.clear()
            return pa.RecordBatch.from_arrays(columns, [key, "place", "n", *forms])

        for batch in batches:
            types = batch.schema.field(0).type
            for name, u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                u, v = (math.nan if z is None else z for z in (u, v))
                if held is None or not (held[0] == name or (name != name and held[0] != held[0])):
                    if held is not None:
                        made.append(held)
                    held = [name, place, 0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
                _, _, n, a0, a1, a2, b0, b1, b2, q00, q01, q02, q11, q12, q22 = held
                e0, e1, e2 = a0 + u * b0, a1 + u * b1, a2 + u * b2 - v
                s, t = rate, rate * u
                held[2:] = [
                    n + 1, a0 - s * e0, a1 - s * e1, a2 - s * e2, b0 - t * e0, b1 - t * e1, b2 - t * e2,
                    q00 + e0 * e0, q01 + e0 * e1, q02 + e0 * e2, q11 + e1 * e1, q12 + e1 * e2, q22 + e2 * e2,
                ]
            if len(made) >= 1_000:
                yield out()
        if held is not None:
            made.append(held)
            yield out()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        rows = pdf[forms].to_numpy()
        a = b = cost = 0.0
        for _ in range(epochs):
            cost = 0.0
            for a0, a1, a2, b0, b1, b2, q00, q01, q02, q11, q12, q22 in rows:
                cost += (q00 * a * a + q11 * b * b + q22) / 2 + q01 * a * b + q02 * a + q12 * b
                a, b = a0 * a + a1 * b + a2, b0 * a + b1 * b + b2
        n = int(pdf["n"].sum())
        return pd.DataFrame({key: [pdf[key].iloc[0]], "a": [a], "b": [b], "cost": [max(cost, 0.0) / max(1, n) if cost == cost else cost]})

    # Rows without a place come last.
    places = {f"_o{2 * k + j}": c for k, o in enumerate(order) for j, c in enumerate((F.col(o).isNull(), F.col(o)))}
    rows = df.select(key, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), *[c.alias(k) for k, c in places.items()])
    ordered = in_key_order(rows, key, list(places)).sortWithinPartitions(key, *places).select(key, "_x", "_y")
    schema = f"{key} {key_type}, place long, n long, " + ", ".join(f"{m} double" for m in forms)
    return ordered.mapInArrow(compose, schema).groupBy(key).applyInPandas(fold, f"{key} {key_type}, a double, b double, cost double")


def mini_batch_descent(df: DataFrame, batch: Column, x: Column, y: Column, rate: float, epochs: int = 1, start: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(a, b, batches): y = a + b x by descent on each batch's mean squared error, batches in ascending order.

    A batch's step is an affine map of (a, b) that its sums give, and maps in a
    row compose to one. A thousand at a time are composed on the executors until
    one is left for an epoch, so no task and no driver goes through all batches.
    """
    sums = df.select(batch.alias("_at"), x.cast("double").alias("_x"), y.cast("double").alias("_y")).where("_at IS NOT NULL AND _x IS NOT NULL AND _y IS NOT NULL")
    n, mean = F.count("*"), lambda c: F.avg(c)
    step = [
        F.lit(1.0 - 2 * rate), -2 * rate * mean(F.col("_x")), 2 * rate * mean(F.col("_y")),
        -2 * rate * mean(F.col("_x")), 1.0 - 2 * rate * mean(F.col("_x") ** 2), 2 * rate * mean(F.col("_x") * F.col("_y")),
    ]
    maps = sums.groupBy("_at").agg(F.array(*step).alias("m"), n.alias("n"), F.lit(1).cast("long").alias("batches"))

    def composed(first: Column, then: Column) -> Column:
        f, t = (lambda k: F.element_at(first, k + 1)), (lambda k: F.element_at(then, k + 1))
        row = lambda r: [t(r) * f(k) + t(r + 1) * f(3 + k) + (t(r + 2) if k == 2 else F.lit(0.0)) for k in range(3)]
        return F.array(*row(0), *row(3))

    one = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)])
    place = in_key_order(maps.withColumn("_one", F.lit(0)), "_one", ["_at"]).select("_at", "m", "batches", F.spark_partition_id().alias("_part"))
    # Rows of a range follow one another, so parts of a range do too, whatever their number.
    kept, path = stored(place)
    ranked = kept.withColumn("_k", F.floor((F.row_number().over(Window.partitionBy("_part").orderBy("_at")) - 1) / 1000))
    while True:
        ordered = F.array_sort(F.collect_list(F.struct("_at", "m")))
        ranked = ranked.groupBy("_part", "_k").agg(
            F.min("_at").alias("_at"), F.aggregate(F.transform(ordered, lambda z: z["m"]), one, composed).alias("m"), F.sum("batches").alias("batches")
        )
        many = ranked.agg(F.count("*")).first()[0]
        if many <= 1:
            break
        # Few are left: a thousand batches each, numbered in one order.
        ranked = ranked.select("_at", "m", "batches", F.lit(0).alias("_part"), F.floor((F.row_number().over(Window.orderBy("_at")) - 1) / 1000).alias("_k"))
    got = ranked.select("m", "batches").first()
    delete(df.sparkSession, path)
    a, b = start
    for _ in range(epochs if got else 0):
        a, b = got.m[0] * a + got.m[1] * b + got.m[2], got.m[3] * a + got.m[4] * b + got.m[5]
    return df.sparkSession.range(1).select(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(got.batches if got else 0).cast("long").alias("batches"))


def save_fit(spark: SparkSession, coefficients: Sequence[float], path: str) -> None:
    """A polynomial's coefficients as a Parquet table (power, coefficient)."""
    rows = [(k, float(c)) for k, c in enumerate(coefficients)]
    spark.createDataFrame(rows, "power int, coefficient double").coalesce(1).write.mode("overwrite").parquet(path)


def load_fit(spark: SparkSession, path: str) -> list[float]:
    rows = spark.read.schema("power int, coefficient double").parquet(path).collect()
    return [r.coefficient for r in sorted(rows)]


def gradient_loop(df: DataFrame, gradient: Callable[[list[float]], list[Column]], start: list[float], rate: float, steps: int) -> list[float]:
    """Descent with one aggregation a step: the mean of each gradient column."""
    w = list(start)
    for _ in range(steps):
        g = df.agg(*[F.avg(c) for c in gradient(w)]).first()
        w = [a - rate * b for a, b in zip(w, g, strict=True)]
    return w


def perceptron(df: DataFrame, features: Sequence[Column], target: Column, rate: float = 0.25, epochs: int = 20) -> list[float]:
    """Weights, the bias input -1 last, by batch updates under the step activation.

    Features are made and written once; every epoch reads them again.
    """
    names = [f"f{k}" for k in range(len(features))]
    rows, path = stored(df.select(*[f.cast("double").alias(k) for f, k in zip(features, names, strict=True)], target.alias("target")))
    inputs = [*map(F.col, names), F.lit(-1.0)]

    def gradient(w: list[float]) -> list[Column]:
        fires = sum((F.lit(a) * x for a, x in zip(w, inputs, strict=True)), F.lit(0.0)) > 0
        error = fires.cast("int") - F.col("target")
        return [error * x for x in inputs]

    w = gradient_loop(rows, gradient, [0.0] * len(inputs), rate, epochs)
    delete(df.sparkSession, path)
    return w


@dataclass
class Stump:
    """A tree over one variable: x < split goes left; a leaf has a value."""

    value: float = 0.0
    split: float | None = None
    left: Stump | None = None
    right: Stump | None = None

    def column(self, x: Column) -> Column:
        if self.split is None or self.left is None or self.right is None:
            return F.lit(self.value)
        return F.when(x < self.split, self.left.column(x)).otherwise(self.right.column(x))


def _grow(sums: pd.DataFrame, depth: int) -> Stump:
    g, h = sums["g"].sum(), sums["h"].sum()
    leaf = Stump(value=float(-g / h) if h else 0.0)
    if depth == 0 or len(sums) < 2:
        return leaf
    gl, hl = sums["g"].cumsum().to_numpy()[:-1], sums["h"].cumsum().to_numpy()[:-1]
    gain = gl**2 / hl + (g - gl) ** 2 / (h - hl) - g**2 / h
    best = len(gain) - 1 - int(np.argmax(gain[::-1]))  # of equal gains the larger split
    if gain[best] <= 1e-15:
        return leaf
    x = sums["x"].to_numpy()
    return Stump(leaf.value, float((x[best] + x[best + 1]) / 2), _grow(sums.iloc[: best + 1], depth - 1), _grow(sums.iloc[best + 1 :], depth - 1))


def boost(df: DataFrame, x: Column, y: Column, rounds: int = 3, depth: int = 2, bins: int = 256) -> list[Stump]:
    """Trees over one variable for squared loss, without shrinkage.

    Each round sums gradients in ``bins`` quantile bins of x (its own values, if
    there are no more), so the driver gets a row a bin.
    """
    rows = df.select(x.cast("double").alias("x"), y.cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    cuts = rows.agg(F.percentile_approx("x", [k / bins for k in range(1, bins)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    binned, path = stored(rows.withColumn("bin", F.least(*[F.when(F.col("x") <= c, k).otherwise(len(cuts)) for k, c in enumerate(cuts)], F.lit(len(cuts))) if cuts else F.lit(0)))
    trees: list[Stump] = []
    for _ in range(rounds):
        predicted = sum((t.column(F.col("x")) for t in trees), F.lit(0.0))
        g = F.sum(predicted - F.col("y"))
        sums = binned.groupBy("bin").agg(F.max("x").alias("x"), F.min("x").alias("low"), g.alias("g"), F.count("*").cast("double").alias("h")).toPandas()
        sums = sums.sort_values("bin").reset_index(drop=True)
        if sums.empty:
            break
        trees.append(_grow(sums, depth))
    delete(df.sparkSession, path)
    return trees


def boosted(trees: list[Stump], x: Column) -> Column:
    return sum((t.column(x) for t in trees), F.lit(0.0))


def logistic(df: DataFrame, features: Sequence[str], label: str, c: float = 1.0, tolerance: float = 1e-4, most: int = 2000):
    """Ridge-penalised logistic regression: penalty 1 / (c n), features as they are.

    The model comes back written and read: as it was fitted it holds a summary
    with the session, which can't be sent to tasks once the session has job tags.
    """
    from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(df)
    fit = LogisticRegression(
        labelCol=label, regParam=1.0 / (c * max(1, df.count())), elasticNetParam=0.0, standardization=False, tol=tolerance, maxIter=most
    )
    path = shared_dir(df.sparkSession)
    fit.fit(rows).save(path)
    model = LogisticRegressionModel.load(path)
    delete(df.sparkSession, path)
    return model, rows


def boosted_classifier(df: DataFrame, features: Sequence[str], label: str, depth: int = 6, rate: float = 0.75, rounds: int = 20):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(df)
    return GBTClassifier(labelCol=label, maxDepth=depth, stepSize=rate, maxIter=rounds, seed=1).fit(rows), rows


def hidden_layer(df: DataFrame, features: Sequence[str], label: str, hidden: int = 8, classes: int = 2):
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(df)
    return MultilayerPerceptronClassifier(labelCol=label, layers=[len(features), hidden, classes], seed=1).fit(rows), rows


@dataclass
class Layers:
    """A network of one hidden layer: weights and biases into it and out of it."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    kind: str = "logistic"

    @classmethod
    def start(cls, inputs: int, hidden: int, outputs: int, kind: str, seed: int) -> Layers:
        """Uniform weights within 1 / sqrt(inputs) of 0, and the biases alike."""
        rng = np.random.default_rng(seed)
        draw = lambda fan, *shape: rng.uniform(-1, 1, shape) / math.sqrt(fan)
        return cls(draw(inputs, inputs, hidden), draw(inputs, hidden), draw(hidden, hidden, outputs), draw(hidden, outputs), kind)

    def parts(self) -> list[np.ndarray]:
        return [self.w1, self.b1, self.w2, self.b2]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hidden values and the outputs of rows ``x``."""
        squash = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        hidden = squash(x @ self.w1 + self.b1)
        z = hidden @ self.w2 + self.b2
        if self.kind == "linear":
            return hidden, z
        if self.kind == "logistic":
            return hidden, squash(z)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return hidden, e / e.sum(axis=1, keepdims=True)

    def sums(self, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The gradients of all parts, flat, summed over the rows; then half the squared error."""
        hidden, out = self.forward(x)
        miss = out - t
        at_out = miss if self.kind == "linear" else miss * out * (1 - out)
        at_hidden = (at_out @ self.w2.T) * hidden * (1 - hidden)
        flat = [x.T @ at_hidden, at_hidden.sum(axis=0), hidden.T @ at_out, at_out.sum(axis=0), np.array([(miss**2).sum() / 2])]
        return np.concatenate([p.ravel() for p in flat])

    def column(self, features: Sequence[Column], output: int = 0) -> Column:
        """One output as a column expression; of softmax layers the score before it is normalised."""
        line = lambda w, b, given: sum((F.lit(float(v)) * c for v, c in zip(w, given, strict=True)), F.lit(float(b)))
        squash = lambda z: 1 / (1 + F.exp(-z))
        hidden = [squash(line(self.w1[:, k], self.b1[k], features)) for k in range(len(self.b1))]
        z = line(self.w2[:, output], self.b2[output], hidden)
        return squash(z) if self.kind == "logistic" else z


def _summed(rows: DataFrame, layers: Layers) -> np.ndarray:
    """``layers.sums`` over all rows (x, t): a task sums its own, so a row for each part and number is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                made = layers.sums(np.stack(pdf["x"].to_list()), np.stack(pdf["t"].to_list()))
                total = made if total is None else total + made
        if total is not None:
            yield pd.DataFrame({"place": np.arange(len(total)), "total": total})

    found = rows.mapInPandas(run, "place int, total double").groupBy("place").agg(F.sum("total").alias("total")).collect()
    out = np.zeros(sum(p.size for p in layers.parts()) + 1)
    for r in found:
        out[r.place] = r.total
    return out


def momentum_layers(
    df: DataFrame,
    features: Sequence[Column],
    targets: Sequence[Column],
    validate: Column,
    hidden: int = 4,
    kind: str = "logistic",
    rate: float = 0.25,
    momentum: float = 0.9,
    steps: int = 10,
    most_rounds: int = 20,
    tolerance: float = 1e-3,
    seed: int = 0,
) -> tuple[Layers, list[float]]:
    """A hidden layer fitted by descent with momentum, and the validation error after each round.

    A round is ``steps`` steps from rest; rounds go on until two in a row lower
    half the squared error of the rows that ``validate`` picks by no more than
    ``tolerance``. Logistic outputs descend on the sum over the rows, linear and
    softmax ones on the mean. Rows with a null are left out. A step is one job
    over rows written once, and the driver holds the weights alone.
    """
    given = df.select(F.array(*[f.cast("double") for f in features]).alias("x"), F.array(*[t.cast("double") for t in targets]).alias("t"), validate.alias("held"))
    whole = ~F.exists("x", lambda v: v.isNull()) & ~F.exists("t", lambda v: v.isNull()) & F.col("held").isNotNull()
    rows, path = stored(given.where(whole))
    train, held = rows.where(~F.col("held")).select("x", "t"), rows.where("held").select("x", "t")
    n = 1 if kind == "logistic" else max(1, train.count())
    layers = Layers.start(len(features), hidden, len(targets), kind, seed)
    errors: list[float] = []
    small = 0
    while small < 2 and len(errors) < most_rounds:
        moves = [np.zeros_like(p) for p in layers.parts()]
        for _ in range(steps):
            flat, at = _summed(train, layers), 0
            for part, move in zip(layers.parts(), moves, strict=True):
                move *= momentum
                move += rate / n * flat[at : at + part.size].reshape(part.shape)
                part -= move
                at += part.size
        errors.append(float(_summed(held, layers)[-1]))
        small = small + 1 if len(errors) > 1 and errors[-2] - errors[-1] <= tolerance else 0
    delete(df.sparkSession, path)
    return layers, errors


def monte_carlo_pi(df: DataFrame, key: str) -> DataFrame:
    """4 * share of points within the quarter circle, a point for each row."""
    from gridloom.functions.scalars import uniform

    x, y = uniform(F.col(key), "x"), uniform(F.col(key), "y")
    return df.agg((4.0 * F.count_if(x * x + y * y <= 1) / F.count("*")).alias("pi"), F.count("*").alias("n"))


def dice_mean(df: DataFrame, key: str) -> DataFrame:
    from gridloom.functions.scalars import uniform

    return df.agg(F.avg(F.floor(uniform(F.col(key), "d") * 6) + 1).alias("mean"), F.count("*").alias("n"))


def least_squares_policy(df: DataFrame, key: str, features: Column, size: int, target: Column, ridge: float = 1e-9) -> list[float]:
    """Weights of target on a feature array, from sums of its products."""
    names = [F.element_at(features, k + 1) for k in range(size)]
    cells = [F.sum(names[i] * names[j]).alias(f"s{i}_{j}") for i in range(size) for j in range(i, size)]
    row = df.agg(*cells, *[F.sum(names[i] * target).alias(f"m{i}") for i in range(size)]).first()
    s = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)], dtype=float)
    return np.linalg.solve(s + ridge * np.eye(size), np.array([row[f"m{i}"] for i in range(size)], dtype=float)).tolist()


def backward_policy(df: DataFrame, step: str, features: Column, size: int, cost: Column, discount: float) -> dict[int, list[float]]:
    """Weights of the action values of each step but the last, from the last one back.

    At a step, the rows' costs plus the discounted least value of the next step
    are fitted to the feature array by the pseudo-inverse; the value after the
    last step is 0. All products are summed in one scan, a row a step, and each
    step then reads its own rows once for the least value.
    """
    rows, path = stored(df.select(F.col(step).cast("long").alias("t"), features.alias("f"), cost.cast("double").alias("r")).where("t IS NOT NULL AND r IS NOT NULL"))
    f = [F.element_at("f", k + 1) for k in range(size)]
    products = [F.sum(f[i] * f[j]).alias(f"s{i}_{j}") for i in range(size) for j in range(i, size)]
    sums = [*products, *[F.sum(f[i] * F.col("r")).alias(f"m{i}") for i in range(size)], *[F.sum(f[i]).alias(f"p{i}") for i in range(size)]]
    found = {r["t"]: r for r in rows.groupBy("t").agg(*sums).collect()}
    weights: dict[int, list[float]] = {}
    least = 0.0
    for t in sorted(found, reverse=True)[1:]:
        s = np.array([[found[t][f"s{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)], dtype=float)
        m, p = (np.array([found[t][f"{k}{i}"] for i in range(size)], dtype=float) for k in "mp")
        w = np.linalg.pinv(s) @ (m + discount * least * p)
        weights[t] = w.tolist()
        value = sum((F.lit(float(a)) * c for a, c in zip(w, f, strict=True)), F.lit(0.0))
        least = rows.where(F.col("t") == t).agg(F.min(value)).first()[0]
    delete(df.sparkSession, path)
    return weights


def best_action(value: Callable[[float], Column], actions: Sequence[float]) -> Column:
    """Of the actions that with the least value; of equal ones the first."""
    return F.array_min(F.array(*[F.struct(value(a).alias("value"), F.lit(k).alias("k"), F.lit(float(a)).alias("action")) for k, a in enumerate(actions)]))["action"]


def chunk_map(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """One row to none or many, a batch at a time, over all partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(f, batches)

    return df.mapInPandas(run, schema)


def cross_section(df: DataFrame, step: str, value: str) -> DataFrame:
    return df.groupBy(step).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("var"))


def cell_anomaly(df: DataFrame, cell: Sequence[str], value: str) -> DataFrame:
    """Each row's difference from the mean of its cell; means are pre-aggregated and joined. Nulls make cells of their own."""
    names = [f"_cell_{k}" for k in range(len(cell))]
    mean = df.groupBy(*[F.col(c).alias(n) for c, n in zip(cell, names, strict=True)]).agg(F.avg(value).alias("cell_mean"))
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(cell, names, strict=True)]
    return df.join(mean, same).drop(*names).withColumn("anomaly", F.col(value) - F.col("cell_mean"))


def by_rank(df: DataFrame, column: Column, k: int, largest: bool = False) -> DataFrame:
    """The k rows of least (or largest) value."""
    return df.orderBy(column.desc() if largest else column.asc(), *df.columns[:1]).limit(k)


def windowed_rank(df: DataFrame, key: str, order: Sequence[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
