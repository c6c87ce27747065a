"""Scans, lags, windows and filters over ordered events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalars import rounded
from gridloom.operators import models as md
from gridloom.operators import intervals as iv
from gridloom.operators import sequences as sq
from gridloom.plans.registry import query
from gridloom.sources.tables import table


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "value")


def _by_user(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "user_id", "ts", "value")


def _joined(array: str) -> Column:
    return F.array_join(F.transform(array, lambda x: x.cast("decimal(18,2)").cast("string")), ",")


_LIST = "array_to_string(list_transform({}, lambda x: x::DECIMAL(18,2)::VARCHAR), ',')"


@query("SELECT event_id, sum((value > 50)::BIGINT) OVER (ORDER BY event_id)::BIGINT AS scan FROM events")
def inclusive_scan(spark: SparkSession, sf: str) -> DataFrame:
    return sq.inclusive_scan(_events(spark, sf), "event_id", (F.col("value") > 50).cast("long")).select("event_id", "scan")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position FROM events")
def group_position(spark: SparkSession, sf: str) -> DataFrame:
    return sq.group_position(table(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"]).select("event_id", F.col("position").cast("long").alias("position"))


_LAG = "(SELECT event_id, user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lag1 FROM events)"


@query(
    "SELECT event_id, lag1, round(value / lag1 - 1, 6) AS simple, round(abs(value / lag1 - 1), 6) AS absolute, round(ln(value / lag1), 6) AS log"
    f" FROM {_LAG} WHERE lag1 IS NOT NULL"
)
def returns(spark: SparkSession, sf: str) -> DataFrame:
    out = sq.returns(_by_user(spark, sf), "user_id", ["ts", "event_id"], "value")
    return out.select("event_id", "lag1", *[rounded(F.col(k), 6).alias(k) for k in ("simple", "absolute", "log")])


@query(f"SELECT round(1 - sum((r - 0.1) ** 2) / sum(r * r), 8) AS r2 FROM (SELECT value / lag1 - 1 AS r FROM {_LAG} WHERE lag1 IS NOT NULL)")
def uncentered_return_r2(spark: SparkSession, sf: str) -> DataFrame:
    from gridloom.operators.aggregates import uncentred_r2

    out = sq.returns(_by_user(spark, sf), "user_id", ["ts", "event_id"], "value")
    return out.agg(rounded(uncentred_r2(F.col("simple"), F.lit(0.1)), 8).alias("r2"))


@query(
    "SELECT event_id, target, " + ", ".join(f"lag_{k}" for k in range(11, 0, -1)) + " FROM (SELECT event_id, value AS target, "
    + ", ".join(f"lag(value, {k}) OVER (ORDER BY event_id) AS lag_{k}" for k in range(11, 0, -1)) + " FROM events) WHERE event_id >= 11"
)
def lag_matrix_10(spark: SparkSession, sf: str) -> DataFrame:
    return sq.lag_matrix(_events(spark, sf), "event_id", "value", 10)


@query(
    f"SELECT event_id, {_LIST.format('h')} AS history, target FROM (SELECT event_id, value AS target,"
    " list(value) OVER (ORDER BY event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS h FROM events) WHERE event_id >= 20"
)
def sliding_history_20(spark: SparkSession, sf: str) -> DataFrame:
    out = sq.sliding_history(_events(spark, sf), "event_id", "value", 20)
    return out.select("event_id", _joined("history").alias("history"), "target")


@query(
    f"SELECT event_id, {_LIST.format('w')} AS window_values, target FROM (SELECT event_id, lead(value, 51) OVER (ORDER BY event_id) AS target,"
    " list(value) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS w FROM events) WHERE target IS NOT NULL"
)
def rnn_window_50(spark: SparkSession, sf: str) -> DataFrame:
    out = sq.rnn_windows(_events(spark, sf), "event_id", ["value"], "value")
    return out.select("event_id", _joined("window.value").alias("window_values"), "target")


@query("SELECT event_id, round(avg(value) OVER (ORDER BY event_id ROWS BETWEEN 39 PRECEDING AND CURRENT ROW), 6) AS trailing FROM events")
def trailing_mean_40(spark: SparkSession, sf: str) -> DataFrame:
    return sq.trailing_mean(_events(spark, sf), "event_id", "value").select("event_id", F.round("trailing", 6).alias("trailing"))


@query("SELECT event_id // 1000 AS batch, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1")
def tumbling_count_mean(spark: SparkSession, sf: str) -> DataFrame:
    return sq.tumbling_mean(_events(spark, sf), "event_id", "value", 1000).select("batch", F.round("mean", 6).alias("mean"), "n")


_BLUR = (
    "SELECT event_id, coalesce(0.25 * (lag(value) OVER (ORDER BY event_id) + 2 * value + lead(value) OVER (ORDER BY event_id)), value)"
    " AS value FROM {}"
)


@query(f"SELECT event_id, round(value, 6) AS value FROM ({_BLUR.format('events')})")
def blur3(spark: SparkSession, sf: str) -> DataFrame:
    return sq.blur(_events(spark, sf), "event_id", "value").select("event_id", F.round("value", 6).alias("value"))


@query("SELECT event_id, round(value, 6) AS value FROM (" + _BLUR.format("(" + _BLUR.format("events") + ")") + ")")
def blur3_twice(spark: SparkSession, sf: str) -> DataFrame:
    return sq.blur(_events(spark, sf), "event_id", "value", 2).select("event_id", F.round("value", 6).alias("value"))


@query(
    "SELECT bool_and(coalesce(p <= value, true)) AS sorted, bool_or(coalesce(p = value, false)) AS adjacent_duplicates"
    " FROM (SELECT value, lag(value) OVER (ORDER BY event_id) AS p FROM events)"
)
def is_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return sq.is_sorted(_events(spark, sf), "event_id", ["value"])


@query(
    "SELECT event_id, round(value - avg(value) OVER (PARTITION BY hour(ts), event_type), 6) AS anomaly FROM events"
)
def cell_mean_anomaly(spark: SparkSession, sf: str) -> DataFrame:
    cells = table(spark, sf, "events").select("event_id", "event_type", "value", F.hour("ts").alias("h"))
    return md.cell_anomaly(cells, ["h", "event_type"], "value").select("event_id", F.round("anomaly", 6).alias("anomaly"))


@query(
    "SELECT event_id, round(exp(sum(x) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 6) AS path FROM (SELECT *, (value - 50) / 1000 AS x FROM events)"
)
def price_path(spark: SparkSession, sf: str) -> DataFrame:
    out = sq.price_path(_by_user(spark, sf), "user_id", ["ts", "event_id"], (F.col("value") - 50) / 1000)
    return out.select("event_id", F.round("path", 6).alias("path"))


@query(
    "SELECT user_id, round(sum(0.1 * value * 0.9 ** (k - 1)), 6) AS smoothed FROM (SELECT user_id, value,"
    " row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) GROUP BY user_id"
)
def recurrence(spark: SparkSession, sf: str) -> DataFrame:
    """Smoothed value at the end of each user's events: w' = 0.9 w + 0.1 value."""
    out = sq.decayed_sum(table(spark, sf, "events"), "user_id", "event_id", 0.1 * F.col("value"), 0.9)
    return out.select("user_id", F.round("state", 6).alias("smoothed"))


@query(
    "WITH g AS (SELECT p_size AS k, avg(p_retailprice) AS y FROM part GROUP BY p_size) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,"
    " round(a.y + 0.3 * (b.y - a.y), 7) AS y FROM lineitem LEFT JOIN (g a JOIN g b ON b.k = a.k + 1) ON a.k = floor(l_quantity)"
)
def piecewise_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Mean price at quantity + 0.3, between the means of whole part sizes."""
    grid = table(spark, sf, "part").groupBy(F.col("p_size").cast("long").alias("k")).agg(F.avg("p_retailprice").alias("y"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    out = sq.interpolated(lines, F.col("l_quantity") + 0.3, grid)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("y", 7).alias("y"))


_POINTS = "(SELECT p_retailprice AS at, min(p_partkey) AS part, avg(p_size) AS y FROM part GROUP BY p_retailprice)"
_LINES = "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / l_quantity AS x FROM lineitem)"
_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy(F.col("p_retailprice").alias("at")).agg(F.min("p_partkey").alias("part"), F.avg("p_size").alias("y"))


@query(f"SELECT l.* EXCLUDE (x), p.at, p.part FROM {_LINES} l ASOF LEFT JOIN {_POINTS} p ON l.x >= p.at")
def price_interval(spark: SparkSession, sf: str) -> DataFrame:
    """The dearest part price up to each line's unit price: an interval of irregular points."""
    lines = table(spark, sf, "lineitem").select(*_LINE, (F.col("l_extendedprice") / F.col("l_quantity")).alias("x"))
    return iv.as_of(lines, F.col("x"), _points(spark, sf).drop("y"), "at").drop("x")


@query(
    f"SELECT l.* EXCLUDE (x), round(CASE WHEN a.at = l.x THEN a.y ELSE a.y + (l.x - a.at) / (b.at - a.at) * (b.y - a.y) END, 6) AS y"
    f" FROM {_LINES} l ASOF LEFT JOIN {_POINTS} a ON l.x >= a.at ASOF LEFT JOIN {_POINTS} b ON l.x < b.at"
)
def irregular_interpolation(spark: SparkSession, sf: str) -> DataFrame:
    """The mean part size at each line's unit price, on the line between the prices around it."""
    lines = table(spark, sf, "lineitem").select(*_LINE, (F.col("l_extendedprice") / F.col("l_quantity")).alias("x"))
    out = iv.interpolated_between(lines, F.col("x"), _points(spark, sf), "at", "y")
    return out.select(*_LINE, F.round("y", 6).alias("y"))


_KINDS = "(SELECT user_id, ts AS at, max(event_id) AS last_event FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2)"


@query(f"SELECT e.event_id, e.user_id, p.last_event FROM events e ASOF LEFT JOIN {_KINDS} p ON e.user_id = p.user_id AND e.ts >= p.at WHERE e.event_id % 3 <> 0")
def last_of_user(spark: SparkSession, sf: str) -> DataFrame:
    """For each event the user's last one whose number three divides."""
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    points = events.where("event_id % 3 = 0").groupBy("user_id", F.col("ts").alias("at")).agg(F.max("event_id").alias("last_event"))
    found = iv.as_of(events.where("event_id % 3 <> 0"), F.col("ts"), points, "at", ["user_id"])
    return found.select("event_id", "user_id", "last_event")
