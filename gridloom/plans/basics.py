"""Selections, reductions, metrics, reshaping and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalars as sc
from gridloom.operators import aggregates as ag
from gridloom.operators import rows as rw
from gridloom.plans.registry import query
from gridloom.sources.tables import table


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders WHERE o_orderkey % 3 = 0")
def select_mod3(spark: SparkSession, sf: str) -> DataFrame:
    return rw.select(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", F.col("o_orderkey") % 3 == 0)


@query("SELECT bool_and(o_orderkey % 3 = 0) AS all_of, count(*) = 0 AS empty FROM orders WHERE o_orderkey % 3 = 0")
def select_postcondition(spark: SparkSession, sf: str) -> DataFrame:
    multiple = F.col("o_orderkey") % 3 == 0
    return rw.all_of(table(spark, sf, "orders").where(multiple), multiple)


@query("SELECT event_id // 8 AS event_id, value FROM events WHERE event_id % 8 = 0")
def decimate_8(spark: SparkSession, sf: str) -> DataFrame:
    return rw.decimate(table(spark, sf, "events").select("event_id", "value"), "event_id", 8)


@query("SELECT p_partkey, CASE p_size WHEN 4 THEN 0 ELSE 1 END AS label FROM part WHERE p_size IN (4, 7)")
def class_relabel(spark: SparkSession, sf: str) -> DataFrame:
    return rw.relabel(table(spark, sf, "part"), "p_size", [4, 7]).select("p_partkey", "label")


@query("SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL")
def dropna_project(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id")
    return docs.join(table(spark, sf, "labels"), "doc_id", "left").na.drop(subset=["quality"])


@query("SELECT * EXCLUDE (l_orderkey) FROM lineitem")
def iloc_project(spark: SparkSession, sf: str) -> DataFrame:
    return rw.iloc(table(spark, sf, "lineitem"), slice(1, None))


@query(
    "SELECT round(sum(l_quantity * l_discount), 4) AS dot, round(sqrt(sum(l_quantity * l_quantity)), 4) AS norm2,"
    " round(max(abs(l_discount - l_tax)), 6) AS max_abs, count(*) FILTER (abs(l_discount - l_tax) / nullif(l_tax, 0) > 0.5"
    " OR (l_tax = 0 AND l_discount <> 0)) AS n_differ FROM lineitem"
)
def dot_and_norm(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("l_quantity"), F.col("l_discount")
    compared = ag.compared(y, F.col("l_tax"), 0.5)
    return table(spark, sf, "lineitem").agg(
        F.round(ag.dot(x, y), 4).alias("dot"),
        F.round(ag.norm2(x), 4).alias("norm2"),
        F.round(compared["max_abs"], 6).alias("max_abs"),
        compared["n_differ"].alias("n_differ"),
    )


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(2 * l_quantity + l_tax, 6) AS axpy,"
    " round(0.5 * l_quantity + 3 * l_tax, 6) AS lcomb, round(2 * (l_quantity - l_discount), 6) AS scaled_diff,"
    " round(l_tax + 2 * (l_quantity - l_discount), 6) AS add_scaled_diff FROM lineitem"
)
def vector_combinations(spark: SparkSession, sf: str) -> DataFrame:
    x, l, y = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.round(2 * x + y, 6).alias("axpy"),
        F.round(0.5 * x + 3 * y, 6).alias("lcomb"),
        F.round(2 * (x - l), 6).alias("scaled_diff"),
        F.round(y + 2 * (x - l), 6).alias("add_scaled_diff"),
    )


@query(
    "SELECT r.bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(61))::BIGINT AS bin) r"
    " LEFT JOIN (SELECT p_size AS bin, count(*) AS n FROM part GROUP BY p_size) c ON r.bin = c.bin"
)
def hist_exact(spark: SparkSession, sf: str) -> DataFrame:
    return ag.histogram(table(spark, sf, "part"), "p_size", 60)


@query(
    "SELECT r.bucket, coalesce(n, 0) AS n FROM (SELECT unnest(range(64))::INTEGER AS bucket) r LEFT JOIN (SELECT b, count(*) AS n FROM ("
    "SELECT CASE WHEN v <= 1 THEN v ELSE least(63, 1 + 9 * (length((v - 1)::VARCHAR) - 1) + left((v - 1)::VARCHAR, 1)::INTEGER) END AS b"
    " FROM (SELECT floor(o_totalprice)::BIGINT AS v FROM orders)) GROUP BY b) c ON r.bucket = c.b"
)
def hist_logdecade(spark: SparkSession, sf: str) -> DataFrame:
    return ag.log_histogram(table(spark, sf, "orders"), F.floor("o_totalprice"), 64)


@query(
    "SELECT o_orderstatus, min(o_totalprice) AS min, max(o_totalprice) AS max, round(avg(o_totalprice), 4) AS avg,"
    " round(stddev_pop(o_totalprice), 4) AS std, round(stddev_pop(o_totalprice) / avg(o_totalprice), 8) AS cv,"
    " list_sort(list(o_totalprice))[count(*) // 2 + 1] AS upper_median FROM orders GROUP BY o_orderstatus"
)
def stats_upper_median(spark: SparkSession, sf: str) -> DataFrame:
    out = ag.statistics(table(spark, sf, "orders"), "o_orderstatus", "o_totalprice")
    return out.withColumns({"avg": F.round("avg", 4), "std": F.round("std", 4), "cv": F.round("cv", 8)})


@query("SELECT count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM documents")
def distinct_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").agg(F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 500).cast("int").alias("guess"))
    return docs.join(table(spark, sf, "labels"), "doc_id")


_JUDGED = "(SELECT quality, (n_chars > 500)::INTEGER AS guess FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


@query(
    "SELECT t.true, count(*) FILTER (guess = 0) AS pred_0, count(*) FILTER (guess = 1) AS pred_1"
    f" FROM (SELECT unnest([0, 1])::INTEGER AS true) t LEFT JOIN {_JUDGED} j ON j.quality = t.true GROUP BY t.true"
)
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return ag.confusion(_judged(spark, sf), F.col("quality"), F.col("guess"), [0, 1])


@query(f"SELECT round(avg((quality = guess)::INTEGER::DOUBLE), 8) AS accuracy, count(*) AS n FROM {_JUDGED}")
def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).agg(F.round(ag.accuracy(F.col("quality"), F.col("guess")), 8).alias("accuracy"), F.count("*").alias("n"))


@query(
    "SELECT round(avg((y - p) ** 2), 2) AS mse, round(avg(abs(y - p)), 4) AS mae, round(sum((y - p) ** 2) / 2 / count(*), 2) AS half_sse,"
    " round(1 - sum((y - p) ** 2) / (sum(y * y) - sum(y) * sum(y) / count(*)), 8) AS r2,"
    " round(1 - sum((y - p) ** 2) / sum(y * y), 8) AS uncentred"
    " FROM (SELECT l_extendedprice AS y, 1500 * l_quantity AS p FROM lineitem)"
)
def mse_mae_r2(spark: SparkSession, sf: str) -> DataFrame:
    y, p = F.col("l_extendedprice"), 1500 * F.col("l_quantity")
    m = ag.regression_metrics(y, p)
    return table(spark, sf, "lineitem").agg(
        F.round(m["mse"], 2).alias("mse"),
        F.round(m["mae"], 4).alias("mae"),
        F.round(m["half_sse"] / F.count("*"), 2).alias("half_sse"),
        F.round(m["r2"], 8).alias("r2"),
        F.round(ag.uncentred_r2(y, p), 8).alias("uncentred"),
    )


@query(
    "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,"
    " round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem"
)
def regr_ols(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").agg(
        F.round(F.regr_slope("l_extendedprice", "l_quantity"), 6).alias("slope"),
        F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("intercept"),
    )


@query(
    "SELECT count(*) AS n, " + ", ".join(f"round(sum(x ** {p}), 6) AS x{p}" for p in range(1, 7)) + ", "
    + ", ".join(f"round(sum(x ** {p} * y), 4) AS x{p}y" for p in range(4))
    + " FROM (SELECT l_discount AS x, l_quantity AS y FROM lineitem)"
)
def poly_moments(spark: SparkSession, sf: str) -> DataFrame:
    out = ag.moments(table(spark, sf, "lineitem"), F.col("l_discount"), F.col("l_quantity"), 3)
    return out.select("n", *[F.round(f"x{p}", 6).alias(f"x{p}") for p in range(1, 7)], *[F.round(f"x{p}y", 4).alias(f"x{p}y") for p in range(4)])


def _standard(how: str, sql_scale: str, fit: str = "true") -> str:
    return (
        f"SELECT event_id, round((value - m) / s, 6) AS z FROM events, (SELECT avg(value) AS m, {sql_scale} AS s FROM events WHERE {fit})"
    )


@query(_standard("pop", "stddev_pop(value)"))
def standardise_pop(spark: SparkSession, sf: str) -> DataFrame:
    out = ag.standardised(table(spark, sf, "events").select("event_id", "value"), "value")
    return out.select("event_id", F.round("z", 6).alias("z"))


@query(_standard("samp", "stddev_samp(value)"))
def standardise_sample(spark: SparkSession, sf: str) -> DataFrame:
    out = ag.standardised(table(spark, sf, "events").select("event_id", "value"), "value", "samp")
    return out.select("event_id", F.round("z", 6).alias("z"))


@query(_standard("pop", "stddev_pop(value)", "event_id % 4 <> 3"))
def standardise_train_only(spark: SparkSession, sf: str) -> DataFrame:
    out = ag.standardised(table(spark, sf, "events").select("event_id", "value"), "value", fit=F.col("event_id") % 4 != 3)
    return out.select("event_id", F.round("z", 6).alias("z"))


@query("SELECT event_id, round((value - m) / s, 6) AS z FROM events, (SELECT avg(value) AS m, greatest(max(value) - avg(value), avg(value) - min(value)) AS s FROM events)")
def scale_max_abs(spark: SparkSession, sf: str) -> DataFrame:
    out = ag.standardised(table(spark, sf, "events").select("event_id", "value"), "value", "max_abs")
    return out.select("event_id", F.round("z", 6).alias("z"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'train' WHEN doc_id % 4 = 1 THEN 'test' ELSE 'valid' END AS split FROM documents")
def split_stride(spark: SparkSession, sf: str) -> DataFrame:
    return rw.split_by_stride(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query(
    "SELECT doc_id, CASE WHEN doc_id < floor(n * 0.9) THEN 'train' WHEN doc_id < floor(n * 0.95) THEN 'test' ELSE 'valid' END AS split"
    " FROM documents, (SELECT count(*) AS n FROM documents)"
)
def split_90_5_5(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id")
    return rw.split_contiguous(docs, "doc_id", {"train": 0.9, "test": 0.05, "valid": 0.05}, docs.count())


@query(
    "SELECT doc_id, (lang = 'de')::INTEGER AS lang_de, (lang = 'en')::INTEGER AS lang_en,"
    " (lang = 'es')::INTEGER AS lang_es, (lang = 'fr')::INTEGER AS lang_fr FROM documents"
)
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    return rw.one_hot(table(spark, sf, "documents").select("doc_id", "lang"), "lang", ["de", "en", "es", "fr"])


@query("SELECT conv_id, turn, text FROM conversations")
def explode_zip(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    nested = rw.nested(rows, "conv_id", ["turn", "text"])
    return rw.zipped(nested, ["turn", "text"])


@query("SELECT slot, event_id, value FROM (SELECT event_id % 64 AS slot, max(event_id) AS event_id FROM events GROUP BY 1) JOIN events USING (event_id)")
def ring_buffer(spark: SparkSession, sf: str) -> DataFrame:
    out = rw.ring(table(spark, sf, "events").select("event_id", "value"), "event_id", 64)
    return out.select(F.col("slot").cast("long").alias("slot"), "event_id", "value")


@query("SELECT o_orderkey, o_orderdate::DATE AS day, year(o_orderdate) || '-' || month(o_orderdate) AS month FROM orders")
def date_parts(spark: SparkSession, sf: str) -> DataFrame:
    packed = F.date_format("o_orderdate", "yyyyMMdd")
    day = F.to_date(packed, "yyyyMMdd")
    return table(spark, sf, "orders").select("o_orderkey", day.alias("day"), sc.lag_parts(day).alias("month"))


_STEP = "{v} - (exp(cos({v})) - 2) / (-sin({v}) * exp(cos({v})))"


@query(
    "WITH a AS (SELECT p_partkey, 1 + (p_size % 10) / 10.0::DOUBLE AS x0 FROM part)"
    + "".join(f", {'bcdef'[k]} AS (SELECT p_partkey, {_STEP.format(v=f'x{k}')} AS x{k + 1} FROM {'abcde'[k]})" for k in range(5))
    + " SELECT p_partkey, round(x5, 6) AS root FROM f"
)
def newton5(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.round(sc.newton(1 + (F.col("p_size") % 10) / 10.0), 6).alias("root"))


@query(
    "SELECT p_partkey, round(1 / (1 + exp(-x)), 8) AS sigmoid, greatest(x, 0) AS relu, round(tanh(x), 8) AS tanh,"
    " least(greatest(x, -1), 1) AS clip, (x > 0)::INTEGER AS step, round(exp(x) / (exp(x) + exp(2 * x) + 1), 8) AS softmax"
    " FROM (SELECT p_partkey, (p_size - 25) / 8.0::DOUBLE AS x FROM part)"
)
def activations(spark: SparkSession, sf: str) -> DataFrame:
    x = (F.col("p_size") - 25) / 8.0
    return table(spark, sf, "part").select(
        "p_partkey",
        F.round(sc.sigmoid(x), 8).alias("sigmoid"),
        sc.relu(x).alias("relu"),
        F.round(F.tanh(x), 8).alias("tanh"),
        sc.clip(x, -1.0, 1.0).alias("clip"),
        sc.step(x).alias("step"),
        F.round(sc.softmax(F.array(x, 2 * x, F.lit(0.0)))[0], 8).alias("softmax"),
    )


@query("SELECT p_partkey, round(0.2 + 0.01 * x + 0.025 * x * x + 0.1 * x * x * x, 8) AS y FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS x FROM part)")
def polyval(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.round(sc.polyval(F.col("p_size") / 50.0), 8).alias("y"))


@query("SELECT p_partkey, CASE WHEN p_size < 25 THEN CASE WHEN p_size < 10 THEN 1.0 ELSE 2.0 END ELSE 3.0 END::DOUBLE AS y FROM part")
def tree_eval(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", sc.tree_value(F.col("p_size"), (25, (10, 1.0, 2.0), 3.0)).alias("y"))


@query(
    "SELECT vec_id, round(cos(s), 6) AS cosine, round(exp(-q), 6) AS gaussian, round(exp(-a), 6) AS kink FROM ("
    "SELECT vec_id, list_sum(list_transform(x, lambda v: v)) AS s, list_sum(list_transform(x, lambda v: v * v)) AS q,"
    " list_sum(list_transform(x, lambda v: abs(v))) AS a FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings))"
)
def testfuncs(spark: SparkSession, sf: str) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    f = sc.test_functions(F.col("x"))
    rows = table(spark, sf, "embeddings").select("vec_id", x.alias("x"))
    return rows.select("vec_id", *[F.round(f[k], 6).alias(k) for k in ("cosine", "gaussian", "kink")])


@query(
    "SELECT l_partkey, round((m - 0.01) / (6 * v), 6) AS optimum, round(-0.5 * 0.01 - 0.5 * m + 3 * 0.25 * v, 6) AS cost"
    " FROM (SELECT l_partkey, avg(l_discount) AS m, var_pop(l_discount) AS v FROM lineitem GROUP BY l_partkey HAVING var_pop(l_discount) > 1e-6)"
)
def markowitz(spark: SparkSession, sf: str) -> DataFrame:
    m, v = F.col("m"), F.col("v")
    stats = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.avg("l_discount").alias("m"), F.var_pop("l_discount").alias("v"))
    return stats.where("v > 1e-6").select(
        "l_partkey",
        F.round(sc.portfolio_optimum(0.01, m, v, 3.0), 6).alias("optimum"),
        F.round(sc.portfolio_cost(F.lit(0.5), 0.01, m, v, 3.0), 6).alias("cost"),
    )


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ORDER BY l_partkey, l_suppkey"
)
def sort_multi(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").orderBy("l_partkey", "l_suppkey")


@query("SELECT event_id, value FROM events ORDER BY abs(value - 100) DESC, event_id LIMIT 10")
def topk_abs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "value").orderBy(F.desc(F.abs(F.col("value") - 100)), "event_id").limit(10)


@query("SELECT event_id, value FROM events ORDER BY abs(value - 100), event_id LIMIT 10")
def bottomk_abs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "value").orderBy(F.abs(F.col("value") - 100), "event_id").limit(10)


@query("SELECT vec_id, list_position(e, list_max(e)) - 1 AS argmax FROM (SELECT vec_id, embedding AS e FROM embeddings)")
def argmax_row(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", ag.argmax(F.col("embedding")).alias("argmax"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS var FROM events GROUP BY event_type")
def cross_section(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.var_pop("value"), 4).alias("var")
    )


_U = "(('0x' || left(md5(o_orderkey::VARCHAR || '{}'), 8))::BIGINT / 4294967296.0::DOUBLE)"


@query(f"SELECT round(4.0 * count(*) FILTER ({_U.format('x')} ** 2 + {_U.format('y')} ** 2 <= 1) / count(*), 8) AS pi, count(*) AS n FROM orders")
def pi_mc(spark: SparkSession, sf: str) -> DataFrame:
    from gridloom.operators.models import monte_carlo_pi

    return monte_carlo_pi(table(spark, sf, "orders"), "o_orderkey").select(F.round("pi", 8).alias("pi"), "n")


@query(f"SELECT round(avg(floor({_U.format('d')} * 6) + 1), 8) AS mean, count(*) AS n FROM orders")
def dice_mean(spark: SparkSession, sf: str) -> DataFrame:
    from gridloom.operators.models import dice_mean as dice

    return dice(table(spark, sf, "orders"), "o_orderkey").select(F.round("mean", 8).alias("mean"), "n")
