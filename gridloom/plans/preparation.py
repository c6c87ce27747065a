"""Scaling, splitting, stacking, answer spans and model inputs over the tables."""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalars as sc
from gridloom.operators import aggregates as ag
from gridloom.operators import models as md
from gridloom.operators import rows as rw
from gridloom.operators import text as tx
from gridloom.plans.registry import query
from gridloom.sources.tables import table


def draw_sql(key: str, salt: str) -> str:
    """The SQL of ``scalars.uniform``."""
    return f"(('0x' || left(md5({key}::VARCHAR || '{salt}'), 8))::BIGINT / 4294967296.0)"


@query("SELECT p_partkey, p_size / 50.0::DOUBLE AS size, list_transform([p_size, 255], lambda v: v / 255.0::DOUBLE)[1] AS first, 1.0::DOUBLE AS last FROM part")
def scale_unit(spark: SparkSession, sf: str) -> DataFrame:
    both = sc.scaled_array(F.array(F.col("p_size"), F.lit(255)))
    return table(spark, sf, "part").select(
        "p_partkey", sc.scaled(F.col("p_size"), 50.0).alias("size"), F.element_at(both, 1).alias("first"), F.element_at(both, 2).alias("last")
    )


@query(f"SELECT split, count(*) AS n, sum(p_partkey)::BIGINT AS keys FROM (SELECT p_partkey, CASE WHEN {draw_sql('p_partkey', '/7')} < 0.8 THEN 'train' ELSE 'test' END AS split FROM part) GROUP BY split")
def split_random_80(spark: SparkSession, sf: str) -> DataFrame:
    return rw.split_random(table(spark, sf, "part"), "p_partkey", 0.8, 7).groupBy("split").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


@query(f"SELECT p_partkey, row_number() OVER (ORDER BY {draw_sql('p_partkey', '/3')}, p_partkey) - 1 AS place FROM part")
def shuffle_places(spark: SparkSession, sf: str) -> DataFrame:
    return rw.shuffled_places(table(spark, sf, "part").select("p_partkey"), "p_partkey", 3)


@query(
    "SELECT 0 AS axis, c_custkey AS k, c_nationkey AS nation, c_acctbal AS balance, -1 AS bias FROM customer"
    " UNION ALL SELECT 1, s_suppkey, s_nationkey, s_acctbal, -1 FROM supplier"
)
def stack_partners(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers stacked along a new axis, with a bias column beside them."""
    parts = [
        table(spark, sf, name).select(F.col(f"{p}_{key}").alias("k"), F.col(f"{p}_nationkey").alias("nation"), F.col(f"{p}_acctbal").alias("balance"))
        for name, p, key in (("customer", "c", "custkey"), ("supplier", "s", "suppkey"))
    ]
    return rw.union_all(parts, "axis").withColumn("bias", F.lit(-1))


@query("SELECT c_nationkey AS nation, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY c_nationkey")
def concat_nations(spark: SparkSession, sf: str) -> DataFrame:
    parts = [table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))]
    return rw.union_all(parts).groupBy("nation").agg(F.count("*").alias("n"))


@query(
    "SELECT chunk, count(*) AS n, round(avg(p_retailprice), 6) AS mean FROM"
    " (SELECT p_retailprice, (p_partkey // (n // 4))::INTEGER AS chunk FROM part, (SELECT count(*) // 4 * 4 AS n FROM part) WHERE p_partkey < n) GROUP BY chunk"
)
def chunk_means(spark: SparkSession, sf: str) -> DataFrame:
    """Four equal parts of the rows; up to three rows at the end that do not divide are left out."""
    parts = table(spark, sf, "part")
    n = parts.count() // 4 * 4
    made = rw.chunked(parts.where(F.col("p_partkey") < n), "p_partkey", n, 4)
    return made.groupBy("chunk").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean"))


@query("SELECT count(*) AS n, count_if(NOT coalesce(p_partkey * 2.5 + 2 = CASE WHEN p_size = 1 THEN 0 ELSE 2.5 * p_partkey + 2 END, false)) AS n_wrong FROM part")
def affine_by_place(spark: SparkSession, sf: str) -> DataFrame:
    """Whether y = a i + 2 holds at each place; parts of size 1 are made wrong."""
    y = F.when(F.col("p_size") == 1, 0.0).otherwise(2.5 * F.col("p_partkey") + 2)
    return ag.affine_check(table(spark, sf, "part").withColumn("y", y), "p_partkey", "y", 2.5, 2.0)


@query("SELECT round(sum((l_extendedprice - 1000 * l_quantity) ** 2) / 1e6, 3) AS off FROM lineitem")
def squared_deviation(spark: SparkSession, sf: str) -> DataFrame:
    off = ag.squared_deviation(F.col("l_extendedprice"), 1000 * F.col("l_quantity"))
    return table(spark, sf, "lineitem").agg(F.round(off / 1e6, 3).alias("off"))


@query("SELECT p_partkey, [p_size, 2 * p_size, 3, 6]::BIGINT[]::VARCHAR AS product FROM part")
def kronecker_rows(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size").cast("long")
    product = sc.kronecker(F.array(size, F.lit(3).cast("long")), F.array(F.lit(1).cast("long"), F.lit(2).cast("long")))
    return table(spark, sf, "part").select("p_partkey", F.concat(F.lit("["), F.array_join(product, ", "), F.lit("]")).alias("product"))


@query(
    "SELECT p_partkey, TRY_CAST(p_partkey::HUGEINT * 1000000000000000 + 9223372036854775000 AS BIGINT) IS NULL AS adds_over,"
    " TRY_CAST(p_size::HUGEINT * 300000000000000000 AS BIGINT) IS NULL AS multiplies_over FROM part"
)
def overflow_flags(spark: SparkSession, sf: str) -> DataFrame:
    # The product may pass 64 bits before the sum is taken: 19 and 16 digits, and one more, always fit a decimal.
    big = F.col("p_partkey").cast("decimal(19,0)") * F.lit(Decimal(10**15))
    return table(spark, sf, "part").select(
        "p_partkey",
        sc.no_long(big + F.lit(Decimal(9223372036854775000))).alias("adds_over"),
        sc.multiplies_over(F.col("p_size").cast("long"), F.lit(300_000_000_000_000_000)).alias("multiplies_over"),
    )


@query(
    "SELECT p_partkey, round(greatest(0, 1 - abs(p_size - 10) / 10.0), 6) AS low, round(greatest(0, 1 - abs(p_size - 20) / 10.0), 6) AS high FROM part"
)
def spline_values(spark: SparkSession, sf: str) -> DataFrame:
    """The two linear splines over 0, 10, 20, 30."""
    basis = sc.spline_basis(F.col("p_size"), [0.0, 10.0, 20.0, 30.0], 1)
    return table(spark, sf, "part").select("p_partkey", *[F.round(F.element_at(basis, k), 6).alias(n) for k, n in ((1, "low"), (2, "high"))])


@query("SELECT conv_id, turn, unnest(list_filter(string_split(text, ' '), lambda w: length(w) > 9)) AS word FROM conversations")
def batched_words(spark: SparkSession, sf: str) -> DataFrame:
    """Long words of each turn, none or many a row, a batch at a time."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        words = rows["text"].fillna("").str.split(" ").map(lambda own: [w for w in own if len(w) > 9])
        return rows[["conv_id", "turn"]].assign(word=words).explode("word").dropna(subset="word")

    turns = table(spark, sf, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "text")
    return md.chunk_map(turns, run, "conv_id long, turn long, word string")


@query("SELECT o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def top_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The three dearest orders of each customer; a higher rank is dropped before the shuffle."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    ranked = md.windowed_rank(orders, "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")])
    return ranked.where("rank <= 3").select("o_orderkey", "o_totalprice", "rank")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 7")
def dearest_parts(spark: SparkSession, sf: str) -> DataFrame:
    return md.by_rank(table(spark, sf, "part").select("p_partkey", "p_retailprice"), F.col("p_retailprice"), 7, largest=True)


# -- answer spans and model inputs: a turn is a context, the turn before it the question

_SPACE = sc.WHITE_SPACE
_SQUEEZED = f"trim(regexp_replace(text, '{_SPACE}+', ' ', 'g'))"
_PIECE = r"[\p{L}\p{N}]+|\s+|[^\s\p{L}\p{N}]"


def tokens_sql(source: str) -> str:
    """(key, place, token, start, end) of ``source`` (key, text), as SQL."""
    pieces = f"SELECT key, unnest(list) AS token, unnest(range(len(list))) AS k FROM (SELECT key, regexp_extract_all(text, '{_PIECE}') AS list FROM {source})"
    placed = (
        "SELECT key, k, token, sum(length(token)) OVER w AS end_at, count_if(regexp_matches(token, '\\S')) OVER w - 1 AS place"
        f" FROM ({pieces}) WINDOW w AS (PARTITION BY key ORDER BY k)"
    )
    return f"(SELECT key, place::BIGINT AS place, token, (end_at - length(token))::BIGINT AS start, end_at::BIGINT AS \"end\" FROM ({placed}) WHERE regexp_matches(token, '\\S'))"


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """(key, context, question, answer, answer_start): the answer is twelve characters, from a place that the key gives."""
    turns = table(spark, sf, "conversations").where("text IS NOT NULL").select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    start = (7 * F.col("turn") + F.col("conv_id")) % 80
    return turns.join(before, ["conv_id", "turn"]).select(
        F.concat_ws("-", "conv_id", "turn").alias("key"),
        F.col("text").alias("context"),
        "question",
        sc.span(sc.squeeze(F.col("text")), start, start + 12).alias("answer"),
        start.alias("answer_start"),
    )


_QA = (
    f"(SELECT t.conv_id || '-' || t.turn AS key, t.text, q.text AS question, (7 * t.turn + t.conv_id) % 80 AS s FROM (SELECT conv_id, turn, {_SQUEEZED} AS text FROM conversations WHERE text IS NOT NULL) t"
    f" JOIN (SELECT conv_id, turn + 1 AS turn, {_SQUEEZED} AS text FROM conversations WHERE text IS NOT NULL) q ON q.conv_id = t.conv_id AND q.turn = t.turn)"
)
_ANSWERED = f"(SELECT *, s + length(trim(substr(text, s + 1, greatest(0, least(s + 12, length(text)) - s)))) AS e FROM {_QA})"


@query(
    f"SELECT key, start_token, end_token, n_context, n_question FROM (SELECT a.key, min(place) FILTER (t.start < e AND t.end > s) AS start_token,"
    " max(place) FILTER (t.start < e AND t.end > s) + 1 AS end_token, count(*) AS n_context,"
    " any_value(len(regexp_extract_all(question, '[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]')))::BIGINT AS n_question"
    f" FROM {_ANSWERED} a JOIN {tokens_sql(_QA)} t ON t.key = a.key WHERE e < length(a.text) GROUP BY a.key)"
    " WHERE start_token IS NOT NULL AND n_context + n_question <= 90"
)
def answer_spans(spark: SparkSession, sf: str) -> DataFrame:
    return tx.answer_spans(_questions(spark, sf), "key", "context", "question", "answer", "answer_start", 90)


_IDS = "list_transform(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}]'), lambda w: ('0x' || left(md5(w), 8))::BIGINT % 30000 + 1)"
_JOINED = "array_to_string({} || list_transform(range(100 - len({})), lambda k: 0), ',')"


@query(
    "SELECT key, len(ids) AS n, md5(" + _JOINED.format("ids", "ids") + ") AS ids_md5, md5("
    + _JOINED.format("(list_transform(c, lambda k: 0) || list_transform(q[2:], lambda k: 1))", "ids")
    + ") AS types_md5, md5(" + _JOINED.format("list_transform(ids, lambda k: 1)", "ids") + ") AS mask_md5 FROM (SELECT key, c, q, c || q[2:] AS ids FROM"
    f" (SELECT key, {_IDS.format('text')} AS c, {_IDS.format('question')} AS q FROM {_QA})) WHERE len(ids) <= 100"
)
def question_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of fixed-length ids, types and mask of each turn and the turn before it; rows of over 100 ids are dropped."""
    ids = _questions(spark, sf).select(
        "key", tx.token_ids(sc.squeeze(F.col("context")), 30_000).alias("c"), tx.token_ids(sc.squeeze(F.col("question")), 30_000).alias("q")
    )
    made = tx.model_inputs(ids, "c", "q", 100)
    digest = lambda c: F.md5(F.array_join(F.col(c), ",").cast("binary"))
    n = F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b).cast("long")
    return made.select(
        "key", n.alias("n"), digest("input_ids").alias("ids_md5"), digest("token_type_ids").alias("types_md5"), digest("attention_mask").alias("mask_md5")
    )


@query("SELECT batch, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM (SELECT l_orderkey // 250 AS batch, l_linenumber FROM lineitem) GROUP BY batch")
def batch_rows(spark: SparkSession, sf: str) -> DataFrame:
    made = rw.batched(table(spark, sf, "lineitem"), "l_orderkey", 250)
    return made.groupBy("batch").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))
