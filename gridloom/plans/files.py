"""Sources and sinks: parts of the tables written to the shared folder in each format, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalars as sc
from gridloom.operators import rows as rw
from gridloom.operators import sparse as sp
from gridloom.plans.registry import query
from gridloom.session import kept_dir
from gridloom.sources import matrices as mx
from gridloom.sources import tables as tb
from gridloom.sources.tables import table


@query(
    "SELECT label, count(*) AS n, round(sum(embedding[1]::DOUBLE), 4) AS first, round(sum(embedding[28]::DOUBLE), 4) AS last FROM embeddings GROUP BY label"
)
def labelled_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Gzipped CSV without a header: a label and 28 features of 32 bits."""
    path = kept_dir(spark)
    written = table(spark, sf, "embeddings").select(F.col("label").cast("float"), *[F.get("embedding", F.lit(k)).alias(f"f{k}") for k in range(28)])
    written.write.option("compression", "gzip").csv(path)
    value = lambda k: F.round(F.sum(F.element_at("features", k).cast("double")), 4)
    read = tb.labelled_csv(spark, path, 28)
    return read.groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"), value(1).alias("first"), value(28).alias("last"))


@query("SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def indexed_rows(spark: SparkSession, sf: str) -> DataFrame:
    path = kept_dir(spark)
    table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")).write.option("header", True).csv(path)
    read = tb.indexed_csv(spark, path, "o_orderkey long, status string, price double")
    return read.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query("SELECT l_quantity AS quantity, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY l_quantity")
def number_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = kept_dir(spark)
    table(spark, sf, "lineitem").select(F.concat_ws(" ", "l_quantity", "l_extendedprice").alias("value")).write.text(path)
    read = tb.numbers(spark, path, ["quantity", "price"], " ")
    return read.groupBy("quantity").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price"))


@query(
    "SELECT conv_id || '-' || turn AS title, md5(text) AS context_md5, role AS question, left(text, 9) AS answer, 0 AS answer_start FROM conversations"
    " WHERE text IS NOT NULL AND role IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL"
)
def nested_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Question rows with nested answers, as JSON lines."""
    path = kept_dir(spark)
    answers = F.struct(F.array(F.left("text", F.lit(9))).alias("text"), F.array(F.lit(0)).alias("answer_start"))
    turns = table(spark, sf, "conversations").dropna()
    turns.select(F.concat_ws("-", "conv_id", "turn").alias("title"), F.col("text").alias("context"), F.col("role").alias("question"), answers.alias("answers")).write.json(path)
    read = tb.questions(spark, path)
    return read.select(
        "title", F.md5(F.col("context").cast("binary")).alias("context_md5"), "question",
        F.get("answer_text", F.lit(0)).alias("answer"), F.get("answer_start", F.lit(0)).alias("answer_start"),
    )


@query(
    "SELECT strftime(ts, '%Y-%m-%d') AS day, user_id % 8 AS y, event_id % 16 AS x, round(avg(value), 6) AS v, count(*) AS n FROM events"
    " WHERE ts IS NOT NULL AND ts < TIMESTAMP '2024-01-15' GROUP BY ALL"
)
def daily_means(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with a folder for each day; only the folders of the days that are asked for are read."""
    path = kept_dir(spark)
    cells = table(spark, sf, "events").where("ts IS NOT NULL").select(
        F.to_date("ts").alias("day"), (F.col("user_id") % 8).alias("y"), (F.col("event_id") % 16).alias("x"), F.col("value").alias("v")
    )
    tb.write_daily_cells(cells, path)
    read = tb.daily_cells(spark, path).where("day < DATE '2024-01-15'").withColumn("day", F.col("day").cast("string"))
    return read.groupBy("day", "y", "x").agg(F.round(F.avg("v"), 6).alias("v"), F.count("*").alias("n"))


@query("SELECT p_brand AS brand, sum(length(p_name) + 1)::BIGINT AS chars FROM part GROUP BY p_brand")
def text_files(spark: SparkSession, sf: str) -> DataFrame:
    """Whole text files, one or more for each brand."""
    path = kept_dir(spark)
    table(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("value")).write.partitionBy("brand").text(path)
    read = tb.whole_texts(spark, f"{path}/*")
    # A folder name's escapes are escaped once more in the path.
    brand = F.url_decode(F.regexp_extract("file", "brand=([^/]*)/", 1))
    return read.groupBy(F.url_decode(brand).alias("brand")).agg(F.sum(F.char_length("text")).cast("long").alias("chars"))


@query("SELECT v, count(*) AS n FROM (SELECT printf('%e', s_acctbal)::DOUBLE AS v FROM supplier) GROUP BY v")
def vector_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A vector as one number a line, read back."""
    path = kept_dir(spark)
    tb.write_vector(table(spark, sf, "supplier"), "s_suppkey", "s_acctbal", path)
    return tb.numbers(spark, path, ["v"]).groupBy("v").agg(F.count("*").alias("n"))


@query("SELECT replace(replace(o_orderpriority, '1-URGENT', '0'), '5-LOW', '4') AS label, count(*) AS n FROM orders GROUP BY 1")
def rewritten_labels(spark: SparkSession, sf: str) -> DataFrame:
    source, target = kept_dir(spark), kept_dir(spark)
    table(spark, sf, "orders").select(F.concat_ws(",", "o_orderkey", "o_orderpriority").alias("value")).write.text(source)
    tb.rewrite_labels(spark, source, target, {"1-URGENT": "0", "5-LOW": "4"})
    return spark.read.schema("k long, label string").csv(target).groupBy("label").agg(F.count("*").alias("n"))


_A = "(SELECT l_partkey AS i, l_suppkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


def _matrix(spark: SparkSession, sf: str) -> tuple[DataFrame, int, int]:
    a = sp.coo(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey", "l_quantity")
    return a, *(n or 0 for n in a.agg(F.max("i") + 1, F.max("j") + 1).first())


@query(f"SELECT i, j, v FROM {_A}")
def packed_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The matrix as packed binary files, read back."""
    a, rows, cols = _matrix(spark, sf)
    path = kept_dir(spark)
    mx.write_packed(a, path, "a", rows, cols)
    return mx.read_packed(spark, f"{path}/a_*.bmtx").select("i", "j", "v")


@query(f"SELECT max(i) + 1 AS n_rows, max(j) + 1 AS n_cols, count(*) AS nnz, true AS fits_32 FROM {_A}")
def matrix_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """A matrix file's sizes from its header alone, and whether 32-bit indices hold them."""
    a, rows, cols = _matrix(spark, sf)
    path = kept_dir(spark)
    mx.write_matrix(a, path, rows, cols)
    head = mx.header(spark, f"{path}/header")
    try:
        mx.check_index_fit(head["rows"], head["cols"], head["nnz"])
        fits = True
    except mx.MatrixError:
        fits = False
    return spark.createDataFrame([(head["rows"], head["cols"], head["nnz"], fits)], "n_rows long, n_cols long, nnz long, fits_32 boolean")


@query("SELECT l_suppkey AS id, count(DISTINCT l_partkey) AS degree FROM lineitem GROUP BY l_suppkey")
def edge_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of each column of an edge file whose columns ascend."""
    a, _, _ = _matrix(spark, sf)
    path = kept_dir(spark)
    mx.write_edges(a, path)
    return mx.read_edges(spark, path).groupBy(F.col("j").alias("id")).agg(F.count("*").alias("degree"))


@query("SELECT o_orderkey, o_totalprice, o_totalprice AS copy, 2.5 * o_totalprice AS scaled, 7.0::DOUBLE AS fill FROM orders")
def aligned_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Copies, scaled values and a fill of one column, aligned by key with the rows they come from."""
    prices = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    made = rw.filled(rw.copied(rw.copied(prices, "o_totalprice", "copy"), "o_totalprice", "scaled", 2.5), "fill", 7.0)
    return rw.aligned(prices, made.drop("o_totalprice"), "o_orderkey")


@query(
    "SELECT vec_id, round(list_product(x[1:4]), 6) AS product, round((1 + list_sum(x[1:4])) ** -2, 6) AS corner,"
    " CASE WHEN list_max(x[1:4]) > 0.5 THEN 0.0 ELSE round(exp(list_sum(x[1:4])), 6) END::DOUBLE AS jump,"
    " round(cos(pi() * x[1] / 2) * cos(pi() * x[2] / 2), 6) AS bump FROM (SELECT vec_id, list_transform(embedding, lambda v: abs(v::DOUBLE)) AS x FROM embeddings)"
)
def test_functions_4d(spark: SparkSession, sf: str) -> DataFrame:
    """The other functions of the six, at four coordinates, and the bump over two."""
    x = F.slice(F.transform("embedding", lambda v: F.abs(v.cast("double"))), 1, 4)
    rows = table(spark, sf, "embeddings").select("vec_id", x.alias("x"))
    made = sc.test_functions(F.col("x"))
    bump = sc.cosine_bump(F.element_at("x", 1), F.element_at("x", 2))
    return rows.select("vec_id", *[F.round(made[k], 6).alias(k) for k in ("product", "corner", "jump")], F.round(bump, 6).alias("bump"))


@query(
    "SELECT vec_id, round(list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2])), 6) AS dot,"
    " round(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) ** 2)), 6) AS apart"
    " FROM (SELECT vec_id, x[1:16] AS a, x[17:32] AS b FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings))"
)
def array_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Products and differences of two slices of each row."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = table(spark, sf, "embeddings").select("vec_id", F.slice(x, 1, 16).alias("a"), F.slice(x, 17, 16).alias("b"))
    rows = rows.withColumn("d", sc.row_difference(F.col("a"), F.col("b")))
    return rows.select("vec_id", F.round(sc.row_dot(F.col("a"), F.col("b")), 6).alias("dot"), F.round(sc.row_dot(F.col("d"), F.col("d")), 6).alias("apart"))
