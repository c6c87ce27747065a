"""Text and Parquet tables with explicit schemas, and a few sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.scalars import replaced


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_csv(spark: SparkSession, path: str, features: int) -> DataFrame:
    """Headless CSV, plain or gzip: a label, then 32-bit features; given back as label and array."""
    names = ["label", *(f"f{k}" for k in range(features))]
    schema = T.StructType([T.StructField(k, T.FloatType()) for k in names])
    rows = spark.read.schema(schema).csv(path, header=False)
    return rows.select("label", F.array(*names[1:]).alias("features"))


def indexed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header whose first column is an index, which is dropped."""
    rows = spark.read.schema(schema).csv(path, header=True)
    return rows.select(rows.columns[1:])


def numbers(spark: SparkSession, path: str, columns: list[str], separator: str = ",") -> DataFrame:
    """Numeric text without a header; blank lines are passed over."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split(F.trim("value"), r"\s+" if separator == " " else rf"\s*{separator}\s*")
    return lines.select(*[F.get(parts, F.lit(k)).cast("double").alias(c) for k, c in enumerate(columns)])


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Question rows with nested answers; flattened to one column for each leaf."""
    schema = "title string, context string, question string, answers struct<text: array<string>, answer_start: array<int>>"
    return spark.read.schema(schema).json(path).select(
        "title", "context", "question", F.col("answers.text").alias("answer_text"), F.col("answers.answer_start").alias("answer_start")
    )


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def daily_cells(spark: SparkSession, path: str) -> DataFrame:
    """(day, y, x, v) cells kept as Parquet with a folder for each day, so that days are pruned."""
    return spark.read.parquet(path)


def write_daily_cells(df: DataFrame, path: str) -> None:
    df.repartition("day").write.partitionBy("day").parquet(path)


def write_vector(df: DataFrame, idx: str, value: str, path: str) -> None:
    """One number a line in the order of ``idx``; part files follow one another."""
    df.orderBy(idx).select(F.format_string("%e", value)).write.text(path)


def rewrite_labels(spark: SparkSession, source: str, target: str, labels: dict[str, str]) -> None:
    """Text lines of ``source`` written to ``target`` with each label replaced."""
    spark.read.text(source).select(replaced(F.col("value"), labels).alias("value")).write.text(target)
