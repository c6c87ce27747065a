"""What the training-data operators share: table access, durable results and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.session import shared_dir

#: ASCII white space: tab, line feed, vertical tab, form feed, return, space.
ASCII_SPACE = r"[\x20\x09-\x0D]"

#: Rows and bytes of one Arrow batch, so that long texts do not pile up in a worker.
ARROW_BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}
_ARROW_TYPES = {
    "int": pa.int32(),
    "long": pa.int64(),
    "double": pa.float64(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<long>": pa.list_(pa.int64()),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- durable results

_written: dict[int, tuple[DataFrame, str]] = {}


#: For ``durable`` where a row has megabytes: Parquet ends a page by its size after any row, not after a hundred at least.
WIDE_ROWS = {"parquet.page.size.row.check.min": "1"}


def durable(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written to the shared folder, with ``options`` of the writer, and read back.

    It cuts the lineage; the files outlive any executor. ``discard`` or
    ``clean_up`` deletes them once nothing reads them any more.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = (out, path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*frames: DataFrame | None) -> None:
    """Deletes the files of durable frames that are read no more; others are passed over."""
    for df in frames:
        _, path = _written.pop(id(df), (None, ""))
        if path:
            _delete(df.sparkSession, path)


def clean_up(spark: SparkSession) -> None:
    """Deletes all that the operators have left in the shared folder for their lazy results.

    Call it when those results have been written or are needed no more.
    """
    for df, _ in list(_written.values()):
        discard(df)
    for path in _folders:
        _delete(spark, path)
    _folders.clear()


_folders: list[str] = []


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """The durable result of ``make``, without what was written on the way to it."""
    before = set(_written)
    out = durable(make())
    discard(*(df for key, (df, _) in list(_written.items()) if key not in before and df is not out))
    return out


def work_dir(spark: SparkSession) -> str:
    """A new folder in the shared one, deleted by ``clean_up``."""
    _folders.append(shared_dir(spark))
    return _folders[-1]


# -- Arrow batches


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small enough for texts of any length, where the caller has set no size."""
    chosen = spark.conf.getAll
    for key, value in ARROW_BATCH.items():
        if key not in chosen:
            spark.conf.set(key, value)


def mapped(read: DataFrame, run: Callable[[list[Any]], dict[str, Any]], schema: dict[str, str]) -> DataFrame:
    """The columns of ``read`` but the last, then those of ``schema`` as ``run`` makes them from the last.

    ``run`` gets the values of a batch and gives a list for each column of
    ``schema``; with ``rows`` among them, these are the places in the batch that
    the result's rows come from, or else it has a row for each value. The other
    columns stay in Arrow, so ids of any type and size come back unchanged.
    """
    kept = read.schema.fields[:-1]
    names = [f.name for f in kept] + list(schema)
    types = [_ARROW_TYPES[t] for t in schema.values()]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            made = run(batch.column(len(kept)).to_pylist())
            own = batch.columns[: len(kept)]
            if "rows" in made:
                rows = pa.array(made["rows"], pa.int64())
                own = [c.take(rows) for c in own]
            made_columns = [pa.array(made[k], t) for k, t in zip(schema, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*own, *made_columns], names=names)

    small_batches(read.sparkSession)
    head = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    return read.mapInArrow(batches, ", ".join([*head, *(f"{k} {t}" for k, t in schema.items())]))


def sample_by_hash(rows: DataFrame, id_col: str, most: int, by: str | None = None) -> DataFrame:
    """At most ``most`` rows, of each value of ``by`` if given: those with the least hashes of their ids.

    Counts give a hash that a quarter more rows than these lie below, so few rows
    are ranked. The values of ``by`` must not be null; the driver holds a count of each.
    """
    kind = F.col(by) if by else F.lit(0)
    counts = [r for r in rows.groupBy(kind.alias("kind")).count().collect() if r["kind"] is not None]
    if not counts:
        return rows.limit(0)
    place = F.shiftrightunsigned(F.xxhash64(id_col), 11)
    ends = [int(2.0**53 * min(1.0, (1.25 * most + 200) / r["count"])) for r in counts]
    end_of = F.create_map(*[F.lit(x) for r, end in zip(counts, ends, strict=True) for x in (r["kind"], end)])
    near = rows.withColumn("_place", place).where(F.col("_place") <= F.element_at(end_of, kind))
    order = Window.partitionBy(kind).orderBy("_place", id_col)
    return near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).select(*rows.columns)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)
