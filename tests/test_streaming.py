"""Streams with state, stopped and started again, against the batch results."""

import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.streaming import state as st


def events(spark, first, last):
    return spark.range(first, last).select(
        F.col("id").alias("event_id"), (F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7)).cast("long").alias("user"),
        F.when(F.col("id") % 5 != 0, F.col("id") * 1.5).alias("value"), F.timestamp_seconds(1_700_000_000 + (F.col("id") * 37 % 400)).alias("ts"),
    )


SCHEMA = "event_id long, user long, value double, ts timestamp"


def arrive(spark, folder, k, first, last):
    events(spark, first, last).coalesce(1).write.parquet(f"{folder}/part{k}")


@pytest.mark.parametrize("order", [["event_id"], ["ts", "event_id"]])
def test_ring_equals_the_batch_query_after_a_restart(spark, tmp_path, order):
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    run = lambda: st.ring_files(spark, f"{source}/*", SCHEMA, "user", order, "value", 4, sink, checkpoint)
    arrive(spark, source, 0, 0, 50)
    arrive(spark, source, 1, 50, 90)
    run()
    arrive(spark, source, 2, 90, 130)
    run()
    run()  # nothing new
    rank = F.row_number().over(Window.partitionBy("user").orderBy(*[F.desc(c) for c in order]))
    last = events(spark, 0, 130).withColumn("k", rank).where("k <= 4")
    want = {r.user: [tuple(x) for x in r.ring] for r in last.groupBy("user").agg(F.array_sort(F.collect_list(F.struct(*order, "value"))).alias("ring")).collect()}
    got = {r.user: [tuple(x) for x in r.ring] for r in st.rings(spark, sink, "user").collect()}
    assert got == want
    if order[0] == "ts":
        assert all(isinstance(x[0], datetime.datetime) for own in got.values() for x in own)


def test_history_sums_to_the_totals_after_a_restart(spark, tmp_path):
    source, sink, history, checkpoint = (str(tmp_path / x) for x in ("in", "out", "history", "state"))
    metrics = {"n": F.count("*"), "total": F.sum("value"), "last": F.max("event_id")}
    run = lambda: st.observed_files(spark, f"{source}/*", SCHEMA, metrics, sink, history, checkpoint, repeat=2, seed=3)
    arrive(spark, source, 0, 0, 40)
    arrive(spark, source, 1, 40, 100)
    run()
    arrive(spark, source, 2, 100, 101)
    run()
    rows = spark.read.parquet(history).orderBy("batch").collect()
    assert [(r.batch, r.n) for r in rows] == [(0, 80), (1, 120), (2, 2)]
    every = events(spark, 0, 101)
    assert sum(r.total or 0 for r in rows) == 2 * every.agg(F.sum("value")).first()[0] and rows[-1].last == 100
    assert sorted(r.event_id for r in spark.read.parquet(sink).collect()) == sorted([*range(101), *range(101)])
