"""Streams that keep state: the last rows of each key, and a history of micro-batches."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ring_files(spark: SparkSession, source: str, schema: str, key: str, order: Sequence[str], value: str, n: int, sink: str, checkpoint: str, files: int = 1) -> None:
    """Keeps the last ``n`` rows of each key over Parquet files that come a few at a time.

    The state of a key is its ``n`` rows that are greatest by ``order`` so far,
    (order..., value), so it is bounded however many rows the key has, and rows
    of one micro-batch are cut to ``n`` a key before they reach it. A micro-batch
    writes the keys that it changes to a folder of its own under ``sink``, which
    it replaces if it runs again; a restart goes on from ``checkpoint``. Rows
    with a null key or order are left out; ``rings`` reads the result.
    """
    columns = [*order, value]
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema}
    key_type = kinds[key].simpleString()
    fields = ", ".join(f"{c}: {kinds[c].simpleString()}" for c in columns)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source).select(key, *dict.fromkeys(columns))
    stream = stream.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (key, *order)))
    # Rows travel as text, so the state has one form for all types.
    packed = stream.select(key, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("row"), F.struct(*order).alias("at"))

    def keep(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        for pdf in batches:
            held += [[list(a.values()) if isinstance(a, dict) else list(a), r] for a, r in zip(pdf["at"].map(_plain), pdf["row"], strict=True)]
            held = sorted(held)[-n:]
        state.update((json.dumps(held),))
        yield pd.DataFrame({key: [own[0]], "rows": [[r for _, r in held]]})

    kept = packed.groupBy(key).applyInPandasWithState(keep, f"{key} {key_type}, rows array<string>", "held string", "update", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, number: int) -> None:
        ring = F.transform("rows", lambda r: F.from_json(r, f"struct<{fields}>"))
        batch.select(key, ring.alias("ring")).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    query = kept.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    query.trigger(availableNow=True).start().awaitTermination()


def _plain(at) -> list:
    """Values that JSON keeps in their order: numbers and text as they are, times as text of one width."""
    values = at.asDict().values() if hasattr(at, "asDict") else at.values() if isinstance(at, dict) else at
    return [v.isoformat(timespec="microseconds") if hasattr(v, "isoformat") and hasattr(v, "hour") else v.isoformat() if hasattr(v, "isoformat") else v.item() if hasattr(v, "item") else v for v in values]


def rings(spark: SparkSession, sink: str, key: str) -> DataFrame:
    """(key, ring): each key's last rows in order, as its latest micro-batch left them."""
    written = spark.read.parquet(sink)
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("batch")))
    return written.withColumn("_last", last).where("_last = 1").select(key, "ring")


class _History(StreamingQueryListener):
    """What each micro-batch of one query observed."""

    def __init__(self, name: str):
        self.name, self.rows, self.over = name, [], False

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None and event.progress.numInputRows:
            self.rows.append((event.progress.batchId, seen.asDict()))

    def onQueryTerminated(self, event) -> None:
        self.over = True


def observed_files(
    spark: SparkSession, source: str, schema: str, metrics: dict[str, Column], sink: str, history: str, checkpoint: str, files: int = 1, repeat: int = 1, seed: int | None = None
) -> None:
    """Copies Parquet files a few at a time to ``sink`` and appends a row of ``metrics`` for each micro-batch to ``history``.

    ``history`` has (batch, and the metrics), taken while the rows pass; with
    ``repeat`` each row comes that often, with ``seed`` each micro-batch is
    shuffled, the same way for a seed. After a restart the history goes on with
    the batches that follow. Micro-batches without rows leave no row.
    """
    name = "history"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    columns = stream.columns
    if repeat > 1:
        stream = stream.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.lit(repeat))))
    seen = stream.observe(name, *[c.alias(k) for k, c in metrics.items()])

    def write(batch: DataFrame, number: int) -> None:
        if seed is not None:
            place = F.xxhash64(F.lit(seed), F.lit(number), *batch.columns)
            # Ranges would read the rows twice for their bounds, and count them twice.
            batch = batch.repartition(place).sortWithinPartitions(place)
        batch.select(*columns).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    listener = _History(name)
    spark.streams.addListener(listener)
    try:
        query = seen.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    kinds = spark.createDataFrame([], schema).agg(*[c.alias(k) for k, c in metrics.items()]).schema
    for number, row in listener.rows:
        spark.createDataFrame([tuple(row[k] for k in metrics)], kinds).write.mode("overwrite").parquet(f"{history}/batch={number}")
