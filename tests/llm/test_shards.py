import hashlib

import pytest
from pyspark.sql import functions as F

from gridloom.llm import shards
from gridloom.llm.common import shared_dir
from gridloom.llm.queries import queries


def contents(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_appends_and_compactions_keep_rows(spark, monkeypatch):
    monkeypatch.setattr(shards, "ARRIVAL_ROWS", 50)
    store = shards.ShardStore(spark, shared_dir(spark), target_bytes=60_000)
    assert store.version() == 0 and store.read() is None and store.compact() == 0
    df = spark.range(1000).select(
        "id", F.when(F.col("id") % 7 > 0, F.sha2(F.col("id").cast("string"), 256)).alias("text"), F.lit(None).cast("int").alias("shard")
    )
    whole = df.unionByName(df.where("id < 100"))
    assert store.append(df) == 1
    assert store.append(df.where("id < 100")) == 2
    small = store.manifest().count()
    assert contents(store.read()) == contents(whole)
    assert store.compact() == 3
    live = store.manifest().collect()
    assert len(live) < small and sum(r.rows for r in live) == 1100
    assert contents(store.read()) == contents(whole)
    assert contents(store.read(1)) == contents(df)
    by_tier = store.manifest().withColumn("tier", shards.tier_of("bytes", 60_000)).groupBy("tier").count().where("tier IS NOT NULL").collect()
    assert all(r["count"] < shards.FAN_IN for r in by_tier)
    assert store.compact() == 3
    assert store.vacuum() == small and contents(store.read()) == contents(whole)


def test_a_version_is_committed_once(spark):
    store = shards.ShardStore(spark, shared_dir(spark))
    store.append(spark.range(3))
    with pytest.raises(shards.ConcurrentCommit):
        store._commit(store.manifest(), 1)
    assert contents(store.read()) == contents(spark.range(3))


def test_empty_arrival(spark):
    store = shards.ShardStore(spark, shared_dir(spark))
    assert store.append(spark.range(0)) == 1
    assert store.compact() == 1 and store.read() is None


def test_query_holds_every_document(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries()["op6_sharding"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        d = docs[r.doc_id]
        assert (r.text_md5, r.lang, r.source, r.n_chars) == (hashlib.md5(d.text.encode()).hexdigest(), d.lang, d.source, d.n_chars)


def test_query_merges_over_several_arrivals(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "ARRIVAL_ROWS", 20)
    docs = spark.range(2000).select(
        F.when(F.col("id") % 50 > 0, F.col("id")).alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(64).alias("n_chars")
    )
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    merged, compact = [], shards.ShardStore.compact

    def watched(store):
        before = {r.shard for r in store.manifest().collect()}
        version = compact(store)
        merged.append(before - {r.shard for r in store.manifest().collect()})
        return version

    monkeypatch.setattr(shards.ShardStore, "compact", watched)
    rows = queries()["op6_sharding"](spark, str(tmp_path)).collect()
    want = [(r.doc_id, hashlib.md5(r.text.encode()).hexdigest()) for r in docs.collect()]
    assert sorted(map(repr, ((r.doc_id, r.text_md5) for r in rows))) == sorted(map(repr, want))
    assert len([m for m in merged if m]) > 1
    assert any("/data/c" in shard for m in merged for shard in m)  # shards of an earlier merge are merged again


def test_other_columns_are_refused(spark):
    store = shards.ShardStore(spark, shared_dir(spark))
    store.append(spark.range(3))
    for other in (spark.range(3).withColumnRenamed("id", "x"), spark.range(3).selectExpr("cast(id AS int) AS id")):
        with pytest.raises(ValueError):
            store.append(other)
    assert store.append(spark.range(2)) == 2


def test_a_tier_is_merged_in_bounded_jobs(spark, monkeypatch):
    monkeypatch.setattr(shards, "ARRIVAL_ROWS", 10)
    monkeypatch.setattr(shards, "MERGE_SHARDS", 5)
    store = shards.ShardStore(spark, shared_dir(spark), target_bytes=1 << 20)
    store.append(spark.range(230))
    before = store.manifest().count()
    store.compact()
    assert store.manifest().count() < before and contents(store.read()) == contents(spark.range(230))
    tiers = store.manifest().withColumn("tier", shards.tier_of("bytes", 1 << 20)).groupBy("tier").count().collect()
    assert all(r["count"] < shards.FAN_IN for r in tiers if r.tier is not None)
