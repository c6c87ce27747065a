from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import common
from gridloom.llm.queries import queries
from gridloom.session import shared_dir


def test_stages_agree_with_their_operators(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = {r.doc_id for r in queries()["op8_toxicity"](spark, sf).where("predicted = 1").collect()}
    civil = corpus_pipeline.civil(spark, docs, sf)
    assert civil.columns == docs.columns
    left = {r.doc_id for r in civil.collect()}
    assert left == {r.doc_id for r in docs.collect()} - toxic
    good = corpus_pipeline.good(spark, docs, sf)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in queries()["op1_quality_rules"](spark, sf).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept
    one = corpus_pipeline.distinct(spark, docs, sf)
    assert sorted(one.columns) == sorted(docs.columns)
    first = {r.doc_id for r in queries()["op2_simhash_near_dedup"](spark, sf).where("doc_id = component_id").collect()}
    assert sorted(r.doc_id for r in one.collect()) == sorted(first)


def test_run_packs_what_the_stages_keep(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        path = shared_dir(spark)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    rows = corpus_pipeline.run(spark, sf_dir)
    got = rows.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()}
    assert rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048


def test_stages_on_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_stages_on_nulls_and_repeated_ids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long = " ".join(f"word{i} follows another{i} here" for i in range(40))
    odd = [(2**60 + 1, long, "en"), (2**60 + 1, long, "en"), (None, long + " more", "en"), (None, None, None), (2**60 + 3, "", "en")]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string").withColumn("_extra", F.lit(1))
    want = [[2**60 + 1, 2**60 + 1, 2**60 + 3, None, None], [2**60 + 1, 2**60 + 1, None], [2**60 + 1, None]]
    for (_, stage), ids in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        columns, docs = docs.columns, common.durable(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        assert sorted((r.doc_id for r in docs.collect()), key=lambda x: (x is None, x)) == ids
    assert {r.doc_id for r in corpus_pipeline.packed(spark, docs, sf_dir).collect()} == {2**60 + 1, None}


def test_intermediate_files_go(spark, sf_dir):
    common.clean_up(spark)
    rows = corpus_pipeline.run(spark, sf_dir).count()
    assert rows and len(common._written) == 2  # the last stage's input and its pieces
    common.clean_up(spark)
    assert not common._written
