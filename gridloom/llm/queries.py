"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import alignment, collocations, html_text, jaccard, language, media, packing, pieces, rules, shards, simhash, toxicity, warc
from gridloom.llm.common import crc_mod, table, work_dir


#: Parts in which the documents of op6 arrive, compacted after every other one.
ARRIVALS = 8


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    first = ["doc_id", *rules.STATISTICS[:5], "base_failed", "kept"]
    return found.select(*first, *rules.STATISTICS[5:])


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"), simhash.fingerprint_text().alias("fingerprint"), "component_id"
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language.learn_profiles(docs.where(crc_mod("doc_id", 3) != 1))
    found = language.identified(docs, profiles)
    return found.select(F.col("id").alias("doc_id"), (crc_mod("id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as the compacted shards hold it, with its shard; documents arrive in eight parts."""
    store = shards.ShardStore(spark, work_dir(spark))
    docs = table(spark, sf_dir, "documents")
    version = 0
    for k in range(ARRIVALS):
        store.append(docs.where(F.coalesce(crc_mod("doc_id", ARRIVALS), F.lit(0)) == k))
        if k % 2:
            version = store.compact()
    rows = store.read(version)
    rows = docs.where(F.lit(False)) if rows is None else rows
    return rows.select(
        "doc_id",
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
        "lang",
        "source",
        "n_chars",
        F.col("_metadata.file_name").alias("shard"),
        F.col("_metadata.file_size").alias("shard_bytes"),
        F.lit(version).alias("manifest_version"),
    )


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_sentencepiece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = pieces.coded_digests(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return digests.withColumnRenamed("id", "doc_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    found = toxicity.scored(docs, toxicity.learn(docs, labels))
    return found.select(
        F.col("id").alias("doc_id"),
        (crc_mod("id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return placed.withColumnRenamed("id", "doc_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).drop("url")


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
    return alignment.alignment_counts(table(spark, sf_dir, "documents"), *files).withColumnRenamed("id", "doc_id")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_simhash_near_dedup": op2_simhash_near_dedup,
        "op3_html_extraction": op3_html_extraction,
        "op4_media_columns": op4_media_columns,
        "op5_language_id": op5_language_id,
        "op6_sharding": op6_sharding,
        "op7_sentencepiece_coding": op7_sentencepiece_coding,
        "op8_toxicity": op8_toxicity,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_warc": op10_warc,
        "op11_jaccard_join": op11_jaccard_join,
        "op12_token_alignment": op12_token_alignment,
        "op13_phrase_collocations": op13_phrase_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_warc": warc.ORACLE_SQL, "op13_phrase_collocations": collocations.ORACLE_SQL}
