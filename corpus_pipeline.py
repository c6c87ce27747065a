"""A corpus pipeline: toxicity, quality rules, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import packing, rules, simhash, toxicity
from gridloom.llm.common import crc_mod, discard, settled, table
from gridloom.llm.queries import tokenizer_file


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5.

    A null or empty text has no n-gram and stays; repeated rows and null ids are
    scored each by itself; an empty table stays empty; columns are left as they are.
    """
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    return toxicity.keep_civil(docs, toxicity.learn(docs, labels))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned list keep.

    A null, empty or very short text goes; repeated rows and null ids are judged
    each by itself; an empty table stays empty; columns are left as they are.
    """
    return rules.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id from each group of near copies.

    Texts without a word are copies of one another. Rows with a null id stay;
    rows that share an id and differ in text stay or go by themselves, equal ones
    are copies; an empty table stays empty; columns are left as they are.
    """
    return simhash.drop_near_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece, with its sequence and place.

    A null or empty text is one piece with the end id alone. Repeated rows and
    null ids are packed as often as they come; an empty table gives no row; other
    columns are ignored.
    """
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", civil),
    ("quality_rules", good),
    ("simhash_near_dedup", distinct),
    ("best_fit_packing", packed),
]

#: The classifier and the learned list have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; of the stages before it only the last result stays, for ``clean_up``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
