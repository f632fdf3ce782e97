"""A training corpus in five stages; each is written as Parquet and read again as the next one's documents.

All stages but the last return the rows that they keep with all their columns, whatever other columns there are and whatever their
names. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from provenir.llm import minhash, mixing, packing, rules, toxicity
from provenir.session import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or the risk-controlled rules reject go.

    Null and empty texts fail the base and go; repeated rows are judged alike; a null doc_id has no label and is judged like any other.
    """
    return rules.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), Scratch(spark))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as toxic go.

    Null and empty texts score the bias alone; repeated rows are scored alike; without labels every document stays.
    """
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the document with the smallest id stays.

    Documents without words are in no group and stay, as do rows without a doc_id. Of rows that repeat a doc_id and a text one stays.
    """
    scratch = Scratch(spark)
    gone = minhash.near_duplicates(docs, size=5, percent=80).where("NOT kept").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    again = scratch.table(docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"))
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns)
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).union(once)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order.

    Documents without words, null texts among them, are never taken. A null source is one of its own; rows equal in id and text
    share their places in any order.
    """
    return mixing.curriculum(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset; a null text is the end id alone, repeated rows are packed each."""
    return packing.pack(docs, Scratch(spark), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources", source_mix),
    ("best-fit packing", packing_stage),
]

#: SQL can state neither a trained classifier nor certified cutoffs; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages, one after another, make of the table ``documents`` below ``sf_dir``, with its ``labels``."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
