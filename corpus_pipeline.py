"""The corpus pipeline: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next one's documents.

Defined cases: a null or empty text has no words, so the quality rules reject it.
Rows of null or equal id whose texts differ are documents of their own in every
stage; of rows equal in id and text near-dedup keeps one.  Of equal texts the
least id stays (null is the least); equal ids tie by the hash of the text.
n_chars is counted anew where a text is cut, other columns stay as they are, of
any name.  A text that cuts leave empty stays as an empty document.  Very long
texts are worked on whole.  Empty tables give no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphspark.llm import common, decontaminate, near_dedup, packing, quality_rules, suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules; references are learned from all of this stage's input."""
    return quality_rules.keep(docs, quality_rules.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class."""
    return near_dedup.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings that occur before."""
    return suffix_dedup.clean(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what they share with test items; mostly shared documents go."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in context windows."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("near_dedup", near_duplicates), ("suffix_dedup", repeats), ("decontaminate", benchmark), ("pack", pack)]
#: Token ids, alignment and suffix order are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.persisted(stage(spark, docs, sf_dir), name)
    return docs
