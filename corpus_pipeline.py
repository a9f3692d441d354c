"""A training-data pipeline: quality rules, line dedup, near-duplicate removal, substring dedup, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
``docs``. ``run`` writes each stage's result as Parquet in the shared folder and reads it back for the next.

Columns may have any names beside ``doc_id``, ``text`` and ``n_chars``, the latter following the text. Null and empty
texts are rejected by the quality rules; the later stages take them too. Repeated rows are copies. An empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kwicloom.llm import line_dedup, ngram_join, packing, quality_rules, substring_blocks
from kwicloom.llm.common import materialise
from kwicloom.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that fail."""
    return quality_rules.quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of similar lines stays, the first by id and line; documents without a word left go. Null is empty."""
    return line_dedup.drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class stays; empty texts are one class; a null id is linked by its exact words only."""
    return ngram_join.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 50 words that a smaller id has are cut; documents without a word left go. Null has no words; a null id comes first."""
    return substring_blocks.cut_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens; null or empty text is one token; repeated rows are packed each."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("best-fit packing", packed),
]
#: The near-duplicate stages are iterative, so no SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{k}")
    return docs
