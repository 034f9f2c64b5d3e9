"""Corpus pipeline: language ID, n-gram Jaccard join, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.

Every stage takes null ids, texts and sources, empty and very long texts, repeated rows, empty tables and extra columns; what it
does with them is in its docstring and in those of the operators, and tests/llm/test_pipeline.py covers it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import decontam, langid, mixing, ngramjoin, scratch, sharding


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is not identified: null texts, texts without a letter, and texts that the byte frequencies of
    all languages, or equal frequencies of all bytes (for scripts that no tree knows), code as shortly as any language's context tree. Of repeated rows all stay or none. Empty in, empty out."""
    return langid.keep_identified(docs)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays, the one with the smallest id (null last; of equal ids any one). Null and
    blank texts are linked with nothing and stay. Empty in, empty out."""
    return ngramjoin.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, re-parameterised or not. Null and empty texts stay; of repeated rows all stay or
    none. Without items everything stays."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it (0 to 3 times). Documents without words stay once; null is a source of its own,
    the last. Empty in, empty out."""
    return mixing.expand(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row, with its size and CRC; a null text has no bytes. Repeated rows each have a slot of their own. Empty
    in, empty out."""
    return sharding.interleave(docs, shards=8)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]

#: The trained model and the Newton iterations have no SQL form; tests/llm tests the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
