"""Postings: which chunk holds which word, so that lexical search reads words of queries instead of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as T

BUCKETS = 32


def bucket_of(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def postings(chunks: DataFrame, *more: str) -> DataFrame:
    """word, path, ordinal (and the columns of more): each different word of each chunk, in lower case. Null texts have none."""
    words = chunks.select("path", "ordinal", *more, F.explode(F.array_distinct(T.words("text"))).alias("word"))
    return words.filter("word <> ''").select("word", "path", "ordinal", *more)


def for_writing(rows: DataFrame, buckets: int = BUCKETS, *keys: str) -> DataFrame:
    """postings with their bucket, dealt and sorted for a write in folders of keys and bucket: the rows of a word lie together, so
    row groups without a query's words are skipped. A bucket is written by several tasks where there are more tasks than buckets,
    and the postings of a very common word are dealt over them by path."""
    wide = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets)
    rows = rows.withColumn("bucket", bucket_of(F.col("word"), buckets))
    return rows.repartition("bucket", F.pmod(F.xxhash64("path"), F.lit(wide))).sortWithinPartitions(*keys, "bucket", "word", "path", "ordinal")


def of_words(rows: DataFrame, words: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The postings (with bucket, the partition column) of the buckets that words (word) fall into: others are not opened."""
    asked = [r[0] for r in words.select(bucket_of(F.col("word"), buckets)).distinct().collect()]  # buckets at most
    return rows.filter(F.col("bucket").isin(asked)) if len(asked) < buckets else rows
