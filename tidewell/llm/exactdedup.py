"""Exact deduplication over a log-structured merge index of text digests. DataFrame operations only.

1. Memtable flush: every scan task digests its rows and writes them as a sorted run (level 0). A row also has a spot, a hash
   of its id, which splits hot digests into segments.
2. Compaction: the runs are merged per (digest, segment) into level 1, which keeps the best row of each and the number of
   rows; level 1 is merged per digest into level 2, which keeps the digests of two rows or more. Levels are sorted runs as
   well, so an index of earlier documents is merged with new runs in the same way.
3. Probe: level 2 comes with a filter, a bitmap of a fixed size. Rows that the filter rules out are alone and are never
   shuffled; the others are looked up in level 2.
4. Byte verification: the texts of the hits, and of few others that a bitmap lets through, are compared byte by byte, as the
   smallest and largest text of each digest. Unequal texts under one digest, if any, are regrouped by (digest, text).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm import scratch

#: Characters deleted before comparing: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without blanks; null is empty."""
    return reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit("")), BLANKS, F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


#: Rows of one digest that a segment holds, about, where there are more than SEGMENTS of these.
SEGMENT_ROWS = 1_000_000
SEGMENTS = 64


def _best() -> Column:
    """Orders rows of a group: most code points, smallest id (null last), first row."""
    return F.struct((-F.col("_n")).alias("neg"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))


def _rows(docs: DataFrame, id_col: str, text_col: str, key: Column) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col("__tw_key").alias("_row"), F.coalesce(F.length(F.col(f"`{text_col}`")), F.lit(0)).alias("_n"), key)
    return rows.withColumn("_spot", F.xxhash64("_id", "_row"))


def flush(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Level 0: _id, _row, _n, _spot and _digest of every row of docs (keyed), sorted by digest in each written run."""
    runs = _rows(docs, id_col, text_col, digest(normalised(F.col(f"`{text_col}`"))).alias("_digest"))
    return scratch.table(runs.sortWithinPartitions("_digest"))


def segment(segments: int) -> Column:
    return F.pmod("_spot", F.lit(segments)).cast("int").alias("_segment")


def merge(runs: DataFrame, segments: int, *levels: DataFrame) -> DataFrame:
    """Level 1 of runs (level 0) and earlier levels 1 of as many segments: per (digest, segment) the best row and the rows."""
    rows = runs.select("_digest", segment(segments), _best().alias("best"), F.lit(1).cast("long").alias("n"))
    for level in levels:
        rows = rows.unionByName(level)
    return rows.groupBy("_digest", "_segment").agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def compact(level1: DataFrame) -> DataFrame:
    """Level 2: the (digest, segment) rows of digests of two rows or more, with the best row of the whole digest (_keep) and the number
    of its rows. A digest has a row per segment at most, so no task gathers a hot one."""
    w = Window.partitionBy("_digest")
    merged = level1.select("_digest", "_segment", F.min("best").over(w).alias("_keep"), F.sum("n").over(w).alias("group_size"))
    return merged.filter("group_size > 1")


def probe(runs: DataFrame, segments: int, level2: DataFrame, filter_bits: int) -> DataFrame:
    """runs with _keep and group_size: rows that the filter of level 2 rules out are alone, the others are looked up."""
    bits = scratch.bitmap(level2.select("_digest").distinct(), F.col("_digest"), filter_bits)
    marked = scratch.mark(runs.withColumn("_segment", segment(segments)), F.col("_digest"), bits, filter_bits, "_maybe")
    alone = marked.filter("not _maybe").select("*", _best().alias("_keep"), F.lit(1).cast("long").alias("group_size"))
    found = marked.filter("_maybe").join(level2, ["_digest", "_segment"], "left")
    found = found.withColumn("_keep", F.coalesce("_keep", _best())).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    return alone.unionByName(found).drop("_maybe", "_segment")


def collisions(docs: DataFrame, hits: DataFrame, text_col: str, digest: Callable[[Column], Column], bits: int) -> DataFrame:
    """The digests that stand for two different texts among the hits (rows with _row)."""
    texts = scratch.maybe_in(docs, F.col("__tw_key"), hits, F.col("_row"), bits).select(normalised(F.col(f"`{text_col}`")).alias("_text"))
    seen = texts.withColumn("_digest", digest(F.col("_text"))).groupBy("_digest").agg(F.min("_text").alias("a"), F.max("_text").alias("b"))
    return seen.filter("a <> b").select("_digest")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    segments: int | None = None,
    filter_bits: int = 1 << 22,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Equal: identical after deleting BLANKS; null is empty. Of equal texts the one with most code points in the original
    text, then the smallest id (null last), then the first row stays, so exactly one of several identical rows is kept.
    An empty table gives an empty result; other columns, whatever their names, are ignored. The bitmaps are broadcast: each
    has filter_bits / 64 rows at most. If one fills up, more rows are looked up or compared and the result is the same.
    segments: parts of a hot digest; by default as many as the number of rows asks for.
    """
    spark = docs.sparkSession
    docs = scratch.keyed(docs, id_col)
    with scratch.steps(spark) as keep:
        runs = flush(docs, id_col, text_col, digest)
        segments = segments or max(SEGMENTS, runs.count() // SEGMENT_ROWS)
        level1 = scratch.table(merge(runs, segments).sortWithinPartitions("_digest"))
        level2 = scratch.table(compact(level1).sortWithinPartitions("_digest"))
        scratch.drop(level1)
        found = keep(scratch.table(probe(runs, segments, level2, filter_bits)))
        scratch.drop(runs, level2)
        shared = keep(scratch.table(collisions(docs, found.filter("group_size > 1"), text_col, digest, filter_bits)))
    out = _resolved(found, F.col("_digest"))
    if not shared.isEmpty():
        rows = _rows(docs, id_col, text_col, normalised(F.col(f"`{text_col}`")).alias("_text")).withColumn("_key", digest(F.col("_text")))
        rows = rows.join(shared.withColumnRenamed("_digest", "_key"), "_key", "left_semi").withColumn("_digest", F.concat_ws(":", "_key", "_text"))
        exact = rows.join(compact(merge(rows, segments)).drop("_segment").distinct(), "_digest", "left")
        exact = exact.withColumn("_keep", F.coalesce("_keep", _best())).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
        out = _resolved(found.join(shared, "_digest", "left_anti"), F.col("_digest")).unionByName(_resolved(exact, F.sha2("_text", 256)))
    if digest is not sha256:
        # the index ran on another digest: the reported one is recomputed from the text
        sums = docs.select(F.col("__tw_key").alias("_row"), F.sha2(normalised(F.col(f"`{text_col}`")), 256).alias("_sha"))
        out = out.join(sums, "_row").withColumn("text_sha256", F.col("_sha")).drop("_sha")
    return out.drop("_row").withColumnRenamed("_id", "doc_id").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _resolved(rows: DataFrame, sha: Column) -> DataFrame:
    return rows.select("_id", "_row", F.col("_keep.id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_keep.row")).alias("kept"), sha.alias("text_sha256"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) = 1 AS kept,
       text_sha256
FROM t
"""
