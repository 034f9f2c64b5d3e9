"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source and get the fractional rank (rank - 1/2) / rows of the source.
Sorted by that rank, every stretch of the order holds each source in proportion, so cutting the order into equal parts
gives shards that all match the mixture. Ranks and positions are exact prefix sums in two levels (counts of narrow key
ranges, then a row number inside one range), so no source, however large, is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm import scratch


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus 1; null has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def interleave(
    docs: DataFrame,
    shards: int = 8,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    hex_digits: int = 3,
    bands: int = 4096,
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null), source.

    Shards differ by one row at most; slots are gapless from 0 in each shard. Null ids, texts and sources are values like
    others (a null text counts no bytes and has the CRC of no bytes; null is a source of its own). Rows with one id are
    ordered by CRC, size and source; wholly equal rows are interchangeable, so reruns agree. Columns other than the three are
    ignored, whatever their names. An empty table gives an empty result. A range of keys holds about 1 / 16 ** hex_digits of a source, a band about 1 / bands of all rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        text_size(F.col(text_col)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.col(source_col).alias("source"),
    )
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32").cast("string")).cast("binary"))
    rows = scratch.table(rows.withColumn("_key", key).withColumn("_lead", F.substring("_key", 1, hex_digits)))

    # level 1 of the rank: rows before each key range of a source, and rows of the source
    by_source = Window.partitionBy("source").orderBy("_lead")
    ranges = rows.groupBy("source", "_lead").agg(F.count("*").alias("n"))
    ranges = ranges.select(
        F.col("source").alias("_s"),
        F.col("_lead").alias("_l"),
        (F.sum("n").over(by_source.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("_before"),
        F.sum("n").over(Window.partitionBy("source")).alias("_of"),
    )
    inside = Window.partitionBy("source", "_lead").orderBy("_key", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("_rank", F.row_number().over(inside)).join(
        ranges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_lead") == F.col("_l"))
    )
    fraction = (F.col("_before") + F.col("_rank") - F.lit(0.5)) / F.col("_of")
    ranked = ranked.withColumn("_at", fraction).withColumn("_band", F.floor(F.col("_at") * bands).cast("int"))
    ranked = scratch.table(ranked.select("doc_id", "size", "text_crc32", "source", "_key", "_at", "_band"))
    scratch.drop(rows)

    # level 2: rows before each band (one row per band, so one small task), then the row number inside the band
    counted = ranked.groupBy("_band").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(F.lit(0)).orderBy("_band")
    counted = counted.select(
        F.col("_band").alias("_b"),
        (F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("_skip"),
        F.sum("n").over(Window.partitionBy(F.lit(0))).alias("_all"),
    )
    order = Window.partitionBy("_band").orderBy("_at", F.col("source").asc_nulls_last(), "_key", "doc_id", "text_crc32", "size")
    placed = ranked.withColumn("_no", F.row_number().over(order) - 1).join(counted, F.col("_band") == F.col("_b"))
    placed = placed.withColumn("_pos", F.col("_skip") + F.col("_no"))
    shard = F.expr(f"_pos * {shards} div _all")
    first = F.expr(f"(shard * _all + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("_pos") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )


#: The CRC runs over the bytes of each text, half a byte at a time; the 16-entry table follows from the polynomial.
ORACLE = """
WITH poly AS (
  SELECT list(c ORDER BY n) AS tab FROM (
    SELECT n, list_reduce([n::BIGINT, 0, 0, 0, 0],
      lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(16) r(n))),
d AS (
  SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size,
    xor(list_reduce(
      list_concat([4294967295::BIGINT], flatten(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
        lambda h: [('0x' || h[2])::BIGINT, ('0x' || h[1])::BIGINT]))),
      lambda c, b: xor(c >> 4, tab[(xor(c & 15, b) + 1)::INT])), 4294967295) AS text_crc32
  FROM documents, poly),
k AS (
  SELECT *, md5('42:' || coalesce(doc_id::VARCHAR, 'null') || ':' || text_crc32) AS key FROM d),
r AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY key, doc_id) - 0.5::DOUBLE)
            / count(*) OVER (PARTITION BY source) AS frac
  FROM k),
p AS (
  SELECT *, row_number() OVER (ORDER BY frac, source NULLS LAST, key, doc_id) - 1 AS pos, count(*) OVER () AS n FROM r),
s AS (SELECT *, (pos * 8) // n AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard, pos - (shard * n + 7) // 8 AS slot,
       NULL::INT AS grown_shard, source
FROM s
"""
