"""The search index of a text table: tables of files, chunks and postings in folders of the batch that wrote them.

A batch adds folders and never changes those of another. A file's rows are those of the last batch that holds the file, so a changed
file costs its own rows only, and a file without text any more has an entry in files and no chunks. A batch counts once its files are
written, which happens last: readers do not see one that is half done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, mtime long, chunks long, batch long"
CHUNKS = "path string, section string, text string, ordinal int, batch long"
POSTINGS = "word string, path string, ordinal int, batch long, bucket int"
FAILED = "path string, mtime long, error string, batch long"
SCHEMAS = {"files": FILES, "chunks": CHUNKS, "postings": POSTINGS, "failed": FAILED}
#: More files than this that later batches hold too are joined by shuffle.
OLD_ROWS = 200_000
PARTITIONS = {"postings": ("batch", "bucket")}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the tables with all its batches; made if it is not there yet."""
    path = f"{root}/{name}"
    spark.createDataFrame([], SCHEMAS[name]).write.mode("ignore").partitionBy(*PARTITIONS.get(name, ("batch",))).parquet(path)
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def files(spark: SparkSession, root: str) -> DataFrame:
    """path, mtime, chunks, batch of each file, as its last batch has it."""
    last = table(spark, root, "files").groupBy("path").agg(F.max(F.struct("batch", "mtime", "chunks")).alias("last"))
    return last.select("path", "last.mtime", "last.chunks", "last.batch")


def _live(rows: DataFrame, root: str) -> DataFrame:
    """The rows of batches that count, without those of files that a later batch holds too. Only these files are joined: a table whose
    files were taken once is read as it is, with no shuffle of its rows."""
    spark = rows.sparkSession
    held = table(spark, root, "files").select("path", "batch")
    last = held.groupBy("path").agg(F.max("batch").alias("last"), F.count("*").alias("n")).filter("n > 1").select("path", "last")
    old = held.join(last, "path").filter("batch < last").select("path", "batch")
    rows = rows.join(F.broadcast(held.select("batch").distinct()), "batch", "left_semi")  # a row a batch
    few = old.limit(OLD_ROWS + 1).count()
    return rows if not few else rows.join(F.broadcast(old) if few <= OLD_ROWS else old, ["path", "batch"], "left_anti")


def chunks(spark: SparkSession, root: str) -> DataFrame:
    """path, section, text, ordinal of all files."""
    return _live(table(spark, root, "chunks"), root).drop("batch")


def postings(spark: SparkSession, root: str) -> DataFrame:
    """word, path, ordinal, bucket of all files. A filter on bucket reaches the folders."""
    return _live(table(spark, root, "postings"), root).select("word", "path", "ordinal", "bucket")


def failed(spark: SparkSession, root: str) -> DataFrame:
    """path, error of the files whose last version could not be taken; what they had before stays in the index."""
    last = table(spark, root, "failed").groupBy("path").agg(F.max(F.struct("batch", "mtime", "error")).alias("last"))
    good = files(spark, root).select("path", F.col("batch").alias("good"))
    return last.join(good, "path", "left").filter("good is null or good < last.batch").select("path", "last.error")
