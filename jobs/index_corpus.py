"""Keeps the search index of a growing text table up to date.

Reads the Parquet files of the table that no earlier run has read (a file stream with a checkpoint), takes the rows whose path is new or
whose time differs from the one known, chunks their texts and writes files, chunks and postings in folders of the micro-batch. A
batch that is run again after a failure replaces its own folders, so a rerun gives the same index; a run without new files writes
nothing.

    PYTHONPATH=. spark-submit jobs/index_corpus.py --config jobs/index_corpus.json
    python -m jobs.index_corpus --source /data/docs.parquet --target /data/index --checkpoint /data/index-checkpoint

Settings: source (a Parquet file, or a folder of them), target, checkpoint; path and mtime (SQL expressions over a row: where the text
belongs, and when it was changed), text (likewise), chunker (markdown, pages or plain), buckets (folders of postings),
files_per_batch. A null text means that the file is gone. Of one path's rows in a batch the newest counts, of equal times the one whose
text sorts last. Files of the source are never changed in place: a changed row comes in a new file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from tidewell.operators import chunking, ingest_diff
from tidewell.operators import postings as P
from tidewell.sources import index
from tidewell.sources.shared import spread

LOG = common.log("index_corpus")
CHUNKERS = {"markdown": chunking.chunk_markdown, "pages": chunking.chunk_pages, "plain": chunking.chunk_plain}
#: A line of a markdown file that is longer than this fails the file.
MAX_LINE = 1 << 20


def run(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    path: str = "path",
    mtime: str = "mtime",
    text: str = "text",
    chunker: str = "markdown",
    buckets: int | str = P.BUCKETS,
    files_per_batch: int | str = 256,
) -> dict[str, int]:
    """Takes what is new in source. -> numbers of batches, rows read, files taken, unchanged and failed, chunks and postings written."""
    buckets, done = int(buckets), dict.fromkeys(("batches", "read", "taken", "unchanged", "failed", "chunks", "postings"), 0)
    for name in index.SCHEMAS:
        index.table(spark, target, name)
    schema = spark.read.parquet(source).schema

    def take(rows: DataFrame, batch: int) -> None:
        rows = spread(rows).select(F.expr(path).alias("path"), F.expr(mtime).cast("long").alias("mtime"), F.expr(text).alias("text")).filter("path is not null")
        read = common.rows(rows)
        many = rows.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
        if not many.isEmpty():
            rows = rows.groupBy("path").agg(F.max(F.struct("mtime", "text")).alias("r")).select("path", "r.mtime", "r.text")
        # what an earlier try of this batch wrote does not count as known
        known = index.table(spark, target, "files").filter(F.col("batch") < batch).groupBy("path").agg(F.max(F.struct("batch", "mtime")).alias("k")).select("path", F.col("k.mtime").alias("mtime"))
        work = ingest_diff.work_list(rows.select("path", "mtime"), known)
        rows = rows.join(work, ["path", "mtime"], "left_semi")
        long_line = F.exists(F.split("text", "\n"), lambda x: F.octet_length(x) >= MAX_LINE) if chunker == "markdown" else F.lit(False)
        rows = rows.withColumn("error", F.when(long_line, F.lit("line too long")))
        at = F.lit(batch).cast("long").alias("batch")
        common.replace_partitions(rows.filter("error is not null").select("path", "mtime", "error", at), f"{target}/failed", "batch")
        good = rows.filter("error is null")
        made = CHUNKERS[chunker](good.filter("text is not null").select("path", "text"))
        common.replace_partitions(made.select("path", "section", "text", "ordinal", at), f"{target}/chunks", "batch")
        # the rest is made from what was written, so texts are chunked once
        written = index.table(spark, target, "chunks").filter(F.col("batch") == batch)
        words = P.for_writing(P.postings(written, "batch"), buckets)
        common.replace_partitions(words.select("word", "path", "ordinal", "batch", "bucket"), f"{target}/postings", "batch", "bucket")
        count = written.groupBy("path").agg(F.count("*").alias("chunks"))
        ledger = good.select("path", "mtime").join(count, "path", "left").select("path", "mtime", F.coalesce("chunks", F.lit(0)).alias("chunks"), at)
        common.replace_partitions(ledger, f"{target}/files", "batch")
        mine = {name: common.rows(index.table(spark, target, name).filter(F.col("batch") == batch)) for name in index.SCHEMAS}
        found = {"batches": 1, "read": read, "taken": mine["files"], "failed": mine["failed"], "chunks": mine["chunks"], "postings": mine["postings"]}
        for key, n in found.items():
            done[key] += n
        LOG.info("batch %d: %s", batch, ", ".join(f"{n} {key}" for key, n in found.items()))

    # a glob of the one name, as the stream takes folders and globs but no single file
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", int(files_per_batch)).parquet(f"{source.rstrip('/')[:-1]}[{source.rstrip('/')[-1]}]")
    query = new.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done["unchanged"] = done["read"] - done["taken"] - done["failed"]
    LOG.info("read %s, wrote %s: %s", source, target, done)
    return done


if __name__ == "__main__":
    common.main("index_corpus", run, ("source", "target", "checkpoint", "path", "mtime", "text", "chunker", "buckets", "files_per_batch"), __doc__)
