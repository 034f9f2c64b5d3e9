"""A landing folder as a stream: each micro-batch of new files goes through the same chunk, embed and replace steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.plans.ingest import apply_files, guard_embedder
from tidewell.sources.embed import Embedder
from tidewell.sources.store import ChunkStore


#: Schema of the binaryFile source.
_BINARY = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.readStream.schema(_BINARY).format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("modificationTime").cast("long").alias("mtime"), "content")


def ingest_stream(store: ChunkStore, folder: str, embedder: Embedder, checkpoint: str) -> StreamingQuery:
    """Each batch goes the way of ingest: files that became empty lose their chunks, broken ones keep them and are listed in
    dead_letters (Spark's file source never reports a file of no bytes). Replays of a batch are harmless: both writes replace what the batch wrote."""
    guard_embedder(store, embedder)

    def batch(files: DataFrame, number: int) -> None:
        files = files.persist()
        _, failures = apply_files(store, files, embedder)
        if not failures.isEmpty():
            failures.write.mode("overwrite").parquet(f"{store.root}/dead_letters/batch={number}")
        failures.unpersist()
        files.unpersist()

    return stream_files(store.spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dead_letters(store: ChunkStore) -> DataFrame:
    """path, error, batch of the files that failed; empty if none did."""
    schema = "path string, error string, batch long"
    fs, p = store._fs(f"{store.root}/dead_letters")
    return store.spark.read.schema(schema).parquet(f"{store.root}/dead_letters") if fs.exists(p) else store.spark.createDataFrame([], schema)
