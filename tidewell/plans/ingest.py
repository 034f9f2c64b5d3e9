"""index: discover, diff, chunk, embed and replace by path. Broken files are listed and do not stop the run."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import embedding_text
from tidewell.operators import ingest_diff
from tidewell.sources.csvsplit import chunk_csv_lines, read_lines
from tidewell.sources.embed import Embedder, embedding
from tidewell.sources.files import changed, clean, discover, read_files, sizes, with_format
from tidewell.sources.files import chunk_files as chunk
from tidewell.sources.shared import stored
from tidewell.sources.store import ChunkStore

#: How often files that change during a run are read again.
ROUNDS = 2
#: CSV files of more bytes are read in splits.
LARGE_CSV = 64 << 20


class IngestError(RuntimeError):
    """The run cannot start, or some files failed."""


@dataclass(frozen=True)
class Stats:
    total: int
    failed: int
    skipped: int
    removed: int
    chunks: int
    written: int = 0

    def line(self) -> str:
        # fixed value: the wording of the summary
        tail = f" ({self.skipped} unchanged skipped, {self.removed} stale removed)" if self.skipped or self.removed else ""
        return f"{self.written} chunks indexed, {self.chunks} in the database{tail}"


def guard_embedder(store: ChunkStore, embedder: Embedder) -> None:
    """A database keeps the embedder it began with; an empty one is stamped."""
    meta = store.meta()
    known = meta.get("embedder", "")
    if not known:
        store.set_meta({**meta, "embedder": embedder.id})
    elif known != embedder.id:
        raise IngestError(f"the database was built with {known}, not {embedder.id}: reindex")


def embed_chunks(chunks: DataFrame, files: DataFrame, embedder: Embedder, home: str = "", known: DataFrame | None = None) -> DataFrame:
    """chunks ready to store: the vector is that of the enriched text, the stored text stays as it is.

    known: chunks with vectors of the same embedder. A chunk whose enriched text is that of one of them takes its vector, so text that
    did not change is not embedded again, wherever in its file it stands.
    """
    enriched = embedding_text("path", "section", F.coalesce("text", F.lit("")), home)
    rows = chunks.join(files.select("path", "mtime"), "path")
    if known is None:
        return rows.withColumn("vector", embedding(embedder, enriched))
    old = known.join(files.select("path"), "path", "left_semi").filter("vector is not null")
    old = old.groupBy("path", F.sha2(enriched.cast("binary"), 256).alias("_key")).agg(F.min("vector").alias("_known"))
    rows = rows.withColumn("_key", F.sha2(enriched.cast("binary"), 256)).join(old, ["path", "_key"], "left")
    rows = rows.withColumn("vector", embedding(embedder, F.when(F.col("_known").isNull(), enriched)))
    return rows.withColumn("vector", F.coalesce("_known", "vector")).drop("_key", "_known")


def apply_files(store: ChunkStore, read: DataFrame, embedder: Embedder, home: str = "", parsers: dict | None = None) -> tuple[int, DataFrame]:
    """Chunks, embeds and stores files (path, mtime, content, maybe error) -> chunks written, and the failures (path, error).

    A file without chunks loses those it had; one that fails keeps them.
    """
    chunks, failures = chunk(read, parsers)
    chunks, failures = chunks.cache(), failures.cache()
    known = store.chunks(store.buckets_of(read)) if store.version() else None
    store.upsert(embed_chunks(chunks, read, embedder, home, known))
    empty = read.select("path").join(chunks.select("path").distinct(), "path", "left_anti").join(failures, "path", "left_anti")
    if not empty.isEmpty():
        store.delete(empty)
    written = chunks.count()
    chunks.unpersist()
    return written, failures


def apply_large_csv(store: ChunkStore, work: DataFrame, embedder: Embedder, home: str = "", over: int | None = None) -> tuple[int, DataFrame, DataFrame]:
    """CSV files of more than `over` bytes are read in splits, one file after the other, and never stand in one row -> chunks written,
    the failures (path, error), and the files that are left."""
    spark, over = store.spark, LARGE_CSV if over is None else over
    csv = with_format(work).filter("format = 'csv'").select("path")
    large = [r["path"] for r in sizes(csv).filter(F.col("size") > over).collect()]  # few, as they are large
    written, failed = 0, []
    for path in large:
        try:
            chunks = stored(chunk_csv_lines(read_lines(spark, path).withColumn("path", F.lit(path))))
            file = work.filter(F.col("path") == path)
            known = store.chunks(store.buckets_of(file)) if store.version() else None
            store.upsert(embed_chunks(chunks, file, embedder, home, known))
            if chunks.isEmpty():
                store.delete(file)
            written += chunks.count()
        except PySparkException as e:  # one broken file must not end the run
            failed.append((path, str(e)[:1000]))
    return written, spark.createDataFrame(failed, "path string, error string"), work.filter(~F.col("path").isin(large)) if large else work


def ingest(store: ChunkStore, roots: list[str], embedder: Embedder, force: bool = False, reset: bool = False, parsers: dict | None = None, strict: bool = False) -> tuple[Stats, DataFrame]:
    """-> statistics and the failures (path, error). reset drops everything first; force reads unchanged files again.

    A file without chunks loses those it had; one that fails keeps them. strict raises if a file failed. A file that is changed while
    the run reads and embeds it is read again, ROUNDS times at most; if it still changes, its stored time is an old one and the next
    run takes it.
    """
    spark = store.spark
    if reset:
        store.reset()
    guard_embedder(store, embedder)
    roots = [clean(r) for r in roots]
    files = discover(spark, roots).cache()
    known = store.paths()
    work = ingest_diff.work_list(files, known, force)
    gone = ingest_diff.vanished(known, files, roots).cache()
    total, removed = work.count(), gone.count()
    unchanged = files.count() - total
    if not total and not unchanged and not removed:
        raise IngestError("no supported files found")
    if removed:
        store.delete(gone)
    if not total:
        return Stats(0, 0, unchanged, removed, store.count()), spark.createDataFrame([], "path string, error string")
    written, failures, small = apply_large_csv(store, work, embedder, os.path.expanduser("~"))
    work = stored(small)
    for again in range(ROUNDS + 1):
        # few large files make few rows: one file a task at most
        read = read_files(work.repartition(min(total, 4 * spark.sparkContext.defaultParallelism), "path")).cache()
        more, failures_now = apply_files(store, read, embedder, os.path.expanduser("~"), parsers)
        written += more
        # a file that was read again counts as it was read last
        failures = failures.join(read.select("path"), "path", "left_anti").unionByName(failures_now)
        edited = stored(changed(work))
        read.unpersist()
        if again == ROUNDS or edited.isEmpty():
            break
        work = edited
    failed = failures.count()
    stats = Stats(total, failed, unchanged, removed, store.count(), written)
    if failed and strict:
        raise IngestError(f"{failed} of {total} files failed")
    return stats, failures
