"""Where intermediate results go: the folder named by spark.checkpoint.dir, which all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Shuffle files of a plan go as soon as its result is written; the result is a table, so nobody reads them again.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset a local session (tests on one machine) gets a folder of its own; a
    cluster is refused, as its executors would not find each other's files in one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="tidewell-")
        shared_folder.own = folder
        folder = "file://" + folder
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder


def _tables(spark: SparkSession) -> str:
    """The folder of this application's tables, which goes with the application."""
    root = f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}"
    if getattr(_tables, "known", None) != root:
        fs, path = _fs(spark, root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _tables.known = root
    return root


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables that no plan reads any more."""
    for df in tables:
        path = getattr(df, "_tw_path", None)
        if path:
            fs, p = _fs(df.sparkSession, path)
            fs.delete(p, True)


@contextmanager
def steps(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables made inside go at the end, but for those passed to the function it gives (the outer scope, if any, has them then)."""
    made: list[str] = []
    _scopes.append(made)
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._tw_path)
        return df

    try:
        yield keep
    finally:
        _scopes.pop()
        if _scopes:
            _scopes[-1].extend(kept)
        for path in set(made) - set(kept):
            fs, p = _fs(spark, path)
            fs.delete(p, True)


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Arrow batches of about 4 MB in this session, unless it was told otherwise: an executor holds each batch a few times, in the
    JVM and in its Python workers, and the default of 64 MB leaves little room beside the heap."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64m", "64MB"):
        spark.conf.set(name, size)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once, with its lineage cut. For small tables and loop states.

    A written table rather than checkpoint(): a checkpointed plan carries its constraints along, which grow in loops.
    """
    return table(df)


def table(df: DataFrame, options: dict[str, str] | None = None, by: str | None = None) -> DataFrame:
    """df, computed once and kept as a compressed Parquet table in the shared folder, in folders of the values of by."""
    spark = df.sparkSession
    path = f"{_tables(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        writer = df.write.options(**(options or {}))
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tw_path = path
    return out


def bitmap(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """(_word, _mask): the hashes of keys as a bitmap, of bits / 64 rows at most however many keys there are."""
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    words = keys.select(slot.alias("_slot")).select(F.expr("cast(_slot div 64 as int)").alias("_word"), F.expr("shiftleft(1L, cast(_slot & 63 as int))").alias("_m"))
    return words.groupBy("_word").agg(F.bit_or("_m").alias("_mask"))


def mark(df: DataFrame, key: Column, words: DataFrame, bits: int, name: str) -> DataFrame:
    """df with a boolean column: false if the row's key is not in the bitmap, which is broadcast."""
    words = words.toDF("__tw_word", "__tw_mask")  # names that no table is likely to have
    rows = df.withColumn("__tw_slot", F.pmod(F.xxhash64(key), F.lit(bits))).withColumn("__tw_word", F.expr("cast(__tw_slot div 64 as int)"))
    rows = rows.join(F.broadcast(words), "__tw_word", "left")
    hit = F.expr("coalesce(__tw_mask & shiftleft(1L, cast(__tw_slot & 63 as int)), 0L) <> 0")
    return rows.withColumn(name, hit).drop("__tw_slot", "__tw_word", "__tw_mask")


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, keys_key: Column, bits: int = 1 << 22) -> DataFrame:
    """df without most of the rows whose key is not among keys.

    Rows that pass may still be strangers (more of them the more keys there are); an exact join follows.
    """
    return mark(df, key, bitmap(keys, keys_key, bits), bits, "__tw_maybe").filter("__tw_maybe").drop("__tw_maybe")


def keyed(docs: DataFrame, id_col: str) -> DataFrame:
    """docs with __tw_key, a unique long that orders the rows by id (null last; rows of one id as they are read).

    That is the id itself where ids are whole, unique and never null. Otherwise docs are written once, sorted, with a number:
    row numbers of a plan that is run twice need not agree. One id of very many rows is sorted in several ranges.
    """
    id_ = F.col(f"`{id_col}`")
    if docs.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        n, known, different = docs.agg(F.count(F.lit(1)), F.count(id_), F.count_distinct(id_)).first()
        if n == known == different:
            return docs.withColumn("__tw_key", id_.cast("long"))
    rows = docs.withColumn("__tw_no", F.monotonically_increasing_id()).orderBy(id_.asc_nulls_last(), "__tw_no").drop("__tw_no")
    return table(rows.withColumn("__tw_key", F.monotonically_increasing_id()))


def without(docs: DataFrame, gone: DataFrame, columns: list[str], bits: int = 1 << 22) -> DataFrame:
    """The columns of the rows of docs (keyed) whose __tw_key is not in gone.key.

    Only rows that a bitmap of the keys lets through are shuffled for the exact anti-join.
    """
    rows = mark(docs, F.col("__tw_key"), bitmap(gone, F.col("key"), bits), bits, "__tw_maybe")
    doubtful = rows.filter("__tw_maybe").join(gone.select(F.col("key").alias("__tw_key")), "__tw_key", "left_anti")
    out = [F.col(f"`{c}`") for c in columns]
    return rows.filter("not __tw_maybe").select(*out).unionByName(doubtful.select(*out))


def keep_rows(docs: DataFrame, text_col: str, keep: Callable[[Iterator[pa.Array]], Iterator[np.ndarray]]) -> DataFrame:
    """The rows of docs for whose texts keep says true, in docs' columns. keep maps a stream of text arrays to one of masks."""
    small_batches(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]  # column names with dots cannot be passed to Arrow functions
    at = docs.columns.index(text_col)
    plain = docs.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def texts() -> Iterator[pa.Array]:
            for batch in batches:
                held.append(batch)
                yield batch.column(at)

        for mask in keep(texts()):
            yield held.pop().filter(pa.array(mask))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs -> (node, comp), comp the smallest node of its connected component.

    Every round hooks each node to its smallest neighbour, shortens the chains and contracts the edges; states are written
    tables. Hubs are aggregated before the shuffle, and nothing but the number of open edges reaches the driver.
    """
    with steps(edges.sparkSession) as keep:
        return keep(_components(edges))


def _components(edges: DataFrame) -> DataFrame:
    edges = table(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    known = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        parent = table(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("comp")))
        while True:
            up = parent.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
            jumped = table(parent.join(up, "comp").select("node", F.col("top").alias("comp"), (F.col("top") != F.col("comp")).alias("moved")))
            drop(parent)
            parent = jumped
            if jumped.filter("moved").isEmpty():
                break
        if known is None:
            known = table(parent.select("node", "comp"))
        else:
            up = parent.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
            more = table(known.join(up, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")))
            drop(known)
            known = more
        p, q = parent.select(F.col("node").alias("a"), F.col("comp").alias("pa")), parent.select(F.col("node").alias("b"), F.col("comp").alias("pb"))
        left = edges.join(p, "a").join(q, "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        left = table(left)
        drop(edges, parent)
        edges = left
    if known is None:
        return table(edges.select(F.col("a").alias("node"), F.col("b").alias("comp")))
    return known
