"""Exact nearest neighbours that read a part of the vectors: a table in cells around pivots, pruned by the triangle inequality.

Each vector lies in the cell of its nearest pivot, at a distance called its reach; the table is stored in folders of the cell, sorted by
reach. The vectors of a query's own cell give a bound B on the distance of its k-th neighbour. A vector nearer than B to a query at distance
D from a pivot has a reach between D - B and D + B, so of every cell only that range is read, and cells whose border is farther away
than B not at all. What is read goes through the same comparison as without pivots, so the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import search as S

#: Pivots, and the vectors (chosen by hash) that they are picked from: what the driver holds.
PIVOTS, SAMPLE = 64, 4096
#: Distances are rounded far below this.
_SLACK = 1e-5


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0.0))


def pick(chunks: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Pivots far from each other: each next one is the vector of the sample that is farthest from those before."""
    some = chunks.filter("vector is not null").orderBy(F.xxhash64("path", "ordinal"), "path", "ordinal").limit(sample).select("vector").toPandas()["vector"]
    if not len(some):
        return np.empty((0, 0))
    rows = np.stack([np.asarray(v, np.float64) for v in some])
    found, away = [0], _distances(rows, rows[:1])[:, 0]
    while len(found) < pivots and away.max() > _SLACK:
        found.append(int(away.argmax()))
        away = np.minimum(away, _distances(rows, rows[found[-1:]])[:, 0])
    return rows[found]


def assigned(chunks: DataFrame, pivots: np.ndarray) -> DataFrame:
    """path, ordinal, vector, cell, reach of the chunks with a vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            away = _distances(np.stack([np.asarray(v, np.float64) for v in batch["vector"]]), pivots)
            cell = away.argmin(1)
            yield batch.assign(cell=cell.astype(np.int32), reach=away[np.arange(len(cell)), cell])

    slim = chunks.filter("vector is not null and path is not null").select("path", F.col("ordinal").cast("int").alias("ordinal"), F.col("vector").cast("array<float>").alias("vector"))
    return slim.mapInPandas(run, "path string, ordinal int, vector array<float>, cell int, reach double")


def write(chunks: DataFrame, folder: str, pivots: int = PIVOTS) -> None:
    """The table of the chunks' vectors in folder, replacing what is there. Cells are dealt by reach too, so that a cell of very many
    vectors is several files, each of a range of reaches."""
    spark, found = chunks.sparkSession, pick(chunks, pivots)
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(found)]
    spark.createDataFrame(rows, "cell int, vector array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/pivots")
    if rows:
        assigned(chunks, found).repartitionByRange("cell", "reach").sortWithinPartitions("cell", "reach").write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/rows")


def read(spark: SparkSession, folder: str) -> tuple[np.ndarray, DataFrame]:
    """(pivots, rows) of a written table."""
    found = spark.read.parquet(f"{folder}/pivots").orderBy("cell").toPandas()["vector"]
    schema = "path string, ordinal int, vector array<float>, reach double, cell int"
    if not len(found):
        return np.empty((0, 0)), spark.createDataFrame([], schema)
    return np.stack([np.asarray(v, np.float64) for v in found]), spark.read.schema(schema).parquet(f"{folder}/rows")


def within(pivots: np.ndarray, queries: np.ndarray, bounds: np.ndarray) -> Column:
    """The rows that can be within its bound of some query."""
    away = _distances(queries, pivots)
    border = (away - away.min(1, keepdims=True)) / 2
    near = border <= bounds[:, None] + _SLACK
    keep = F.lit(False)
    for cell in np.flatnonzero(near.any(0)):
        q = near[:, cell]
        low, high = (away[q, cell] - bounds[q]).min() - _SLACK, (away[q, cell] + bounds[q]).max() + _SLACK
        keep = keep | ((F.col("cell") == int(cell)) & ((F.col("reach") >= float(max(low, 0.0))) & (F.col("reach") <= float(high)) if np.isfinite(high) else F.lit(True)))
    return keep


def candidates(pivots: np.ndarray, rows: DataFrame, queries: DataFrame, k: int) -> Iterator[tuple[DataFrame, DataFrame]]:
    """(queries, rows to compare them with), a block of queries at a time."""
    spark = rows.sparkSession
    kind = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vector array<double>"
    for ids, vectors in S._query_blocks(queries):
        block = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)], kind)
        own = np.unique(_distances(vectors, pivots).argmin(1)).tolist()
        first = S.vector_hits(rows.filter(F.col("cell").isin(own)), block, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("score"))
        found = {r["query_id"]: np.sqrt(max(2 * (1 - r["score"]), 0.0)) for r in first.collect() if r["n"] >= k}
        bounds = np.array([found.get(i, np.inf) for i in ids])
        yield block, rows.filter(within(pivots, vectors, bounds))


def vector_hits(pivots: np.ndarray, rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """operators.search.vector_hits over a written table: query_id, path, ordinal, score, rank."""
    out = None
    for block, part in candidates(pivots, rows, queries, k) if len(pivots) else ():
        hits = S.vector_hits(part, block, k)
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else S.vector_hits(rows, queries, k)
