"""Nearest neighbours through pivots against those of all vectors."""

import numpy as np
import pytest

from tidewell.operators import pivots
from tidewell.operators import search as S

CHUNKS = "path string, ordinal int, vector array<float>"


def vectors(spark, rows):
    return spark.createDataFrame([(f"p{i:05}", 0, None if v is None else [float(x) for x in v]) for i, v in enumerate(rows)], CHUNKS).repartition(4)


def asked(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "query_id int, vector array<float>")


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def found(df):
    return sorted((r["query_id"], r["rank"], r["path"], round(r["score"], 6)) for r in df.collect())


@pytest.mark.parametrize(("clusters", "k"), [(20, 5), (0, 5), (3, 400)])
def test_same_rows_as_without(spark, tmp_path, clusters, k):
    """Clustered vectors, where less than half of the rows is read; vectors without clusters; more neighbours than a cell holds."""
    rng = np.random.default_rng(clusters)
    rows = rng.standard_normal((2000, 24))
    if clusters:
        rows = rng.standard_normal((clusters, 24))[rng.integers(0, clusters, 2000)] + 0.1 * rows
    rows = list(unit(rows)) + [None, np.zeros(24)]
    rows[7] = rows[8]  # ties
    chunks, queries = vectors(spark, rows), asked(spark, np.array(rows[5:9]) + 0.01)
    for _ in range(2):  # the second time over what is there
        pivots.write(chunks, str(tmp_path / "t"), 16)
        centres, table = pivots.read(spark, str(tmp_path / "t"))
        assert table.count() == 2001 and len(centres) <= 16
        assert found(pivots.vector_hits(centres, table, queries, k)) == found(S.vector_hits(chunks, queries, k))
    [(_, part)] = pivots.candidates(centres, table, queries, k)
    if clusters and k < 10:
        assert part.count() < 1000
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "cell#" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0] and "reach" in plan.split("PushedFilters:")[1].split("ReadSchema")[0]


def test_nothing_to_search(spark, tmp_path):
    pivots.write(vectors(spark, [None]), str(tmp_path / "t"))
    centres, table = pivots.read(spark, str(tmp_path / "t"))
    assert pivots.vector_hits(centres, table, asked(spark, [[1.0, 0.0]]), 3).count() == 0
    pivots.write(vectors(spark, [[1.0, 0.0]]), str(tmp_path / "t"))
    centres, table = pivots.read(spark, str(tmp_path / "t"))
    assert found(pivots.vector_hits(centres, table, asked(spark, [[1.0, 0.0]]), 3)) == [(0, 1, "p00000", 1.0)]
    assert pivots.vector_hits(centres, table, asked(spark, [[1.0, 0.0]]).filter("false"), 3).count() == 0
