"""Near-duplicate vectors against all pairs."""

import logging
import math
import random

import numpy as np
from pyspark.sql import types as T

from tidewell.llm import neardup

CLASHING = ("id", "ball", "m", "vec", "code", "dim", "near", "key", "low", "n_links", "a.b")


def table(spark, rows, item=None, ids=None, parts=3):
    """rows: (vec_id, embedding, label), with columns of the names that the operator uses inside."""
    kinds = [T.StructField("vec_id", ids or T.LongType()), T.StructField("embedding", T.ArrayType(item or T.FloatType())), T.StructField("label", T.IntegerType())]
    kinds += [T.StructField(c, T.StringType()) for c in CLASHING]
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], T.StructType(kinds)).repartition(parts)


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def slow(rows, least=0.93, single=True):
    """(n_links, component's first row in the order of ids) of each row."""
    n = len(rows)
    unit = []
    for _, v, label in rows:
        if label is None or not usable(v):
            unit.append(None)
            continue
        x = np.array(v, np.float32 if single else np.float64).astype(np.float64)
        x = x / np.abs(x).max()
        unit.append(x / np.linalg.norm(x))
    near = [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                near[i].append(j)
                near[j].append(i)
    place = lambda r: (rows[r][0] is None, rows[r][0] or 0)
    comp = {}
    for i in sorted(range(n), key=place):
        todo = [i] if i not in comp else []
        while todo:
            j = todo.pop()
            if j not in comp:
                comp[j] = rows[i][0]
                todo += near[j]
    return sorted(((rows[i][0] is None, rows[i][0] or 0, len(near[i]), comp[i] if comp[i] is not None else -1) for i in range(n)))


def found(df):
    got = df.collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"] if r["component_id"] is not None else -1) for r in got)


def cloud(seed, n=400, dim=16, labels=3):
    """Strangers, families of close copies, chains of links, exact copies, and vectors at about the bound."""
    rng = np.random.default_rng(seed)
    pick = random.Random(seed)
    out = []
    for i in range(n):
        base = pick.choice(out) if out and pick.random() < 0.7 else None
        if base is None:
            out.append((rng.standard_normal(dim), pick.randrange(labels)))
        elif pick.random() < 0.2:
            out.append((base[0] * pick.choice((1.0, 2.0)), base[1] if pick.random() < 0.8 else pick.randrange(labels)))
        else:
            noise = rng.standard_normal(dim)
            wanted = pick.choice((0.999, 0.985, 0.95, 0.931, 0.929))
            b = base[0] / np.linalg.norm(base[0])
            noise -= (noise @ b) * b
            out.append((wanted * b + math.sqrt(1 - wanted**2) * noise / np.linalg.norm(noise), base[1]))
    ids = list(range(n))
    pick.shuffle(ids)
    return [(i, [float(x) for x in v], label) for i, (v, label) in zip(ids, out, strict=True)]


NASTY = [
    (900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, [float("inf")] + [1.0] * 15, 1), (905, [None] + [1.0] * 15, 1), (906, [1.0] * 16, None),
    (907, [1.0] * 16, 1), (908, [2.0] * 16, 1), (909, [1.0] * 8, 1), (910, [-1.0] * 16, 1), (911, [1e-30] * 16, 1), (912, [1e30] * 16, 1), (907, [1.0] * 16, 1), (907, [-1.0] * 16, 1),
    (None, [1.0] * 16, 1), (None, [5.0] + [0.0] * 15, 2), (None, None, None), (913, [0.0, -0.0] + [1.0] * 14, 4), (914, [-0.0, 0.0] + [1.0] * 14, 4),
]


def test_against_all_pairs(spark):
    rows = cloud(1)
    assert found(neardup.near_duplicates(table(spark, rows))) == slow(rows)


def test_nasty_rows(spark):
    rows = cloud(3, 120) + NASTY
    assert found(neardup.near_duplicates(table(spark, rows))) == slow(rows)


def test_doubles_and_string_ids(spark):
    rows = cloud(4, 150) + [(800, [1e200] * 16, 0), (801, [1e-200] * 16, 0)]
    assert found(neardup.near_duplicates(table(spark, rows, T.DoubleType()))) == slow(rows, single=False)
    named = [(f"v{i:04}", v, label) for i, v, label in rows]
    got = neardup.near_duplicates(table(spark, named, T.DoubleType(), T.StringType())).collect()
    want = {f"v{i:04}": (n, f"v{c:04}") for _, i, n, c in slow(rows, single=False)}
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want


def test_large_families(spark):
    """One family of close copies and one of exact copies, over several Arrow batches and blocks; one ball each."""
    rng = np.random.default_rng(9)
    base, other = rng.standard_normal(64), rng.standard_normal(64)
    rows = [(i, [float(x) for x in base + 0.05 * rng.standard_normal(64)], 1) for i in range(900)]
    rows += [(1000 + i, [float(x) for x in other], 1) for i in range(600)]
    rows += [(2000 + i, [float(x) for x in rng.standard_normal(64)], 1) for i in range(300)]
    limit = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = neardup.near_duplicates(table(spark, rows, parts=2)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)
    by = {r["vec_id"]: r for r in got}
    assert {by[i]["n_links"] for i in range(900)} == {899} and {by[i]["component_id"] for i in range(900)} == {0}
    assert {by[1000 + i]["n_links"] for i in range(600)} == {599} and {by[1000 + i]["component_id"] for i in range(600)} == {1000}
    assert len({by[i]["ball"] for i in range(900)}) <= 4 and len({by[1000 + i]["ball"] for i in range(600)}) == 1


def test_low_bound_grows_lists(spark):
    """At a low bound nearly all rows of a label are linked: lists grow far beyond k."""
    rows = [(i, [abs(x) for x in v], label) for i, v, label in cloud(6, 200, labels=1)]
    assert found(neardup.near_duplicates(table(spark, rows), least=0.7, k=3)) == slow(rows, 0.7)


def test_audit_adds_turns(spark, caplog):
    """A search too small for its data says so, and never reports a link that is none."""
    rows = cloud(7, 300, dim=32, labels=1)
    with caplog.at_level(logging.WARNING):
        weak = neardup.near_duplicates(table(spark, rows), k=1, trees=1, rounds=0, turns=1, recall=1.01).collect()
    assert "the audit found" in caplog.text
    truth = {i: n for _, i, n, _ in slow(rows)}
    assert all(r["n_links"] <= truth[r["vec_id"]] for r in weak)


def test_empty_table(spark):
    got = neardup.near_duplicates(table(spark, []))
    assert got.count() == 0 and got.columns == ["vec_id", "n_links", "component_id", "kept", "ball"]
    assert found(neardup.near_duplicates(table(spark, NASTY[:7]))) == slow(NASTY[:7])
