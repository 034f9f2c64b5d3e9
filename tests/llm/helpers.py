"""Small nasty tables: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]
    + [T.StructField(n, T.StringType()) for n in ("_row", "_no", "key", "n", "size", "shard", "kept", "score", "run", "copies", "_slot", "_word", "_mask", "a.b", "component_id")]
)
EXTRA = ("x",) * 15


def frame(spark, rows, parts=3):
    """rows: (doc_id, text, lang, source) tuples."""
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary):x}" for _ in range(n))


def corpus(seed=1, n=60):
    """Documents with exact and near copies, passages, blanks, nulls and repeated rows."""
    rng = random.Random(seed)
    passage = words(rng, 60)
    rows = []
    for i in range(n):
        kind = i % 10
        if kind < 3 or not rows:
            t = words(rng, rng.choice((3, 8, 40, 120)))
        elif kind < 5:
            t = rng.choice(rows)[1]
        elif kind < 8:
            base = (rng.choice(rows)[1] or "none at all").split(" ")
            for _ in range(rng.randrange(4)):
                base[rng.randrange(len(base))] = f"edit{rng.randrange(99)}"
            t = " ".join(base)
        else:
            t = words(rng, 10) + "\n" + passage + "\n" + words(rng, 5)
        rows.append((i, t, rng.choice(("en", "fr", None)), rng.choice(("s1", "s1", "s2", None))))
    rows += [(n, None, "en", "s1"), (n + 1, "", None, None), (n + 2, " \t\n ", "fr", "s2"), (n + 3, "é" * 7, "en", "s3"), (n + 4, words(rng, 5000), "en", "s1")]
    rows += [(None, "lonely words of no id at all", "en", "s1"), (None, None, None, None), rows[3], rows[3]]
    return rows


NASTY = corpus()
