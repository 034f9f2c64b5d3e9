"""Vector column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays. The sum is in double precision, the division in single."""
    n = norm(v).cast("float")
    return F.when(n == 0, v.cast("array<float>")).otherwise(F.transform(v, lambda x: F.try_divide(x.cast("float"), n).cast("float")))
