"""Retrieval quality: rank of the first expected result, recall@k and MRR per golden set and overall."""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class GoldenError(ValueError):
    """A golden file that cannot be used."""


def golden_files(folder: str) -> list[str]:
    found = sorted(glob.glob(os.path.join(folder, "*.yaml")) + glob.glob(os.path.join(folder, "*.yml")))
    if not found:
        raise GoldenError(f"no golden sets in {folder}")
    return found


def load_golden(path: str) -> list[tuple[str, list[str]]]:
    """(query, expected path suffixes) cases of a YAML list; every case needs both."""
    import yaml

    with open(path, encoding="utf-8") as f:
        cases = yaml.safe_load(f)
    if not isinstance(cases, list) or not cases:
        raise GoldenError(f"{path}: not a list of cases")
    out = []
    for i, case in enumerate(cases, 1):
        query, expect = (case.get("query"), case.get("expect")) if isinstance(case, dict) else (None, None)
        if not query or not expect:
            raise GoldenError(f"{path}: case {i} needs query and expect")
        out.append((query, [expect] if isinstance(expect, str) else list(expect)))
    return out


def golden_frame(spark: SparkSession, sets: dict[str, list[tuple[str, list[str]]]]) -> DataFrame:
    rows = [(i, name, q, e) for i, (name, q, e) in enumerate((name, q, e) for name, cases in sets.items() for q, e in cases)]
    return spark.createDataFrame(rows, "query_id int, `set` string, query string, expect array<string>")


def first_expected_rank(results: DataFrame, golden: DataFrame) -> DataFrame:
    """query_id, set, rank: of the first result whose path ends with an expected suffix; 0 if none."""
    met = results.join(golden.select("query_id", "expect"), "query_id").filter(F.exists("expect", lambda e: F.endswith(F.col("path"), e)))
    best = met.groupBy("query_id").agg(F.min("rank").alias("rank"))
    return golden.select("query_id", "set").join(best, "query_id", "left").select("query_id", "set", F.coalesce("rank", F.lit(0)).cast("int").alias("rank"))


def _metrics():
    rank = F.col("rank")
    return F.count("*").alias("cases"), F.sum((rank > 0).cast("long")).alias("hits"), F.avg((rank > 0).cast("double")).alias("recall"), F.avg(F.when(rank > 0, 1 / rank).otherwise(0.0)).alias("mrr")


def metrics_by_set(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("set").agg(*_metrics())


def metrics_overall(ranks: DataFrame) -> DataFrame:
    return ranks.agg(*_metrics())


def report(metrics: DataFrame, limit: int, mode: str = "") -> DataFrame:
    """line: one line per row of metrics; without a mode, as for all sets together."""
    # fixed value: the format of the line
    form = f"recall@{limit} %.2f (%d/%d)   MRR %.3f" + (f"   mode={mode}" if mode else "")
    return metrics.withColumn("line", F.format_string(form, "recall", "hits", "cases", "mrr"))


def case_report(results: DataFrame, golden: DataFrame) -> DataFrame:
    """query_id, set, no (from 1 in its set), rank, query, found (the first expected path, or null), expect of every case."""
    met = results.join(golden.select("query_id", "expect"), "query_id").filter(F.exists("expect", lambda e: F.endswith(F.col("path"), e)))
    best = met.groupBy("query_id").agg(F.min("rank").alias("rank"), F.min_by("path", "rank").alias("found"))
    no = F.row_number().over(Window.partitionBy("set").orderBy("query_id"))
    return golden.withColumn("no", no).join(best, "query_id", "left").select("query_id", "set", "no", F.coalesce("rank", F.lit(0)).alias("rank"), "query", "found", "expect")
