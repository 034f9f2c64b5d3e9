"""Measures search over a text table: what each mode finds for the golden queries, and recall and MRR of each set.

Reads the texts (as a table, or the index that jobs.index_corpus keeps), the golden queries and the vectors; searches in each mode; writes
results, cases and metrics in folders of the mode. A rerun replaces the folders of its modes and leaves the others, so the same
input gives the same output, and modes can be measured one at a time.

    PYTHONPATH=. spark-submit jobs/search_report.py --config jobs/search_report.json

Settings: texts (Parquet with path, section, text and ordinal by the SQL expressions path and section, one chunk a row), or index (the
target of jobs.index_corpus) instead; golden (Parquet), with the expressions query_id, query, set and expect (array of path
suffixes); vectors (Parquet with vector_id and vector) with text_vector and query_vector, the expressions for the id of a text's and a
query's vector (tables without vectors are searched by words only); target; modes (comma-joined); limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from tidewell.plans import evaluate
from tidewell.plans.search import Options, search_batch
from tidewell.sources import index as indexed
from tidewell.sources.shared import spread, stored

LOG = common.log("search_report")


def run(
    spark: SparkSession,
    golden: str,
    target: str,
    texts: str = "",
    index: str = "",
    vectors: str = "",
    path: str = "path",
    section: str = "''",
    query_id: str = "query_id",
    query: str = "query",
    set: str = "'all'",  # noqa: A002 - a setting's name
    expect: str = "expect",
    vector_id: str = "vec_id",
    vector: str = "embedding",
    text_vector: str = "",
    query_vector: str = "",
    modes: str = "text,vector,hybrid",
    limit: int | str = 5,
) -> dict[str, int]:
    """Searches all golden queries in each mode. -> rows read and written."""
    limit = int(limit)
    asked = spark.read.parquet(golden).select(F.expr(query_id).alias("query_id"), F.expr(query).alias("query"), F.expr(set).alias("set"), F.expr(expect).alias("expect"), *([F.expr(query_vector).alias("_v")] if vectors else []))
    if index:
        chunks, postings, texts_of = indexed.chunks(spark, index), indexed.postings(spark, index), None
    else:
        rows = spread(spark.read.parquet(texts)).select(F.expr(path).alias("path"), F.expr(section).alias("section"), "text", F.lit(0).alias("ordinal"), *([F.expr(text_vector).alias("_v")] if vectors and text_vector else []))
        chunks, postings = rows.drop("_v"), None  # all postings would be many times what a few queries need of them
        texts_of = rows.select("path", "ordinal", "_v") if "_v" in rows.columns else None
    if vectors:
        known = spark.read.parquet(vectors).select(F.expr(vector_id).alias("_v"), F.expr(vector).alias("vector")).filter("_v is not null")
        asked = asked.join(known, "_v", "left").drop("_v")
    vectors_of = texts_of.join(known, "_v").drop("_v") if texts_of is not None else None  # without the texts, which are not shuffled
    asked = stored(asked)
    done = {"chunks": common.rows(chunks.select("path")), "queries": common.rows(asked), "results": 0, "cases": 0, "metrics": 0}
    for mode in modes.split(","):
        if mode != "text" and vectors_of is None:
            LOG.info("%s: the texts have no vectors, left out", mode)
            continue
        at = F.lit(mode).alias("mode")
        found = search_batch(chunks, asked.select("query_id", "query", *(["vector"] if vectors else [])), Options(mode, limit), postings=postings, vectors=vectors_of)
        common.replace_partitions(found.select("query_id", "rank", "path", "ordinal", "section", "score", at), f"{target}/results", "mode")
        kept = results(spark, target).filter(F.col("mode") == mode)
        common.replace_partitions(evaluate.first_expected_rank(kept, asked).withColumn("mode", at), f"{target}/cases", "mode")
        mine = cases(spark, target).filter(F.col("mode") == mode)
        common.replace_partitions(evaluate.metrics_by_set(mine).withColumn("mode", at), f"{target}/metrics", "mode")
        counts = {name: common.rows(read(spark, target).filter(F.col("mode") == mode)) for name, read in (("results", results), ("cases", cases), ("metrics", metrics))}
        for name, n in counts.items():
            done[name] += n
        for line in evaluate.report(evaluate.metrics_overall(mine), limit, mode).collect():
            LOG.info("%s", line["line"])
    LOG.info("read %s and %s, wrote %s: %s", index or texts, golden, target, done)
    return done


def results(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/results")


def cases(spark: SparkSession, target: str) -> DataFrame:
    """mode, set, query_id, rank (of the first expected result; 0 if there is none)."""
    return spark.read.parquet(f"{target}/cases")


def metrics(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/metrics")


SETTINGS = ("golden", "target", "texts", "index", "vectors", "path", "section", "query_id", "query", "set", "expect", "vector_id", "vector", "text_vector", "query_vector", "modes", "limit")

if __name__ == "__main__":
    common.main("search_report", run, SETTINGS, __doc__)
