"""The jobs as queries: each runs its function twice into a new folder of the shared one and gives the output as it then stands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import index_corpus, search_report
from tidewell.plans import oracles
from tidewell.sources import index
from tidewell.sources.shared import new_folder

PATH = "concat('docs/', source, '/', lang, '/', doc_id, '.md')"
INDEX = {"path": PATH, "mtime": "1700000000 + doc_id"}
REPORT = {
    "path": PATH, "section": "lang", "query_id": "item_id", "query": "text", "set": "if(item_id % 2 = 0, 'even', 'odd')",
    "expect": "array(concat('/', item_id, '.md'), '0.md', '5.md')", "text_vector": "doc_id", "query_vector": "7 * item_id + 3",
}


def job1_index_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The index of documents: a row a chunk, with the number of its postings and a digest of their words."""
    root = new_folder(spark, "job1")
    for _ in range(2):
        index_corpus.run(spark, f"{d}/documents.parquet", f"{root}/tables", f"{root}/checkpoint", **INDEX)
    words = index.postings(spark, f"{root}/tables").groupBy("path", "ordinal").agg(F.count("*").alias("words"), F.md5(F.array_join(F.array_sort(F.collect_list("word")), " ").cast("binary")).alias("words_md5"))
    chunks = index.chunks(spark, f"{root}/tables").join(index.files(spark, f"{root}/tables").select("path", "mtime"), "path")
    text = [F.octet_length("text").cast("long").alias("bytes"), F.md5(F.col("text").cast("binary")).alias("md5")]
    return chunks.join(words, ["path", "ordinal"], "left").select("path", "mtime", "section", "ordinal", *text, F.coalesce("words", F.lit(0)).alias("words"), F.coalesce("words_md5", F.md5(F.lit("").cast("binary"))).alias("words_md5"))


def job2_search_report(spark: SparkSession, d: str) -> DataFrame:
    """Results of the benchmark items in all modes, with the rank of the first expected one and the metrics of mode and set."""
    target = new_folder(spark, "job2")
    for _ in range(2):
        search_report.run(spark, f"{d}/benchmark.parquet", target, texts=f"{d}/documents.parquet", vectors=f"{d}/embeddings.parquet", **REPORT)
    cases = search_report.cases(spark, target).withColumnRenamed("rank", "expected_rank")
    metrics = search_report.metrics(spark, target).select("mode", "set", "cases", "hits", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))
    found = search_report.results(spark, target).select("mode", "query_id", "rank", "path", F.round("score", 5).alias("score"))
    return cases.join(found, ["mode", "query_id"], "left").join(metrics, ["mode", "set"]).select("mode", "set", "query_id", "expected_rank", "rank", "path", "score", "cases", "hits", "recall", "mrr")


ORACLES = {
    "job1_index_corpus": rf"""WITH {oracles._FILES},
      b AS (SELECT path, mtime, trim(text, {oracles._BLANK}) AS body FROM f),
      cut AS (SELECT path, mtime, body, unnest(range(CASE WHEN strlen(body) > 1500 THEN ceil(length(body) / 1500)::BIGINT ELSE 1 END)) AS i FROM b WHERE body <> ''),
      c AS (SELECT path, mtime, i, CASE WHEN strlen(body) > 1500 THEN trim(substr(body, i * 1500 + 1, 1500), {oracles._BLANK}) ELSE body END AS text FROM cut),
      w AS (SELECT path, mtime, i, text, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{Nd}}_]+'), lambda x: x <> ''))) AS w FROM c)
      SELECT path, mtime, '' AS section, (row_number() OVER (PARTITION BY path ORDER BY i) - 1)::INT AS ordinal, strlen(text)::BIGINT AS bytes, md5(text) AS md5,
        len(w)::BIGINT AS words, md5(array_to_string(w, ' ')) AS words_md5 FROM w""",
    "job2_search_report": f"""WITH {oracles._TEXT}, {oracles._VEC},
      h2 AS (SELECT query_id, path, sum(1 / (60 + rank)) / (2.0::DOUBLE / 61) AS score
        FROM (SELECT query_id, path, rank FROM vec WHERE rank <= 15 UNION ALL SELECT query_id, path, rank FROM txt WHERE rank <= 15) GROUP BY ALL),
      res AS (SELECT 'text' AS mode, query_id, rank, path, score FROM txt WHERE rank <= 5
        UNION ALL SELECT 'vector', query_id, rank, path, score FROM vec WHERE rank <= 5
        UNION ALL SELECT * FROM (SELECT 'hybrid', query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, path) AS rank, path, score FROM h2) WHERE rank <= 5),
      g AS (SELECT m.mode, query_id, CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS "set", ['/' || query_id || '.md', '0.md', '5.md'] AS expect
        FROM q, (SELECT unnest(['text', 'vector', 'hybrid']) AS mode) m),
      cas AS (SELECT g.mode, g."set", g.query_id, coalesce(min(res.rank), 0)::INT AS expected_rank FROM g LEFT JOIN res
        ON res.mode = g.mode AND res.query_id = g.query_id AND len(list_filter(g.expect, lambda e: suffix(res.path, e))) > 0 GROUP BY ALL),
      met AS (SELECT mode, "set", {oracles._METRICS.replace("rank", "expected_rank")} FROM cas GROUP BY ALL)
      SELECT cas.mode, cas."set", cas.query_id, cas.expected_rank, res.rank, res.path, round(res.score, 5) AS score, met.cases, met.hits, met.recall, met.mrr
      FROM cas LEFT JOIN res ON res.mode = cas.mode AND res.query_id = cas.query_id JOIN met ON met.mode = cas.mode AND met."set" = cas."set" """,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_index_corpus, job2_search_report)}
