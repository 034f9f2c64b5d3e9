"""search: one query or a DataFrame of queries, in hybrid, vector or text mode, as one plan."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import search as ops
from tidewell.sources.embed import Embedder, embedding
from tidewell.sources.store import ChunkStore

MODES = ("hybrid", "vector", "text")


@dataclass(frozen=True)
class Options:
    mode: str = "hybrid"
    limit: int = 5
    exclude: tuple[str, ...] = field(default=())
    exclude_path: tuple[str, ...] = field(default=())


class SearchError(ValueError):
    """The query cannot be answered as it stands."""


def search_batch(chunks: DataFrame, queries: DataFrame, options: Options = Options(), embedder: Embedder | None = None, postings: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """queries: query_id, query, and vector unless an embedder makes it; postings: those of the chunks, if they are at hand; vectors: path,
    ordinal and vector of the chunks, if these have no vector themselves (a join that keeps texts out of its shuffle). -> query_id, path, section, text, ordinal, score, rank.

    Each half fetches limit rows, three times as many in hybrid mode, four times as many for a query that excludes anything;
    exclusions apply to the fetched rows, so fewer than limit may come back. A query's results do not depend on the others.
    Texts are fetched once: after the fusion, or before the exclusions that need them.
    """
    if options.mode not in MODES:
        raise SearchError(f"unknown mode {options.mode!r}: hybrid, vector or text")
    limit = options.limit if options.limit > 0 else 5
    positive, terms = T.parse_exclusions("query")
    asked = queries.withColumns({"query": positive, "_terms": F.concat(terms, F.array(*[F.lit(t) for t in options.exclude]).cast("array<string>"))})
    fragments = F.array(*[F.lit(p) for p in options.exclude_path]).cast("array<string>")
    always = bool(options.exclude or options.exclude_path)
    filtered = always or not asked.filter(F.size("_terms") > 0).isEmpty()
    plain = limit * (3 if options.mode == "hybrid" else 1)
    fetch = plain * (4 if filtered else 1)

    halves = []
    if options.mode != "text":
        wanted = asked
        if embedder:
            wanted = asked.withColumn("vector", embedding(embedder, F.col("query")))
        elif "vector" not in asked.columns:
            raise SearchError(f"{options.mode} mode needs an embedder")
        halves.append(ops.vector_hits(chunks if vectors is None else vectors, wanted.select("query_id", "vector"), fetch))
    if options.mode != "vector":
        halves.append(ops.text_hits(chunks, asked.select("query_id", "query"), fetch, postings))
    if filtered:
        own = asked.select("query_id", "_terms", F.when(F.lit(always) | (F.size("_terms") > 0), F.lit(fetch)).otherwise(F.lit(plain)).alias("_fetch"))
        halves = [ops.fetched(h, chunks, asked, fetch).join(own, "query_id").filter(F.col("rank") <= F.col("_fetch")) for h in halves]
        halves = [ops.rerank(ops.filter_excluded(h, F.col("_terms"), fragments).drop("_terms", "_fetch")) for h in halves]
    elif options.mode == "hybrid":
        later = F.lit(None).cast("string")
        halves = [h.withColumns({"section": later, "text": later}) for h in halves]
    found = ops.rrf_merge(halves, limit) if options.mode == "hybrid" else halves[0].filter(F.col("rank") <= limit)
    return found if filtered else ops.fetched(found.select("query_id", "path", "ordinal", "score", "rank"), chunks, asked, limit)


def search(store: ChunkStore, query: str, options: Options = Options(), embedder: Embedder | None = None) -> DataFrame:  # noqa: B008
    """One query against a store, with its guards: path, section, text, ordinal, score, rank."""
    if options.mode not in MODES:
        raise SearchError(f"unknown mode {options.mode!r}: hybrid, vector or text")
    spark = store.spark
    asked = spark.createDataFrame([(0, query)], "query_id int, query string")
    if not asked.select(T.parse_exclusions("query")[0].alias("q")).first()["q"]:
        raise SearchError("nothing to search for: the query has exclusions only")
    known = store.meta().get("embedder")
    if not known:
        raise SearchError("the database is empty: index something first")
    if options.mode != "text":
        if embedder is None:
            raise SearchError(f"{options.mode} mode needs an embedder")
        if embedder.id != known:
            raise SearchError(f"the database was built with {known}, not {embedder.id}: reindex")
    return search_batch(store.chunks(), asked, options, embedder).drop("query_id").orderBy("rank")


def results_json(results: DataFrame) -> DataFrame:
    """json: one object per result, scores rounded to four places, an empty section left out."""
    section = F.when(F.col("section") != "", F.col("section"))
    return results.withColumn("json", F.to_json(F.struct("path", section.alias("section"), "text", "ordinal", T.rounded("score").alias("score"))))


def to_json(results: DataFrame) -> str:
    """The results of one query as an indented array. The rows are limited by the query."""
    rows = [json.loads(r["json"]) for r in results_json(results).orderBy("rank").collect()]
    return json.dumps(rows, ensure_ascii=False, indent=2)
