"""Vector half, lexical half, exclusion filter and rank fusion. All take a DataFrame of queries and keep query_id."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import postings as P
from tidewell.sources.shared import stored

#: Fixed value: the constant of reciprocal rank fusion.
RRF_K = 60
#: Queries that one pass over the vectors compares at once; the block is what executors hold.
QUERY_BLOCK = 4096
#: Numbers in a matrix of distances, of vectors, or of words met, in a task.
BLOCK_NUMBERS = 1 << 22
#: Words of queries that one pass over the texts compares at once, and rows of texts that are scored together.
FORM_BLOCK = 1 << 16
TEXT_ROWS = 4096
#: What _ stands for in a query word: any character but a line's end.
_ANY = "[^\n\r\u0085\u2028\u2029]"
#: A query side larger than this is joined by shuffle.
BROADCAST_ROWS = 200_000


def _top(df: DataFrame, k: Column | int, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "path", "ordinal"))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def text_hits(chunks: DataFrame, queries: DataFrame, k: int, postings: DataFrame | None = None, buckets: int = P.BUCKETS) -> DataFrame:
    """Lexical search: query_id, path, ordinal, score, rank.

    chunks: path, text, ordinal; queries: query_id, query. The score is the share of the query's words whose singular is a word of
    the chunk; a chunk must also hold a raw query word as a substring. A path and ordinal is one chunk. Up to FORM_BLOCK words of
    queries are broadcast: each task scores its chunks against all queries and sends on k rows a query, so what is shuffled and written
    does not grow with the chunks that a common word meets. More query words work as an inverted index: words of chunks and queries
    meet in an equi-join, the words met are counted as bits, so a task sends one row per query and chunk. postings (of
    operators.postings, with their bucket if they are stored by it) save reading and splitting the texts; these are touched only where
    a match rests on plurals alone.
    """
    words = queries.select("query_id", T.query_words("query").alias("words")).filter(F.size("words") > 0)
    terms = words.select("query_id", F.size("words").alias("of"), F.posexplode("words").alias("no", "raw")).withColumn("word", T.singular(F.col("raw")))
    # a chunk word matches if its singular is the term's: the term itself or with one s more, as far as those fold to it. So it is
    # the few query terms that are varied, and chunk words are compared as they stand
    forms = terms.withColumn("form", F.explode(F.array("word", F.concat("word", F.lit("s"))))).filter(T.singular(F.col("form")) == F.col("word"))
    # a word that is its own singular, or that is met as it is, stands in the text
    sure = (F.col("raw") == F.col("word")) | (F.col("raw") == F.col("form"))
    forms = forms.select("query_id", "of", "no", "raw", "word", "form", sure.alias("sure"), (F.col("raw") != F.col("word")).alias("plural"))
    asked = forms.limit(FORM_BLOCK + 1).collect()
    if not asked:
        return queries.select("query_id", F.lit("").alias("path"), F.lit(0).alias("ordinal"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).filter("false")
    few = len(asked) <= FORM_BLOCK
    longest, plural = (None, any(r["plural"] for r in asked)) if few else forms.agg(F.max("no"), F.max("plural")).first()
    if few and postings is None:
        held = [F.lower("text").alias("low")] if plural else []
        rows = chunks.filter("path is not null and text is not null").select("path", "ordinal", F.array_distinct(T.words("text")).alias("words"), *held)
        hits = _scored(rows, asked, k, queries.schema["query_id"].dataType)
        return _top(hits.groupBy("query_id", "path", "ordinal").agg(F.max("score").alias("score")), k, F.desc("score")).select("query_id", "path", "ordinal", "score", "rank")
    words_of = P.postings(chunks) if postings is None else postings
    if "bucket" in words_of.columns:
        words_of = P.of_words(words_of, forms.select(F.col("form").alias("word")), buckets)
    met = words_of.select(F.col("word").alias("form"), "path", "ordinal")
    if few:  # the words met of a chunk are put together, not the pairs of query and chunk
        met = met.join(F.broadcast(forms.select("form").distinct()), "form", "left_semi").filter("path is not null")
        hits = _scored(met.groupBy("path", "ordinal").agg(F.collect_set("form").alias("words")), asked, k, queries.schema["query_id"].dataType)
    else:
        met = met.join(_small(forms), "form")
        bits = {f"b{i}": F.bit_or(F.when((F.col("no") >= 63 * i) & (F.col("no") < 63 * (i + 1)), F.expr(f"shiftleft(1L, no - {63 * i})")).otherwise(F.lit(0).cast("long"))) for i in range(longest // 63 + 1)}
        hits = met.groupBy("query_id", "path", "ordinal").agg(F.first("of").alias("of"), F.max("sure").alias("sure"), *[b.alias(n) for n, b in bits.items()])
        hits = hits.select("query_id", "path", "ordinal", (sum((F.bit_count(n) for n in bits), F.lit(0)) / F.col("of")).alias("score"), "sure")
    if plural:
        hits = stored(hits)
        doubt = _small(hits.filter("not sure").drop("sure"))
        held = doubt.join(chunks.select("path", "ordinal", "text"), ["path", "ordinal"]).join(_small(words), "query_id")
        held = held.filter(T.like_any(F.col("text"), F.col("words"))).select("query_id", "path", "ordinal", "score")
        hits = hits.filter("sure").drop("sure").unionByName(held)
    return _top(hits, k, F.desc("score")).select("query_id", "path", "ordinal", "score", "rank")


class _Terms:
    """Words of queries as tables: which word a form stands for, and the queries that ask for each word."""

    def __init__(self, rows: list):
        self.ids = list(dict.fromkeys(r["query_id"] for r in rows))
        number = {i: n for n, i in enumerate(self.ids)}
        self.of = np.ones(len(self.ids))
        self.raw: list[set[str]] = [set() for _ in self.ids]
        word: dict[str, int] = {}
        terms: dict[int, set[tuple[int, int]]] = {}
        at: dict[str, tuple[int, set[int]]] = {}
        for r in rows:
            q = number[r["query_id"]]
            self.of[q] = r["of"]
            self.raw[q].add(r["raw"])
            w = word.setdefault(r["word"], len(word))
            terms.setdefault(w, set()).add((q, r["no"]))
            sure = at.setdefault(r["form"], (w, set()))[1]
            if r["sure"]:
                sure.add(q)
        self.forms = list(at)
        self.word = np.array([w for w, _ in at.values()])  # a form is one of a single word
        self.asked = _Lists([[q for q, _ in terms[w]] for w in range(len(word))])
        self.sure = _Lists([sorted(qs) for _, qs in at.values()]) if any(r["plural"] for r in rows) else None

    def holds(self, q: int, low: str) -> bool:
        """functions.text.like_any of the words of query q, on a text in lower case."""
        for w in self.raw[q]:
            if w in low if "_" not in w else re.search("".join(_ANY if c == "_" else re.escape(c) for c in w), low):
                return True
        return False

    def scores(self, words: pa.ListArray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """row, query, score, sure of each chunk (its distinct words) and query that meet at a score of the query's floor or more.

        The words met are counted in a table of chunks and queries, so no pair of them is sorted.
        """
        n, q = len(words), len(self.ids)
        form = pc.index_in(words.flatten(), pa.array(self.forms, words.type.value_type)).fill_null(-1).to_numpy()
        row = np.repeat(np.arange(n), pc.list_value_length(words).fill_null(0).to_numpy())[form >= 0]
        form = form[form >= 0]
        met = np.sort(row * len(self.asked) + self.word[form])
        met = met[np.diff(met, prepend=-1) > 0]  # a word that is met in both its forms counts once
        count = self.asked.counted(met // len(self.asked), met % len(self.asked), n, q)
        score = count / self.of
        at = np.flatnonzero((count > 0) & (score >= floor))
        sure = np.ones(len(at), bool) if self.sure is None else self.sure.counted(row, form, n, q).ravel()[at] > 0
        return at // q, at % q, score.ravel()[at], sure


class _Lists:
    """Lists of queries, one after the other in one array."""

    def __init__(self, lists: list[list[int]]):
        self.count = np.array([len(x) for x in lists])
        self.start = np.cumsum(self.count) - self.count
        self.query = np.array([q for x in lists for q in x], np.int64)

    def __len__(self) -> int:
        return len(self.count)

    def counted(self, row: np.ndarray, which: np.ndarray, rows: int, queries: int) -> np.ndarray:
        """How often each row (a table of rows and queries) meets each query, if row i takes the list which[i]."""
        n = self.count[which]
        at = np.repeat(self.start[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(np.repeat(row * queries, n) + self.query[at], minlength=rows * queries).reshape(rows, queries)


def _scored(rows: DataFrame, asked: list, k: int, id_type) -> DataFrame:
    """rows: path, ordinal, words (distinct) and maybe low, the text in lower case -> query_id, path, ordinal, score, sure.

    Of each task and query the first k rows by score, path and ordinal, and nothing else where low is given. Without it, also the rows
    before them whose match rests on plurals alone (not sure), which must be looked up in the text.
    """
    spark, terms = rows.sparkSession, _Terms(asked)
    found = rows.mapInArrow(_best_texts(spark.sparkContext.broadcast(terms), k, "low" in rows.columns), "q int, path string, ordinal int, score double, sure boolean")
    # tasks know queries by number, so that ids of any type stay out of them
    ids = spark.createDataFrame(list(enumerate(terms.ids)), f"q int, query_id {id_type.simpleString()}")
    return found.join(F.broadcast(ids), "q").select("query_id", "path", "ordinal", "score", "sure")


def _best_texts(shared, k: int, whole: bool):
    columns = ["q", "minus", "path", "ordinal"]

    def sent(part: pd.DataFrame, sure: bool) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(part), 1 << 16):
            p = part.iloc[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(p["q"].to_numpy(np.int32)), pa.array(p["path"], pa.string()), pa.array(p["ordinal"].to_numpy(np.int32)), pa.array(-p["minus"].to_numpy(np.float64)), pa.array(np.full(len(p), sure))],
                ["q", "path", "ordinal", "score", "sure"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        held = pd.DataFrame({"q": np.empty(0, np.int64), "minus": np.empty(0), "path": np.empty(0, object), "ordinal": np.empty(0, np.int32)})
        floor = np.zeros(len(terms.ids))  # the score of the k-th row held
        step = max(1, min(TEXT_ROWS, BLOCK_NUMBERS // len(terms.ids)))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                row, q, score, sure = terms.scores(part.column("words"), floor)
                if not len(row):
                    continue
                path, ordinal = part.column("path").to_numpy(zero_copy_only=False), part.column("ordinal").to_numpy()
                place = np.empty(part.num_rows, np.int64)
                place[np.lexsort((ordinal, path))] = np.arange(part.num_rows)
                order = np.lexsort((place[row], -score, q))
                row, q, score, sure = row[order], q[order], score[order], sure[order]
                before = np.cumsum(sure) - sure
                near = before - before[np.searchsorted(q, q)] < k  # fewer than k sure rows come first
                row, q, score, sure = row[near], q[near], score[near], sure[near]
                if whole:
                    low = part.column("low")
                    for i in np.flatnonzero(~sure):
                        sure[i] = terms.holds(q[i], low[int(row[i])].as_py())
                fresh = pd.DataFrame({"q": q, "minus": -score, "path": path[row], "ordinal": ordinal[row]})
                if not whole:
                    yield from sent(fresh[~sure], False)
                held = pd.concat([held, fresh[sure]], ignore_index=True).sort_values(columns, kind="stable").drop_duplicates(["q", "path", "ordinal"]).groupby("q").head(k)
                last = held.groupby("q").agg(n=("q", "size"), minus=("minus", "max"))
                last = last[last["n"] == k]
                floor[last.index.to_numpy()] = -last["minus"].to_numpy()
        yield from sent(held, True)

    return run


def text_topk(chunks: DataFrame, queries: DataFrame, k: int, postings: DataFrame | None = None, buckets: int = P.BUCKETS) -> DataFrame:
    """text_hits with section and text: query_id, path, section, text, ordinal, score, rank."""
    return fetched(text_hits(chunks, queries, k, postings, buckets), chunks, queries, k)


def fetched(hits: DataFrame, chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """hits, k of each query at most, with section and text. That many are broadcast, so the texts are scanned and not shuffled; it
    is the number of queries that is counted."""
    most = BROADCAST_ROWS // max(k, 1)
    if queries.limit(most + 1).count() <= most:
        hits = F.broadcast(hits)
    return chunks.select("path", "ordinal", "section", "text").join(hits, ["path", "ordinal"]).select("query_id", "path", "section", "text", "ordinal", "score", "rank")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast, if it is small: counted, not guessed."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def vector_hits(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact nearest neighbours: query_id, path, ordinal, score (cosine of unit vectors), rank.

    chunks: path, ordinal, vector; queries: query_id, vector. Each task compares its vectors with a block of queries by matrix
    products of a bounded size and keeps k candidates a query, so what is shuffled is k rows per query and task.
    """
    slim = chunks.select("path", "ordinal", "vector").filter("vector is not null and path is not null")
    kind = queries.schema["query_id"].dataType.simpleString()
    out = None
    for ids, vectors in _query_blocks(queries):
        shared = chunks.sparkSession.sparkContext.broadcast((ids, vectors))
        part = slim.mapInArrow(_nearest(shared, k, queries.schema["query_id"].dataType), f"query_id {kind}, path string, ordinal int, d double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return chunks.sparkSession.createDataFrame([], f"query_id {kind}, path string, ordinal int, score double, rank int")
    return _top(out, k, F.col("d")).select("query_id", "path", "ordinal", (1 - F.col("d") / 2).alias("score"), "rank")


def vector_topk(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """vector_hits with section and text: query_id, path, section, text, ordinal, score, rank."""
    return fetched(vector_hits(chunks, queries, k), chunks, queries, k)


def _query_blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    ids, vectors = [], []
    for r in queries.filter("vector is not null").select("query_id", "vector").toLocalIterator():
        ids.append(r["query_id"])
        vectors.append(r["vector"])
        if len(ids) == QUERY_BLOCK:
            yield ids, np.array(vectors, np.float64)
            ids, vectors = [], []
    if ids:
        yield ids, np.array(vectors, np.float64)


def _nearest(shared, k: int, id_type):
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(id_type)

    def best(*parts: pd.DataFrame) -> pd.DataFrame:
        """The first k rows of each query by (d, path, ordinal)."""
        rows = pd.concat(parts, ignore_index=True)
        return rows.sort_values(["q", "d", "path", "ordinal"], kind="stable").groupby("q").head(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        square = (q**2).sum(1)[:, None]
        held = pd.DataFrame({"q": np.empty(0, np.int64), "d": np.empty(0), "path": np.empty(0, object), "ordinal": np.empty(0, np.int64)})
        fresh, waiting = [], 0
        for batch in batches:
            width = len(batch.column("vector")[0]) if batch.num_rows else 1
            step = max(1, BLOCK_NUMBERS // max(len(ids), width))
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                n = part.num_rows
                v = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
                # rounded far below the precision of single floats, so that equal vectors tie whatever their place in a batch
                d = np.round((v**2).sum(1)[None, :] + square - 2 * (q @ v.T), 12)
                path, ordinal = part.column("path").to_numpy(zero_copy_only=False), part.column("ordinal").to_numpy()
                keep = min(k, n)
                row, col = np.nonzero(d <= np.partition(d, keep - 1, axis=1)[:, keep - 1 : keep])
                if len(row) > keep * len(ids):  # ties: the first by path and ordinal
                    place = np.empty(n, np.int64)
                    place[np.lexsort((ordinal, path))] = np.arange(n)
                    order = np.lexsort((place[col], d[row, col], row))
                    row, col = row[order], col[order]
                    nth = np.arange(len(row)) - np.searchsorted(row, row)
                    row, col = row[nth < keep], col[nth < keep]
                fresh.append(pd.DataFrame({"q": row, "d": np.maximum(d[row, col], 0.0), "path": path[col], "ordinal": ordinal[col]}))
                waiting += len(row)
                if waiting > max(4 * k * len(ids), 1 << 16):
                    held, fresh, waiting = best(held, *fresh), [], 0
        held = best(held, *fresh)
        for a in range(0, len(held), 1 << 16):
            part = held.iloc[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, kind).take(pa.array(part["q"].to_numpy())), pa.array(part["path"], pa.string()), pa.array(part["ordinal"].to_numpy().astype(np.int32)), pa.array(part["d"].to_numpy())],
                ["query_id", "path", "ordinal", "d"],
            )

    return run


def filter_excluded(results: DataFrame, terms: Column, fragments: Column) -> DataFrame:
    """Results whose text or section holds a term, or whose path holds a fragment, are dropped."""
    return results.filter(~T.is_excluded(F.col("text"), F.coalesce("section", F.lit("")), F.col("path"), terms, fragments))


def rerank(results: DataFrame) -> DataFrame:
    """Ranks without gaps, in the order of the old ones."""
    return results.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def rrf_merge(lists: list[DataFrame], k: int) -> DataFrame:
    """Reciprocal rank fusion: score sum of 1 / (60 + rank), scaled so that first in two lists is 1. The row of the first list
    that has a chunk is kept."""
    tagged = [x.select("query_id", "path", "ordinal", F.struct(F.lit(i).alias("list"), "section", "text").alias("row"), (1 / (F.lit(RRF_K) + F.col("rank"))).alias("part")) for i, x in enumerate(lists)]
    rows = tagged[0]
    for x in tagged[1:]:
        rows = rows.unionByName(x)
    fused = rows.groupBy("query_id", "path", "ordinal").agg(F.sum("part").alias("sum"), F.min_by("row", "row.list").alias("row"))
    fused = fused.withColumn("score", F.col("sum") / F.lit(2.0 / (RRF_K + 1)))
    best = _top(fused, k, F.desc("score"))
    return best.select("query_id", "path", "row.section", "row.text", "ordinal", "score", "rank")
