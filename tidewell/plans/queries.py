"""Queries of the driver over its tables, each with the SQL that must give the same rows.

documents are files docs/<source>/<lang>/<doc_id>.md with one chunk each unless a query chunks them; the vectors are those of
embeddings with the same id; the queries are the benchmark items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions import vectors as V
from tidewell.operators import chunking, ingest_diff, pivots
from tidewell.operators import search as S
from tidewell.plans import evaluate
from tidewell.plans.search import Options, results_json, search_batch
from tidewell.sources import csvsplit
from tidewell.sources import files as files_source
from tidewell.sources.embed import HashEmbedder, embedding
from tidewell.sources.shared import new_folder, spread, stored
from tidewell.sources.store import ChunkStore, delete_by_path, latest_paths, replace_by_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _path() -> F.Column:
    return F.concat_ws("/", F.lit("docs"), "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return spread(_table(spark, d, "documents")).select("doc_id", _path().alias("path"), (F.col("doc_id") + 1700000000).alias("mtime"), "source", "lang", "text")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("path", F.col("lang").alias("section"), "text", F.lit(0).alias("ordinal"), "mtime", "doc_id")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    v = _table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return _chunks(spark, d).join(v, "doc_id")


def _slim(spark: SparkSession, d: str) -> DataFrame:
    """The vectors without the texts."""
    return _vectors(spark, d).select("path", "ordinal", "vector")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as queries; their vectors are those of the embeddings with ids 7 * item_id + 3."""
    items = _table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    v = _table(spark, d, "embeddings").select(F.expr("(vec_id - 3) div 7").alias("query_id"), F.col("embedding").alias("vector"), "vec_id").filter("vec_id % 7 = 3").drop("vec_id")
    return items.join(v, "query_id", "left")


def _conversations(spark: SparkSession, d: str) -> DataFrame:
    """One file per conversation, its turns as paragraphs."""
    turns = _table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return turns.select(F.concat(F.lit("talk/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), "t")


def discover_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Formats of the paths, with extensions in both cases."""
    p = _files(spark, d).select(F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("path", "md$", "CSV")).when(F.col("doc_id") % 3 == 1, F.regexp_replace("path", "md$", "txt")).otherwise(F.col("path")).alias("path"))
    return files_source.with_format(p)


def _digest(chunks: DataFrame) -> DataFrame:
    return chunks.select("path", "section", "ordinal", F.octet_length("text").cast("long").alias("bytes"), F.md5(F.col("text").cast("binary")).alias("md5"))


def chunk_hard_split(spark: SparkSession, d: str) -> DataFrame:
    return _digest(chunking.chunk_plain(_files(spark, d)))


def chunk_pack_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    files = _conversations(spark, d).select("path", F.array_join(F.col("t.text"), "\n\n").alias("text"))
    return chunking.chunk_plain(files).select("path", "ordinal", F.octet_length("text").cast("long").alias("bytes"), F.md5(F.col("text").cast("binary")).alias("md5"))


def chunk_markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    turn = F.transform("t", lambda t: F.concat(F.lit("# "), t["role"], F.lit("\n## "), t["turn"].cast("string"), F.lit("\n"), t["text"]))
    files = _conversations(spark, d).select("path", F.array_join(turn, "\n").alias("text"))
    return _digest(chunking.chunk_markdown(files))


def chunk_markdown_fences(spark: SparkSession, d: str) -> DataFrame:
    """Headings of three levels, and fences whose lines look like headings."""
    turn = F.transform("t", lambda t: F.concat(F.lit("### "), t["role"], F.lit("\n```\n# "), t["text"], F.lit("\n## no\n~~~\n")))
    files = _conversations(spark, d).select("path", F.concat(F.lit("# talk\n## turns\n"), F.array_join(turn, "")).alias("text"))
    return _digest(chunking.chunk_markdown(files))


def chunk_pdf_pages(spark: SparkSession, d: str) -> DataFrame:
    files = _conversations(spark, d).select("path", F.array_join(F.col("t.text"), "\f").alias("text"))
    return _digest(chunking.chunk_pages(files))


def chunk_docx_files(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as DOCX files: roles are headings, turns paragraphs."""

    def pack(batches):
        import io
        import zipfile
        from xml.sax.saxutils import escape

        import pyarrow as pa

        for part in files_source.slices(batches):
            out = []
            for turns in part.column("t").to_pylist():
                body = "".join(f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>{escape(t["role"])}</w:t></w:r></w:p><w:p><w:r><w:t>{escape(t["text"])}</w:t></w:r></w:p>' for t in turns)
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as z:
                    z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
                out.append(held.getvalue())
            yield pa.RecordBatch.from_arrays([part.column("path"), pa.array(out, pa.binary())], ["path", "content"])

    files = _conversations(spark, d).withColumn("path", F.replace("path", F.lit(".md"), F.lit(".docx"))).mapInArrow(pack, "path string, content binary")
    return _digest(files_source.chunk_files(files)[0])


def chunk_xml_subtrees(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as XML files above the limit: own lines, then the children."""
    turn = F.transform("t", lambda t: F.concat(F.lit("<turn no='"), t["turn"].cast("string"), F.lit("'><who>"), t["role"], F.lit("</who><said>"), F.replace(F.replace(t["text"], F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</said></turn>")))
    body = F.concat(F.lit("<talk at='x'>"), F.array_join(turn, ""), F.lit("<pad><p>"), F.repeat(F.lit("y"), 1600), F.lit("</p></pad></talk>"))
    files = _conversations(spark, d).select(F.replace("path", F.lit(".md"), F.lit(".xml")).alias("path"), body.cast("binary").alias("content"))
    return _digest(files_source.chunk_files(files)[0])


def chunk_csv_rows(spark: SparkSession, d: str) -> DataFrame:
    names = ["c_custkey", "c_name", "c_nationkey"]
    rows = _table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.array(*[F.lit(n) for n in names[:2]]).alias("header"), F.array(*[F.col(n).cast("string") for n in names]).alias("record"))
    return chunking.render_csv_rows(rows).select("path", "row")


def chunk_csv_files(spark: SparkSession, d: str) -> DataFrame:
    """nation as one CSV file through the parser."""
    line = F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string"))
    body = _table(spark, d, "nation").agg(F.array_join(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line"))))["line"], "\n").alias("b"))
    files = body.select(F.lit("nation.csv").alias("path"), F.concat(F.lit("key,name,region\n"), "b").cast("binary").alias("content"))
    return files_source.chunk_files(files)[0].select("path", "section", F.length("text").cast("long").alias("characters"), "ordinal")


def chunk_csv_splits(spark: SparkSession, d: str) -> DataFrame:
    """orders as one CSV file of quoted fields with breaks, quotes and commas, its lines dealt in blocks as a reader's splits are."""
    key = F.col("o_orderkey").cast("string")
    note = F.concat(F.lit('"of customer '), F.col("o_custkey").cast("string"), F.lit('\nby ""sea"", or so"'))
    record = F.concat_ws(",", key, F.col("o_custkey").cast("string"), F.col("o_orderstatus"), F.when(F.col("o_custkey") % 3 == 0, note).otherwise(F.lit("")))
    rows = _table(spark, d, "orders").select(F.expr("o_orderkey div 500").alias("block"), (F.col("o_orderkey") * 2 + 2).alias("at"), F.posexplode(F.split(record, "\n")).alias("k", "line"))
    head = spark.range(1).select(F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("no"), F.lit("order,customer,status,note").alias("line"))
    lines = head.unionByName(rows.select("block", (F.col("at") + F.col("k")).alias("no"), "line"))
    return _digest(csvsplit.chunk_csv_lines(lines.select(F.lit("orders.csv").alias("path"), "block", "no", "line")))


def chunk_xml_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Each nation as an XML file."""
    body = F.format_string('<nation id="%s"><name>%s</name><region>%s</region></nation>', F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string"))
    files = _table(spark, d, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".xml")).alias("path"), body.cast("binary").alias("content"))
    return files_source.chunk_files(files)[0]


def failed_files_dead_letter(spark: SparkSession, d: str) -> DataFrame:
    """Good and broken files together: which give chunks, which fail."""
    broken = F.col("n_nationkey") % 2 == 0
    path = F.concat(F.col("n_nationkey").cast("string"), F.when(broken, ".docx").otherwise(".md"))
    files = _table(spark, d, "nation").select(path.alias("path"), F.col("n_name").cast("binary").alias("content"))
    chunks, failures = files_source.chunk_files(files)
    return chunks.select("path", F.lit(False).alias("failed"), "text").unionByName(failures.select("path", F.col("error").isNotNull().alias("failed"), F.lit("").alias("text")))


def path_words(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("path", T.path_words("path").alias("words"))


def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("path", F.md5(T.embedding_text("path", "section", "text").cast("binary")).alias("md5"))


def _known(spark: SparkSession, d: str) -> DataFrame:
    """Files of ids divisible by 5 changed since, those by 7 were unknown, and some have been deleted."""
    f = _files(spark, d).filter("doc_id % 7 <> 0").select("path", F.when(F.col("doc_id") % 5 == 0, F.col("mtime") - 1).otherwise(F.col("mtime")).alias("mtime"))
    old = _table(spark, d, "nation").select(F.concat(F.lit("docs/src1/old/"), F.col("n_nationkey").cast("string"), F.lit(".md")).alias("path"), F.lit(1).cast("long").alias("mtime"))
    return f.unionByName(old).unionByName(old.withColumn("path", F.replace("path", F.lit("src1"), F.lit("src10"))))


def incremental_skip(spark: SparkSession, d: str) -> DataFrame:
    return ingest_diff.skipped(_files(spark, d).select("path", "mtime"), _known(spark, d))


def incremental_work(spark: SparkSession, d: str) -> DataFrame:
    return ingest_diff.work_list(_files(spark, d).select("path", "mtime"), _known(spark, d))


def vanished_files(spark: SparkSession, d: str) -> DataFrame:
    return ingest_diff.vanished(_known(spark, d), _files(spark, d).select("path"), ["docs/src1"])


def upsert_replace_by_path(spark: SparkSession, d: str) -> DataFrame:
    old = _files(spark, d).select("path", F.lit("old").alias("state"))
    return replace_by_path(old, old.filter(F.col("path").contains("/en/")).withColumn("state", F.lit("new")))


def delete_paths(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    return delete_by_path(f.select("path", "mtime"), f.filter("lang = 'de'").select("path"))


def store_replace_and_delete(spark: SparkSession, d: str) -> DataFrame:
    """A chunk table as it stands after its writers: all documents with a vector, then those in English with a new text and time, then
    without those in German. The ids give back the chunks' numbers."""
    store = ChunkStore(spark, new_folder(spark, "store"))
    chunks = stored(_vectors(spark, d).drop("doc_id"))
    store.upsert(chunks)
    store.upsert(chunks.filter("section = 'en'").withColumns({"text": F.concat("text", F.lit(" (new)")), "mtime": F.col("mtime") + 1}))
    store.delete(chunks.filter("section = 'de'").select("path"))
    return store.chunks().select("id", "path", T.ordinal_of("id").alias("ordinal"), "section", F.md5("text").alias("md5"), "mtime", F.size("vector").alias("dim"))


def eval_cases(spark: SparkSession, d: str) -> DataFrame:
    """The report of each golden case: its number in its set, the rank and the path of the first expected result."""
    golden = _queries(spark, d).select("query_id", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd").alias("set"), "query", F.array(F.concat(F.lit("/"), F.col("query_id").cast("string"), F.lit(".md")), F.lit("0.md"), F.lit("5.md")).alias("expect"))
    cases = evaluate.case_report(S.text_topk(_chunks(spark, d), _queries(spark, d), 10), golden)
    return cases.select("set", F.col("no").cast("int").alias("no"), "query_id", F.col("rank").cast("int").alias("rank"), "found")


def count_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).agg(F.count("*").alias("chunks"))


def paths_latest(spark: SparkSession, d: str) -> DataFrame:
    return latest_paths(_chunks(spark, d))


def list_files(spark: SparkSession, d: str) -> DataFrame:
    return latest_paths(_chunks(spark, d)).select("path", T.rfc3339("mtime").alias("modified"))


def query_words(spark: SparkSession, d: str) -> DataFrame:
    return _queries(spark, d).select("query_id", F.array_join(T.query_words("query"), " ").alias("words"))


def word_set_size(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("path", F.size(T.word_set("text")).alias("words"))


def parse_exclusions(spark: SparkSession, d: str) -> DataFrame:
    q = F.concat(F.col("n_name"), F.lit(' -"two words" in-word -'), F.lower("n_name"), F.lit(" tail -"))
    positive, terms = T.parse_exclusions(q)
    return _table(spark, d, "nation").select("n_nationkey", positive.alias("positive"), F.array_join(terms, "|").alias("terms"))


def text_search(spark: SparkSession, d: str) -> DataFrame:
    return S.text_topk(_chunks(spark, d), _queries(spark, d), 10).select("query_id", "path", F.round("score", 6).alias("score"), "rank")


def _numbers(v: F.Column) -> list[F.Column]:
    """Values that all numbers of a vector decide."""
    weight = F.aggregate(F.transform(v, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    whole = lambda x, n: F.round(x, n) + F.lit(0.0)  # no negative zeros
    return [whole(F.get(v, F.lit(0)).cast("double"), 4).alias("first"), whole(weight, 3).alias("weight"), F.size(v).alias("dim"), F.round(V.norm(v), 3).alias("norm")]


def normalize_vectors(spark: SparkSession, d: str) -> DataFrame:
    scaled = F.transform("embedding", lambda x: x * 3)
    return _table(spark, d, "embeddings").select("vec_id", V.normalize(scaled).alias("v")).select("vec_id", *_numbers(F.col("v")))


def vector_search(spark: SparkSession, d: str) -> DataFrame:
    return S.vector_topk(_vectors(spark, d), _queries(spark, d), 10).select("query_id", "path", F.round("score", 5).alias("score"), "rank")


def vector_search_pivots(spark: SparkSession, d: str) -> DataFrame:
    """The rows of vector_search, from a table in cells around pivots of which only the parts that can hold them are read."""
    folder = new_folder(spark, "pivots")
    pivots.write(_vectors(spark, d), folder)
    found = pivots.vector_hits(*pivots.read(spark, folder), _queries(spark, d), 10)
    return found.select("query_id", "path", F.round("score", 5).alias("score"), "rank")


def filter_excluded(spark: SparkSession, d: str) -> DataFrame:
    found = S.text_topk(_chunks(spark, d), _queries(spark, d), 10)
    return S.filter_excluded(found, F.array(F.lit("THE and")), F.array(F.lit("SRC1/"))).select("query_id", "path")


def rrf_merge(spark: SparkSession, d: str) -> DataFrame:
    a, b = _lists(spark, d)
    return S.rrf_merge([a, b], 5).select("query_id", "path", F.round("score", 9).alias("score"), "rank", "text")


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = _table(spark, d, "nation").select(F.col("n_regionkey").alias("query_id"), "n_nationkey", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("path"), F.lit(0).alias("ordinal"), F.lit("").alias("section"))
    from pyspark.sql import Window

    up = F.row_number().over(Window.partitionBy("query_id").orderBy("n_nationkey"))
    down = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n_nationkey")))
    return n.withColumn("rank", up).withColumn("text", F.lit("a")).filter("rank <= 4"), n.withColumn("rank", down).withColumn("text", F.lit("b")).filter("rank <= 3")


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    found = search_batch(_chunks(spark, d), _queries(spark, d), Options(limit=5), vectors=_slim(spark, d))
    return found.select("query_id", "path", F.round("score", 6).alias("score"), "rank")


def hybrid_search_filtered(spark: SparkSession, d: str) -> DataFrame:
    found = search_batch(_chunks(spark, d), _queries(spark, d), Options(limit=5, exclude=("idiot",), exclude_path=("/src1/",)), vectors=_slim(spark, d))
    return found.select("query_id", "path", F.round("score", 6).alias("score"), "rank")


def hybrid_search_mixed(spark: SparkSession, d: str) -> DataFrame:
    """Every third query excludes something, the others nothing: each fetches as it would alone."""
    asked = _queries(spark, d).withColumn("query", F.when(F.col("query_id") % 3 == 0, F.concat("query", F.lit(" -the"))).otherwise(F.col("query")))
    found = search_batch(_chunks(spark, d), asked, Options(limit=5), vectors=_slim(spark, d))
    return found.select("query_id", "path", F.round("score", 6).alias("score"), "rank")


def search_mode_text(spark: SparkSession, d: str) -> DataFrame:
    found = search_batch(_chunks(spark, d), _queries(spark, d).drop("vector"), Options("text", limit=4))
    return found.select("query_id", "path", "section", F.md5("text").alias("md5"), F.round("score", 6).alias("score"), "rank")


def search_mode_vector(spark: SparkSession, d: str) -> DataFrame:
    found = search_batch(_chunks(spark, d), _queries(spark, d), Options("vector", limit=0), vectors=_slim(spark, d))
    return found.select("query_id", "path", "section", F.md5("text").alias("md5"), F.round("score", 5).alias("score"), "rank")


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    """Golden cases: each item expects the documents of source src0 to src4 or of its own number."""
    golden = _queries(spark, d).select("query_id", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd").alias("set"), F.array(F.concat(F.lit("/"), F.col("query_id").cast("string"), F.lit(".md")), F.lit("0.md"), F.lit("5.md")).alias("expect"))
    return evaluate.first_expected_rank(S.text_topk(_chunks(spark, d), _queries(spark, d), 10), golden)


def first_expected_rank(spark: SparkSession, d: str) -> DataFrame:
    return _ranks(spark, d)


def _rounded(m: DataFrame) -> DataFrame:
    return m.withColumns({"recall": F.round("recall", 6), "mrr": F.round("mrr", 6)})


def eval_recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluate.metrics_by_set(_ranks(spark, d)))


def eval_overall(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluate.metrics_overall(_ranks(spark, d)))


def snippets(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("path", T.snippet("text", 60).alias("snippet"))


def score_bands(spark: SparkSession, d: str) -> DataFrame:
    found = S.text_topk(_chunks(spark, d), _queries(spark, d), 5)
    return found.groupBy(T.score_band("score").alias("band")).agg(F.count("*").alias("results"))


def search_results_json(spark: SparkSession, d: str) -> DataFrame:
    found = S.text_topk(_chunks(spark, d), _queries(spark, d), 5).withColumn("text", F.md5("text"))
    return results_json(found).select("query_id", "rank", "json")


def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("path", embedding(HashEmbedder(), F.col("text")).alias("v")).select("path", *_numbers(F.col("v")))


ALL = (discover_dispatch, chunk_hard_split, chunk_pack_paragraphs, chunk_markdown_sections, chunk_markdown_fences, chunk_pdf_pages, chunk_docx_files, chunk_xml_subtrees, chunk_csv_rows, chunk_csv_files, chunk_csv_splits, chunk_xml_catalog, failed_files_dead_letter, path_words, embedding_text, incremental_skip, incremental_work, vanished_files, upsert_replace_by_path, delete_paths, store_replace_and_delete, count_chunks, paths_latest, list_files, query_words, word_set_size, parse_exclusions, text_search, normalize_vectors, vector_search, vector_search_pivots, filter_excluded, rrf_merge, hybrid_search, hybrid_search_filtered, hybrid_search_mixed, search_mode_text, search_mode_vector, first_expected_rank, eval_cases, eval_recall_mrr, eval_overall, snippets, score_bands, search_results_json, hash_embed)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in ALL}
