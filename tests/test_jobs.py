"""The jobs: growing input, reruns, failures in between, and their command lines."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import common, index_corpus, search_report
from tests.conftest import ROOT
from tidewell.operators import postings as P
from tidewell.operators import search as S
from tidewell.sources import index

TABLE = "path string, mtime long, text string"


def put(spark, folder, rows):
    """One more file of the source table."""
    spark.createDataFrame(rows, TABLE).coalesce(1).write.mode("append").parquet(str(folder))


def indexed(spark, root):
    """The whole index: chunks with their words, and files."""
    words = {}
    for r in index.postings(spark, root).collect():
        words.setdefault((r["path"], r["ordinal"]), set()).add(r["word"])
    chunks = {(r["path"], r["ordinal"]): (r["section"], r["text"]) for r in index.chunks(spark, root).collect()}
    files = {r["path"]: (r["mtime"], r["chunks"]) for r in index.files(spark, root).collect()}
    return chunks, words, files


FIRST = [
    ("a.md", 10, "lead\n# Harbour\nThe quay is wet\n## Piers\nferries and cranes"),
    ("b.md", 10, "# Tides\nhigh water at noon, low water at six"),
    ("c.md", 10, "soon to vanish"),
    ("d.md", 10, ""),
    (None, 10, "a row without a path"),
]
SECOND = [
    ("a.md", 20, "# Harbour\nThe quay is dry"),
    ("b.md", 10, "not taken: the time is that of the text we have"),
    ("c.md", 30, None),
    ("e.md", 5, "older of two"),
    ("e.md", 6, "newer of two"),
    ("f.md", 1, "x" * (1 << 20)),
]


def test_index_takes_only_what_is_new(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("source", "target", "checkpoint"))
    put(spark, source, FIRST)
    run = lambda: index_corpus.run(spark, source, target, checkpoint, buckets=8)
    done = run()
    assert (done["batches"], done["read"], done["taken"], done["failed"], done["chunks"]) == (1, 4, 4, 0, 5)
    chunks, words, files = indexed(spark, target)
    assert chunks["a.md", 2] == ("Harbour > Piers", "ferries and cranes") and words["a.md", 1] == {"the", "quay", "is", "wet"}
    assert files == {"a.md": (10, 3), "b.md": (10, 1), "c.md": (10, 1), "d.md": (10, 0)}

    assert run()["batches"] == 0  # nothing new: nothing written
    before = sorted(os.listdir(f"{target}/chunks"))
    put(spark, source, SECOND)
    done = run()
    assert (done["batches"], done["read"], done["taken"], done["unchanged"], done["failed"]) == (1, 6, 3, 2, 1)
    chunks, words, files = indexed(spark, target)
    assert chunks == {
        ("a.md", 0): ("Harbour", "The quay is dry"),
        ("b.md", 0): ("Tides", "high water at noon, low water at six"),
        ("e.md", 0): ("", "newer of two"),
    }
    assert words["a.md", 0] == {"the", "quay", "is", "dry"} and set(words) == set(chunks)
    assert files["c.md"] == (30, 0) and "f.md" not in files
    assert [(r["path"], r["error"]) for r in index.failed(spark, target).collect()] == [("f.md", "line too long")]
    # folders of the first batch are as they were
    assert set(before) <= set(os.listdir(f"{target}/chunks"))

    put(spark, source, [("f.md", 2, "short lines now")])
    run()
    assert index.failed(spark, target).count() == 0 and indexed(spark, target)[2]["f.md"] == (2, 1)


@pytest.mark.parametrize("table", ["postings", "files"])
def test_index_after_a_failure(spark, tmp_path, monkeypatch, table):
    """A run that dies while it writes a table, before or after the write, leaves an index that the next run completes."""
    source, clean = str(tmp_path / "source"), str(tmp_path / "clean")
    put(spark, source, FIRST)
    index_corpus.run(spark, source, clean, f"{clean}-checkpoint", buckets=8)
    want = indexed(spark, clean)
    real = common.replace_partitions
    for after in (False, True):
        target = str(tmp_path / f"target-{after}")

        def dies(df, path, *by, after=after):
            if path.endswith(table):
                if after:
                    real(df, path, *by)
                raise OSError("lost")
            real(df, path, *by)

        monkeypatch.setattr(common, "replace_partitions", dies)
        with pytest.raises(Exception, match="lost"):
            index_corpus.run(spark, source, target, f"{target}-checkpoint", buckets=8)
        if not (after and table == "files"):
            assert index.chunks(spark, target).count() == 0  # a batch counts when its files are there
        monkeypatch.setattr(common, "replace_partitions", real)
        index_corpus.run(spark, source, target, f"{target}-checkpoint", buckets=8)
        assert indexed(spark, target) == want


def test_index_of_a_table_in_growing_parts(spark, tmp_path, sf_dir):
    """The documents in two parts give what they give at once, and search in the index what it gives without."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    source, at_once = str(tmp_path / "docs"), str(tmp_path / "at_once")
    how = {"path": "concat(source, '/', doc_id, '.md')", "mtime": "doc_id", "buckets": 8, "files_per_batch": 2}
    root, checkpoint = str(tmp_path / "index"), str(tmp_path / "checkpoint")
    for part in range(2):
        docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == part).repartition(3).write.mode("append").parquet(source)
        assert index_corpus.run(spark, source, root, checkpoint, **how)["batches"] == 2  # of three files, two at a time
    index_corpus.run(spark, f"{sf_dir}/documents.parquet", at_once, f"{at_once}-checkpoint", **how)
    assert indexed(spark, root) == indexed(spark, at_once)

    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    chunks = index.chunks(spark, root)
    want = S.text_topk(chunks, asked, 5)
    got = S.text_topk(chunks, asked, 5, index.postings(spark, root), 8)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = S.text_hits(chunks, asked.limit(1), 5, index.postings(spark, root), 8)
    assert plan.count() > 0


def test_index_of_files_taken_once_is_read_without_a_shuffle(spark, tmp_path, monkeypatch):
    """Rows are joined with the files that several batches hold, not with all files; all rows are those of a join with all."""
    source, root, name = str(tmp_path / "docs"), str(tmp_path / "index"), "spark.sql.autoBroadcastJoinThreshold"
    plan = lambda: index.postings(spark, root)._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get(name)
    for mtime, paths in ((1, "abc"), (2, "b"), (3, "bd")):
        spark.createDataFrame([(p, mtime, f"tide {p} {mtime}") for p in paths], "path string, mtime long, text string").coalesce(1).write.mode("append").parquet(source)
        index_corpus.run(spark, source, root, f"{root}-checkpoint", buckets=2)
        if mtime == 1:
            spark.conf.set(name, "-1")
            try:
                assert "Exchange hashpartitioning(path" not in plan() and "SortMergeJoin" not in plan()
            finally:
                spark.conf.set(name, before)
    for most in (200_000, 0):
        monkeypatch.setattr(index, "OLD_ROWS", most)
        assert sorted(r["text"] for r in index.chunks(spark, root).collect()) == ["tide a 1", "tide b 3", "tide c 1", "tide d 3"]
        assert index.postings(spark, root).count() == 12


def test_words_of_other_buckets_are_not_opened(spark, tmp_path):
    rows = spark.createDataFrame([(f"p{i}", 0, f"word{i}") for i in range(50)], "path string, ordinal int, text string")
    P.for_writing(P.postings(rows), 8).write.partitionBy("bucket").parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    one = P.of_words(stored, spark.createDataFrame([("word7",)], "word string"), 8)
    assert one.filter("word = 'word7'").collect() and one.select("bucket").distinct().count() == 1 < stored.select("bucket").distinct().count()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]


def report(spark, target):
    every = [search_report.results(spark, target), search_report.cases(spark, target), search_report.metrics(spark, target)]
    return [sorted(map(str, df.select(*sorted(df.columns)).collect())) for df in every]


def test_search_report(spark, tmp_path):
    texts, golden, vectors, target = (str(tmp_path / x) for x in ("texts", "golden", "vectors", "target"))
    spark.createDataFrame([(1, "x/1.md", "low tide"), (2, "x/2.md", "high tide"), (3, "x/3.md", "storm")], "id long, path string, text string").write.parquet(texts)
    spark.createDataFrame([(1, "storm", "s", ["/3.md"]), (2, "tide", "s", ["/2.md"]), (3, "calm", "t", ["/9.md"])], "query_id int, query string, `set` string, expect array<string>").write.parquet(golden)
    spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "vec_id long, embedding array<float>").write.parquet(vectors)
    how = {"texts": texts, "vectors": vectors, "text_vector": "id", "query_vector": "query_id", "set": "`set`", "limit": 2}
    done = search_report.run(spark, golden, target, **how)
    assert done["chunks"] == 3 and done["queries"] == 3 and done["cases"] == 9
    ranks = {(r["mode"], r["query_id"]): r["rank"] for r in search_report.cases(spark, target).collect()}
    assert ranks["text", 1] == 1 and ranks["text", 2] == 2 and ranks["text", 3] == 0 and ranks["vector", 2] == 1
    metric = {(r["mode"], r["set"]): (r["cases"], r["hits"], r["recall"], r["mrr"]) for r in search_report.metrics(spark, target).collect()}
    assert metric["text", "s"] == (2, 2, 1.0, 0.75) and metric["text", "t"] == (1, 0, 0.0, 0.0)
    first = report(spark, target)
    search_report.run(spark, golden, target, **how)
    assert report(spark, target) == first
    search_report.run(spark, golden, target, modes="text", **how)  # one mode alone leaves the others
    assert report(spark, target) == first
    other = str(tmp_path / "words only")
    search_report.run(spark, golden, other, texts=texts, set="`set`", limit=2)  # no vectors: words only
    assert {r["mode"] for r in search_report.cases(spark, other).collect()} == {"text"}


def test_report_writes_no_postings_of_texts(spark, tmp_path, sf_dir, monkeypatch):
    """Of the texts only what the queries find is written."""
    written, real = [], search_report.stored
    monkeypatch.setattr(search_report, "stored", lambda df: written.append(df.columns) or real(df))
    how = {"texts": f"{sf_dir}/documents.parquet", "path": "concat(doc_id, '.md')", "query_id": "item_id", "query": "text", "expect": "array('1.md')", "modes": "text"}
    search_report.run(spark, f"{sf_dir}/benchmark.parquet", str(tmp_path / "report"), **how)
    assert written == [["query_id", "query", "set", "expect"]]


def test_report_from_the_index(spark, tmp_path, sf_dir):
    golden = {"query_id": "item_id", "query": "text", "expect": "array('1.md')", "modes": "text"}
    how = {"path": "concat(source, '/', doc_id, '.md')"}
    root, one, two = (str(tmp_path / x) for x in ("index", "one", "two"))
    index_corpus.run(spark, f"{sf_dir}/documents.parquet", root, f"{root}-checkpoint", mtime="1", chunker="plain", **how)
    search_report.run(spark, f"{sf_dir}/benchmark.parquet", one, index=root, **golden)
    chunks = str(tmp_path / "chunks")
    index.chunks(spark, root).filter("ordinal = 0").write.parquet(chunks)
    search_report.run(spark, f"{sf_dir}/benchmark.parquet", two, texts=chunks, **golden)
    first = {(r["query_id"], r["path"]) for r in search_report.results(spark, one).collect() if r["ordinal"] == 0}
    assert first and first <= {(r["query_id"], r["path"]) for r in search_report.results(spark, two).collect()}


def test_command_lines(tmp_path, sf_dir):
    for name, own in (("index_corpus", {"source": f"{sf_dir}/documents.parquet", "target": f"{tmp_path}/index", "checkpoint": f"{tmp_path}/checkpoint"}), ("search_report", {"index": f"{tmp_path}/index", "golden": f"{sf_dir}/benchmark.parquet", "target": f"{tmp_path}/report", "modes": "text", "vectors": "", "texts": ""})):
        with open(os.path.join(ROOT, "jobs", f"{name}.json")) as f:
            config = json.load(f) | own
        (tmp_path / f"{name}.json").write_text(json.dumps(config))
        done = subprocess.run([sys.executable, "-m", f"jobs.{name}", "--config", f"{tmp_path}/{name}.json"], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=300, check=False)
        assert done.returncode == 0, done.stderr[-3000:]
        assert f"jobs.{name} read" in done.stderr and "wrote" in done.stderr
    assert os.path.isdir(f"{tmp_path}/report/metrics/mode=text") and os.path.isdir(f"{tmp_path}/index/postings/batch=0")
