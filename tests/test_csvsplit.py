"""Large CSV files in splits against the whole-file parser."""

import random
import re

import pytest

from tidewell.plans import ingest
from tidewell.sources import csvsplit
from tidewell.sources import files as fs
from tidewell.sources.embed import HashEmbedder
from tidewell.sources.store import ChunkStore


def table(seed, rows, delimiter=","):
    """Quoted fields with breaks, doubled quotes and delimiters, quotes in the middle of fields, blank lines, long and ragged rows."""
    rng = random.Random(seed)
    cells = ["wind", "", " 12 ", '"a ""calm"" sea"', f'"one{delimiter} two"', '"top\nmiddle\n\nbottom"', 'mid"quote', '"open\r\nend"', "größe", "x" * 400, '"' + "y " * 900 + '"', '""']
    weight = [9, 4, 4, 3, 3, 3, 2, 2, 3, 2, 1, 1]
    lines = [delimiter.join(("port", '"depth\nin m"', " tide ", ""))]
    for _ in range(rows):
        kind = rng.random()
        lines.append("" if kind < 0.03 else delimiter * 2 if kind < 0.06 else delimiter.join(rng.choices(cells, weight, k=rng.randrange(1, 7))))
    return rng.choice(("\n", "\r\n")).join(lines)


def found(df):
    got = sorted((r["ordinal"], r["section"], r["text"]) for r in df.collect())
    assert [x[0] for x in got] == list(range(len(got)))
    return [x[1:] for x in got]


@pytest.mark.parametrize(("seed", "delimiter", "block"), [(1, ",", 1), (2, ";", 7), (3, "\t", 64)])
def test_blocks_of_lines(spark, monkeypatch, seed, delimiter, block):
    monkeypatch.setattr(csvsplit, "BLOCK_ROWS", 16)
    text = table(seed, 300, delimiter)
    lines = [("p.csv", i // block, i, line) for i, line in enumerate(text.split("\n"))]
    random.Random(seed).shuffle(lines)
    got = found(csvsplit.chunk_csv_lines(spark.createDataFrame(lines, "path string, block long, no long, line string")))
    assert got == fs.chunk_csv(text.encode(), ".csv") and len(got) > 20


def test_splits_of_files(spark, tmp_path):
    """Several files, read in splits of a few hundred bytes; one of a single record over many splits, one of a header, one empty."""
    texts = {"a.csv": table(4, 150), "b.tsv": table(5, 60, "\t"), "c.csv": 'h\n"' + "fog\n" * 500 + '"', "d.csv": "only,a header\n", "e.csv": "", "f.csv": '\n\n"never closed\n1\n2'}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "512b")
        df = csvsplit.read_lines(spark, str(tmp_path))
        assert df.filter("path like '%/a.csv'").select("block").distinct().count() > 5
        chunks = csvsplit.chunk_large_csv(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name, text in texts.items():
        got = [(r["section"], r["text"]) for r in sorted(chunks, key=lambda r: r["ordinal"]) if r["path"] == str(tmp_path / name)]
        assert got == fs.chunk_csv(text.encode(), name[-4:]), name


def test_large_files_are_ingested_in_splits(spark, tmp_path, monkeypatch):
    """Large and small files of one run; a broken large one is listed and stops nothing."""
    docs = tmp_path / "docs"
    docs.mkdir()
    large, small = table(7, 120), table(8, 5)
    (docs / "large.csv").write_bytes(large.encode())
    (docs / "small.csv").write_bytes(small.encode())
    (docs / "note.md").write_text("fog")
    (docs / "broken.csv").write_bytes(b"a,b\n" + b"1,x\ry\n" * 2000)
    monkeypatch.setattr(ingest, "LARGE_CSV", 4000)
    store = ChunkStore(spark, str(tmp_path / "db"))
    stats, failures = ingest.ingest(store, [str(docs)], HashEmbedder())
    assert (stats.total, stats.failed) == (4, 1) and [r["path"] for r in failures.collect()] == [str(docs / "broken.csv")]
    rows = store.chunks().collect()
    for name, text in (("large.csv", large), ("small.csv", small)):
        got = [(r["section"], r["text"]) for r in sorted(rows, key=lambda r: r["ordinal"]) if r["path"] == str(docs / name)]
        assert got == fs.chunk_csv(text.encode(), ".csv")
    assert stats.written == len(rows) == store.count()
    stats, _ = ingest.ingest(store, [str(docs)], HashEmbedder())
    assert (stats.total, stats.skipped) == (1, 3)


def test_rows_of_a_file_do_not_meet_in_one_task(spark, monkeypatch):
    """Nothing of the size of the rows is joined by the file's path alone, which a shuffle would put into one task."""
    rng, plans, real, name = random.Random(9), [], csvsplit.stored, "spark.sql.autoBroadcastJoinThreshold"
    text = "\n".join(["a,b", *(f'{rng.random()},"{rng.random()}\n{rng.random()}"' for _ in range(3000))])
    lines = [("p.csv", i // 500, i, line) for i, line in enumerate(text.split("\n"))]
    monkeypatch.setattr(csvsplit, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    before = spark.conf.get(name)
    spark.conf.set(name, "20000")
    try:
        got = found(csvsplit.chunk_csv_lines(spark.createDataFrame(lines, "path string, block long, no long, line string")))
    finally:
        spark.conf.set(name, before)
    assert got == fs.chunk_csv(text.encode(), ".csv")
    assert len(plans) > 5 and not [p for p in plans if re.search(r"SortMergeJoin \[path#\d+\], \[path#\d+\]", p)]
