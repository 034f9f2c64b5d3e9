"""Chunks of large CSV files: the lines of one file are dealt over many tasks, and the chunks are those of the whole-file parser.

A CSV file is a chain of states: whether a line begins inside a quoted field depends on all lines before it, and where a chunk begins on
all rows before it. Both states are small, so each block of lines (or rows) is first summed up as a function from the state it is
entered with to the state it is left with; the summaries, one row a block, are chained in order; then each block is cut by itself.

1. Blocks of lines -> state and number of records at each block's begin; records, those over the edge of a block put together.
2. Rows as `header: value` lines, by the plan of operators.chunking.
3. Blocks of rows -> what the open chunk holds at each block's begin; chunks, joined by the number of their first row.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import chunking
from tidewell.operators.chunking import MAX_CHUNK
from tidewell.sources.files import sniff_delimiter
from tidewell.sources.shared import stored

#: Rows of a block when chunks are cut.
BLOCK_ROWS = 4096


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, block, no, line: the lines of the files, block being where the reader's split begins; a file of any size."""
    lines = spark.read.option("lineSep", "\n").text(path)
    name = F.regexp_replace("_metadata.file_path", "^file:/*", "/")
    return lines.select(name.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("no"), F.col("value").alias("line"))


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The stretches of equal keys of a sorted stream, whole."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        new = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy()
        cuts = [0, *(np.flatnonzero(new[1:]) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.iloc[a:b]
            if held and (held[0][keys].iloc[0] != part[keys].iloc[0]).any():
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True)


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Blocks (the first two keys) whole in a task, in order."""
    return rows.repartition(*keys[:2]).sortWithinPartitions(*keys)


def _after(line: str, inside: bool, delimiter: str) -> bool:
    """Whether a quoted field is open after a line that begins inside one or at a record's begin."""
    if '"' not in line:
        return inside
    at, n, begin = 0, len(line), not inside
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if at + 1 < n and line[at + 1] == '"':
                at += 2
                continue
            at, inside, begin = at + 1, False, False
        elif begin and at < n and line[at] == '"':
            at, inside = at + 1, True
            continue
        at = line.find(delimiter, at)
        if at < 0:
            return False
        at, begin = at + 1, True


def _starts(line: str) -> bool:
    """A line at a record's begin that gives a record: blank ones give none."""
    return line not in ("", "\r")


def _line_summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for g in _groups(batches, ["path", "block"]):
        out, inn, out_n, in_n = False, True, 0, 0
        for line, d in zip(g["line"], g["delimiter"], strict=True):
            starts = _starts(line)
            out_n += not out and starts
            in_n += not inn and starts
            if '"' in line:
                same = out == inn  # from here on both ways are one
                out = _after(line, out, d)
                inn = out if same else _after(line, inn, d)
        yield pd.DataFrame([{"path": g["path"].iloc[0], "block": g["block"].iloc[0], "out_end": out, "out_n": out_n, "in_end": inn, "in_n": in_n}])


def _line_chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """State and records so far at the begin of each block, of blocks in order."""
    path, inside, n = None, False, 0
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if r.path != path:
                path, inside, n = r.path, False, 0
            out.append((r.path, r.block, inside, n))
            n += r.in_n if inside else r.out_n
            inside = bool(r.in_end if inside else r.out_end)
        yield pd.DataFrame(out, columns=["path", "block", "inside", "before"])


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, num, block, text, whole) of each record, or of the part of it that a block holds."""
    for g in _groups(batches, ["path", "block"]):
        path, block, inside, num = g["path"].iloc[0], g["block"].iloc[0], bool(g["inside"].iloc[0]), int(g["before"].iloc[0])
        out: list[tuple] = []
        held: list[str] = []
        whole = not inside  # the first record of the block, if it began before, is a part
        for line, d in zip(g["line"], g["delimiter"], strict=True):
            if not inside:
                if held:
                    out.append((path, num, block, "\n".join(held), whole))
                held, whole = [], True
                if not _starts(line):
                    continue
                num += 1
            held.append(line)
            if '"' in line:
                inside = _after(line, inside, d)
        if held:
            out.append((path, num, block, "\n".join(held), whole and not inside))
        yield pd.DataFrame(out, columns=["path", "num", "block", "text", "whole"])


def _fields(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    csv.field_size_limit(sys.maxsize)
    for batch in batches:
        record = [next(csv.reader(io.StringIO(t), delimiter=d), []) for t, d in zip(batch["text"], batch["delimiter"], strict=True)]
        yield batch[["path", "num"]].assign(record=record)


def _row_summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A block of rows as a function of what the open chunk holds: `upto`, the sizes at which the chunk is closed before a row, and
    what is held at the block's end, and since which row, if one begins there."""
    for g in _groups(batches, ["path", "block"]):
        total = np.cumsum(g["size"].to_numpy())
        num, n = g["num"].to_numpy(), len(g)
        before = np.concatenate(([0], total[:-1]))
        following = np.searchsorted(total, before + MAX_CHUNK, side="right")
        end, since = np.empty(n, np.int64), np.empty(n, np.int64)
        for j in range(n - 1, -1, -1):
            k = max(following[j], j + 1)  # a row of any size begins a chunk
            end[j], since[j] = (end[k], since[k]) if k < n else (total[-1] - before[j], num[j])
        few = int(np.searchsorted(total, MAX_CHUNK)) + 1
        yield pd.DataFrame([{"path": g["path"].iloc[0], "block": g["block"].iloc[0], "upto": total[:few], "end": end[:few], "since": since[:few], "all": total[-1]}])


def _row_chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What is held, and since which row, at the begin of each block, of blocks in order."""
    path, held, since = None, 0, 0
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if r.path != path:
                path, held, since = r.path, 0, 0
            out.append((r.path, r.block, held, since))
            j = int(np.searchsorted(r.upto, MAX_CHUNK - held, side="right")) if held else 0
            if j < len(r.upto):
                held, since = int(r.end[j]), int(r.since[j])
            else:
                held += int(r.all)
        yield pd.DataFrame(out, columns=["path", "block", "held", "since"])


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """first, the row that begins each row's chunk; and for a row that begins one, the chunk that it closes."""
    for g in _groups(batches, ["path", "block"]):
        held, since = int(g["held"].iloc[0]), int(g["since"].iloc[0])
        first, closes = [], []
        for num, size in zip(g["num"], g["size"], strict=True):
            closed = None
            if not held or held + size > MAX_CHUNK:
                closed, since, held = (since if held else None), num, 0
            held += size
            first.append(since)
            closes.append(closed)
        yield g[["path", "num", "row"]].assign(first=first, closes=pd.array(closes, "Int64"))


def chunk_csv_lines(lines: DataFrame) -> DataFrame:
    """lines: path, block, no, line (in the order of block and no) -> path, section, text, ordinal, as files.chunk_csv gives them.

    A file's first line sets its delimiter. Null lines count as empty. Files without a record give nothing.
    """
    lines = lines.withColumn("line", F.coalesce("line", F.lit("")))
    ext = lambda path: "." + path.rsplit(".", 1)[-1]
    sniff = F.udf(lambda line, path: sniff_delimiter(line, ext(path)), "string")
    first = lines.groupBy("path").agg(F.min_by("line", F.struct("block", "no")).alias("head"))
    delimiters = stored(first.select("path", sniff("head", "path").alias("delimiter")))
    told = _dealt(lines.join(delimiters, "path"), "path", "block", "no")

    # 1. records
    sums = told.mapInPandas(_line_summaries, "path string, block long, out_end boolean, out_n long, in_end boolean, in_n long")
    begins = stored(sums.repartition("path").sortWithinPartitions("path", "block").mapInPandas(_line_chain, "path string, block long, inside boolean, before long"))
    entered = _dealt(lines.join(delimiters, "path").join(begins, ["path", "block"]), "path", "block", "no")
    parts = stored(entered.mapInPandas(_records, "path string, num long, block long, text string, whole boolean"))
    torn = parts.filter("not whole").groupBy("path", "num").agg(F.array_join(F.array_sort(F.collect_list(F.struct("block", "text")))["text"], "\n").alias("text"))
    records = parts.filter("whole").select("path", "num", "text").unionByName(torn).join(delimiters, "path")
    records = stored(records.mapInPandas(_fields, "path string, num long, record array<string>"))

    # 2. rows
    # written, as the small side of a join whose key is the file: it is then broadcast, where a shuffle would put a file into one task
    header = stored(records.filter("num = 1").select("path", F.col("record").alias("header")))
    rows = chunking.render_csv_rows(records.filter("num > 1").join(header, "path")).filter("row <> ''")
    rows = stored(rows.select("path", "num", "row", (F.length("row") + 2).cast("long").alias("size"), F.expr(f"num div {BLOCK_ROWS}").alias("block")))
    last = stored(records.groupBy("path").agg(F.max("num").alias("records")))

    # 3. chunks
    sums = _dealt(rows.select("path", "block", "num", "size"), "path", "block", "num").mapInPandas(_row_summaries, "path string, block long, upto array<long>, end array<long>, since array<long>, all long")
    begins = stored(sums.repartition("path").sortWithinPartitions("path", "block").mapInPandas(_row_chain, "path string, block long, held long, since long"))
    cut = stored(_dealt(rows.join(begins, ["path", "block"]), "path", "block", "num").mapInPandas(_cut, "path string, num long, row string, first long, closes long"))
    ends = cut.filter("closes is not null").select("path", F.col("closes").alias("first"), (F.col("num") - 1).alias("last"))
    chunks = cut.groupBy("path", "first").agg(F.array_join(F.array_sort(F.collect_list(F.struct("num", "row")))["row"], "\n\n").alias("body"))
    chunks = chunks.join(ends, ["path", "first"], "left").join(last, "path").withColumn("last", F.coalesce("last", "records"))
    section = F.when(F.col("last") > F.col("first"), F.format_string("rows %d-%d", "first", "last")).otherwise(F.format_string("row %d", "first"))
    chunks = stored(chunks.select("path", "first", F.expr(f"first div {BLOCK_ROWS}").alias("block"), section.alias("section"), chunking.pack_paragraphs(F.col("body")).alias("pieces")))

    # ordinals: a running number of blocks, and of pieces in a block
    sizes = chunks.groupBy("path", "block").agg(F.sum(F.size("pieces")).alias("n"))
    so_far = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("path", "block", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("offset"))
    pieces = chunks.join(sizes, ["path", "block"]).select("path", "block", "first", "section", "offset", F.posexplode("pieces").alias("no", "text"))
    number = F.row_number().over(Window.partitionBy("path", "block").orderBy("first", "no")) - 1 + F.col("offset")
    return pieces.select("path", "section", "text", number.cast("int").alias("ordinal"))


def chunk_large_csv(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of one or more CSV files of any size (a path, folder or glob), read in splits."""
    return chunk_csv_lines(read_lines(spark, path))
