"""Removal of repeated 100-byte strings by bucket-pointer refinement.

Positions are sorted into buckets by q-grams, and buckets are refined by the identifiers of buckets at later offsets until
they stand for 100 bytes. An identifier is the 64-bit hash of the bucket's content, so no round renumbers the corpus.

1. Initial buckets. Of the 69 32-grams inside a 100-byte window the one with the smallest hash is the window's anchor (the
   leftmost of equal ones). Equal windows have their anchor at the same place, so only anchors (about 1 position in 35)
   enter the buckets: consecutive windows with one anchor form a run, filed under the anchor's bucket.
2. First refinement. Inside a bucket, runs with equal identifiers of the whole stretch they span are equal window by
   window: all but the earliest are repeats at once. A bucket with one such class is done.
3. Second refinement, of the earliest runs of buckets with several classes only: identifiers of 25 bytes are joined with those
   25 bytes later, those of 50 with those 50 bytes later; windows equal in the 100-byte identifier form the final
   buckets, and all but the earliest are repeats.

Before each shuffle a batch keeps one run of each (bucket, identifier), the earliest; its others are repeats already and are
dealt out by row instead, so a passage in a third of all documents does not gather in one task. Sorted buckets are read as a
stream with one row of memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import bytekit, scratch

LENGTH = 100
GRAM = 32
STEP = 25
#: A run is packed into one long: start * 128 + windows.
PACK = 128
_REACH = LENGTH - GRAM + 1


def ordered(docs: DataFrame, id_col: str, text_col: str, carry: list[str] = []) -> DataFrame:  # noqa: B006
    """key, doc_id, text, and the carried columns as _0, _1, ...; key orders rows by doc_id."""
    others = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(carry)]
    return scratch.keyed(docs, id_col).select(F.col("__tw_key").alias("key"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *others)


def _sliding_min(x: np.ndarray) -> np.ndarray:
    """Minimum of each _REACH (69 = 64 + 5) consecutive values."""
    width = 1
    while width * 2 <= _REACH:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (_REACH - width)], x[_REACH - width :])


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """bucket (hash of the anchor), identifier of the stretch, row, packed run, for all runs of the rows."""
    n = len(data)
    if n < LENGTH:
        none = np.empty(0, np.uint64)
        return none, none, np.empty(0, np.int64), np.empty(0, np.int64)
    s = bytekit.prefix_hash(data, bytekit._VALUES)
    h = bytekit.mix64((s[GRAM:] - s[:-GRAM]) * bytekit.powers(bytekit._INVERSE, n)[: n - GRAM + 1])
    low = np.uint64(0xFFFFFFFF)
    anchor = (_sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64)) & low).astype(np.int64)
    # windows that would run into the next row do not count
    edge = np.zeros(len(anchor) + 1, np.int64)
    ends = offsets[1:]
    np.add.at(edge, np.minimum(np.maximum(offsets[:-1], ends - LENGTH + 1), len(anchor)), 1)
    np.add.at(edge, np.minimum(ends, len(anchor)), -1)
    valid = np.cumsum(edge[:-1]) == 0
    change = np.ones(len(anchor) + 1, bool)
    change[1:-1] = (anchor[1:] != anchor[:-1]) | ~valid[:-1] | ~valid[1:]
    begin, end = np.flatnonzero(change[:-1] & valid), np.flatnonzero(change[1:] & valid) + 1
    row = np.searchsorted(offsets, begin, "right") - 1
    return h[anchor[begin]], bytekit.stretch_hash(s, begin, end + LENGTH - 1), row, (begin - offsets[row]) * PACK + (end - begin)


def _combined(bucket: np.ndarray, ident: np.ndarray, key: np.ndarray, run: np.ndarray) -> pa.RecordBatch:
    """The rows, with negative runs (~run) and zeros for all but the earliest of each (bucket, ident)."""
    order = np.lexsort((run, key, ident, bucket))
    again = np.zeros(len(order), bool)
    again[order[1:]] = (bucket[order][1:] == bucket[order][:-1]) & (ident[order][1:] == ident[order][:-1])
    bucket, ident, run = np.where(again, 0, bucket), np.where(again, 0, ident), np.where(again, ~run, run)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket, ident, key, run)], ["bucket", "ident", "key", "run"])


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Sorted buckets, one in one partition; known repeats by their keys."""
    spread = F.when(F.col("run") < 0, F.xxhash64("key", "run")).otherwise(F.lit(0))
    return rows.repartition(*by, spread).sortWithinPartitions("bucket", "ident", "key", "run")


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = bytekit.buffers(batch.column("text"))
        key = batch.column("key").to_numpy(zero_copy_only=False)
        parts = []
        for a, b in bytekit.slices(offsets):
            bucket, ident, row, run = runs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            parts.append((bucket.view(np.int64), ident.view(np.int64), key[a + row], run))
        if parts:
            yield _combined(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _split(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(bucket, ident, key, run) of the rows to compare, and (bucket, key, run) of known repeats."""
    bucket, ident, key, run = columns = [batch.column(i).to_numpy() for i in range(4)]
    known = run < 0
    return [c[~known] for c in columns], [bucket[known], key[known], ~run[known]]


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From runs sorted by (bucket, ident, key, run): repeats (open false), and the earliest run of each ident of a bucket
    that has several (open true)."""
    last = None  # (bucket, ident) of the last row
    held = None  # the earliest run of a bucket's only ident so far: bucket, key, run
    for batch in batches:
        (bucket, ident, key, run), known = _split(batch)
        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in known), pa.array(np.zeros(len(known[0]), bool))], ["bucket", "key", "run", "open"])
        if not len(bucket):
            continue
        first = np.ones(len(bucket), bool)
        first[1:] = (bucket[1:] != bucket[:-1]) | (ident[1:] != ident[:-1])
        first[0] = last != (bucket[0], ident[0])
        lead = np.flatnonzero(first)
        b, k, r = bucket[lead], key[lead], run[lead]
        # a bucket that began in an earlier batch: held is its only class, or it is open already (held run < 0)
        if held is not None:
            b, k, r = np.concatenate(([held[0]], b)), np.concatenate(([held[1]], k)), np.concatenate(([held[2]], r))
        several = np.zeros(len(b), bool)
        same = b[1:] == b[:-1]
        several[1:] |= same
        several[:-1] |= same
        sure = several & (r >= 0)
        if len(b):
            held = (b[-1], k[-1], -1 if several[-1] or r[-1] < 0 else r[-1])
        last = (bucket[-1], ident[-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((bucket[~first], b[sure]))), pa.array(np.concatenate((key[~first], k[sure]))), pa.array(np.concatenate((run[~first], r[sure]))), pa.array(np.concatenate((np.zeros((~first).sum(), bool), np.ones(sure.sum(), bool))))],
            ["bucket", "key", "run", "open"],
        )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of open runs with their 100-byte identifiers, by doubling those of 25 bytes."""
    for batch in batches:
        data, offsets = bytekit.buffers(batch.column("text"))
        key = batch.column("key").to_numpy()
        listed = batch.column("run")
        at, packed = listed.offsets.to_numpy().astype(np.int64), listed.values.to_numpy()
        buckets = batch.column("bucket").values.to_numpy()
        for a, b in bytekit.slices(offsets):
            part = data[offsets[a] : offsets[b]]
            begin, count = packed[at[a] : at[b]] // PACK, packed[at[a] : at[b]] % PACK
            row = np.repeat(np.arange(a, b), np.diff(at[a : b + 1]))
            s = bytekit.prefix_hash(part, bytekit._VALUES)
            ident = bytekit.mix64((s[STEP:] - s[:-STEP]) * bytekit.powers(bytekit._INVERSE, len(part))[: len(part) - STEP + 1])
            width = STEP
            while width < LENGTH:
                ident = bytekit.mix64(ident[:-width] * np.uint64(0xD6E8FEB86659FD93) + ident[width:])
                width *= 2
            start = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            of = np.repeat(row, count)
            place = offsets[of] - offsets[a] + start
            yield _combined(np.repeat(buckets[at[a] : at[b]], count), ident[place].view(np.int64), key[of], start * PACK + 1)


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From windows sorted by (bucket, ident, key, run): all but the first of each ident."""
    last = None
    for batch in batches:
        (bucket, ident, key, run), known = _split(batch)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in known[1:]], ["key", "run"])
        if not len(bucket):
            continue
        first = np.ones(len(bucket), bool)
        first[1:] = (bucket[1:] != bucket[:-1]) | (ident[1:] != ident[:-1])
        first[0] = last != (bucket[0], ident[0])
        last = (bucket[-1], ident[-1])
        yield pa.RecordBatch.from_arrays([pa.array(key[~first]), pa.array(run[~first])], ["key", "run"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes the bytes under the repeated windows of each row: what is left, and where the removed spans begin and end."""
    for batch in batches:
        data, offsets = bytekit.buffers(batch.column("text"))
        listed = batch.column("run")
        listed = listed.fill_null([]) if listed.null_count else listed
        at, packed = listed.offsets.to_numpy().astype(np.int64), listed.values.to_numpy()
        kept, begins, ends = [], [], []
        for i in range(len(offsets) - 1):
            part = data[offsets[i] : offsets[i + 1]]
            begin, count = packed[at[i] : at[i + 1]] // PACK, packed[at[i] : at[i + 1]] % PACK
            depth = np.bincount(begin, minlength=len(part) + 1) - np.bincount(begin + count + LENGTH - 1, minlength=len(part) + 1)
            edge = np.diff((np.cumsum(depth) > 0).astype(np.int8), prepend=0, append=0)
            begins.append(np.flatnonzero(edge > 0))
            ends.append(np.flatnonzero(edge < 0))
            kept.append(part[np.cumsum(edge[: len(part)]) == 0].tobytes())
        spans = [pa.array(x, pa.list_(pa.int64())) for x in (begins, ends)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(kept, pa.binary()), *spans], ["doc_id", "n_bytes", "kept", "begins", "ends"])


def repeats(texts: DataFrame) -> DataFrame:
    """(key, run): every run of windows that also starts earlier. texts: key, text."""
    columns = "bucket long, ident long, key long, run long"
    filed = texts.select("key", "text").mapInArrow(_file, columns)
    solved = _dealt(filed, "bucket").mapInArrow(_resolve, "bucket long, key long, run long, open boolean")
    solved = scratch.table(solved)
    todo = solved.filter("open").groupBy("key").agg(F.collect_list(F.struct("bucket", "run")).alias("l")).select("key", F.col("l.bucket").alias("bucket"), F.col("l.run").alias("run"))
    near = scratch.maybe_in(texts.select("key", "text"), F.col("key"), solved.filter("open").select("key"), F.col("key"))
    windows = near.join(todo, "key").select("key", "text", "bucket", "run").mapInArrow(_windows, columns)
    late = _dealt(windows, "bucket", "ident").mapInArrow(_later, "key long, run long")
    return solved.filter("not open").select("key", "run").unionByName(late)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, kept (the remaining bytes), begins and ends (of the removed spans, in bytes).

    A byte goes if a 100-byte string over it also starts earlier: in a row of smaller doc_id (null last; rows of one id in
    the order of the table), or earlier in the same row. Null texts are empty; texts below 100 bytes stay whole. Matches
    never cross rows, and all are judged on the input, so of repeated rows the first stays whole. What is left may end inside a
    character, so it is binary. Empty tables give an empty result; other columns are ignored, whatever their names.
    """
    scratch.small_batches(docs.sparkSession)
    texts = ordered(docs, id_col, text_col)
    with scratch.steps(docs.sparkSession) as keep:
        found = keep(scratch.table(repeats(texts).groupBy("key").agg(F.collect_list("run").alias("run"))))
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, kept binary, begins array<long>, ends array<long>"
    # rows without repeats stay where they are read; only the others (and what the bitmap lets through) are shuffled
    bits = 1 << 22
    marks = scratch.bitmap(found.select("key"), F.col("key"), bits)
    marked = scratch.mark(texts, F.col("key"), marks, bits, "_maybe")
    none = F.array().cast("array<bigint>")
    clean = marked.filter("not _maybe").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce("text", F.lit("")).cast("binary").alias("kept"), none.alias("begins"), none.alias("ends"))
    dirty = marked.filter("_maybe").select("key", "doc_id", "text").join(found, "key", "left").select("doc_id", "text", "run").mapInArrow(_cut, schema)
    return clean.unionByName(dirty)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """cut_repeats as numbers and a digest: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    cut = cut_repeats(docs, id_col, text_col)
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("begins").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
