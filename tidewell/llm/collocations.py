"""Phrase collocation mining: level-wise (Apriori) passes over the corpus, then scores from the level tables.

Level k counts the phrases of k words. Every occurrence of a phrase is one of both its overlapping parts of k - 1 words, so a
phrase as frequent as asked has frequent parts; level k emits a phrase only where both parts may be frequent. What is frequent
is passed to the tasks as a bitmap of a fixed number of bits, however many phrases there are: a phrase that slips through
is counted like any other and dropped by its own count, so a full bitmap costs time, not results.

Each task counts the phrases of a slice of text exactly (words are numbered by an Arrow dictionary, phrases by pairs of numbers) and
sends one row a phrase and slice, which Spark adds up by the phrase itself. No hash decides a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm import bytekit, scratch

LEAST = 10
LONGEST = 3
TOP = 2000
SHARE = 50
#: Bits of the bitmap of a level: 4 MB for each task, whatever the corpus.
BITS = 1 << 25
_SLICE = 1 << 20
#: Parts that a group's candidates are ranked in first.
PARTS = 32
#: floor(1000000 * a * a / (l * r)) in decimals, exact for counts up to 10 ** 14.
SCORE = """cast((cast(a as decimal(14, 0)) * cast(a as decimal(14, 0)) * cast(1000000 as decimal(7, 0)))
  div (cast(l as decimal(14, 0)) * cast(r as decimal(14, 0))) as long)"""

#: Between pieces [.,;:!?\x0A-\x0D], and between words [\x20\x09].
_PIECE = np.isin(np.arange(256), [*b".,;:!?\n\x0b\x0c\r"])
_WORD = ~_PIECE & ~np.isin(np.arange(256), [*b" \t"])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Different words of a slice, the number of each word, its row, and whether the next word stands in the same piece of the same row."""
    data = _LOWER[data]
    begin, end, first = bytekit.words(data, offsets, _WORD)
    n = len(begin)
    if not n:
        return pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    # words and what stands between them, one after the other: an array over the bytes as they are
    ends = np.empty(2 * n, np.int32)
    ends[0::2], ends[1::2] = begin, end
    strings = pa.StringArray.from_buffers(2 * n - 1, pa.py_buffer(ends), pa.py_buffer(data))
    coded = strings.dictionary_encode()
    number = coded.indices.to_numpy()[0::2].astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    breaks = np.concatenate(([0], np.cumsum(_PIECE[data], dtype=np.int64)))
    joined = np.zeros(n, bool)
    joined[:-1] = (row[1:] == row[:-1]) & (breaks[begin[1:]] == breaks[end[:-1]])
    return coded.dictionary, number, row, joined


def _seeds(column: pa.Array) -> np.ndarray:
    data, offsets = bytekit.buffers(column)
    return bytekit.stretch_hash(bytekit.prefix_hash(data, bytekit._VALUES), offsets[:-1], offsets[1:])


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of its two parts."""
    return bytekit.mix64(a * np.uint64(0xD6E8FEB86659FD93) + b)


def _level_one(words: np.ndarray, groups: np.ndarray) -> np.ndarray:
    return _pair(words, groups)


def _count(texts: DataFrame, k: int, known: list) -> DataFrame:
    """(grp, phrase, f) of the phrases of k words that the bitmaps of the lower levels let through."""

    def lit(j: int, h: np.ndarray) -> np.ndarray:
        slot = h & np.uint64(BITS - 1)
        return (known[j - 1].value[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column("grp").dictionary_encode()
            group = coded.indices.to_numpy()
            names, seeds = coded.dictionary, _seeds(coded.dictionary)
            data, offsets = bytekit.buffers(batch.column("text"))
            for a, b in bytekit.slices(offsets, _SLICE):
                words, number, row, joined = _tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if not len(number):
                    continue
                different, at, f = np.unique(group[a + row] * np.int64(len(words)) + number, return_inverse=True, return_counts=True)
                of, word = different // len(words), different % len(words)
                parts = [words.take(pa.array(word))]  # of each different phrase, the words
                h = _level_one(_seeds(words)[word], seeds[of])
                ok = np.ones(len(at), bool)  # a phrase of j words begins here
                for j in range(2, k + 1):
                    frequent = lit(j - 1, h)
                    ok = ok & frequent[at]
                    here = np.flatnonzero(ok[:-1] & ok[1:] & (joined[:-1] if j == 2 else True))
                    pairs, back, f = np.unique(at[here] * np.int64(len(h)) + at[here + 1], return_inverse=True, return_counts=True)
                    left, right = pairs // len(h), pairs % len(h)
                    parts = [p.take(pa.array(left)) for p in parts] + [parts[-1].take(pa.array(right))]
                    of, h = of[left], _pair(h[left], h[right])
                    ok = np.zeros(len(ok), bool)
                    ok[here] = True
                    at = np.zeros(len(ok), np.int64)
                    at[here] = back
                    if not len(h):
                        break
                if len(h):
                    phrase = pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(of)), phrase, pa.array(f.astype(np.int64))], ["grp", "phrase", "f"])

    return texts.mapInArrow(run, "grp string, phrase string, f long").groupBy("grp", "phrase").agg(F.sum("f").alias("f"))


def _bitmap(level: DataFrame, k: int):
    """The phrases of a level table (k words each) as a bitmap of BITS bits, broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            seeds = _seeds(batch.column("grp"))
            words = _seeds(pc.split_pattern(batch.column("phrase"), " ").flatten()).reshape(-1, k)
            hashes = [_level_one(words[:, j], seeds) for j in range(k)]
            while len(hashes) > 1:
                hashes = [_pair(a, b) for a, b in zip(hashes, hashes[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array((hashes[0] & np.uint64(BITS - 1)).astype(np.int64))], ["slot"])

    slots = level.select("grp", "phrase").mapInArrow(run, "slot long")
    words = slots.groupBy(F.expr("cast(slot div 64 as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("mask"))
    bits = np.zeros(BITS // 64, np.int64)
    got = words.toArrow()  # BITS / 64 rows at most
    bits[got.column("word").to_numpy()] = got.column("mask").to_numpy()
    return level.sparkSession.sparkContext.broadcast(bits.view(np.uint8))


def levels(docs: DataFrame, text_col: str = "text", group_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """The tables (grp, phrase, f) of frequent phrases of 1 to `longest` words, and (grp, n), the number of words of each group."""
    scratch.small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(f"`{group_col}`").cast("string"), F.lit("und")).alias("grp"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    every = scratch.table(_count(texts, 1, []))
    total = scratch.table(every.groupBy("grp").agg(F.sum("f").alias("n")))
    tables, known = [scratch.table(every.filter(F.col("f") >= least))], []
    scratch.drop(every)
    for k in range(2, longest + 1):
        known.append(_bitmap(tables[-1], k - 1))
        tables.append(scratch.table(_count(texts, k, known).filter(F.col("f") >= least)))
    for bits in known:
        bits.destroy()
    return tables, total


def mine(docs: DataFrame, text_col: str = "text", group_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each group's first `top` collocations.

    Words are lower-cased (A-Z); a phrase stays within a piece. A candidate has 2 to `longest` words and occurs `least` times or more
    (a). Its cut after k words gives l and r, the counts of the two parts, and floor(1000000 * a * a / (l * r)); the lowest cut counts, of
    equal ones the first. Candidates inside a longer candidate that has `share` percent of their occurrences or more are dropped.

    Null and empty texts and texts without a word give nothing; repeated rows count each time; a null group is `und`, as is a group of
    that name. Equal scores are ordered by a, then by the bytes of the phrase, so ranks are unique. An empty table gives an empty result; other
    columns are ignored.
    """
    with scratch.steps(docs.sparkSession) as keep:
        tables, total = levels(docs, text_col, group_col, least, longest)
        counts = tables[0].withColumn("size", F.lit(1))
        for k, level in enumerate(tables[1:], 2):
            counts = counts.unionByName(level.withColumn("size", F.lit(k)))
        found = counts.filter("size > 1")
        words = F.split("phrase", " ")

        # the lowest cut
        at = F.sequence(F.lit(1), F.col("size") - 1)
        cuts = found.select("grp", "phrase", "size", F.col("f").alias("a"), words.alias("w"), F.explode(at).alias("k"))
        part = lambda begin, count: F.array_join(F.slice("w", begin, count), " ")
        cuts = cuts.select("grp", "phrase", "size", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
        heads, tails = (counts.select("grp", F.col("phrase").alias(p), F.col("f").alias(c)) for p, c in (("head", "l"), ("tail", "r")))
        cuts = cuts.join(heads, ["grp", "head"]).join(tails, ["grp", "tail"])
        cuts = cuts.withColumn("score", F.expr(SCORE))
        best = cuts.groupBy("grp", "phrase").agg(F.max("a").alias("a"), F.max("size").alias("size"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

        # those that stand inside a longer one
        spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
        inner = found.filter("size > 2").withColumn("w", words).select("grp", F.col("f"), F.explode(spans).alias("phrase"))
        inner = inner.groupBy("grp", "phrase").agg(F.max("f").alias("longer"))
        best = best.join(inner, ["grp", "phrase"], "left").filter(F.expr(f"longer is null or 100 * longer < {share} * a"))

        # a group's first rows are those of its parts: no task sorts all candidates of a group
        order = (F.desc("cut.score"), F.desc("a"), "phrase")
        part = Window.partitionBy("grp", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
        best = best.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order))).filter(F.col("rank") <= top)
        out = best.join(total, "grp")
        return keep(scratch.table(out.select(F.col("grp").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))))


#: Every phrase of one to three words, counted; then the same rules. (Feasible for thousands of documents.)
ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS g, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT g, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
o AS (
  SELECT g, 1 AS size, unnest(w) AS phrase FROM w
  UNION ALL SELECT g, 2, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) FROM w
  UNION ALL SELECT g, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM w),
f AS (SELECT g, size, phrase, count(*) AS f FROM o GROUP BY ALL),
n AS (SELECT g, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY g),
c AS (SELECT g, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
k AS (
  SELECT *, 1 AS k, w[1] AS head, array_to_string(w[2:], ' ') AS tail FROM c
  UNION ALL SELECT *, 2, array_to_string(w[1:2], ' '), w[3] FROM c WHERE size = 3),
s AS (
  SELECT k.g, k.phrase, k.a, k.k, x.f AS l, y.f AS r, (1000000::HUGEINT * k.a * k.a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM k JOIN f x ON x.g = k.g AND x.phrase = k.head JOIN f y ON y.g = k.g AND y.phrase = k.tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY g, phrase ORDER BY score, k) = 1),
i AS (SELECT g, phrase, max(a) AS longer FROM (
  SELECT g, a, array_to_string(w[1:2], ' ') AS phrase FROM c WHERE size = 3
  UNION ALL SELECT g, a, array_to_string(w[2:3], ' ') FROM c WHERE size = 3) GROUP BY ALL),
q AS (SELECT b.*, row_number() OVER (PARTITION BY b.g ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM b LEFT JOIN i ON i.g = b.g AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a)
SELECT q.g AS lang, q.rank, q.phrase, q.a, q.l, q.r, n.n, q.score FROM q JOIN n ON n.g = q.g WHERE q.rank <= 2000
"""
