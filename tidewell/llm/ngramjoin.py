"""Exact n-gram Jaccard join: a grouped prefix join.

A document's set holds its distinct five-word shingles, as 64-bit hashes. Shingles are ordered by rarity: by a sketch of
their counts over all documents, then by hash. Two sets with Jaccard similarity t or more share a shingle among their first
n - ceil(t * n) + 1.

1. Equal sets become one class (128-bit set hash and size).
2. Classes with identical prefixes and size become one group; only the group's leader enters the prefix index.
3. Star rounds: in each bucket the members are verified against one of them, in the first round the one with the fewest
   shingles before the shared one (the least edited copy, as edits make rare shingles), then the second, and so on.
   Verified links give components, which most copies of one text join here; pairs inside a component are left out.
4. Last round: every pair of members of different components that meets in a bucket and passes the length, positional and
   count filters is verified. A pair inside one component cannot change the result, so a family of k copies costs about k
   comparisons a round and not k * k.

The count filter: with p the length of the prefixes, the intersection is at most the shared prefix shingles + n - p (of the larger
one), so about 45 % of the prefixes must agree.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm import bytekit, scratch

SHINGLE = 5
PERCENT = 80
SKETCH_BITS = 20
_PARTS = 64


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All shingles (not distinct) of the rows, and where each row's begin. Fewer words than SHINGLE make one shingle."""
    begin, end, first = bytekit.words(data, offsets, bytekit.SPACED)
    if not len(begin):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = bytekit.stretch_hash(bytekit.prefix_hash(data), begin, end)
    count = np.diff(first)
    h = bytekit.ngrams(word, SHINGLE)
    ok = np.ones(len(h), bool)
    for back in range(1, SHINGLE):
        at = first[1:] - back
        ok[at[(at >= 0) & (at < len(h))]] = False
    kept = np.maximum(count - SHINGLE + 1, 0)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    out, starts = h[ok], np.concatenate(([0], np.cumsum(kept)))
    if len(short):
        whole = np.array([bytekit.ngrams(word[first[r] : first[r + 1]], int(count[r]))[0] for r in short], np.uint64)
        whole ^= bytekit.mix64(count[short].astype(np.uint64))
        out = np.insert(out, starts[short], whole)
        kept[short] = 1
        starts = np.concatenate(([0], np.cumsum(kept)))
    return out, starts


def _text_slices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, offsets = bytekit.buffers(batch.column("text"))
    for a, b in bytekit.slices(offsets):
        yield a, *shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def rarity_sketch(texts: DataFrame) -> np.ndarray:
    """Occurrences of all shingles of all documents in 2 ** SKETCH_BITS counters. The counters of the tasks are added on the
    executors, in two levels; the driver gets the sums only, whose size is fixed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            slots = [(h >> np.uint64(64 - SKETCH_BITS)).astype(np.uint32) for _, h, _ in _text_slices(batch)]
            if slots:
                total += np.bincount(np.concatenate(slots), minlength=len(total)).astype(np.uint32)
        if total.any():
            parts = [zlib.compress(p.tobytes(), 1) for p in np.split(total, _PARTS)]
            salt = int(total.sum(dtype=np.uint64) % 32)
            yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array([salt] * _PARTS, pa.int32()), pa.array(parts, pa.binary())], ["part", "salt", "counts"])

    def add(key, table):
        total = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.uint64) for x in table["counts"].to_pylist())
        total = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
        return pa.table({"part": [key[0].as_py()], "salt": [key[1].as_py()], "counts": [zlib.compress(total.tobytes(), 1)]}, schema=_SKETCH)

    rows = texts.select("text").mapInArrow(count, "part int, salt int, counts binary")
    rows = rows.groupBy("part", "salt").applyInArrow(add, "part int, salt int, counts binary").withColumn("salt", F.lit(0))
    rows = rows.groupBy("part", "salt").applyInArrow(add, "part int, salt int, counts binary")
    sketch = np.zeros((_PARTS, (1 << SKETCH_BITS) // _PARTS), np.uint32)
    for r in rows.collect():
        sketch[r["part"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    return sketch.ravel()


_SKETCH = pa.schema([("part", pa.int32()), ("salt", pa.int32()), ("counts", pa.binary())])


def profiles(texts: DataFrame, sketch: np.ndarray, percent: int) -> DataFrame:
    """_row, doc_id, n, lo, hi (set hash), pa, pb (prefix hash) and the prefix of every row."""
    shared = texts.sparkSession.sparkContext.broadcast(sketch)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        salt = np.uint64(0x5851F42D4C957F2D)
        for batch in batches:
            size = batch.num_rows
            n, sums, prefixes = np.zeros(size, np.int64), np.zeros((4, size), np.uint64), []
            lengths = np.zeros(size + 1, np.int32)
            for a, h, starts in _text_slices(batch):
                for r in range(len(starts) - 1):
                    s = np.unique(h[starts[r] : starts[r + 1]])
                    if not len(s):
                        continue
                    i = a + r
                    n[i] = len(s)
                    keep = len(s) - -(-percent * len(s) // 100) + 1
                    key = _ordered(s, counts)  # only the prefix needs to be in order
                    head = np.argpartition(key, keep - 1)[:keep] if keep < len(s) else np.arange(len(s))
                    prefix = s[head[np.argsort(key[head], kind="stable")]]
                    for j, of in enumerate((s, prefix)):
                        sums[2 * j, i], sums[2 * j + 1, i] = bytekit.mix64(of).sum(dtype=np.uint64), bytekit.mix64(of ^ salt).sum(dtype=np.uint64)
                    prefixes.append(prefix)
                    lengths[i + 1] = keep
            flat = np.concatenate(prefixes) if prefixes else np.empty(0, np.uint64)
            listed = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths, dtype=np.int32)), pa.array(flat.view(np.int64)))
            hashes = [pa.array(x.view(np.int64)) for x in sums]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), pa.array(n), *hashes, listed], ["_row", "doc_id", "n", "lo", "hi", "pa", "pb", "prefix"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(profile, f"_row long, doc_id {kind}, n long, lo long, hi long, pa long, pb long, prefix array<long>")


def _ordered(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Keys that order shingles by rarity: counter, then hash."""
    return (counts[s >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(32)) | (s & np.uint64(0xFFFFFFFF))


def _sets(texts: DataFrame) -> DataFrame:
    """_row and the whole set of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("_row")
            for a, h, starts in _text_slices(batch):
                sets = [np.unique(h[starts[r] : starts[r + 1]]) for r in range(len(starts) - 1)]
                at = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([rows.slice(a, len(sets)), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["_row", "s"])

    return texts.select("_row", "text").mapInArrow(run, "_row long, s array<long>")


def _rest(n: str, percent: int):
    """n - p: the shingles after the prefix."""
    return F.expr(f"cast(({percent} * {n} + 99) div 100 as int) - 1")


def _enough(shared, na: str, nb: str, percent: int):
    """The count filter, for the number of shared prefix shingles."""
    most = shared + F.greatest(_rest(na, percent), _rest(nb, percent))
    return (100 + percent) * most >= percent * (F.col(na) + F.col(nb))


def _verified(pairs: DataFrame, rows: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of rows whose sets are similar enough, as a table: the count filter on the stored prefixes first; the whole sets only
    of the pairs that are left, from their texts."""

    def fetch(some: DataFrame, source: DataFrame, load=None) -> DataFrame:
        ends = scratch.table(some.select(F.col("a").alias("cid")).unionByName(some.select(F.col("b").alias("cid"))).distinct())
        near = scratch.maybe_in(source, F.col("_row"), ends, F.col("cid"))
        if load:
            near = load(near.join(ends.select(F.col("cid").alias("_row")), "_row", "left_semi"))
        near = scratch.table(near)  # read twice, for both ends
        return some.join(near.toDF("b", "nb", "sb"), "b").join(near.toDF("a", "na", "sa"), "a").withColumn("common", F.size(F.array_intersect("sa", "sb")))

    with scratch.steps(rows.sparkSession) as keep:
        near = fetch(pairs, rows.select("_row", "n", "prefix"))
        near = scratch.table(near.filter(_enough(F.col("common"), "na", "nb", percent)).select("a", "b"))
        both = fetch(near, texts.select("_row", "text"), lambda t: _sets(t).select("_row", F.size("s").alias("n"), "s"))
        return keep(scratch.table(both.filter(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")))


def _passes(percent: int, na: str, pos_a: str, nb: str, pos_b: str):
    """Length and positional filters of a pair, for its first shared shingle: from there on both sets must be long enough for the
    intersection that their sizes need. A similar pair passes in one bucket at least."""
    a, b, i, j = F.col(na), F.col(nb), F.col(pos_a), F.col(pos_b)
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & ((100 + percent) * F.least(a - i, b - j) >= percent * (a + b))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, segments: int = 64, rounds: int = 8) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, _row (a key), _comp (a number of the component; null if the set is empty).

    component_id is the smallest doc_id reachable over links (100 * intersection >= percent * union). Null or blank texts have
    an empty set and only themselves; rows of equal sets are linked. Null ids come after all others. An empty table gives
    an empty result; columns other than the two are ignored. Whole texts are used, and all links between different texts
    count, whether or not they were compared one by one. `rounds` bounds the star rounds, not the result.
    """
    scratch.small_batches(docs.sparkSession)
    return _join(scratch.keyed(docs, id_col), id_col, text_col, percent, segments, rounds)


def _join(docs: DataFrame, id_col: str, text_col: str, percent: int = PERCENT, segments: int = 64, rounds: int = 8) -> DataFrame:
    with scratch.steps(docs.sparkSession) as keep:
        return keep(scratch.table(_linked(docs, id_col, text_col, percent, segments, rounds)))


def _linked(docs: DataFrame, id_col: str, text_col: str, percent: int, segments: int, rounds: int) -> DataFrame:
    texts = docs.select(F.col("__tw_key").alias("_row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = scratch.table(profiles(texts, rarity_sketch(texts), percent))

    # 1. classes of equal sets, hot ones merged in segments
    key = ["lo", "hi", "n"]
    full = rows.filter("n > 0").withColumn("seg", F.pmod(F.col("_row"), F.lit(segments)))
    merged = full.groupBy(*key, "seg").agg(F.min("_row").alias("first"), F.min("doc_id").alias("least"))
    one = Window.partitionBy(*key)
    merged = merged.select(*key, "seg", F.min("first").over(one).alias("cid"), F.min("least").over(one).alias("label"))
    member = scratch.table(full.drop("prefix", "pa", "pb").join(merged, [*key, "seg"]).select("_row", "doc_id", "n", "cid", "label"))
    classes = full.join(member.filter("_row = cid").select("_row", "label"), "_row").select(F.col("_row").alias("cid"), "label", "n", "pa", "pb", "prefix")

    # 2. groups of classes with identical prefixes and size; buckets with one class are dropped
    same = Window.partitionBy("n", "pa", "pb")
    classes = classes.withColumn("gid", F.min("cid").over(same)).withColumn("m", F.count("*").over(same))
    groups = classes.filter("cid = gid").select("gid", F.col("n").cast("int").alias("n"), F.col("m").cast("int").alias("m"), F.posexplode("prefix").alias("pos", "token"))
    index = groups.withColumn("all", F.sum("m").over(Window.partitionBy("token"))).filter("`all` > 1")
    index = scratch.table(index.select("token", "gid", "n", "pos"))
    # expanded to members; only classes of the index can have links
    expand = classes.join(index.select("gid").distinct(), "gid", "left_semi").select("gid", "cid", "label", "n")
    expand = scratch.table(expand)

    # 3. stars
    links, comp = None, None
    for turn in range(rounds):
        spread = _open_buckets(index, expand, comp)
        order = Window.partitionBy("token").orderBy("pos", "cid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        star = spread.withColumn("x", F.nth_value(F.struct("cid", "comp", "n", "pos"), turn + 1).over(order)).filter("x is not null and x.comp <> comp")
        star = star.select(F.col("cid").alias("b"), F.col("n").alias("bn"), F.col("pos").alias("bp"), F.col("x.cid").alias("a"), F.col("x.n").alias("an"), F.col("x.pos").alias("ap"))
        star = scratch.table(star.filter(_passes(percent, "an", "ap", "bn", "bp")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        tried = star.count()
        if not tried:
            break
        found = _verified(star, rows, texts, percent)
        scratch.drop(spread, star)
        new = found.count()
        if new:
            links = found if links is None else links.unionByName(found)
            scratch.drop(comp)
            comp = scratch.components(links)
        if turn and new * 50 < tried:
            break

    # 4. all pairs of different components
    spread = _open_buckets(index, expand, comp)
    per = spread.groupBy("token", "comp").agg(F.count("*").alias("k"))
    main = per.groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"))
    spread = scratch.table(spread.join(main, "token"))
    a = spread.filter("comp <> main").select("token", F.col("cid").alias("a"), F.col("comp").alias("ac"), F.col("n").alias("an"), F.col("pos").alias("ap"))
    b = spread.select("token", F.col("cid").alias("b"), F.col("comp").alias("bc"), F.col("n").alias("bn"), F.col("pos").alias("bp"), (F.col("comp") != F.col("main")).alias("minor"))
    more = a.join(b, "token").filter((F.col("ac") != F.col("bc")) & (~F.col("minor") | (F.col("a") < F.col("b"))) & _passes(percent, "an", "ap", "bn", "bp"))
    more = scratch.table(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    scratch.drop(spread)
    if not more.isEmpty():
        late = _verified(more, rows, texts, percent)
        if not late.isEmpty():
            comp = scratch.components(late if links is None else links.unionByName(late))
    if comp is None:
        comp = expand.select(F.col("cid").alias("node"), F.col("cid").alias("comp"))
    classes = expand

    # labels: the smallest id of each component
    named = classes.select("cid", "label").join(comp.withColumnRenamed("node", "cid"), "cid")
    least = named.groupBy("comp").agg(F.min("label").alias("component_id"))
    linked = named.select("cid", "comp").join(least, "comp").select("cid", "comp", "component_id")
    out = member.join(linked, "cid", "left").select("_row", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "label").alias("component_id"), F.coalesce("comp", "cid").alias("_comp"))
    empty = rows.filter("n = 0").select("_row", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("_comp"))
    return out.unionByName(empty).select("doc_id", "n_shingles", "component_id", "_row", "_comp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without all but one row of each component: the one with the smallest id (null last), then the first row. Rows with an
    empty set stay."""
    scratch.small_batches(docs.sparkSession)
    rows = scratch.keyed(docs, id_col)
    with scratch.steps(docs.sparkSession) as keep:
        found = _join(rows, id_col, text_col, **options).filter("_comp is not null").select("_row", "_comp")
        kept = found.groupBy("_comp").agg(F.min("_row").alias("_row")).select("_row")  # keys are in the order of ids
        gone = keep(scratch.table(found.select("_row").join(kept, "_row", "left_anti").select(F.col("_row").alias("key"))))
    return scratch.without(rows, gone, docs.columns)


def _open_buckets(index: DataFrame, expand: DataFrame, comp: DataFrame | None) -> DataFrame:
    """(token, cid, comp, n, pos) of the buckets that hold classes of two components or more."""
    if comp is None:
        grown = expand.select("gid", "cid", F.col("cid").alias("comp"))
        return scratch.table(index.join(grown, "gid").select("token", "cid", "comp", "n", "pos"))
    grown = expand.select("gid", "cid").join(comp.withColumnRenamed("node", "cid"), "cid", "left").select("gid", "cid", F.coalesce("comp", "cid").alias("comp"))
    spread = index.join(grown, "gid").select("token", "cid", "comp", "n", "pos")
    # (spread is read twice here; the small side of the semi-join has one row a bucket)
    split = spread.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("token")
    return scratch.table(spread.join(split, "token"))


#: Pairs that share a shingle, then the links' closure. (Feasible for thousands of documents.)
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.m = e.x)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(m) AS component_id
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
