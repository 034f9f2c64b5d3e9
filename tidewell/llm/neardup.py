"""Near-duplicate vectors: NN-descent over balls of close copies.

1. Equal vectors of one label become one class, which counts as often as it occurs.
2. Balls: a class joins a centre within half the angle of a link, so that any two classes of a ball are linked without being
   compared. A family of close copies is one or a few balls, whatever its size.
3. NN-descent over the centres of each label. The first lists come from blocks of neighbours in the order of random hyperplane codes;
   then each centre's neighbours, in both directions, are compared with each other (pairs with a new list entry only) until few lists
   change. A list keeps its k nearest and is enlarged beyond k by all that lie near enough for a link between the two balls.
4. Pairs of balls that can hold links are compared member by member, in chunks; of each pair of chunks only counts are sent on.
5. Audit: a bounded number of classes is compared with all classes, in blocks. While they miss links, further orders and rounds are added.

Every link that counts was computed in double precision or follows from the triangle inequality of angles.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm import scratch

LEAST = 0.93
#: Neighbours in a list that no link enlarges; rows of a block; classes of a chunk; neighbours in a group of the local join.
K, BLOCK, CHUNK, GROUP = 10, 256, 512, 128
#: Hyperplane orders and rounds of a turn, turns, classes of the audit and the share of their links to be found.
TREES, ROUNDS, TURNS, AUDIT, RECALL = 4, 3, 4, 1024, 0.99
#: Rounds that merge balls.
COVERS = 3
#: Angles are kept this far (in radians) from the bounds that save a comparison.
_SAFE = 1e-6
_log = logging.getLogger(__name__)


def _units(raw: np.ndarray, kind: str, rows: int) -> np.ndarray:
    """Unit vectors in double precision, from the values of rows of one length."""
    v = raw.view(kind).reshape(rows, -1).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column and where each row's begin."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets


class _Rows:
    """Rows of a record batch with the vectors of any stretch of them."""

    def __init__(self, batch: pa.RecordBatch, kind: str):
        self.kind, (self.data, self.at) = kind, _raw(batch.column("vec"))
        self.of = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names if n not in ("vec", "label")}

    def units(self, a: int, b: int) -> np.ndarray:
        return _units(self.data[self.at[a] : self.at[b]], self.kind, b - a)


def _stretches(batches: Iterator[pa.RecordBatch], keys: list[str], kind: str, limit: int | None) -> Iterator[tuple[_Rows, int, int]]:
    """Stretches of rows with equal keys, of at most `limit` rows, of a sorted stream."""
    held: list[pa.RecordBatch] = []

    def cuts(rows: pa.RecordBatch, last: bool) -> tuple[list[tuple[int, int]], int]:
        n = rows.num_rows
        differs = np.zeros(max(n - 1, 0), bool)
        for k in keys:
            c = rows.column(k)
            differs |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False).astype(bool)
        edges = [0, *(np.flatnonzero(differs) + 1).tolist(), n]
        out = []
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            open_ = i == len(edges) - 2 and not last
            step = limit or max(b - a, 1)
            for x in range(a, b, step):
                if open_ and (limit is None or x + step > b):
                    return out, x
                out.append((x, min(x + step, b)))
        return out, n

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = whole()
        found, rest = cuts(rows, False)
        if found:
            view = _Rows(rows, kind)
            for a, b in found:
                yield view, a, b
        held[:] = [rows.slice(rest)] if rest < rows.num_rows else []
    if held:
        rows = whole()
        view = _Rows(rows, kind)
        for a, b in cuts(rows, True)[0]:
            yield view, a, b


def _ordered(nodes: DataFrame, tree: int, kind: str) -> DataFrame:
    """nodes (id, label, dim, vec, ...) within each label in the order of a code of 30 random hyperplanes."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _raw(batch.column("vec"))
            dims = batch.column("dim").to_numpy()
            codes = np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                raw = np.concatenate([data[at[r] : at[r + 1]] for r in rows]) if len(rows) < batch.num_rows else data[at[0] : at[-1]]
                planes = np.random.default_rng((77, tree, int(dim))).standard_normal((int(dim), 30))
                codes[rows] = (_units(raw, kind, len(rows)) @ planes > 0) @ (np.int64(1) << np.arange(29, -1, -1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes)], [*batch.schema.names, "code"])

    schema = nodes.schema.simpleString().removeprefix("struct<").removesuffix(">")
    coded = nodes.mapInArrow(code, f"{schema},code:bigint")
    return coded.repartitionByRange("label", "dim", "code", "id").sortWithinPartitions("label", "dim", "code", "id")


def _top(cos: np.ndarray, need: np.ndarray, k: int) -> np.ndarray:
    """Of each row the k largest entries and all needed ones; entries of -2 are none."""
    take = need.copy()
    if cos.shape[1] > k:
        kth = np.partition(cos, -k, axis=1)[:, -k]
        take |= cos >= kth[:, None]
    else:
        take[:] = True
    return take & (cos > -2)


_EDGES = "b long, nid long, cos double, need boolean"


def _edge_batch(ids: np.ndarray, cos: np.ndarray, need: np.ndarray, take: np.ndarray) -> tuple:
    i, j = np.nonzero(take)
    return ids[i], ids[j], cos[i, j], need[i, j]


def _batch(parts: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names)


def _gather(stretches: Iterator[tuple[_Rows, int, int]], one: Callable, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows that `one` gives for each stretch, in batches."""
    parts, size = [], 0
    for rows, a, b in stretches:
        got = one(rows, a, b)
        if got is not None and len(got[0]):
            parts.append(got)
            size += len(got[0])
        if size > 20_000:
            yield _batch(parts, names)
            parts, size = [], 0
    if parts:
        yield _batch(parts, names)


def _needed(cos: np.ndarray, rad: np.ndarray, theta: float) -> np.ndarray:
    """Pairs of balls that can hold a link, by the angle of their centres and their radii."""
    return cos >= np.cos(np.minimum(theta + rad[:, None] + rad[None, :] + _SAFE, math.pi))


class _Search:
    def __init__(self, kind: str, least: float, k: int):
        self.kind, self.k, self.least, self.theta = kind, k, least, math.acos(min(1.0, least))
        self.half = math.cos(max(self.theta / 2 - _SAFE, 0.0))

    # --- balls ---
    def cover(self, nodes: DataFrame) -> DataFrame:
        """nodes (id, label, dim, vec, m) with ball, the id of a class within half a link's angle, and near, the cosine to it."""
        kind, half = self.kind, self.half

        def absorb(rows: _Rows, a: int, b: int):
            u = rows.units(a, b)
            close = u @ u.T >= half
            ids, weight = rows.of["id"][a:b], rows.of["m"][a:b]
            to = np.arange(b - a)
            crowd = np.flatnonzero(close.sum(axis=1) > 1)
            open_ = np.ones(b - a, bool)
            for i in crowd[np.lexsort((ids[crowd], -weight[crowd]))]:
                if open_[i]:
                    mine = close[i] & open_
                    to[mine] = i
                    open_[mine] = False
            moved = np.flatnonzero(to != np.arange(b - a))
            return ids[moved], ids[to[moved]]

        def retest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                balls, near = batch.column("ball").to_numpy().copy(), batch.column("near").to_numpy().copy()
                own, at = _raw(batch.column("vec"))
                other, oat = _raw(batch.column("to_vec"))
                to = batch.column("to").fill_null(-1).to_numpy()
                for r in np.flatnonzero(batch.column("to").is_valid().to_numpy(zero_copy_only=False)):
                    pair = np.concatenate((own[at[r] : at[r + 1]], other[oat[r] : oat[r + 1]]))
                    x, y = _units(pair, kind, 2)
                    cos = float(x @ y)
                    if cos >= half:
                        balls[r], near[r] = to[r], cos
                keep = batch.select(["id", "label", "dim", "vec", "m"])
                yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(balls), pa.array(near)], [*keep.schema.names, "ball", "near"])

        members = nodes.select("id", "label", "dim", "vec", "m", F.col("id").alias("ball"), F.lit(1.0).alias("near"))
        schema = members.schema.simpleString().removeprefix("struct<").removesuffix(">")
        centres = nodes.select("id", "label", "dim", "vec", "m")
        made = None
        for tree in range(COVERS):
            moves = _ordered(centres, tree, kind).mapInArrow(lambda x: _gather(_stretches(x, ["label", "dim"], kind, BLOCK), absorb, ["ball", "to"]), "ball long, to long")
            moves = scratch.table(moves)
            if moves.isEmpty():
                break
            to = nodes.select(F.col("id").alias("to"), F.col("vec").alias("to_vec"))
            with_to = scratch.table(moves.join(to, "to"))
            new = scratch.table(members.join(with_to, "ball", "left").mapInArrow(retest, schema))
            scratch.drop(made, moves, with_to)
            members = made = new
            weight = members.groupBy("ball").agg(F.sum("m").alias("m"))
            centres = nodes.select("id", "label", "dim", "vec").join(weight.withColumnRenamed("ball", "id"), "id")
        return made if made is not None else scratch.table(members)

    # --- lists ---
    def blocks(self, centres: DataFrame, tree: int) -> DataFrame:
        k, theta, kind = self.k, self.theta, self.kind

        def near(rows: _Rows, a: int, b: int):
            u = rows.units(a, b)
            cos = u @ u.T
            np.fill_diagonal(cos, -3)
            need = _needed(cos, rows.of["rad"][a:b], theta)
            return _edge_batch(rows.of["id"][a:b], cos, need, _top(cos, need, k))

        return _ordered(centres, tree, kind).mapInArrow(lambda x: _gather(_stretches(x, ["label", "dim"], kind, BLOCK), near, ["b", "nid", "cos", "need"]), _EDGES)

    def merged(self, old: DataFrame | None, found: DataFrame) -> DataFrame:
        """Lists of old and found entries: (b, nid, cos, need, new); new entries were not in old."""
        rows = found.withColumn("new", F.lit(True))
        if old is not None:
            rows = rows.unionByName(old.withColumn("new", F.lit(False)))
        rows = rows.groupBy("b", "nid").agg(F.max("cos").alias("cos"), F.max("need").alias("need"), F.min("new").alias("new"))
        best = Window.partitionBy("b").orderBy(F.desc("cos"), "nid")
        return rows.withColumn("place", F.row_number().over(best)).filter(F.col("need") | (F.col("place") <= self.k)).drop("place")

    def descend(self, lists: DataFrame, centres: DataFrame, turn: int) -> DataFrame:
        """Entries that the neighbours of each centre propose to each other. Those of a centre in many lists are dealt into groups."""
        k, theta, kind = self.k, self.theta, self.kind

        def join(rows: _Rows, a: int, b: int):
            new = rows.of["new"][a:b].astype(bool)
            if b - a < 2 or not new.any():
                return None
            u = rows.units(a, b)
            cos = u @ u.T
            cos[~(new[:, None] | new[None, :])] = -3
            np.fill_diagonal(cos, -3)
            need = _needed(cos, rows.of["rad"][a:b], theta)
            cos[(cos < rows.of["floor"][a:b][:, None]) & ~need] = -3
            return _edge_batch(rows.of["id"][a:b], cos, need, _top(cos, need, k))

        around = lists.select(F.col("b").alias("v"), F.col("nid").alias("id"), "new")
        around = around.unionByName(lists.select(F.col("nid").alias("v"), F.col("b").alias("id"), "new")).groupBy("v", "id").agg(F.max("new").alias("new"))
        around = scratch.table(around)
        size = around.groupBy("v").agg(F.count("*").alias("size"), F.max("new").alias("any")).filter("any and size > 1").select("v", "size")
        floors = lists.groupBy("b").agg(F.when(F.count("*") >= k, F.min("cos")).otherwise(F.lit(-2.0)).alias("floor")).withColumnRenamed("b", "id")
        vectors = centres.select("id", "rad", "vec").join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
        deal = F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("size") / GROUP).cast("long"))
        rows = around.join(size, "v").withColumn("deal", deal).drop("size").join(vectors, "id")
        rows = rows.select("v", "deal", "id", "new", "rad", "floor", "vec").repartition("v", "deal").sortWithinPartitions("v", "deal", "id")
        out = rows.mapInArrow(lambda x: _gather(_stretches(x, ["v", "deal"], kind, None), join, ["b", "nid", "cos", "need"]), _EDGES)
        out = scratch.table(out)
        scratch.drop(around)
        return out

    # --- links ---
    def links(self, lists: DataFrame, members: DataFrame, balls: DataFrame) -> DataFrame:
        """(x, y, ids, adds) for each pair of chunks of two balls with a link: how many rows each class is linked with there."""
        least, kind = self.least, self.kind

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                xs, ys, lengths, ids, adds = [], [], [], [], []
                sides = []
                for side in "xy":
                    listed = [batch.column(f"{side}_{c}") for c in ("ids", "ms", "vecs")]
                    at = listed[0].offsets.to_numpy()
                    flat = [c.flatten() for c in listed]
                    sides.append((at - at[0], flat[0].to_numpy(), flat[1].to_numpy(), *_raw(flat[2])))
                for r in range(batch.num_rows):
                    u, i, m = [], [], []
                    for at, all_ids, all_ms, raw, where in sides:
                        p, q = at[r], at[r + 1]
                        u.append(_units(raw[where[p] : where[q]], kind, q - p))
                        i.append(all_ids[p:q])
                        m.append(all_ms[p:q])
                    linked = u[0] @ u[1].T >= least
                    if not linked.any():
                        continue
                    add = np.concatenate((linked @ m[1], linked.T @ m[0]))
                    who = np.concatenate(i)
                    who, add = who[add > 0], add[add > 0]
                    xs.append(r), lengths.append(len(who)), ids.append(who), adds.append(add)
                if xs:
                    at = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
                    lists_ = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(c).astype(np.int64))) for c in (ids, adds)]
                    rows = pa.array(xs, pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column("x").take(rows), batch.column("y").take(rows), *lists_], ["x", "y", "ids", "adds"])

        pairs = scratch.table(lists.filter("need").select(F.least("b", "nid").alias("x"), F.greatest("b", "nid").alias("y")).distinct())
        ends = pairs.select(F.col("x").alias("ball")).unionByName(pairs.select(F.col("y").alias("ball"))).distinct()
        sized = balls.select(F.col("id").alias("ball"), "classes").join(ends, "ball")
        chunk = F.pmod(F.xxhash64("id"), F.ceil(F.col("classes") / CHUNK).cast("long"))
        chunks = members.join(sized, "ball").withColumn("chunk", chunk).groupBy("ball", "chunk").agg(F.collect_list(F.struct("id", "m", "vec")).alias("all"))
        chunks = scratch.table(chunks.select("ball", F.col("all.id").alias("ids"), F.col("all.m").alias("ms"), F.col("all.vec").alias("vecs")))
        rows = pairs.join(chunks.toDF("x", "x_ids", "x_ms", "x_vecs"), "x").join(chunks.toDF("y", "y_ids", "y_ms", "y_vecs"), "y")
        out = scratch.table(rows.mapInArrow(compare, "x long, y long, ids array<long>, adds array<long>"))
        scratch.drop(pairs, chunks)
        return out

    # --- audit ---
    def true_links(self, nodes: DataFrame, size: int) -> DataFrame:
        """(id, links) of `size` classes at most, chosen by hash, compared with all classes; a class's other rows count too."""
        least, kind = self.least, self.kind
        asked = nodes.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(size).select("id", "label", "dim", "vec").toArrow()
        labels = {x: i for i, x in enumerate(pc.unique(asked.column("label")).to_pylist())}
        by: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        of = list(zip((labels[x] for x in asked.column("label").to_pylist()), asked.column("dim").to_pylist(), strict=True))
        for key in set(of):
            rows = [i for i, x in enumerate(of) if x == key]
            raw = np.frombuffer(b"".join(asked.column("vec")[i].as_py() for i in rows), np.uint8)
            by[key] = asked.column("id").to_numpy()[rows], _units(raw, kind, len(rows))
        shared = nodes.sparkSession.sparkContext.broadcast((labels, by))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            labels, by = shared.value
            for batch in batches:
                data, at = _raw(batch.column("vec"))
                m = batch.column("m").to_numpy()
                code = np.array([labels.get(x, -1) for x in batch.column("label").to_pylist()], np.int64)
                dims = batch.column("dim").to_numpy()
                for key, (ids, u) in by.items():
                    rows = np.flatnonzero((code == key[0]) & (dims == key[1]))
                    for part in np.array_split(rows, max(1, len(rows) // 4096)):
                        if len(part):
                            raw = np.concatenate([data[at[r] : at[r + 1]] for r in part])
                            n = (u @ _units(raw, kind, len(part)).T >= least) @ m[part]
                            hit = np.flatnonzero(n)
                            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(n[hit].astype(np.int64))], ["id", "n"])

        return nodes.mapInArrow(count, "id long, n long").groupBy("id").agg((F.sum("n") - 1).alias("links"))


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST,
    k: int = K, trees: int = TREES, rounds: int = ROUNDS, turns: int = TURNS, audit: int = AUDIT, recall: float = RECALL,
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept (vec_id = component_id), ball (rows of one ball are all linked).

    Rows are linked if their labels are equal and not null and the cosine of their vectors is `least` (positive) or more; vectors of
    different lengths are not linked. Null, empty and zero vectors and those with a null, infinite or NaN component are linked with
    nothing and have a null ball. component_id is the smallest id reachable (null last). Repeated rows and rows of one id are rows of
    their own, linked with each other. An empty table gives an empty result; other columns are ignored.

    Pairs are searched, not compared one by one: the audit measures how many of the links of `audit` classes were found, and the
    search goes on until that is `recall` or `turns` turns are over (then a warning gives the share found). Found links all count,
    without a cap.
    """
    spark = vectors.sparkSession
    scratch.small_batches(spark)
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"
    item = "float" if kind == "<f4" else "double"
    search = _Search(kind, least, k)
    with scratch.steps(spark) as keep:
        v = F.col(f"`{vector_col}`").cast(f"array<{item}>")
        rows = scratch.keyed(vectors, id_col).select(F.col("__tw_key").alias("key"), F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), v.alias("v"))
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        rows = rows.withColumn("ok", F.coalesce(F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False)))

        # 1. classes of equal vectors, hot ones merged in segments
        hashed = rows.filter("ok").withColumns({"p": F.xxhash64("v"), "q": F.xxhash64(F.lit(1), "v"), "seg": F.pmod(F.xxhash64("key"), F.lit(64))})
        same = ["label", "p", "q"]
        merged = hashed.groupBy(*same, "seg").agg(F.min("key").alias("first"), F.count("*").alias("n"), F.min("vec_id").alias("low"))
        one = Window.partitionBy(*same)
        merged = merged.select(*same, "seg", F.min("first").over(one).alias("id"), F.sum("n").over(one).alias("m"), F.min("low").over(one).alias("low"))
        known = hashed.join(merged, [*same, "seg"]).select("key", "vec_id", "id", "m", "low", "label", F.when(F.col("key") == F.col("id"), F.col("v")).alias("v"))
        known = scratch.table(known)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                listed = batch.column("v")
                at, flat = listed.offsets.to_numpy(), listed.values.to_numpy(zero_copy_only=False).astype(kind)
                width = np.diff(at)
                vec = pa.Array.from_buffers(pa.binary(), len(listed), [None, pa.py_buffer(((at - at[0]) * flat.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat[at[0] : at[-1]]))])
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(width.astype(np.int32)), vec, batch.column("m")], ["id", "label", "dim", "vec", "m"])

        label = known.schema["label"].dataType.simpleString()
        nodes = known.filter("key = id").select("id", "label", "m", "v").mapInArrow(pack, f"id long, label {label}, dim int, vec binary, m long")
        nodes = scratch.table(nodes)

        # 2. balls
        members = search.cover(nodes)
        balls = members.groupBy("ball").agg(F.sum("m").alias("rows"), F.count("*").alias("classes"), F.min("near").alias("near"))
        balls = scratch.table(balls.select(F.col("ball").alias("id"), "rows", "classes", F.when(F.col("classes") == 1, F.lit(0.0)).otherwise(F.acos(F.least("near", F.lit(1.0)))).alias("rad")))
        centres = scratch.table(nodes.select("id", "label", "dim", "vec").join(balls.select("id", "rad"), "id"))

        # 3. - 5. lists, links, audit
        asked = scratch.table(search.true_links(nodes, audit))
        lists = None
        for turn in range(turns):
            found = None
            for tree in range(trees):
                more = search.blocks(centres, 100 + turn * trees + tree)
                found = more if found is None else found.unionByName(more)
            old = lists
            lists = scratch.table(search.merged(old.drop("new") if old is not None else None, found))
            scratch.drop(old)
            for step in range(rounds):
                proposed = search.descend(lists, centres, turn * rounds + step)
                new = scratch.table(search.merged(lists.drop("new"), proposed))
                scratch.drop(lists, proposed)
                lists = new
                changed, total = lists.agg(F.count(F.when(F.col("new"), 1)), F.count(F.lit(1))).first()
                if changed * 100 <= total:
                    break
            links = search.links(lists, members, balls)
            extra = links.select(F.explode(F.arrays_zip("ids", "adds")).alias("z")).groupBy(F.col("z.ids").alias("id")).agg(F.sum("z.adds").alias("add"))
            classes = members.select("id", "ball", "m").join(balls.select(F.col("id").alias("ball"), "rows"), "ball").join(extra, "id", "left")
            classes = scratch.table(classes.select("id", "ball", "m", (F.col("rows") - 1 + F.coalesce("add", F.lit(0))).alias("n_links")))
            share = asked.filter("links > 0").join(classes, "id").agg(F.avg(F.col("n_links") / F.col("links"))).first()[0]
            if share is None or share >= recall or turn == turns - 1:
                break
            scratch.drop(links, classes)
        if share is not None and share < recall:
            _log.warning("near_duplicates: the audit found %.4f of the links", share)

        # components of balls, named by their smallest id
        comp = scratch.components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
        lows = known.filter("key = id").select("id", "low")
        placed = classes.join(comp.select(F.col("node").alias("ball"), "comp"), "ball", "left").withColumn("comp", F.coalesce("comp", "ball"))
        least_id = placed.join(lows, "id").groupBy("comp").agg(F.min("low").alias("component_id"))
        placed = scratch.table(placed.join(least_id, "comp").select("id", "n_links", "component_id", "ball"))
        out = known.select("vec_id", "id").join(placed, "id").select("vec_id", "n_links", "component_id", "ball")
        alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(None).cast("long").alias("ball"))
        out = out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
        return keep(scratch.table(out.select("vec_id", "n_links", "component_id", "kept", "ball")))


#: All pairs of a label. (Feasible for thousands of vectors.)
ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  AND list_cosine_similarity(a.v, b.v) >= 0.93),
n AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x),
r AS (SELECT vec_id, vec_id AS m FROM embeddings UNION SELECT r.vec_id, l.y FROM r JOIN l ON r.m = l.x),
c AS (SELECT vec_id, min(m) AS component_id FROM r GROUP BY vec_id)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.vec_id = c.vec_id
"""
