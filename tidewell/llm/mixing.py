"""Mixing sources to target weights by entropy balancing. DataFrame operations only.

The rates r of the documents that stay closest to 1 in relative entropy, take the target number of tokens from each source
and stay below a cap solve a convex problem; its dual has one multiplier per source, and r = min(cap, exp(l * x)) with
x = tokens of the document / token-weighted mean of its source. Safeguarded Newton iterations solve the dual over the
histogram (source, size, documents), which has one row per source and size however many documents there are. The rates
are then rounded into whole copies by systematic rounding along the sizes, whose error stays below about one document per
source, and a few corrections of one document each bring the rest down.

The copies of one source and size are dealt evenly, one more for the documents with the smallest hashes. The last of these
is found once, so every document decides by itself: what goes to the documents is a table of sources and sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm import scratch

#: Rows of (source, size) up to which the plan is broadcast (about 64 bytes each). Beyond it is joined by shuffles.
BROADCAST_ROWS = 1 << 20


def word_count(text: Column) -> Column:
    r"""Number of [^\x20\x09-\x0D]+ in the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """source, source_size -> also target. One row per source; sources are few, so they meet in one task.

    Water filling in closed form: in the order of cap * size / weight, a source is capped as long as the level of those
    from it on, (rest of the total) / (rest of the weights), is above its own ratio.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    ranked = sizes.withColumn("_w", w).withColumn("_ratio", F.lit(cap) * F.col("source_size") / F.col("_w"))
    order = Window.partitionBy(F.lit(0)).orderBy("_ratio", F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    level = (total - F.coalesce(F.lit(cap) * F.sum("source_size").over(before), F.lit(0.0))) / F.sum("_w").over(rest)
    ranked = ranked.withColumn("_level", level)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    open_level = F.first(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")), ignorenulls=True).over(whole)
    target = F.least(F.lit(cap) * F.col("source_size"), F.coalesce(open_level, F.lit(float("inf"))) * F.col("_w"))
    return ranked.select("source", "source_size", target.alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def multipliers(histogram: DataFrame, goals: DataFrame, cap: float, rounds: int, tolerance: float) -> DataFrame:
    """Per source the dual's multiplier (lam) and the mean size (mean) that scales it: distributed Newton iterations.

    Each iteration sums tokens and their derivative over the histogram and takes one step per source inside the bracket of
    multipliers known to be too small or too large. A source whose target is its cap needs none: its rate is the cap.
    """
    scale = histogram.groupBy("source").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("mean"))
    # a document of the mean size starts at the right rate
    start = F.coalesce(F.log(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))), F.lit(0.0))
    state = scale.withColumnRenamed("source", "_s").join(goals, _same("_s", "source")).select(
        "source", "target", F.coalesce("mean", F.lit(1.0)).alias("mean"), start.alias("lam"), F.lit(None).cast("double").alias("lo"),
        F.lit(None).cast("double").alias("hi"), (F.col("target") >= F.lit(cap) * F.col("source_size") * (1 - 1e-12)).alias("full"),
    )
    state = scratch.cut(state.withColumn("off", F.when(F.col("full"), F.lit(0.0)).otherwise(F.lit(1.0))))
    for _ in range(rounds):
        rate = F.least(F.lit(cap), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0))))
        tokens = F.col("n") * F.col("size") * rate
        sums = histogram.withColumnRenamed("source", "_s").join(state, _same("_s", "source")).groupBy("_s").agg(
            F.sum(tokens).alias("f"), F.sum(F.when(rate < cap, tokens * F.col("size") / F.col("mean")).otherwise(0.0)).alias("g")
        )
        step = state.join(sums, _same("_s", "source")).withColumn("low", F.col("f") < F.col("target"))
        step = step.withColumn("lo", F.when(F.col("low"), F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("low"), F.col("hi")).otherwise(F.col("lam")))
        # Newton on log(tokens / target), which is closer to linear than the tokens themselves
        move = F.when((F.col("g") > 0) & (F.col("f") > 0) & (F.col("target") > 0), F.log(F.col("target") / F.col("f")) * F.col("f") / F.col("g"))
        wide = F.greatest(F.lit(1.0), 2 * F.abs("lam"))
        move = F.greatest(-wide, F.least(wide, F.coalesce(move, F.when(F.col("low"), wide).otherwise(-wide))))
        new = F.col("lam") + move
        half = (F.col("lo") + F.col("hi")) / 2
        new = F.when((new <= F.col("lo")) | (new >= F.col("hi")), F.coalesce(half, new)).otherwise(new)
        off = F.when(F.col("full"), 0.0).otherwise(F.coalesce(F.abs(F.col("f") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0)), F.lit(0.0)))
        done = F.col("off2") <= tolerance
        step = step.withColumn("off2", off).select(
            "source", "target", "mean", F.when(done, F.col("lam")).otherwise(new).alias("lam"), "lo", "hi", "full", F.col("off2").alias("off")
        )
        last, state = state, scratch.cut(step)
        scratch.drop(last)
        if state.filter(F.col("off") > tolerance).isEmpty():
            break
    return state.select("source", "mean", "lam", "full")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    cap: int = 3,
    seed: int = 7,
    bits: int = 12,
    rounds: int = 40,
    tolerance: float = 1e-7,
    corrections: int = 4,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies, source, _no (a key).

    Null texts and ids are allowed, null is a source of its own (the last). A document without words has one copy and takes
    nothing. Columns other than the three are ignored, whatever their names. Rows of one id differ by their text's hash; wholly
    equal rows are interchangeable, so reruns agree. An empty table gives an empty result. Documents of one source and size
    are counted in 2 ** bits ranges of their hash and only one range of them is ranked; `corrections` documents per source
    at most change by one copy at the end.
    """
    return _mix(scratch.keyed(docs, id_col), id_col, text_col, source_col, weights, cap, seed, bits, rounds, tolerance, corrections)


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 7, bits: int = 12, rounds: int = 40, tolerance: float = 1e-7, corrections: int = 4) -> DataFrame:
    with scratch.steps(docs.sparkSession) as keep:
        rows = scratch.table(_narrow(docs, id_col, text_col, source_col, seed))
        plan = _plan(rows, weights, cap, bits, rounds, tolerance, corrections)
        return keep(scratch.table(_dealt(rows, plan)))


def _marks(id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    """size, source, _key (the hash that deals out copies)."""
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    return [word_count(F.col(text_col)).alias("size"), F.col(source_col).alias("source"), key.alias("_key")]


def _narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """doc_id, size, source, _key, _no of keyed docs."""
    return docs.select(F.col(id_col).alias("doc_id"), *_marks(id_col, text_col, source_col, seed), F.col("__tw_key").alias("_no"))


def _with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (source, size, _key, _no) with their row of the plan and their copies."""
    up_to = (F.col("_key") == F.col("_cut_key")) & F.coalesce(F.col("_no") <= F.col("_cut_no"), F.lit(True))
    more = F.when((F.col("_key") < F.col("_cut_key")) | up_to, 1).otherwise(0)
    return rows.join(plan, _same("source", "_s") & (F.col("size") == F.col("_size"))).withColumn("copies", F.col("_base") + more)


def _dealt(rows: DataFrame, plan: DataFrame) -> DataFrame:
    dealt = _with_copies(rows, F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan)
    return dealt.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source", "_no")


def _plan(rows: DataFrame, weights: tuple[int, ...], cap: int, bits: int, rounds: int, tolerance: float, corrections: int) -> DataFrame:
    """A table with one row per source and size: _s, _size, _base copies of each document, one more up to the document with the
    hash _cut_key (of equal hashes, up to the key _cut_no; null: all), source_size, target."""
    plan = scratch.table(copies_by_size(rows, weights, cap, rounds, tolerance, corrections))
    by = ["_s", "_size"]
    rows = rows.select(F.col("source").alias("_s"), F.col("size").alias("_size"), "_key", "_no")
    hashes = rows.groupBy(*by, "_key").agg(F.count("*").alias("m"))
    more = plan.filter("_copies % _n > 0").select(*by, F.expr("_copies % _n").alias("want"))
    cut = scratch.table(_nth(hashes, more, "_key", F.shiftright("_key", 64 - bits)))
    # equal hashes: rows of one id and text; which of them does not matter, how many does
    ties = cut.filter("want < m").select(F.col("_s").alias("s2"), F.col("_size").alias("size2"), F.col("_key").alias("key2"), "want")
    equal = rows.join(ties, _same("_s", "s2") & (F.col("_size") == F.col("size2")) & (F.col("_key") == F.col("key2"))).select(*by, "_no", F.lit(1).alias("m"))
    last = _nth(equal, ties.select(F.col("s2").alias("_s"), F.col("size2").alias("_size"), "want"), "_no", F.shiftright("_no", 33))
    cut = _left(cut.select(*by, F.col("_key").alias("_cut_key")), last.select(*by, F.col("_no").alias("_cut_no")))
    full = _left(plan, cut).withColumn("_base", F.expr("_copies div _n"))
    return scratch.table(full.select(*by, "_base", "_cut_key", "_cut_no", "source_size", "target"))


def _left(left: DataFrame, right: DataFrame) -> DataFrame:
    """left join on _s (null is a value) and _size."""
    right = right.withColumnsRenamed({"_s": "_rs", "_size": "_rsize"})
    return left.join(right, _same("_s", "_rs") & (F.col("_size") == F.col("_rsize")), "left").drop("_rs", "_rsize")


def _nth(items: DataFrame, wanted: DataFrame, order: str, cell: Column) -> DataFrame:
    """_s, _size, order, m, want: for each source and size in wanted the item that holds the want-th unit in the order of the items
    (m units each), and the place of that unit within it.

    cell rises with the order. Cells are counted first (map-side combined), and only the items of one cell are put in order.
    """
    items = items.withColumn("cell", cell)
    wanted = wanted.withColumnsRenamed({"_s": "_ws", "_size": "_wsize"})
    per = items.groupBy("_s", "_size", "cell").agg(F.sum("m").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("_s", "_size").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    per = per.join(wanted, _same("_s", "_ws") & (F.col("_size") == F.col("_wsize"))).withColumn("upto", upto)
    hit = per.filter("upto >= want and upto - k < want").select("_ws", "_wsize", F.col("cell").alias("_wcell"), F.expr("want - upto + k").alias("want"))
    inside = items.join(hit, _same("_s", "_ws") & (F.col("_size") == F.col("_wsize")) & (F.col("cell") == F.col("_wcell")))
    upto = F.sum("m").over(Window.partitionBy("_s", "_size").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return inside.withColumn("upto", upto).filter("upto >= want and upto - m < want").select("_s", "_size", order, "m", F.expr("want - upto + m").alias("want"))


def copies_by_size(rows: DataFrame, weights: tuple[int, ...], cap: int, rounds: int, tolerance: float, corrections: int) -> DataFrame:
    """_s, _size, _n documents, _copies to take of them all, source_size, target."""
    histogram = scratch.table(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    sizes = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goals = scratch.cut(targets(sizes, weights, float(cap)))
    solved = multipliers(histogram.filter("size > 0"), goals, float(cap), rounds, tolerance)

    rate = F.when(F.col("full"), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.coalesce(F.col("lam") * F.col("size") / F.col("mean"), F.lit(0.0)), F.lit(50.0)))))
    # a document without words takes nothing at any rate and stays once
    rate = F.when(F.col("size") > 0, F.coalesce(rate, F.lit(1.0))).otherwise(F.lit(1.0))
    rated = histogram.withColumnRenamed("source", "_s").join(solved, _same("_s", "source"), "left").drop("source")
    # rates in units of 2^-32 add up exactly in any order
    rated = rated.withColumn("_want", F.floor(rate * (1 << 32) * F.col("n")).cast("decimal(38,0)"))
    # prefix sums along the sizes in two levels: 32 bands per doubling of the size, then sizes inside a band
    rated = rated.withColumn("_band", F.floor(F.log2(F.col("size") + 1) * 32).cast("int"))
    inside = Window.partitionBy("_s", "_band").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    bands = rated.groupBy("_s", "_band").agg(F.sum("_want").alias("_sum"))
    upto = Window.partitionBy("_s").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select(F.col("_s").alias("_bs"), F.col("_band").alias("_bb"), F.coalesce(F.sum("_sum").over(upto), F.lit(0).cast("decimal(38,0)")).alias("_skip"))
    summed = rated.withColumn("_upto", F.sum("_want").over(inside)).join(bands, _same("_s", "_bs") & (F.col("_band") == F.col("_bb")))
    high = F.floor((F.col("_skip") + F.col("_upto") + (1 << 31)) / F.lit(1 << 32)).cast("long")
    low = F.floor((F.col("_skip") + F.col("_upto") - F.col("_want") + (1 << 31)) / F.lit(1 << 32)).cast("long")
    rounded = scratch.table(summed.select("_s", F.col("size").alias("_size"), F.col("n").alias("_n"), F.least(high - low, F.lit(cap) * F.col("n")).alias("_copies")))
    return _corrected(rounded, goals, cap, corrections)


def _corrected(rounded: DataFrame, goals: DataFrame, cap: int, corrections: int) -> DataFrame:
    """Moves one copy at a time in each source while that brings its tokens closer to the target."""
    plan = rounded
    for _ in range(corrections):
        have = plan.groupBy("_s").agg(F.sum(F.col("_copies") * F.col("_size")).alias("_have"))
        gap = have.join(goals, _same("_s", "source")).select(F.col("source").alias("_gs"), (F.col("target") - F.col("_have")).alias("_gap"))
        room = F.when(F.col("_gap") > 0, F.col("_copies") < F.lit(cap) * F.col("_n")).otherwise(F.col("_copies") > 0)
        left = F.abs(F.abs("_gap") - F.col("_size"))
        better = plan.join(gap, _same("_s", "_gs")).filter((F.col("_size") > 0) & room & (left < F.abs("_gap")))
        pick = better.groupBy("_gs").agg(F.min_by(F.struct("_size", F.signum("_gap").cast("long").alias("sign")), F.struct(left, F.col("_size"))).alias("p"))
        pick = scratch.cut(pick.select("_gs", F.col("p._size").alias("_ps"), F.col("p.sign").alias("_sign")))
        if pick.isEmpty():
            break
        plan = plan.join(pick, _same("_s", "_gs") & (F.col("_size") == F.col("_ps")), "left")
        plan = plan.select("_s", "_size", "_n", (F.col("_copies") + F.coalesce(F.col("_sign"), F.lit(0))).alias("_copies"))
    return plan.join(goals, _same("_s", "source")).select("_s", "_size", "_n", "_copies", "source_size", "target")


def expand(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    cap: int = 3,
    seed: int = 7,
    bits: int = 12,
    rounds: int = 40,
    tolerance: float = 1e-7,
    corrections: int = 4,
) -> DataFrame:
    """The mixed corpus itself: every row of docs as often as its copies say, in docs' columns, whatever their names. A row without
    words stays once, whatever its source; repeated rows have copies of their own. Empty in, empty out.

    Rows decide by the broadcast plan and do not move. A plan too large for that (BROADCAST_ROWS) costs one shuffle of docs.
    """
    rows = scratch.keyed(docs, id_col)
    with scratch.steps(docs.sparkSession) as keep:
        narrow = scratch.table(_narrow(rows, id_col, text_col, source_col, seed))
        plan = keep(_plan(narrow, weights, cap, bits, rounds, tolerance, corrections))
        names = [f"c{i}" for i in range(len(docs.columns))]  # the columns of docs may have any names
        rows = rows.toDF(*names, "_no")
        if plan.count() <= BROADCAST_ROWS:
            marks = _marks(*(names[docs.columns.index(c)] for c in (id_col, text_col, source_col)), seed)
            dealt = _with_copies(rows.select("*", *marks), F.broadcast(plan))
        else:
            dealt = rows.join(keep(scratch.table(_with_copies(narrow, plan).select("_no", "copies"))), "_no")
    repeated = dealt.filter("copies > 0").withColumn("i", F.explode(F.expr("sequence(1, cast(copies as int))")))
    return repeated.select(*names).toDF(*docs.columns)
