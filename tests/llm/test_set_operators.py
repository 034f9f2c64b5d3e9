"""Sharding, mixing, exact and near deduplication against brute force."""

import hashlib
import inspect
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import NASTY, SCHEMA, corpus, empty, frame, words
from tidewell.llm import exactdedup, linededup, mixing, ngramjoin, scratch, sharding, suffixdedup


def place(i):
    return (i is None, i or 0)


@pytest.mark.parametrize("shards", [8, 3])
def test_sharding(spark, shards):
    rows = corpus(2, 300)
    df = frame(spark, rows)
    got = sharding.interleave(df, shards).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    per = defaultdict(list)
    for r in got:
        per[r["shard"]].append(r)
    sizes = [len(v) for v in per.values()]
    assert set(per) == set(range(shards)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in per.values())
    for source, n in Counter(r[3] for r in rows).items():
        counts = [sum(r["source"] == source for r in v) for v in per.values()]
        assert max(counts) - min(counts) <= 2, source  # every shard matches the mixture
        assert sum(counts) == n
    again = sharding.interleave(df.repartition(7), shards).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert sharding.interleave(empty(spark)).count() == 0


def slow_targets(sizes):
    """Iterated: excess over three times a source is shared again by weight."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        level = (total - sum(capped.values())) / max(sum(weight[s] for s in open_), 1)
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s] * (1 + 1e-12)]
        if not over:
            return {**capped, **{s: level * weight[s] for s in open_}}
        capped |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing(spark, seed):
    rng = random.Random(seed)
    rows = [(i, words(rng, rng.randrange(1, 80)), "en", rng.choice(("a", "b", "é", "z", None))) for i in range(400)]
    rows += [(400 + i, words(rng, 5), "en", "tiny") for i in range(3)] + [(None, None, None, "b"), (1, rows[1][1], "en", rows[1][3]), (990, " \n", "en", "blank")]
    df = frame(spark, rows)
    got = mixing.mix(df).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += count(t)
    want = slow_targets(sizes)
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in got) == Counter((i, count(t), s) for i, t, _, s in rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], abs=1e-6)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 2 for s in sizes), (dict(taken), want)
    again = mixing.mix(df.repartition(2)).collect()
    key = lambda rs: Counter((r["doc_id"], r["taken"]) for r in rs)
    assert key(got) == key(again)
    whole = scratch.table(df)
    grown = mixing.expand(whole)
    assert grown.schema == SCHEMA and grown.count() == sum(r["copies"] for r in got)
    assert Counter((r["doc_id"], r["source"]) for r in grown.collect()) == Counter((r["doc_id"], r["source"]) for r in got for _ in range(r["copies"]))
    assert mixing.mix(empty(spark)).count() == 0


def slow_copies(rows, solved, goals, cap=3, corrections=4):
    """(source, size) -> copies: systematic rounding of the tilted rates, then corrections, in integers."""
    n = Counter((s, size) for s, size, _ in rows)
    out = {}
    for source in {s for s, _ in n}:
        upto = 0
        for size in sorted(z for s, z in n if s == source):
            lam, mean, full = solved.get(source, (0.0, 1.0, False))
            rate = 1.0 if not size else float(cap) if full else min(float(cap), math.exp(min(lam * size / mean, 50.0)))
            before, upto = upto, upto + math.floor(rate * 2**32 * n[source, size])
            out[source, size] = min((upto + 2**31 >> 32) - (before + 2**31 >> 32), cap * n[source, size])
        for _ in range(corrections):
            gap = goals[source] - sum(c * z for (s, z), c in out.items() if s == source)
            fits = [z for s, z in out if s == source and z and (out[s, z] < cap * n[s, z] if gap > 0 else out[s, z] > 0)]
            better = [(abs(abs(gap) - z), z) for z in fits if abs(abs(gap) - z) < abs(gap)]
            if not better:
                break
            out[source, min(better)[1]] += 1 if gap > 0 else -1
    return out


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_mixing_copies(spark, monkeypatch, limit):
    """Every row's copies against brute force, with many equal rows, by both joins of the plan."""
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", limit)
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randrange(1, 30)), "en", rng.choice(("a", "b", "c", "d", None))) for i in range(500)]
    rows += [(None, "always the same", "en", "a")] * 150 + [(7, "twice " * 9, "en", "d")] * 40 + [(600, "", "en", "a"), (601, None, "en", "c")]
    whole = scratch.table(frame(spark, rows, 5))
    narrow = scratch.table(mixing._narrow(scratch.keyed(whole, "doc_id"), "doc_id", "text", "source", 7)).collect()
    sizes = Counter()
    for r in narrow:
        sizes[r["source"]] += r["size"]
    hist = Counter((r["source"], r["size"]) for r in narrow if r["size"])
    h = spark.createDataFrame([(*k, n) for k, n in hist.items()], "source string, size long, n long")
    goals = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    solved = {r["source"]: (r["lam"], r["mean"], r["full"]) for r in mixing.multipliers(h, scratch.table(goals), 3.0, 40, 1e-7).collect()}
    copies = slow_copies([(r["source"], r["size"], None) for r in narrow], solved, {r["source"]: r["target"] for r in goals.collect()})
    want, groups = Counter(), defaultdict(list)
    for r in narrow:
        groups[r["source"], r["size"]].append((r["_key"], r["_no"], r["doc_id"]))
    for (source, size), members in groups.items():
        base, more = divmod(copies[source, size], len(members))
        for k, (_, _, i) in enumerate(sorted(members, key=lambda m: m[:2])):
            want[i, source, size, base + (k < more)] += 1
    got = mixing.mix(whole).collect()
    assert Counter((r["doc_id"], r["source"], r["size"], r["copies"]) for r in got) == want
    grown = Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.expand(whole).collect())
    assert sum(grown.values()) == sum(c * n for (_, _, _, c), n in want.items())
    for i, text, _, source in set(rows):
        size = len((text or "").split())
        assert grown[i, text, source] == sum(c * n for (j, s, z, c), n in want.items() if (j, s, z) == (i, source, size)), i


def test_mixing_precision():
    for f in (mixing.mix, mixing._mix):
        given = inspect.signature(f).parameters
        assert (given["tolerance"].default, given["corrections"].default) == (1e-7, 4)


def test_mixing_balances_by_exponential_tilting(spark):
    """The rates solve the dual: log rate is linear in the size, below the cap."""
    rng = random.Random(4)
    hist = spark.createDataFrame([("a", rng.randrange(1, 300), rng.randrange(1, 9)) for _ in range(80)], "source string, size long, n long").groupBy("source", "size").agg(F.sum("n").alias("n"))
    rows = hist.collect()
    total = sum(r["n"] * r["size"] for r in rows)
    for share in (0.3, 1.7, 2.9):
        goals = spark.createDataFrame([("a", total, share * total)], "source string, source_size long, target double")
        s = mixing.multipliers(hist, goals, 3.0, 40, 1e-9).first()
        assert sum(r["n"] * r["size"] * min(3, math.exp(min(s["lam"] * r["size"] / s["mean"], 50))) for r in rows) == pytest.approx(share * total, rel=1e-6)


def weak(text):
    return F.substring(F.sha2(text, 256), 1, 1)


@pytest.mark.parametrize("digest", [exactdedup.sha256, weak])
def test_exact_dedup(spark, digest):
    rows = [*NASTY, (70, "a b", "en", "s"), (71, "ab", "en", "s"), (72, "a  b", "en", "s"), (69, "a\tb ", "en", "s")]
    got = exactdedup.exact_dedup(scratch.table(frame(spark, rows)), digest=digest).collect()
    groups = defaultdict(list)
    for i, t, _, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), place(i), i))
    want = Counter()
    for text, members in groups.items():
        members.sort(key=lambda m: m[:2])
        sha = hashlib.sha256(text.encode()).hexdigest()
        want.update((i, members[0][2], len(members), k == 0, sha) for k, (_, _, i) in enumerate(members))
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    assert exactdedup.exact_dedup(empty(spark)).count() == 0


def test_exact_dedup_merges_levels(spark):
    """An index of earlier documents and new runs give the level that all of them give at once; a full filter changes nothing."""
    rows = [(i, f"text {i % 7}" if i % 3 else f"one{i}", "en", "s") for i in range(80)]
    docs = scratch.keyed(scratch.table(frame(spark, rows)), "doc_id")
    runs = [exactdedup.flush(d, "doc_id", "text", exactdedup.sha256) for d in (docs, docs.filter("doc_id < 30"), docs.filter("doc_id >= 30"))]
    whole = exactdedup.merge(runs[0], 4)
    parts = exactdedup.merge(runs[2], 4, exactdedup.merge(runs[1], 4))
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))
    one = lambda **o: sorted(map(str, exactdedup.exact_dedup(frame(spark, rows), **o).collect()))
    assert one() == one(filter_bits=64) == one(segments=3)


def shingle_set(text, lower=str.lower):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def similar(a, b):
    return bool(a) and 100 * len(a & b) >= 80 * len(a | b)


def family(seed, n):
    """Variants of one text that are similar in chains, between other texts that share a passage."""
    rng = random.Random(seed)
    base = words(rng, 70).split(" ")
    out = []
    for i in range(n):
        v = list(base)
        for _ in range(rng.randrange(5)):
            v[rng.randrange(len(v))] = f"x{rng.randrange(1000)}"
        out.append((1000 + i, " ".join(v), "en", "s"))
    passage = words(rng, 60)
    return out + [(2000 + i, passage + " " + words(rng, rng.randrange(5, 60)), "en", "s") for i in range(n)]


@pytest.mark.parametrize("rows", [NASTY, corpus(9, 150), family(1, 60)])
def test_ngram_join(spark, rows):
    got = ngramjoin.join(scratch.table(frame(spark, rows)))
    sets = [shingle_set(t) for _, t, _, _ in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                comp = [comp[j] if c == comp[i] else c for c in comp]
    least = {c: min((place(rows[i][0]), rows[i][0]) for i in range(len(rows)) if comp[i] == c)[1] for c in set(comp)}
    want = Counter((rows[i][0], len(sets[i]), least[comp[i]]) for i in range(len(rows)))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == want
    kept = ngramjoin.keep_one(scratch.table(frame(spark, rows)))
    assert kept.schema == SCHEMA and kept.count() == len(set(comp))


def test_ngram_join_empty(spark):
    assert ngramjoin.join(empty(spark)).count() == 0
    assert ngramjoin.keep_one(frame(spark, [(1, None, None, None), (1, None, None, None)])).count() == 2


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(20)] + [(200, 200 + i) for i in range(1, 30)]
    comp = {x: x for e in edges for x in e}
    for _ in comp:
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r["node"]: r["comp"] for r in scratch.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in comp.items() if any(x in e and e[0] != e[1] for e in edges)}


def slow_lines(rows):
    seen, out = [], Counter()
    for i, t, _, _ in sorted(rows, key=lambda r: place(r[0])):
        lines = [] if t is None else t.split("\n")
        gone = []
        for k, line in enumerate(lines):
            w = [x for x in re.split(r"[\x20\x09\x0B-\x0D]+", line.lower()) if x]
            s = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[j : j + 5]) for j in range(len(w) - 4)])
            if s and any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                gone.append(k)
            if s:
                seen.append(s)
        out[(i, len(lines), len(gone), ",".join(map(str, gone)))] += 1
    return out


@pytest.mark.parametrize("rows", [NASTY, [(i, t.replace(" ", "\n", 1), a, b) for i, t, a, b in family(3, 40)]])
def test_line_dedup(spark, rows):
    got = linededup.dedup_lines(frame(spark, rows), shingle=5)
    assert Counter((r["doc_id"], r["n_lines"], r["n_removed"], r["removed"]) for r in got.collect()) == slow_lines(rows)


@pytest.mark.parametrize("rows", [NASTY, [(i, t.replace(" ", "\n", 1), a, b) for i, t, a, b in family(3, 40)]])
def test_line_dedup_by_words(spark, rows):
    """One changed word of 27 leaves a match; no shingle of five words could."""
    line = [f"v{i}" for i in range(27)]
    rows = [*rows, (3000, " ".join(line), "en", "s"), (3001, " ".join(["other" if i == 13 else w for i, w in enumerate(line)]), "en", "s"), (3002, "p q r s\nP q r s t", "en", "s")]
    seen, want = [], Counter()
    for i, t, _, _ in sorted(rows, key=lambda r: place(r[0])):
        lines, gone = [] if t is None else t.split("\n"), []
        for k, x in enumerate(lines):
            s = frozenset(w for w in re.split(r"[\x20\x09\x0B-\x0D]+", x.lower()) if w)
            gone += [k] if any(similar(s, o) for o in seen) else []
            seen += [s] if s else []
        want[(i, len(lines), len(gone), ",".join(map(str, gone)))] += 1
    got = Counter((r["doc_id"], r["n_lines"], r["n_removed"], r["removed"]) for r in linededup.dedup_lines(frame(spark, rows)).collect())
    assert got == want and got[(3001, 1, 1, "0")] and got[(3002, 2, 1, "1")]


def test_line_dedup_query_compares_words(spark, tmp_path):
    from tidewell.llm import queries

    frame(spark, [(1, "a b c d e f g h i j", "en", "s"), (2, "a b c d x f g h i j", "en", "s"), (3, "a b c d e f g h i k", "en", "s")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n_removed"] for r in queries.op4_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: 0, 2: 1, 3: 1}


def test_line_dedup_keeps_no_settled_buckets(spark, monkeypatch):
    """A bucket of two or three lines whose pairs the filters refuse leaves no row in the index, and no row holds its bucket's others."""
    seen, table = [], scratch.table

    def kept(df, *args):
        out = table(df, *args)
        if "token" in out.columns:
            seen.append((out.count(), set(out.columns)))
        return out

    monkeypatch.setattr(scratch, "table", kept)
    rows = [(i, " ".join(["rare", *[f"w{i}x{j}" for j in range(9)]]), "en", "s") for i in range(2)]
    assert [r["n_removed"] for r in linededup.dedup_lines(frame(spark, rows)).collect()] == [0, 0]
    rows = [(i, " ".join([*[f"v{j}" for j in range(9)], f"u{i}"]), "en", "s") for i in range(3)]
    assert sorted(r["n_removed"] for r in linededup.dedup_lines(frame(spark, rows)).collect()) == [0, 1, 1]
    assert seen[0][0] == 0 and seen[1][0] > 0 and not any({"x", "y"} & columns for _, columns in seen)


def test_line_dedup_stores_no_index(spark, monkeypatch):
    """Lines that share words, none of them alike, leave no row in any table that goes by words."""
    seen, table = [], scratch.table

    def kept(df, *args):
        out = table(df, *args)
        if "token" in out.columns:
            seen.append(out.count())
        return out

    monkeypatch.setattr(scratch, "table", kept)
    rows = [(i, " ".join(random.Random(i).sample([f"w{j}" for j in range(60)], 20)), "en", "s") for i in range(20)]
    assert not any(r["n_removed"] for r in linededup.dedup_lines(frame(spark, rows)).collect()) and sum(seen) == 0


@pytest.mark.parametrize("cold", [512, 1])
def test_line_dedup_bucket_of_three(spark, monkeypatch, cold):
    """The one bucket that lines 1 and 2 share holds line 0 too, and the line with the fewest words before the shared one is the last."""
    monkeypatch.setattr(linededup, "COLD", cold, raising=False)
    s, c = [f"s{i}" for i in range(9)], [f"c{i}" for i in range(9)]
    texts = [[*s, *c, "a1", "a2"], [*s, "u1", "u2"], s, *([*c, *(f"d{i}x{j}" for j in range(9))] for i in range(6))]
    got = linededup.dedup_lines(frame(spark, [(i, " ".join(t), "en", "s") for i, t in enumerate(texts)])).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {i: int(i == 2) for i in range(9)}


@pytest.mark.parametrize(("cold", "sample", "salted"), [(1, 1 << 14, 1 << 16), (1, 1 << 14, 4), (512, 8, 1 << 16)])
def test_line_dedup_of_hot_buckets_and_samples(spark, monkeypatch, cold, sample, salted):
    """Neither the size of a bucket nor the sample of the rarity sketch changes a result."""
    for name, value in (("COLD", cold), ("SAMPLE", sample), ("BUCKET", salted)):
        monkeypatch.setattr(linededup, name, value)
    rows = [*NASTY, (4000, "a\tb\x0bc\x0cd\re f  g h\nk l m n o", "en", "s"), (4001, "A b c d e f g h x\r\n\r\nK l m n o", "en", "s")]
    got = Counter((r["doc_id"], r["n_lines"], r["n_removed"], r["removed"]) for r in linededup.dedup_lines(frame(spark, rows)).collect())
    seen, want = [], Counter()
    for i, t, _, _ in sorted(rows, key=lambda r: place(r[0])):
        lines, gone = [] if t is None else t.split("\n"), []
        for k, x in enumerate(lines):
            s = frozenset(w for w in re.split(r"[\x20\x09\x0B-\x0D]+", x.lower()) if w)
            gone += [k] if any(similar(s, o) for o in seen) else []
            seen += [s] if s else []
        want[(i, len(lines), len(gone), ",".join(map(str, gone)))] += 1
    assert got == want and got[(4001, 3, 2, "0,2")]


def test_line_dedup_long_lines_are_no_candidates(spark, monkeypatch):
    """Lines of 150 words that share a rare one are no pair to verify, though their words fill a bitmap of 64 bits."""
    seen, table = [], scratch.table

    def kept(df, *args):
        out = table(df, *args)
        if "token" in out.columns:
            seen.append(out.count())
        return out

    monkeypatch.setattr(scratch, "table", kept)
    rng = random.Random(5)
    rows = [(i, " ".join([f"rare{i // 2}", *rng.sample([f"w{j}" for j in range(400)], 150)]), "en", "s") for i in range(40)]
    assert not any(r["n_removed"] for r in linededup.dedup_lines(frame(spark, rows)).collect()) and seen and sum(seen) == 0


def test_line_dedup_counts_buckets_not_words(spark, monkeypatch):
    """A word of many lines that stands in the prefix of one of them only has a small bucket, and no row goes the way of large ones."""
    monkeypatch.setattr(linededup, "COLD", 4)
    seen, table = [], scratch.table

    def kept(df, *args):
        out = table(df, *args)
        seen.append("salt" in out.columns)
        return out

    monkeypatch.setattr(scratch, "table", kept)
    texts = ["common", *(" ".join([*(f"p{i // 2}x{j}" for j in range(9)), "common"]) for i in range(20))]
    got = {r["doc_id"]: r["n_removed"] for r in linededup.dedup_lines(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert got == {i: int(i > 0 and i % 2 == 0) for i in range(21)} and seen and not any(seen)


@pytest.mark.parametrize("cold", [1024, 1])
def test_line_dedup_of_short_and_long_sets(spark, monkeypatch, cold):
    """Sets on both sides of the size from which on there is a second bitmap, with more and less changed than a match allows."""
    monkeypatch.setattr(linededup, "COLD", cold)
    rng, texts = random.Random(9), []
    for n in (58, 64, 70, 130, 300):
        base = [f"b{n}x{i}" for i in range(n)]
        for e in range(8):
            cut = rng.randrange(n // 5)
            texts.append([w for i, w in enumerate(base) if i % 5 or i // 5 >= cut] + [f"e{n}x{e}x{i}" for i in range(rng.randrange(n // 5))])
    seen, want = [], {}
    for k, t in enumerate(texts):
        want[k] = int(any(similar(frozenset(t), o) for o in seen))
        seen.append(frozenset(t))
    got = {r["doc_id"]: r["n_removed"] for r in linededup.dedup_lines(frame(spark, [(i, " ".join(t), "en", "s") for i, t in enumerate(texts)])).collect()}
    assert got == want and 0 < sum(want.values()) < len(texts) - 5


def test_line_dedup_empty(spark):
    assert linededup.dedup_lines(empty(spark)).count() == 0


def slow_repeats(rows):
    seen, out = set(), Counter()
    for i, t, _, _ in sorted(rows, key=lambda r: place(r[0])):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[(i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())] += 1
    return out


REPEATS = [(50, "ab" * 300, "en", "s"), (51, "a" * 350, "en", "s"), (52, "é" * 49 + "xy", "en", "s"), (53, "x" * 99, "en", "s"), (54, "x" * 100, "en", "s"), (55, "y" + "x" * 100 + "z", "en", "s")]


@pytest.mark.parametrize("rows", [NASTY, REPEATS, family(5, 20), [(i, "q" * 30 + t[:150] + "é" * (i % 7) + t[20:190], a, b) for i, t, a, b in family(6, 20)]])
def test_suffix_repeats(spark, rows):
    got = suffixdedup.remove_repeats(frame(spark, rows)).collect()
    key = Counter(tuple(r) for r in got)
    assert key == slow_repeats(rows)


def test_suffix_repeats_texts_and_spans(spark):
    """The operator's own output: the bytes that are left, and the spans that put back give the text."""
    rows = [*NASTY, *((i + 1000, *r) for i, *r in REPEATS)]
    texts = {i: (t or "").encode() for i, t, _, _ in rows if i is not None and i != rows[3][0]}
    for r in suffixdedup.cut_repeats(frame(spark, rows)).collect():
        if r["doc_id"] in texts:
            text, left, last = texts[r["doc_id"]], b"", 0
            for a, b in zip(r["begins"], r["ends"], strict=True):
                assert last <= a < b and (a > last or not last)
                left, last = left + text[last:a], b
            assert left + text[last:] == bytes(r["kept"]) and r["n_bytes"] == len(text)


def test_text_ids_have_the_same_results(spark):
    """Ids that are no numbers are put in order first; one of them may repeat."""
    rows = [r for r in NASTY if r[0] is not None]
    numbered = frame(spark, rows)
    lettered = numbered.withColumn("doc_id", F.format_string("d%05d", "doc_id"))
    for op in (suffixdedup.remove_repeats, ngramjoin.join, exactdedup.exact_dedup):
        drop = lambda d: d.drop("doc_id", "component_id", "keep_id", "_row", "_comp")
        assert Counter(map(tuple, drop(op(numbered)).collect())) == Counter(map(tuple, drop(op(lettered)).collect())), op


def test_lines_are_cut_out(spark):
    rows = [(1, "a b c d e\nf g h i j\nA b c d e", "en", "s"), (2, "f g h i j", "en", "s"), (3, None, "en", "s"), (4, "k", "en", "s")]
    out = linededup.drop_lines(frame(spark, rows))
    assert out.schema == SCHEMA and {r["doc_id"]: r["text"] for r in out.collect()} == {1: "a b c d e\nf g h i j", 2: "", 3: None, 4: "k"}


def test_ngram_join_sql(spark, sf_dir):
    import duckdb

    from tidewell.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = queries.op6_ngram_jaccard_join(spark, sf_dir).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(ngramjoin.ORACLE).fetchall())


def test_suffix_repeats_empty(spark):
    assert suffixdedup.remove_repeats(empty(spark)).count() == 0


def test_pipeline_on_the_small_tables(spark, sf_dir):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in c.STAGES[:-1]:
        docs = scratch.table(stage(spark, before, sf_dir))
        assert docs.schema.names == before.schema.names, name
        if "language" in name:
            assert docs.count() == before.filter("text rlike '\\\\p{L}'").count()
        elif "join" in name:
            rows = before.select("doc_id", "text").collect()
            sets = {r["doc_id"]: shingle_set(r["text"]) for r in rows}
            kept = {r["doc_id"] for r in docs.collect()}
            for a in kept:
                assert not any(similar(sets[a], sets[b]) for b in kept if b != a)
        elif "decontamination" in name:
            bench = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            clean = {r["doc_id"] for r in before.collect() if not any(t in r["text"] for t in bench)}
            assert {r["doc_id"] for r in docs.collect()} == clean
        before = docs
    out = c.run(spark, sf_dir).collect()
    assert len(out) == before.count() and {r["shard"] for r in out} == set(range(8))
