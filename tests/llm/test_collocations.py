"""Collocation mining against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tests.llm.helpers import NASTY, empty, frame
from tidewell.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(rows, least, longest=3, top=2000, share=50):
    f = defaultdict(Counter)
    n = Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = []
        for p, a in c.items():
            if len(p) > 1 and a >= least:
                score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((p, a, c[p[:k]], c[p[k:]], score))
        inner = defaultdict(int)
        for p, a, *_ in found:
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inner[p[i : i + m]] = max(inner[p[i : i + m]], a)
        left = [x for x in found if 100 * inner[x[0]] < share * x[1]]
        left.sort(key=lambda x: (-x[4], -x[1], " ".join(x[0]).encode()))
        out += [(lang, i, " ".join(p), a, l, r, n[lang], s) for i, (p, a, l, r, s) in enumerate(left[:top], 1)]
    return sorted(out)


def found(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def speech(seed, n=150):
    """Texts with set phrases, capitals, tabs, all separators, repeats and words of other scripts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Über", "größe", "слово", "語", "A", "ÀB", "x y", "_", "\x00"]
    phrases = ["New York City", "red Red red red", "kick the bucket", "ad hoc"]
    gaps = [" "] * 8 + ["\t", "  ", ", ", ".", "!?", "\n", "\r\n", "\x0b", " ; "]
    rows = []
    for i in range(n):
        text = "".join((rng.choice(phrases) if rng.random() < 0.2 else rng.choice(words)) + rng.choice(gaps) for _ in range(rng.randrange(40)))
        rows.append((i, text, rng.choice(("en", "de", "und", None, "")), "s"))
    return rows + rows[:9] + [(None, None, "en", None), (n, "", "xx", None), (n + 1, " \t.\n", "en", None), (n + 2, "only", "yy", None)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("least,longest,top", [(3, 3, 2000), (4, 4, 7), (2, 2, 2000)])
def test_against_brute_force(spark, seed, least, longest, top):
    rows = speech(seed)
    want = slow(rows, least, longest, top)
    assert want and found(collocations.mine(frame(spark, rows), least=least, longest=longest, top=top)) == want


def test_nasty_tables(spark):
    assert found(collocations.mine(frame(spark, NASTY))) == slow(NASTY, 10)
    got = collocations.mine(empty(spark))
    assert got.count() == 0 and got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rare = [(1, "one two three", "en", None)]
    assert found(collocations.mine(frame(spark, rare))) == []


def test_long_text_and_full_bitmap(spark, monkeypatch):
    """Texts above the slice and batch sizes; a bitmap that lets nearly everything through changes nothing."""
    rng = random.Random(5)
    long = " ".join(rng.choice(("alpha", "Beta", "gamma.", "delta", f"r{rng.randrange(3000)}")) for _ in range(60000))
    rows = [(1, long, "en", None), (2, long[:300000], None, None), *speech(3, 20)]
    want = slow(rows, 10)
    monkeypatch.setattr(collocations, "_SLICE", 1 << 16)
    assert found(collocations.mine(frame(spark, rows))) == want
    monkeypatch.setattr(collocations, "BITS", 64)
    assert found(collocations.mine(frame(spark, rows))) == want


def test_exact_beyond_64_bits(spark):
    """The score's products are taken as decimals: 1000000 * a * a passes 64 bits from about 3 million on."""
    from pyspark.sql import functions as F

    for a, left, right in ((9_000_000_000, 9_000_000_007, 12_345_678_901), (99_999_999_999_999, 99_999_999_999_999, 99_999_999_999_999)):
        row = spark.range(1).select(F.lit(a).alias("a"), F.lit(left).alias("l"), F.lit(right).alias("r"))
        got = row.select(F.expr(collocations.SCORE)).first()[0]
        assert got == 1000000 * a * a // (left * right)
