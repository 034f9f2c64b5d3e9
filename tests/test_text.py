"""Column functions against the fixture table."""

import pytest
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions import vectors as V


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make("x").alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("text", "words"),
    [("Buoys as moss sea_chart", {"buoy", "as", "mos", "sea_chart"}), ("", set()), ("Маяк, маяк!", {"маяк"}), ("a1-b2 s", {"a1", "b2", "s"})],
)
def test_word_set(spark, text, words):
    assert set(one(spark, text, T.word_set)) == words


@pytest.mark.parametrize(("word", "out"), [("tides", "tide"), ("us", "us"), ("moss", "mos"), ("s", "s"), ("яs", "я")])
def test_singular(spark, word, out):
    assert one(spark, word, lambda c: T.singular(F.col(c))) == out


def test_query_words(spark):
    assert len(one(spark, "Где маяки стоят под водой?", T.query_words)) == 3
    assert one(spark, "the and to", T.query_words) == []
    assert one(spark, "%sea_chart% «n++» buoy buoy buoys re-float", T.query_words) == ["sea_chart", "n++", "buoy", "buoys", "re-float"]


@pytest.mark.parametrize(
    ("query", "positive", "terms"),
    [
        ("plain words", "plain words", []),
        ("a -b c", "a c", ["b"]),
        ('find -"two words" me -x', "find me", ["two words", "x"]),
        ("in-word - stays", "in-word - stays", []),
        ("-only", "", ["only"]),
        ('a -"', "a", []),
    ],
)
def test_parse_exclusions(spark, query, positive, terms):
    df = spark.createDataFrame([(query,)], "q string")
    p, t = T.parse_exclusions("q")
    row = df.select(p.alias("p"), t.alias("t")).first()
    assert (row["p"], row["t"]) == (positive, terms)


@pytest.mark.parametrize(
    ("path", "words"),
    [("/h/u/docs/go/my-notes_1.md", "u docs go my notes 1"), ("a.md", "a"), ("x/.hid/y/b.tar.md", "x y b.tar"), ("noext", "noext"), ("/h/me/a/b.md", "a b")],
)
def test_path_words(spark, path, words):
    assert one(spark, path, lambda c: T.path_words(c, "/h/me")) == words


def test_embedding_text_and_snippet(spark):
    df = spark.createDataFrame([("d/a.md", "", "body"), ("d/a.md", "S", "body")], "p string, s string, t string")
    assert [r[0] for r in df.select(T.embedding_text("p", "s", "t")).collect()] == ["d a\nbody", "d a\nS\nbody"]
    assert one(spark, " a\n b c ", lambda c: T.snippet(c, 3)) == "a b…"
    assert one(spark, "ab", lambda c: T.snippet(c, 3)) == "ab"


def test_roots_ids_scores(spark):
    df = spark.createDataFrame([("/a/b/x.md",), ("/a/bc/x.md",), ("/a/b",)], "p string")
    assert [r[0] for r in df.select(T.under_any_root("p", ["/a/b"])).collect()] == [True, False, True]
    assert one(spark, "a#b#7", T.ordinal_of) == 7 and one(spark, "a", T.ordinal_of) == 0
    assert [one(spark, s, T.score_band, "double") for s in (0.7, 0.5, 0.49)] == ["green", "yellow", "grey"]
    assert one(spark, 1600000000, T.rfc3339, "long") == "2020-09-13T12:26:40Z"
    assert one(spark, 0.12345, T.rounded, "double") == 0.1235


def test_like_any(spark):
    df = spark.createDataFrame([("Dry-Run a\\b", ["dry_run"]), ("dryrun", ["dry_run"]), ("a\\b", ["\\b"]), ("abc", [])], "t string, w array<string>")
    assert [r[0] for r in df.select(T.like_any(F.col("t"), F.col("w"))).collect()] == [True, False, True, False]


def test_normalize(spark):
    for v, out in (([3.0, 4.0], [0.6, 0.8]), ([0.0, 0.0], [0.0, 0.0])):
        got = one(spark, v, lambda c: V.normalize(F.col(c)), "array<float>")
        assert got == pytest.approx(out, abs=1e-6)
