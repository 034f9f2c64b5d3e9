"""Chunking: files to (path, section, text, ordinal) rows. Markdown, pages and packing are DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import SPACE, trim

#: Fixed value: bytes when packing paragraphs, code points when splitting a long one.
MAX_CHUNK = 1500
_BLANK_LINE = r"\n[\t\n\f\r ]*\n"


def hard_split(p: Column) -> Column:
    """Windows of MAX_CHUNK code points, each trimmed (a blank window stays, as an empty piece)."""
    last = F.ceil(F.length(p) / F.lit(MAX_CHUNK)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: trim(F.substring(p, i * MAX_CHUNK + 1, F.lit(MAX_CHUNK))))


def pack_paragraphs(text: Column) -> Column:
    """Greedy packing of blank-line separated paragraphs into pieces of MAX_CHUNK bytes at most; longer ones are hard-split and
    stay by themselves."""
    paragraphs = F.filter(F.transform(F.split(text, _BLANK_LINE), trim), lambda p: p != "")
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), F.lit("").alias("cur"))

    def flushed(acc: Column) -> Column:
        return F.when(acc["cur"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["cur"]))

    def step(acc: Column, p: Column) -> Column:
        full = (acc["cur"] != "") & (F.octet_length(acc["cur"]) + 2 + F.octet_length(p) > MAX_CHUNK)
        joined = F.when(acc["cur"] == "", p).otherwise(F.concat(acc["cur"], F.lit("\n\n"), p))
        return (
            F.when(F.octet_length(p) > MAX_CHUNK, F.struct(F.concat(flushed(acc), hard_split(p)).alias("out"), F.lit("").alias("cur")))
            .when(full, F.struct(F.array_append(acc["out"], acc["cur"]).alias("out"), p.alias("cur")))
            .otherwise(F.struct(acc["out"].alias("out"), joined.alias("cur")))
        )

    return F.aggregate(paragraphs, start, step, flushed)


def _pieces(sections: DataFrame, order: list[str]) -> DataFrame:
    """path, section, body -> chunks with contiguous ordinals."""
    pieces = sections.select("path", "section", *order, F.posexplode(pack_paragraphs(F.col("body"))).alias("_piece", "text"))
    if not order:  # one section a file: the piece's number is the ordinal, and no text is shuffled
        return pieces.select("path", "section", "text", F.col("_piece").alias("ordinal"))
    number = F.row_number().over(Window.partitionBy("path").orderBy(*order, "_piece")) - 1
    return pieces.select("path", "section", "text", number.alias("ordinal"))


#: Events that one inner fold takes: appending to an array copies it, so long files are folded in stretches.
_STRETCH = 256
_HEADING = r"^(#{1,6})[\t\n\f\r ]+(.*)\z"
_MARK = "struct<no:int,level:int,title:string>"


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _sections(lines: Column) -> Column:
    """array<struct<section, body>> of a file's lines: one fold over its fence and heading lines.

    The state is whether a fence is open and the titles of the six levels; a heading outside a fence closes a section and opens the
    next. Bodies are then slices of the lines.
    """
    mark = F.transform(lines, lambda x, i: F.struct(i.cast("int").alias("no"), x.alias("line"), trim(x).alias("bare")))
    mark = F.filter(mark, lambda m: m["line"].startswith("#") | m["bare"].startswith("```") | m["bare"].startswith("~~~"))

    def event(m: Column) -> Column:
        fence = m["bare"].startswith("```") | m["bare"].startswith("~~~")
        return F.struct(m["no"].alias("no"), F.when(fence, 0).otherwise(F.length(F.regexp_extract(m["line"], _HEADING, 1))).alias("level"), trim(F.regexp_extract(m["line"], _HEADING, 2)).alias("title"), fence.alias("fence"))

    # a line of # without a blank and a title is no heading
    events = F.filter(F.transform(mark, event), lambda e: e["fence"] | (e["level"] > 0))
    events = F.transform(events, lambda e: F.struct(e["no"].alias("no"), e["level"].cast("int").alias("level"), e["title"].alias("title")).cast(_MARK))
    open_ = F.array(F.struct(F.lit(-1).alias("no"), F.lit("").alias("section")))
    state = F.struct(F.lit(False).alias("inside"), F.array_repeat(F.lit(""), 6).alias("trail"), F.array().cast("array<struct<no:int,section:string>>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        trail = F.transform(acc["trail"], lambda t, i: F.when(i + 1 < e["level"], t).when(i + 1 == e["level"], e["title"]).otherwise(F.lit("")))
        name = lambda t: F.array_join(F.filter(t, lambda x: x != ""), " > ")
        heading = _let(trail, lambda t: F.struct(acc["inside"].alias("inside"), t.alias("trail"), F.array_append(acc["out"], F.struct(e["no"].alias("no"), name(t).alias("section"))).alias("out")))
        fence = F.struct((~acc["inside"]).alias("inside"), acc["trail"].alias("trail"), acc["out"].alias("out"))
        return F.when(e["level"] == 0, fence).when(acc["inside"], acc).otherwise(heading)

    def stretch(acc: Column, events: Column) -> Column:
        begin = F.struct(acc["inside"].alias("inside"), acc["trail"].alias("trail"), F.array().cast("array<struct<no:int,section:string>>").alias("out"))
        return _let(F.aggregate(events, begin, step), lambda x: F.struct(x["inside"].alias("inside"), x["trail"].alias("trail"), F.array_append(acc["out"], x["out"]).alias("out")))

    def fold(events: Column) -> Column:
        count = F.ceil(F.size(events) / F.lit(_STRETCH)).cast("int")
        parts = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.slice(events, i * _STRETCH + 1, F.lit(_STRETCH)))).otherwise(F.array().cast(f"array<array<{_MARK}>>"))
        outer = F.struct(state["inside"].alias("inside"), state["trail"].alias("trail"), F.array().cast("array<array<struct<no:int,section:string>>>").alias("out"))
        return F.aggregate(parts, outer, stretch, lambda acc: F.flatten(acc["out"]))

    starts = _let(events, lambda e: F.concat(open_, fold(e)))
    return _let(
        F.struct(lines.alias("lines"), starts.alias("starts")),
        lambda f: F.transform(
            f["starts"],
            lambda s, i: F.struct(
                s["section"].alias("section"),
                trim(F.array_join(F.slice(f["lines"], s["no"] + 2, F.coalesce(F.get(f["starts"], i + 1)["no"], F.size(f["lines"])) - s["no"] - 1), "\n")).alias("body"),
            ),
        ),
    )


def chunk_markdown(files: DataFrame) -> DataFrame:
    """files: path, text. Fenced lines are body; # headings outside fences start sections, whose name is the trail of the
    headings above, `A > B`. A section without body gives no chunk. A file stays one row until its chunks are cut: nothing is
    shuffled."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"\r\z", ""))
    sections = files.select("path", F.explode(F.array(_sections(lines))).alias("sections"))
    pieces = F.flatten(F.transform(F.filter("sections", lambda s: s["body"] != ""), lambda s: F.transform(pack_paragraphs(s["body"]), lambda t: F.struct(s["section"].alias("section"), t.alias("text")))))
    pieces = sections.select("path", F.posexplode(pieces).alias("ordinal", "piece"))
    return pieces.select("path", "piece.section", "piece.text", "ordinal")


def chunk_pages(files: DataFrame) -> DataFrame:
    """files: path, text with form feeds between pages. Sections are `p. N`; blank pages keep their number and give nothing."""
    pages = files.select("path", F.posexplode(F.split("text", "\f")).alias("page", "text"))
    pages = pages.select("path", "page", F.concat(F.lit("p. "), (F.col("page") + 1).cast("string")).alias("section"), F.col("text").alias("body"))
    return _pieces(pages.filter(~F.col("body").rlike(rf"^[{SPACE}]*\z")), ["page"])


def chunk_plain(files: DataFrame) -> DataFrame:
    """files: path, text without structure: one section."""
    return _pieces(files.select("path", F.lit("").alias("section"), F.col("text").alias("body")), [])


def render_csv_rows(rows: DataFrame) -> DataFrame:
    """rows: path, header, record (arrays) and line -> also row: `header: value` lines of the values that are not blank."""
    numbered = F.transform(F.col("record"), lambda v, i: F.struct(trim(v).alias("v"), i.alias("i")))
    name = lambda i: F.coalesce(F.nullif(trim(F.get(F.col("header"), i)), F.lit("")), F.concat(F.lit("col "), (i + 1).cast("string")))
    lines = F.transform(F.filter(numbered, lambda s: s["v"] != ""), lambda s: F.concat(name(s["i"]), F.lit(": "), s["v"]))
    return rows.withColumn("row", F.array_join(lines, "\n"))
