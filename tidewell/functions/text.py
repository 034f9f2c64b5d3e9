"""Column functions over text, paths and queries. All are Column -> Column and stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------------------------------
#: Unicode White_Space, the characters that trimming removes.
SPACE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Characters trimmed from both ends of a query word.
QUERY_PUNCTUATION = ".,!?:;()[]{}«»\"'`"
#: Function words that carry no search signal.
RUSSIAN_STOPWORDS = """
и в во не что он на я с со как а то все она так его но да ты к у же
вы за бы по только ее её мне было вот от меня еще ещё нет о из ему
теперь когда даже ну вдруг ли если уже или ни быть был него до вас
нибудь опять уж вам ведь там потом себя ничего ей может они тут где
есть надо ней для мы тебя их чем была сам чтоб без будто чего раз
тоже себе под будет ж тогда кто этот того потому этого какой совсем
ним здесь этом один почти мой тем чтобы нее неё сейчас были куда
зачем всех можно при два об другой хоть после над больше тот через
эти нас про всего них какая много разве три эту моя хорошо свою
этой перед иногда лучше чуть том нельзя такой им более всегда
конечно всю между это собой собою мной мною тобой тобою нами вами
ними ею тебе нам очень также
""".split()
ENGLISH_STOPWORDS = """
a an the and or but if of at by for with about into to from in on
is are was were be been being have has had do does did will would
could should shall may might must can i you he she it we they them
me my his her its our their your this that these those not no yes
than then so such when where which who whom whose why how what
""".split()
# ----------------------------------------------------------------------------------------------------------------------
STOPWORDS = frozenset(RUSSIAN_STOPWORDS + ENGLISH_STOPWORDS)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim(x: Column | str) -> Column:
    """Both ends without Unicode white space (Spark's own trim() only knows the space)."""
    return F.regexp_replace(_c(x), rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def fields(x: Column | str) -> Column:
    """Maximal runs without white space."""
    return F.filter(F.split(_c(x), f"[{SPACE}]+"), lambda w: w != "")


def singular(w: Column) -> Column:
    """One trailing s less, if the word has three bytes or more."""
    return F.when((F.octet_length(w) >= 3) & w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def words(x: Column | str) -> Column:
    """Runs of letters, decimal digits and _ in lower case; there may be empty strings at the ends."""
    return F.split(F.lower(_c(x)), r"[^\p{L}\p{Nd}_]+")


def word_set(x: Column | str) -> Column:
    """Distinct singular words of a text."""
    return F.array_distinct(F.transform(F.filter(words(x), lambda w: w != ""), singular))


def query_words(x: Column | str, stopwords: frozenset[str] = STOPWORDS) -> Column:
    """Search words of a query, in order, without stop words and repeats. Inner punctuation stays."""
    stop = F.array(*[F.lit(w) for w in sorted(stopwords)])
    bare = F.transform(fields(F.lower(_c(x))), lambda w: F.btrim(F.replace(w, F.lit("%"), F.lit("")), F.lit(QUERY_PUNCTUATION)))
    return F.array_distinct(F.filter(bare, lambda w: (w != "") & ~F.array_contains(stop, w)))


_PHRASE = r'(?:^|[\t\n\f\r ])-"([^"]+)"'
_TERM = r"(?:^|[\t\n\f\r ])-([^\t\n\f\r ]+)"


def parse_exclusions(x: Column | str) -> tuple[Column, Column]:
    """(positive part, excluded terms) of a query: -word and -"a phrase" exclude; phrases come first."""
    q = _c(x)
    rest = F.regexp_replace(q, _PHRASE, " ")
    positive = F.array_join(fields(F.regexp_replace(rest, _TERM, " ")), " ")
    terms = F.concat(F.regexp_extract_all(q, F.lit(_PHRASE), F.lit(1)), F.regexp_extract_all(rest, F.lit(_TERM), F.lit(1)))
    return positive, F.filter(F.transform(terms, lambda t: F.btrim(t, F.lit('"'))), lambda t: t != "")


def is_excluded(text: Column, section: Column, path: Column, terms: Column, fragments: Column) -> Column:
    """Some term occurs in text or section, or some fragment in the path; case does not matter."""
    where = F.lower(F.concat(text, F.lit("\n"), section))
    return F.exists(terms, lambda t: F.contains(where, F.lower(t))) | F.exists(fragments, lambda f: F.contains(F.lower(path), F.lower(f)))


def like_any(text: Column, words: Column) -> Column:
    """Some word occurs in the text, whatever the case; _ stands for any character and a backslash for itself."""
    low = F.lower(text)
    return F.exists(words, lambda w: F.when(F.contains(w, F.lit("_")), F.regexp_like(low, F.regexp_replace(F.regexp_replace(w, r"([^\p{L}\p{Nd}_])", r"\\$1"), "_", "."))).otherwise(F.contains(low, w)))


def path_words(path: Column | str, home: str = "") -> Column:
    """The base name without its extension after up to three nearest visible directories; - and _ become spaces."""
    p = _c(path)
    if home:
        p = F.when(p.startswith(home + "/"), F.substring(p, F.lit(len(home) + 2), F.length(p))).otherwise(p)
    parts = F.split(p, "/")
    base = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*\z", "")
    dirs = F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda d: (d != "") & ~d.startswith("."))
    near = F.slice(dirs, F.greatest(F.size(dirs) - 2, F.lit(1)), F.lit(3))
    return F.translate(F.array_join(F.concat(near, F.array(base)), " "), "-_", "  ")


def embedding_text(path: Column | str, section: Column | str, text: Column | str, home: str = "") -> Column:
    """What the embedder sees of a chunk: path words, section and text, a line each."""
    s = _c(section)
    return F.concat_ws("\n", path_words(path, home), F.when(s != "", s), _c(text))


def under_any_root(path: Column | str, roots: list[str]) -> Column:
    """The path is a root or below one (a whole path component)."""
    p = _c(path)
    hit = F.lit(False)
    for r in roots:
        hit = hit | (p == r) | p.startswith(r + "/")
    return hit


def snippet(x: Column | str, n: int = 200) -> Column:
    """One line: white space collapsed, cut after n characters with an ellipsis."""
    flat = F.array_join(fields(x), " ")
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat)


def chunk_id(path: Column | str, ordinal: Column | str) -> Column:
    return F.concat(_c(path), F.lit("#"), _c(ordinal).cast("string"))


def ordinal_of(chunk: Column | str) -> Column:
    """The number after the last #, else 0."""
    return F.coalesce(F.substring_index(_c(chunk), "#", -1).try_cast("int"), F.lit(0))


def rounded(score: Column | str) -> Column:
    return F.round(_c(score), 4)


def score_band(score: Column | str) -> Column:
    s = _c(score)
    return F.when(s >= 0.7, "green").when(s >= 0.5, "yellow").otherwise("grey")


def rfc3339(mtime: Column | str) -> Column:
    """Epoch seconds in UTC."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(_c(mtime)), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
