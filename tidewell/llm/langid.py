"""Language identification by prediction by partial matching over bytes.

Per language a tree of byte contexts of order 0 to 3 is counted on a bounded sample of labelled rows and then frozen. The
code length of a text under a language is the sum over its bytes of -log2 of the probability that the longest context of
the tree gives: method C (escape weight = number of distinct bytes seen) with exclusion of the bytes already seen in the
longer contexts, down to the uniform order -1. The shortest code wins.

The trees are stored sparsely, by context and language, so all contexts of the sample are kept however many languages there
are. With exclusion, the probability of a byte that a context has not seen is a factor of that context (escape / mass that the
next shorter context gives to unseen bytes) times the probability in the next shorter context; so a node needs that factor
and the exact costs of its own bytes. A slice of texts looks up each of its different four-byte strings once.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import bytekit, scratch

ORDER = 3
PIECE = 1 << 18
#: Bounds of the training sample per language: about SAMPLE_DOCS documents and SAMPLE_BYTES bytes, of documents of at most SAMPLE_BYTES / 16.
SAMPLE_DOCS = 1500
SAMPLE_BYTES = 1 << 25
_models: dict[int, PpmModel] = {}


def held_out(id_col: str):
    """crc32 of the id as text, modulo 4, is 2. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the 32-bit code of the three bytes before it in its row (0 where the row begins) and itself."""
    n = len(data)
    code = data.astype(np.uint32)
    for back in range(1, ORDER + 1):
        shifted = np.zeros(n, np.uint32)
        shifted[back:] = data[: n - back]
        for k in range(back):  # the first bytes of a row have fewer before them
            at = offsets[:-1] + k
            shifted[at[at < offsets[1:]]] = 0
        code |= shifted << np.uint32(8 * back)
    return code


Level = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _level(code: np.ndarray, lang: np.ndarray, value: np.ndarray) -> Level:
    """Rows (code, lang, value) sorted by code, as different codes, row ranges, languages and values."""
    codes, begin = np.unique(code, return_index=True)
    return codes, np.append(begin, len(code)), lang, value.astype(np.float32)


class PpmModel:
    """Frozen statistics: languages, and (language, four-byte code, count) rows sorted by code. max_contexts, if given, keeps the
    most frequent contexts of each language and order only."""

    def __init__(self, languages: list[str], lang: np.ndarray, code: np.ndarray, count: np.ndarray, max_contexts: int | None = None):
        self.languages, self.lang, self.code, self.count, self.max_contexts = languages, lang, code, count, max_contexts

    def tables(self) -> tuple[np.ndarray, list[tuple[Level, Level]]]:
        """Costs in bits: [byte, language] of order 0; per longer order the escapes by context and the costs by context and byte."""
        langs = len(self.languages)
        seen = np.zeros((256, langs))
        np.add.at(seen, (self.code & 255, self.lang), self.count)
        n, kinds = seen.sum(0), (seen > 0).sum(0)
        unseen = np.where(kinds < 256, kinds / np.maximum(n + kinds, 1) / np.maximum(256 - kinds, 1), 0.0)
        p = np.where(n == 0, 1 / 256, np.where(seen > 0, seen / np.maximum(np.where(kinds < 256, n + kinds, n), 1), unseen))
        order0 = -np.log2(np.maximum(p, 1e-300))
        key = (np.arange(256)[:, None] * langs + np.arange(langs)).ravel()  # (code of the shorter context and the byte, language)
        lower = p.ravel()
        levels = []
        for order in range(1, ORDER + 1):
            gram = (self.code.astype(np.int64) & (256 ** (order + 1) - 1)) * langs + self.lang
            grams, at = np.unique(gram, return_inverse=True)
            count = np.bincount(at, weights=self.count)
            lang, code = grams % langs, grams // langs
            node, of = np.unique((code >> 8) * langs + lang, return_inverse=True)
            n = np.bincount(of, weights=count)
            # a context enters the trees if it was seen twice
            context, group = np.unique(node // langs, return_inverse=True)
            ok = np.bincount(group, weights=n)[group] >= 2
            if self.max_contexts is not None:
                rank = np.empty(len(node), np.int64)
                by_lang = np.lexsort((-n, node % langs))
                rank[by_lang] = np.arange(len(node)) - np.searchsorted((node % langs)[by_lang], (node % langs)[by_lang])
                ok &= rank < self.max_contexts
            kinds = np.bincount(of)
            short = np.searchsorted(key, (code & (256**order - 1)) * langs + lang)
            # its bytes were all seen in the shorter context, unless that one is not in the tree of the language
            short = np.minimum(short, len(key) - 1)
            ok &= np.bincount(of, key[short] == (code & (256**order - 1)) * langs + lang) == kinds
            left = 1 - np.bincount(of, weights=lower[short])
            all_ = left <= 1e-12
            p = count / np.where(all_, n, n + kinds)[of]
            escape = np.where(all_, 1e-300, kinds / (n + kinds) / np.where(all_, 1, left))
            use = ok[of]
            key, lower = grams[use], p[use]
            levels.append((_level((node // langs)[ok], (node % langs)[ok], -np.log2(escape[ok])), _level(code[use], lang[use], -np.log2(lower))))
        return order0, levels


def _loaded(blob: bytes) -> tuple[list[str], np.ndarray, list[tuple[Level, Level]]]:
    """The tables of a model, built once in each Python worker."""
    key = zlib.crc32(blob)
    if key not in _models:
        model = pickle.loads(zlib.decompress(blob))
        _models.clear()
        _models[key] = (model.languages, *model.tables())
    return _models[key]


def _found(level: Level, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of a level for each code: place in code, language, value."""
    codes, begin, lang, value = level
    if not len(codes):
        return np.empty(0, np.int64), lang, value
    at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
    hit = np.flatnonzero(codes[at] == code)
    first = begin[at[hit]]
    n = begin[at[hit] + 1] - first
    row = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(hit, n), lang[row], value[row]


def costs(code: np.ndarray, order0: np.ndarray, levels: list[tuple[Level, Level]]) -> np.ndarray:
    """[code, language]: bits of the last byte of four-byte codes after the three before it."""
    out = order0[code & 255]
    for order, (escapes, grams) in enumerate(levels, 1):
        at, lang, bits = _found(escapes, (code >> np.uint32(8)).astype(np.int64) & (256**order - 1))
        out[at, lang] += bits
        at, lang, bits = _found(grams, code.astype(np.int64) & (256 ** (order + 1) - 1))
        out[at, lang] = bits
    return out


def code_lengths(data: np.ndarray, offsets: np.ndarray, order0: np.ndarray, levels: list[tuple[Level, Level]]) -> np.ndarray:
    """[row, language]: bits of each row's bytes."""
    out = np.zeros((len(offsets) - 1, order0.shape[1]))
    for a, b in bytekit.slices(offsets, PIECE):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if not len(part):
            continue
        code = _grams(part, at)
        for i in range(0, len(code), 4 * PIECE):  # a long row in pieces
            different, place = np.unique(code[i : i + 4 * PIECE], return_inverse=True)
            bits = costs(different, order0, levels)
            if b == a + 1:
                out[a] += np.bincount(place, minlength=len(different)) @ bits
            else:
                row = np.repeat(np.arange(b - a), np.diff(at))
                for lang in range(bits.shape[1]):
                    out[a:b, lang] = np.bincount(row, bits[place, lang], minlength=b - a)
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, max_languages: int = 512, sample_bytes: int = SAMPLE_BYTES) -> bytes | None:
    """Learns from the labelled rows of docs; returns the packed model, or None if no row has a language.

    The bound of the sample: rows are chosen by the hash of their id, in whole, with a share per language that makes about
    sample_docs rows and sample_bytes bytes at most. Rows of more than sample_bytes / 16 bytes are not learned from, so that no
    single one carries the sum far beyond; they are identified like all others. All contexts of the sample seen twice are kept.
    Every language that has a row of that size is learned; more than max_languages are an error. The counts are summed on the
    executors; what reaches the driver is bounded by the sample. An empty table, and one without labelled text, gives None.
    Repeated rows count as often as they are there; columns of other names are ignored.
    """
    scratch.small_batches(docs.sparkSession)
    size = F.octet_length(text_col)
    rows = docs.filter(F.col(lang_col).isNotNull() & (size <= sample_bytes // 16))
    sizes = {r["lang"]: (r["n"], r["b"]) for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n"), F.sum(size).alias("b")).limit(max_languages + 1).collect()}
    if not sizes:
        return None
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = sorted(sizes)
    share = F.create_map(*[F.lit(x) for lang, (n, b) in sorted(sizes.items()) for x in (lang, min(1.0, sample_docs / n, sample_bytes / max(b, 1)))])
    draw = F.pmod(F.xxhash64(F.lit(11), F.col(id_col), F.length(text_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.filter(draw < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.array([languages.index(x) for x in batch.column("lang").to_pylist()], np.int64)
            data, offsets = bytekit.buffers(batch.column("text"))
            for a, b in bytekit.slices(offsets, PIECE):
                at = offsets[a : b + 1] - offsets[a]
                key = (np.repeat(of[a:b], np.diff(at)) << 32) | _grams(data[offsets[a] : offsets[b]], at).astype(np.int64)
                key, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["key", "n"])

    counts = sample.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = counts["key"].to_numpy(), counts["n"].to_numpy()
    order = np.argsort(key)
    key, n = key[order], n[order].astype(np.float64)
    model = PpmModel(languages, key >> 32, (key & 0xFFFFFFFF).astype(np.uint32), n)
    return zlib.compress(pickle.dumps(model), 1)


def identify(docs: DataFrame, model: bytes | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    lang_pred is `und` with score 0 for a null text, a text without a letter, or without a model; else the language with
    the shortest code (ties: the first by name), and the score is its share of 2 ** -(bits per byte) over all languages, 1 / languages
    at least: a text that all trees code alike, as one in a foreign script, scores low however long it is.
    Whole texts are scored; other columns are ignored, whatever their names. Repeated rows have equal results; an empty table
    gives an empty result.
    """
    scratch.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).alias("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, *tables = _loaded(shared.value)
        names = np.array([*languages, "und"], object)
        for batch in batches:
            text = batch.column("text")
            data, offsets = bytekit.buffers(text)
            bits = code_lengths(data, offsets, *tables)
            best = bits.argmin(1)
            more = (bits - bits.min(1, keepdims=True)) / np.maximum(np.diff(offsets), 1)[:, None]
            p = 1 / np.exp2(-more).sum(1)
            none = np.asarray(text.is_null())
            best[none], p[none] = len(languages), 0.0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names[best], pa.string()), pa.array(p)], ["doc_id", "held_out", "lang_pred", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def train_and_identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> DataFrame:
    """Learns from the rows that are not held out, predicts all rows."""
    return identify(docs, fit(docs.filter(~held_out(id_col)), id_col, text_col, lang_col, **bounds), id_col, text_col)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> DataFrame:
    """The rows of docs whose language is identified, in docs' columns.

    Rejected are null texts, texts without a letter, and texts that no language's contexts predict: the byte frequencies of all
    languages together (order 0 of the merged tree), or equal frequencies of all bytes (order -1, 8 bits a byte), code them in no
    more bits than the best language's tree does. The first finds noise, whatever its letters, the second scripts that no
    tree has learned; there is no threshold to fit. Repeated rows stay or go together; without a labelled row
    nothing can be identified, and the result, like that of an empty table, is empty. Columns of any name are kept.
    """
    model = fit(docs.filter(~held_out(id_col)), id_col, text_col, lang_col, **bounds)
    if model is None:
        return docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: Iterator[pa.Array]) -> Iterator[np.ndarray]:
        _, order0, levels = _loaded(shared.value)
        plain = -np.log2(np.exp2(-order0).mean(1))[:, None]
        for text in texts:
            data, offsets = bytekit.buffers(text)
            rival = np.minimum(code_lengths(data, offsets, plain, [])[:, 0], 8.0 * np.diff(offsets))
            yield code_lengths(data, offsets, order0, levels).min(1) < rival

    # texts without a letter are `und` whatever their code lengths
    return scratch.keep_rows(docs.filter(F.col(f"`{text_col}`").rlike(r"\p{L}")), text_col, keep)
