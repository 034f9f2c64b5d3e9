"""Benchmark decontamination by template canonicalisation.

Documents and benchmark items become sequences of canonical words: lower case, without punctuation; numbers, names (a
capital inside a sentence) and units after a number become typed placeholders. Numbers are words that begin with a digit and
single number words, which have the value of their digits ("twelve" is 12; "one", mostly a pronoun, stays a word). Windows of five canonical words, with three
literal words at least, are looked up in the items' windows (a hash join with the bounded item side held in memory, in
blocks of items). Matches that lie on one diagonal (document position - item position) belong together: a document is
contaminated by an item if the windows on its diagonals, all of them or those of one place in the document, cover enough of
the item's words, and if the values in the slots are consistent: equal values of the item's slots stand for equal values in
the document's slots, and different names for different names (numbers may coincide). So a re-parameterised question is
caught and an accidental run of placeholders is not.

Capitals are not always there to tell names: windows are looked up in three forms. Form 0 is the one above; form 1 has no
names, so copies in lower case or in title case match; in form 2 a capital at the beginning of a sentence makes a name too.

Items whose windows cannot cover enough of them (dense in names, numbers and units) are also looked up by their windows of
one or two literal words and by windows of the words' own values, and items shorter than a window by the hash of all their
words. A match that has fewer than three literal words in all counts only if all its values are equal.

Items of one text are one entry. A window that many items share does not pair a document with all of them: per item the most
shared windows stay passive as long as they cannot reach the coverage by themselves, so one of the others must match; the
passive ones are then looked up for the (document, item) pairs that these found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import bytekit, scratch

WINDOW = 5
LITERALS = 3
COVERAGE = 0.6
#: Windows of more items than this may be passive.
SHARED = 16
#: A block of items, which executors hold, has this many characters at most, or one item.
BLOCK_CHARACTERS = 1 << 24
#: Words that are units when they follow a number.
UNITS = (
    "mm cm m km in ft mi g kg mg lb oz s sec min h hr ms ml l kwh w kw v a hz khz mhz ghz pa bar usd eur gbp percent "
    "meter meters metre metres kilometer kilometers mile miles gram grams kilogram kilograms second seconds minute minutes "
    "hour hours day days week weeks month months year years dollar dollars euro euros cent cents liter liters degree degrees"
).split()
#: Number words and what they stand for.
NUMBER_WORDS = {
    "zero": 0, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30,
    "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000, "million": 1000000,
}
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x11, 0x22, 0x33))
#: Words of letters and digits; an inner dot or comma of a number separates two numbers.
_TABLE = bytekit.ALNUM
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:\n"]] = True


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return bytekit.stretch_hash(bytekit.prefix_hash(data), begin, end)


def _word_hashes(words: list[str]) -> np.ndarray:
    return np.array([_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0] for w in words], np.uint64)


_UNIT_HASHES = np.sort(_word_hashes(UNITS))
_SPELT, _DIGITS = _word_hashes(list(NUMBER_WORDS)), _word_hashes([str(n) for n in NUMBER_WORDS.values()])
_SPELT, _DIGITS = _SPELT[np.argsort(_SPELT)], _DIGITS[np.argsort(_SPELT)]


Form = tuple[np.ndarray, np.ndarray]


def _read(data: np.ndarray, offsets: np.ndarray) -> tuple[list[Form], np.ndarray, np.ndarray, np.ndarray]:
    """(canonical hash, literal?) per word in each form, hash of the value itself, capital at the beginning of a sentence?, and
    the first word of each row."""
    begin, end, first = bytekit.words(data, offsets, _TABLE)
    if not len(begin):
        return [(np.empty(0, np.uint64), np.empty(0, bool))] * 3, np.empty(0, np.uint64), np.empty(0, bool), first
    value = _hashes(data, begin, end)
    lead = data[begin]
    spelt = np.minimum(np.searchsorted(_SPELT, value), len(_SPELT) - 1)
    named = _SPELT[spelt] == value
    value = np.where(named, _DIGITS[spelt], value)
    number = named | (lead >= 48) & (lead <= 57)
    upper = (lead >= 65) & (lead <= 90)
    second = data[np.minimum(begin + 1, len(data) - 1)]
    shout = (end - begin > 1) & (second >= 65) & (second <= 90)  # a word in capitals is emphasis, not a name
    # a sentence begins at the row's start and after a stop between the words
    stops = np.concatenate(([0], np.cumsum(_STOP[data])))
    opens = np.ones(len(begin), bool)
    opens[1:] = stops[begin[1:]] > stops[end[:-1]]
    starts = first[:-1]
    opens[starts[starts < len(begin)]] = True
    after_number = np.zeros(len(begin), bool)
    after_number[1:] = number[:-1]
    after_number[starts[starts < len(begin)]] = False
    unit = after_number & ~number & np.isin(value, _UNIT_HASHES)
    capital = upper & ~shout & ~number
    forms = []
    for name in (capital & ~opens, np.zeros(len(begin), bool), capital):
        code = value.copy()
        code[number], code[name], code[unit] = _NUMBER, _NAME, _UNIT
        forms.append((code, ~(number | name | unit)))
    return forms, value, capital & opens, first


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word: canonical hash, literal?, hash of the value itself; and the first word of each row (form 0)."""
    forms, value, _, first = _read(data, offsets)
    return *forms[0], value, first


def _grams(codes: np.ndarray, literal: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the window of that length that starts at each word, its literal words, and whether it is inside one row."""
    if len(codes) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool)
    h = bytekit.ngrams(bytekit.mix64(codes), length)
    n = len(h)
    words = np.concatenate(([0], np.cumsum(literal)))
    inside = np.ones(n, bool)
    for back in range(1, length):  # windows that would run into the next row
        at = first[1:] - back
        inside[at[(at >= 0) & (at < n)]] = False
    return h, words[length : length + n] - words[:n], inside


def windows(code: np.ndarray, literal: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, valid) of the window that starts at each word; valid: inside one row and with enough literal words."""
    h, literals, inside = _grams(code, literal, first, WINDOW)
    return h, inside & (literals >= LITERALS)


class _Lookup:
    """Item windows sorted by hash."""

    def __init__(self, h: np.ndarray, at: np.ndarray):
        order = np.argsort(h[at], kind="stable")
        self.hash, self.at = h[at][order], at[order]
        # a first look at 20 bits of the hash rules out nearly all windows of a document
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.hash >> np.uint64(44)] = True

    def probe(self, h: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(ok & self.sieve[h >> np.uint64(44)])
        lo, hi = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
        n = hi - lo
        mine = np.repeat(at, n)
        theirs = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return mine, self.at[theirs]


    def meet(self, h: np.ndarray, ok: np.ndarray, row: np.ndarray, first: np.ndarray, pair_row: np.ndarray, pair_item: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for the given pairs (row, item) only. row: of each document word; begin: first word of each item."""
        by_item = np.argsort(self.at, kind="stable")
        at = self.at[by_item]
        lo, hi = np.searchsorted(at, begin[pair_item]), np.searchsorted(at, begin[pair_item + 1])
        n = hi - lo
        which = by_item[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        of = np.repeat(pair_row, n)
        kinds, kind = np.unique(self.hash, return_inverse=True)
        place = np.flatnonzero(ok & self.sieve[h >> np.uint64(44)])
        mine = np.minimum(np.searchsorted(kinds, h[place]), len(kinds) - 1)
        hit = kinds[mine] == h[place]
        place, mine = place[hit], mine[hit]
        key = row[place] * len(kinds) + mine
        order = np.argsort(key, kind="stable")
        want = of * len(kinds) + kind[which]
        lo, hi = np.searchsorted(key[order], want, "left"), np.searchsorted(key[order], want, "right")
        n = hi - lo
        return place[order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]], self.at[np.repeat(which, n)]


class ItemIndex:
    """Windows of a block of items, sorted by hash; codes and values of their words. ids: those of each different text."""

    def __init__(self, ids: list, texts: list[str], coverage: float = COVERAGE):
        groups: dict[str, list] = {}
        for i, t in zip(ids, texts, strict=True):
            groups.setdefault(t or "", []).append(i)
        self.ids = list(groups.values())
        data, offsets = bytekit.buffers(pa.array(list(groups), pa.string()))
        forms, self.value, opening, self.first = _read(data, offsets)
        self.code, self.literal = forms[0]
        size = np.diff(self.first)
        owner = np.repeat(np.arange(len(size)), size)
        # slots: placeholders, and names at the beginning of a sentence that are names elsewhere in the item as well
        named = np.unique(np.stack((owner[self.code == _NAME], self.value[self.code == _NAME].view(np.int64)), 1), axis=0)
        again = {(int(a), int(b)) for a, b in named}
        self.name = self.code == _NAME
        for w in np.flatnonzero(opening):
            self.name[w] |= (int(owner[w]), int(self.value[w : w + 1].view(np.int64)[0])) in again
        self.slot = ~self.literal | self.name

        listed = [windows(code, literal, self.first) for code, literal in forms]
        shares = np.zeros(len(self.code), np.int64)  # the items that share the window at each word, in the form that most do
        for h, ok in listed:
            at = np.flatnonzero(ok)
            pairs = np.unique(np.stack((h[at].view(np.int64), owner[at]), 1), axis=0)
            kinds, n = np.unique(pairs[:, 0], return_counts=True)
            shares[at] = np.maximum(shares[at], n[np.searchsorted(kinds, h[at].view(np.int64))]) if len(at) else 0
        passive = self._passive(shares, owner, size, coverage)
        self.main = _Lookup(listed[0][0], np.flatnonzero(listed[0][1]))
        #: (form or None for the values, length, windows that find items, passive windows or None)
        self.lookups: list[tuple[int | None, int, _Lookup, _Lookup | None]] = []
        for form, (h, ok) in enumerate(listed):
            idle = ok & passive[: len(h)]
            self.lookups.append((form, WINDOW, _Lookup(h, np.flatnonzero(ok & ~idle)), _Lookup(h, np.flatnonzero(idle)) if idle.any() else None))
        # items that the windows with enough literal words cannot cover
        at = np.flatnonzero(listed[0][1])
        steps = np.bincount(at, minlength=len(self.code) + WINDOW) - np.bincount(at + WINDOW, minlength=len(self.code) + WINDOW)
        met = np.bincount(owner, np.cumsum(steps)[: len(self.code)] > 0, minlength=len(size))
        sparse = (met < coverage * size) & (size >= WINDOW)
        for by_value, length, wanted in ((False, WINDOW, sparse), (True, WINDOW, sparse), *((True, k, size == k) for k in range(1, WINDOW))):
            h, few, inside = _grams(self.value if by_value else self.code, self.literal, self.first, length)
            ok = inside & wanted[owner[: len(h)]] & (by_value | (few > 0) & (few < LITERALS))
            if ok.any():
                self.lookups.append((None if by_value else -1, length, _Lookup(h, np.flatnonzero(ok)), None))

    @staticmethod
    def _passive(shares: np.ndarray, owner: np.ndarray, size: np.ndarray, coverage: float) -> np.ndarray:
        """Per word whether its window is passive: the most shared ones of each item, while they cover less than coverage."""
        out = np.zeros(len(shares), bool)
        begin = np.concatenate(([0], np.cumsum(size)))
        for item in np.unique(owner[shares > SHARED]):
            own = shares[begin[item] : begin[item + 1]]
            covered = np.zeros(len(own) + WINDOW, bool)
            for w in np.argsort(-own, kind="stable"):
                fresh = covered.copy()
                fresh[w : w + WINDOW] = True
                if own[w] <= SHARED or fresh[: len(own)].sum() >= coverage * len(own):
                    break
                covered = fresh
                out[begin[item] + w] = True
        return out

    def probe(self, h: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (document window, item window) of equal hash."""
        return self.main.probe(h, ok)

    def search(self, forms: list[Form], value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The matching windows: document word, item word, length. All of them for every (row, item) that can be covered enough."""
        found, idle = [], []
        made = [windows(code, literal, first) for code, literal in forms]
        code, literal = forms[0]
        for form, length, active, passive in self.lookups:
            if form is not None and form >= 0:
                h, ok = made[form]
            else:
                h, few, inside = _grams(value if form is None else code, literal, first, length)
                ok = inside & ((few > 0) & (few < LITERALS) if form is not None else np.True_)
            found.append((*active.probe(h, ok), length))
            if passive:
                idle.append((h, ok, passive))
        if idle and any(len(f[0]) for f in found):
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            mine, theirs = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            pairs = np.unique(row[mine] * len(self.ids) + np.searchsorted(self.first, theirs, "right") - 1)
            for h, ok, passive in idle:
                found.append((*passive.meet(h, ok, row, first, pairs // len(self.ids), pairs % len(self.ids), self.first), WINDOW))
        mine, theirs = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        length = np.repeat([f[2] for f in found], [len(f[0]) for f in found])
        _, once = np.unique((mine * (len(self.code) + 1) + theirs) * 8 + length, return_index=True)  # forms that agree
        return mine[once], theirs[once], length[once]


def _consistent(item: np.ndarray, doc: np.ndarray) -> bool:
    """Slots of equal value in the item have equal values in the document."""
    order = np.argsort(item, kind="stable")
    same = item[order][1:] == item[order][:-1]
    return bool((doc[order][1:] == doc[order][:-1])[same].all())


def _agreeing(index: ItemIndex, words: np.ndarray, doc: np.ndarray) -> bool:
    """Slots (item words) hold consistent values in the document: equal ones for equal ones, different names for different names."""
    item, name = index.value[words], index.name[words]
    return not len(words) or _consistent(item, doc) and _consistent(doc[name], item[name])


def _cells(at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The words of windows."""
    return np.unique(np.repeat(at, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length))


def _judge(index: ItemIndex, value: np.ndarray, mine: np.ndarray, theirs: np.ndarray, length: np.ndarray, item: int, coverage: float) -> tuple[float, int, bool] | None:
    """(covered share of the item's words, document word where it begins, all slots equal), or None if clean.

    All diagonals together are tried first. If their slots clash, each diagonal in turn stands for a copy: what else lies in
    its stretch of the document belongs to it and must agree; what lies elsewhere is added, nearest first, where it agrees.
    """
    begin, size = index.first[item], index.first[item + 1] - index.first[item]
    diagonals, which, n = np.unique(mine - theirs, return_inverse=True, return_counts=True)
    order = np.argsort(which, kind="stable")
    parts = np.split(order, np.cumsum(n)[:-1])
    cells = [_cells(theirs[p], length[p]) - begin for p in parts]

    def put(covered: np.ndarray, own: np.ndarray, diagonal: int) -> np.ndarray:
        """covered (the document word of each item word, or -1) with the words of a diagonal that are still open."""
        out = covered.copy()
        free = own[covered[own] < 0]
        out[free] = free + begin + diagonal
        return out

    def agrees(covered: np.ndarray) -> bool:
        hit = np.flatnonzero(covered >= 0)
        slots = hit[index.slot[begin + hit]]
        return _agreeing(index, begin + slots, value[covered[slots]])

    def verdict(covered: np.ndarray) -> tuple[float, int, bool] | None:
        hit = np.flatnonzero(covered >= 0)
        slots = hit[index.slot[begin + hit]]
        same = bool((index.value[begin + slots] == value[covered[slots]]).all())
        if len(hit) / size < coverage or not agrees(covered) or len(hit) - len(slots) < LITERALS and not same:
            return None
        return len(hit) / size, int(covered[hit].min()), same

    none = np.full(size, -1)
    ranked = sorted(range(len(diagonals)), key=lambda k: (-n[k], diagonals[k]))
    covered = none
    for k in ranked:
        covered = put(covered, cells[k], diagonals[k])
    if np.count_nonzero(covered >= 0) / size < coverage:
        return None
    found = verdict(covered)
    if found or len(diagonals) == 1:
        return found
    for seed in ranked:
        start = diagonals[seed] + begin
        covered = put(none, cells[seed], diagonals[seed])
        if not agrees(covered):
            continue
        others = sorted((k for k in ranked if k != seed), key=lambda k: abs(diagonals[k] - diagonals[seed]))
        rest = []
        for k in others:
            place = cells[k] + begin + diagonals[k]
            near = (place >= start) & (place < start + size)
            covered = put(covered, cells[k][near], diagonals[k])
            rest.append((cells[k][~near], diagonals[k]))
        if not agrees(covered):
            continue
        for own, diagonal in rest:
            if np.count_nonzero(covered >= 0) / size >= coverage:
                break
            more = put(covered, own, diagonal)
            covered = more if agrees(more) else covered
        found = verdict(covered)
        if found:
            return found
    return None


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE, block_items: int = 20_000) -> DataFrame:
    """The contaminated documents: doc_id, item_id, covered (share of the item's canonical words), word (where it begins,
    in words from 0), verbatim (all slots keep their values). One row per (document row, item).

    Null texts and texts without words match nothing. An item of fewer than WINDOW words, even of one, matches where all its
    words stand in a row. Items of equal text are all reported. The items are a query set: they are read in blocks of block_items by their order, each held in memory
    by the executors and compared with all documents, so any number of them is handled. Empty tables give no rows. Whole texts
    are searched; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ids, item_kind = rows.schema["doc_id"].dataType.simpleString(), items.schema[item_id_col].dataType.simpleString()
    out, schema = None, f"doc_id {ids}, item_id {item_kind}, covered double, word long, verbatim boolean"
    queries = items.filter(F.col(item_text_col).isNotNull()).select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text"))
    for block in _blocks(queries, block_items):
        part = rows.mapInArrow(_searcher(spark.sparkContext.broadcast(block), coverage, rows, queries), schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def _blocks(queries: DataFrame, size: int) -> Iterator[tuple[list, list[str]]]:
    ids, texts, held = [], [], 0
    for r in queries.toLocalIterator():
        if ids and (len(ids) == size or held + len(r["text"]) > BLOCK_CHARACTERS):
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        held += len(r["text"])
    if ids:
        yield ids, texts


def _searcher(shared, coverage: float, rows: DataFrame, queries: DataFrame):
    from pyspark.sql.pandas.types import to_arrow_type

    doc_type, item_type = to_arrow_type(rows.schema["doc_id"].dataType), to_arrow_type(queries.schema["item_id"].dataType)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(*shared.value, coverage)
        for batch in batches:
            found = [(row, i, *rest) for row, item, *rest in _matches(index, batch.column("text"), coverage) for i in index.ids[item]]
            cols = list(zip(*found, strict=True)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(cols[0], pa.int64())).cast(doc_type), pa.array(list(cols[1]), item_type), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.bool_())],
                ["doc_id", "item_id", "covered", "word", "verbatim"],
            )

    return search


def _matches(index: ItemIndex, texts: pa.Array, coverage: float) -> list[tuple[int, int, float, int, bool]]:
    """(row, item's place, covered share, word, verbatim) of every contaminated (row, item) of a batch."""
    data, offsets = bytekit.buffers(texts)
    found = []
    for a, b in bytekit.slices(offsets):
        forms, value, _, first = _read(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        mine, theirs, length = index.search(forms, value, first)
        if not len(mine):
            continue
        row = np.searchsorted(first, mine, "right") - 1
        item = np.searchsorted(index.first, theirs, "right") - 1
        key = row * len(index.ids) + item
        order = np.argsort(key, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            g = group[0]
            if length[group].sum() < coverage * (index.first[item[g] + 1] - index.first[item[g]]):
                continue
            verdict = _judge(index, value, mine[group], theirs[group], length[group], item[g], coverage)
            if verdict:
                share, word, verbatim = verdict
                found.append((int(a + row[g]), int(item[g]), share, word - int(first[row[g]]), verbatim))
    return found


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_text_col: str = "text", coverage: float = COVERAGE, block_items: int = 20_000) -> DataFrame:
    """The rows of docs that no item contaminates, in docs' columns, whatever their names. Null and empty texts stay, repeated rows
    stay or go together; without items all rows stay, and an empty table stays empty."""

    def cleaner(shared):
        def keep(texts: Iterator[pa.Array]) -> Iterator[np.ndarray]:
            index = ItemIndex(*shared.value, coverage)
            for text in texts:
                clean = np.ones(len(text), bool)
                clean[[m[0] for m in _matches(index, text, coverage)]] = False
                yield clean

        return keep

    queries = items.filter(F.col(item_text_col).isNotNull()).select(F.lit(0).alias("item_id"), F.col(item_text_col).alias("text"))
    for block in _blocks(queries, block_items):
        docs = scratch.keep_rows(docs, text_col, cleaner(docs.sparkSession.sparkContext.broadcast(block)))
    return docs
