"""Vector kernels over the UTF-8 bytes of an Arrow string column: words, word hashes and n-gram hashes.

The kernels see the column's own buffers (no Python string per row) and work on slices of a bounded number of bytes.
Hashes are 64-bit: a sum of random byte values times powers of an odd number, so the hash of any stretch is a difference
of two prefix sums; results go through a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Blanks of the word pattern [^\x20\x09-\x0D]+.
BLANK = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SLICE = 1 << 18
_rng = np.random.default_rng(20240229)
_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def lower_table(values: np.ndarray = _VALUES) -> np.ndarray:
    """Byte values that treat A-Z as a-z."""
    out = values.copy()
    out[65:91] = values[97:123]
    return out


LOWER = lower_table()


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(SLICE + 1, n + 1)
        have = np.empty(size, np.uint64)
        have[0] = 1
        filled = 1
        while filled < size:
            step = min(filled, size - filled)
            have[filled : filled + step] = have[:step] * np.uint64(pow(base, filled, 1 << 64))
            filled += step
        _powers[base] = have
    return have


def prefix_hash(data: np.ndarray, values: np.ndarray = LOWER) -> np.ndarray:
    """Sums s with hash(data[a:b]) = (s[b] - s[a]) * inverse powers[a]."""
    s = np.empty(len(data) + 1, np.uint64)
    s[0] = 0
    np.cumsum(values[data] * powers(_BASE, len(data))[: len(data)], out=s[1:])
    return s


def stretch_hash(s: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix64((s[end] - s[begin]) * powers(_INVERSE, len(s))[begin])


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and the n + 1 offsets into them; null rows have none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each, or one row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = min(max(stop, row + 1), rows)
        yield row, stop
        row = stop


def word_table(is_word) -> np.ndarray:
    return np.array([bool(is_word(b)) for b in range(256)])


#: Words of [^\x20\x09-\x0D]+.
SPACED = word_table(lambda b: b not in BLANK)
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM = word_table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """begin, end of each word in data, and the index of the first word of each row (rows + 1 values).

    offsets are those of the rows in data; a word never spans two rows.
    """
    inside = table[data]
    n = len(data)
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        before[cuts] = False
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        after[cuts - 1] = False
        begin = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
    else:
        begin = end = np.empty(0, np.int64)
    return begin, end, np.searchsorted(begin, offsets)


def ngrams(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words: len(word_hash) - n + 1 values (none if there are fewer words)."""
    count = len(word_hash) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(count, np.uint64)
    for j in range(n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + word_hash[j : j + count]
    return mix64(h)
