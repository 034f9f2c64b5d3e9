"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score.

Kinds: email, ip (parts at most 255), card (14 to 19 digits, Luhn), phone (10 to 15 digits) and, added by the checksum
step, iban (two letters, two digits, 11 to 30 letters or digits, mod-97; in one run or printed in groups of four). Every pattern takes time linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import bytekit, scratch

KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]
#: Words near a span that raise its score, per kind.
CONTEXT = {
    "email": ("email", "mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "payment", "mastercard"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
}
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A digit run is tried at its first digit only: if that fails, so do its other digits.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")
_IBAN_GROUPS = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def grouped_ibans(text: str) -> Iterator[tuple[int, int]]:
    """IBANs in groups of four, the last one of one to four, with a space between. Capitals that follow look like further groups, so
    from each start the longest part with the right remainder counts (nine groups at most, so at most six are tried)."""
    m = _IBAN_GROUPS.search(text)
    while m:
        groups, end = m[0].split(" "), None
        for n in range(len(groups), 3, -1):
            whole = "".join(groups[:n])
            if 15 <= len(whole) <= 34 and mod97(whole):
                end = m.start() + len(whole) + n - 1
                yield m.start(), end
                break
        m = _IBAN_GROUPS.search(text, end or m.start() + 1)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches: each @ takes the local characters before it and the longest domain after it."""
    done = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL_SET:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
            done = domain.end()
        else:
            done = at + 1  # the next local part begins after this @
        at = text.find("@", max(at + 1, done))


def spans(text: str) -> list[tuple[int, int, str]]:
    """All confirmed spans (start, kind's place in KINDS, end, kind is KINDS[place]), by start and then kind."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    for m in _IBAN.finditer(text):
        if mod97(m[0]):
            found.append((m.start(), 4, m.end()))
    found += [(a, 4, b) for a, b in grouped_ibans(text)]
    return sorted(found)


def score(text: str, begin: int, end: int, kind: str, window: int = 60) -> float:
    """Prior of the kind; half of what is missing to 1 is added if a context word stands within the window."""
    near = re.findall(r"[a-z]+", (text[max(0, begin - window) : begin] + " " + text[end : end + window]).lower())
    prior = PRIOR[kind]
    return prior + (1 - prior) / 2 if any(w in CONTEXT[kind] for w in near) else prior


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_iban, scores.

    spans and scores are comma-joined in the same order; offsets are code points, ends exclusive. Null texts are empty; a
    text without spans has the hash of the empty text and empty lists. Repeated rows have equal results, an empty table gives an
    empty result, and other columns are ignored, whatever their names. Whole texts are scanned. Only texts with a digit or
    an @ are decoded: every pattern needs one of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            data, offsets = bytekit.buffers(batch.column("text"))
            rows = len(offsets) - 1
            counts = np.zeros((rows, len(KINDS)), np.int64)
            sums, listed, scored = [empty] * rows, [""] * rows, [""] * rows
            sign = np.flatnonzero(((data >= 48) & (data <= 57)) | (data == 64))
            per_row = np.diff(np.searchsorted(sign, offsets))
            for i in np.flatnonzero(per_row):
                text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
                found = spans(text)
                if not found:
                    continue
                for _, k, _ in found:
                    counts[i, k] += 1
                sums[i] = hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found if k < 4).encode()).hexdigest()
                listed[i] = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)
                scored[i] = ",".join(f"{score(text, a, b, KINDS[k]):.2f}" for a, k, b in found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(4)), pa.array(sums), pa.array(listed), pa.array(counts[:, 4]), pa.array(scored)],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_iban", "scores"],
            )

    scratch.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_iban long, scores string")
