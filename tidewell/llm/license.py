"""License scan with a positional rare-token index.

Templates (short licence passages) are indexed by word: word -> (template, position). A first pass counts in how many
documents each template word occurs, over all documents. Then every occurrence of a template word in a file votes, with the
weight of its IDF, for the (template, file position - template position) that it implies, so the postings are intersected by
relative position. Alignments with two votes are scored by the IDF-weighted share of template words at their places, which is
the sum of their votes, and count if the template's mandatory phrases stand inside the aligned stretch. The base phrases are templates too: their rarest word alone proposes, the other words verify,
so every place is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import bytekit, scratch

#: Base phrase -> label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label -> (passage, mandatory phrases).
TEMPLATES = {
    "agpl": ("gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license version 2",)),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    "cc-by-nc": ("licensed under cc by nc 4 0", ("cc by nc",)),
    "cc-by-sa": ("licensed under cc by sa 4 0", ("cc by sa",)),
    "cc0": ("the person who associated a work with this deed has dedicated the work to the public domain", ("to the public domain",)),
    "gpl-2.0": ("this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    "lgpl": ("gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    "unlicense": ("this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
}
#: Least IDF-weighted share of a template's words at their places.
COVERAGE = 0.7


def _hash_words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    begin, end, _ = bytekit.words(data, np.array([0, len(data)]), bytekit.ALNUM)
    return bytekit.stretch_hash(bytekit.prefix_hash(data), begin, end)


class TemplateIndex:
    """Postings of the words of all templates; the base phrases come first."""

    def __init__(self):
        self.labels = [*PHRASES.values(), *TEMPLATES]
        self.words = [_hash_words(t) for t in (*PHRASES, *(t for t, _ in TEMPLATES.values()))]
        self.base = len(PHRASES)
        self.needs = [[w] for w in self.words[: self.base]] + [[_hash_words(p) for p in phrases] for _, phrases in TEMPLATES.values()]
        self.vocabulary = np.unique(np.concatenate(self.words))
        self.ids = [np.searchsorted(self.vocabulary, w) for w in self.words]
        self.longest = max(map(len, self.ids))
        self.owner, self.flat = np.repeat(np.arange(len(self.ids)), [len(x) for x in self.ids]), np.concatenate(self.ids)
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[self.vocabulary >> np.uint64(48)] = True
        posting = [(v, t, p) for t, ids in enumerate(self.ids) for p, v in enumerate(ids)]
        # those of passages, sorted by word: (template, position) of word v at [lead[v], lead[v + 1])
        word, self.template, self.position = np.array(sorted(x for x in posting if x[1] >= self.base), np.int64).T
        self.lead = np.searchsorted(word, np.arange(len(self.vocabulary) + 1))

    def weight(self, idf: np.ndarray) -> np.ndarray:
        """The sum of each template's IDF."""
        return np.bincount(self.owner, idf[self.flat])

    def locate(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of template words among the words of files, and their ids."""
        at = np.flatnonzero(self.sieve[hashes >> np.uint64(48)])
        v = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
        hit = self.vocabulary[v] == hashes[at]
        return at[hit], v[hit]


def _has(words: np.ndarray, phrase: np.ndarray) -> bool:
    n = len(words) - len(phrase) + 1
    return n > 0 and bool(np.logical_and.reduce([words[j : j + n] == p for j, p in enumerate(phrase)]).any())


def scan_file(index: TemplateIndex, idf: np.ndarray, words: np.ndarray, at: np.ndarray, ids: np.ndarray, coverage: float) -> tuple[list[int], list[int], set[str], float]:
    """Starts of base phrases, their templates, labels of other templates, best score. words: hashes of the file's words."""
    starts, kinds, labels, best = [], [], set(), 0.0
    by_id = {int(v): at[ids == v] for v in np.unique(ids)}
    for t in range(index.base):
        own = index.ids[t]
        lead = int(np.argmax(idf[own]))  # the rarest word of the phrase proposes
        places = by_id.get(int(own[lead]))
        if places is None:
            continue
        begin = places - lead
        begin = begin[(begin >= 0) & (begin + len(own) <= len(words))]
        for j, w in enumerate(index.words[t]):
            begin = begin[words[begin + j] == w]
        starts += begin.tolist()
        kinds += [t] * len(begin)
    n = index.lead[ids + 1] - index.lead[ids]
    if n.any():
        post = np.repeat(index.lead[ids], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        span = len(words) + index.longest
        key = index.template[post] * span + np.repeat(at, n) - index.position[post] + index.longest
        lines, line, votes = np.unique(key, return_inverse=True, return_counts=True)
        share = np.bincount(line, np.repeat(idf[ids], n)) / index.weight(idf)[lines // span]
        share = np.where(votes >= 2, np.minimum(share, 1.0), 0.0)
        best = float(share.max())
        for k in np.flatnonzero(share >= coverage):
            t, begin = int(lines[k] // span), int(lines[k] % span) - index.longest
            stretch = words[max(0, begin) : begin + len(index.words[t])]
            if index.labels[t] not in labels and all(_has(stretch, phrase) for phrase in index.needs[t]):
                labels.add(index.labels[t])
    return starts, kinds, labels, 1.0 if starts else best


def _file_words(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of rows: the first row, the hashes of all words, and the first word of each row."""
    data, offsets = bytekit.buffers(batch.column("text"))
    for a, b in bytekit.slices(offsets):
        part = data[offsets[a] : offsets[b]]
        begin, end, first = bytekit.words(part, offsets[a : b + 1] - offsets[a], bytekit.ALNUM)
        yield a, bytekit.stretch_hash(bytekit.prefix_hash(part), begin, end), first


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """Rows, and rows that hold each template word: over all documents, summed on the executors (one row per word)."""
    size = len(TemplateIndex().vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total, rows = TemplateIndex(), np.zeros(size, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, hashes, first in _file_words(batch):
                at, ids = index.locate(hashes)
                row = np.searchsorted(first, at, "right") - 1
                total += np.bincount(np.unique(row * size + ids) % size, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, size)), pa.array(np.concatenate(([rows], total)))], ["word", "n"])

    out = np.zeros(size + 1, np.int64)
    for r in docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r["word"] + 1] = r["n"]
    return int(out[0]), out[1:]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null texts are empty: no words, no labels (empty strings), null places, score 0. score is 1 if a base phrase occurs,
    else the best weighted share of an alignment, accepted or not. Whole texts are scanned; equal rows have equal results.
    An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    scratch.small_batches(docs.sparkSession)
    rows, n = document_frequencies(docs, text_col)
    idf = np.log((rows + 1) / (n + 1)) + 1e-3
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex()
        for batch in batches:
            size = batch.num_rows
            n_words, n_base = np.zeros(size, np.int64), np.zeros(size, np.int64)
            low, high = [None] * size, [None] * size
            base_labels, labels, score = [""] * size, [""] * size, np.zeros(size)
            for a, hashes, first in _file_words(batch):
                n_words[a : a + len(first) - 1] = np.diff(first)
                at, ids = index.locate(hashes)
                row = np.searchsorted(first, at, "right") - 1
                cuts = np.flatnonzero(np.diff(row)) + 1
                for group in np.split(np.arange(len(at)), cuts) if len(at) else ():
                    r = row[group[0]]
                    starts, kinds, more, best = scan_file(index, idf, hashes[first[r] : first[r + 1]], at[group] - first[r], ids[group], coverage)
                    i = a + r
                    base = {index.labels[k] for k in kinds}
                    n_base[i], score[i] = len(starts), best
                    if starts:
                        low[i], high[i] = min(starts), max(starts)
                    base_labels[i], labels[i] = ",".join(sorted(base)), ",".join(sorted(base | more))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words), pa.array(n_base), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(base_labels), pa.array(labels), pa.array(score)],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
