"""Embedders: an id that names the vector space, and texts -> vectors in order. They run inside Arrow batches on the executors."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    @property
    def id(self) -> str: ...

    def embed(self, texts: list[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class HashEmbedder:
    """Deterministic vectors without a model: FNV-1a of the text seeds a xorshift generator; unit length."""

    dim: int = 32

    @property
    def id(self) -> str:
        return f"fake/{self.dim}"

    def embed(self, texts: list[str]) -> np.ndarray:
        raw = [t.encode() for t in texts]
        size = np.array([len(r) for r in raw], np.int64)
        order = np.argsort(-size, kind="stable")
        state = np.full(len(raw), 0xCBF29CE484222325, np.uint64)  # fixed value: FNV offset basis
        if len(raw):
            flat, start = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size
            active = len(raw)
            for i in range(int(size.max(initial=0))):
                while size[order[active - 1]] <= i:
                    active -= 1
                rows = order[:active]
                state[rows] = (state[rows] ^ flat[start[rows] + i]) * np.uint64(0x100000001B3)  # fixed value: FNV prime
        out = np.empty((len(raw), self.dim), np.float32)
        for j in range(self.dim):
            for shift in (np.left_shift, 13), (np.right_shift, 7), (np.left_shift, 17):
                state ^= shift[0](state, np.uint64(shift[1]))
            out[:, j] = state.view(np.int64).astype(np.float32) / np.float32(2**63)
        norm = np.sqrt((out.astype(np.float64) ** 2).sum(1)).astype(np.float32)
        norm[norm == 0] = 1
        return out / norm[:, None]


@dataclass(frozen=True)
class HttpEmbedder:
    """POST {model, input} to <url>/api/embed. Network errors and 5xx are retried with doubling pauses; other failures are not."""

    url: str
    model: str
    batch: int = 32
    timeout: float = 300.0
    attempts: int = 3
    backoff: float = 1.0

    @property
    def id(self) -> str:
        return f"ollama/{self.model}"

    def embed(self, texts: list[str]) -> np.ndarray:
        parts = [self._batch(texts[i : i + self.batch]) for i in range(0, len(texts), self.batch)]
        return np.array([v for part in parts for v in part], np.float32)

    def _batch(self, texts: list[str]) -> list[list[float]]:
        for attempt in range(self.attempts):
            if attempt:
                time.sleep(self.backoff * 2 ** (attempt - 1))
            try:
                return self._once(texts)
            except urllib.error.HTTPError as e:
                if e.code < 500:
                    raise RuntimeError(f"embedding server: HTTP {e.code}: {e.read()[:200].decode(errors='replace')}") from e
                last: Exception = e
            except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
                last = e
        raise RuntimeError(f"after {self.attempts} attempts: {last}")

    def _once(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": self.model, "input": texts}).encode()
        request = urllib.request.Request(f"{self.url.rstrip('/')}/api/embed", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            got = json.load(answer)
        vectors = got.get("embeddings") or []
        if got.get("error"):
            raise RuntimeError(f"embedding server: {got['error']}")
        if len(vectors) != len(texts) or not all(vectors):
            raise RuntimeError(f"embedding server: {len(vectors)} vectors for {len(texts)} texts")
        return vectors


def same_model(a: str, b: str) -> bool:
    """A model name without a tag means its latest version."""
    return a.removesuffix(":latest") == b.removesuffix(":latest")


#: Factories by name, of a server's URL and a model; add your own.
EMBEDDERS: dict[str, Callable[[str, str], Embedder]] = {"fake": lambda url, model: HashEmbedder(), "ollama": HttpEmbedder}


def unit(v: np.ndarray) -> np.ndarray:
    """functions.vectors.normalize for a batch of vectors."""
    n = np.sqrt((v.astype(np.float64) ** 2).sum(1)).astype(np.float32)
    n[n == 0] = 1
    return v / n[:, None]


def embedding(embedder: Embedder, text: Column) -> Column:
    """The unit vector of a text column, as array<float>; null texts are not embedded and have none."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            some = texts.dropna()
            vectors = pd.Series(list(unit(embedder.embed(some.tolist()))) if len(some) else [], index=some.index, dtype=object)
            yield vectors.reindex(texts.index).where(texts.notna(), None)

    return run(text)
