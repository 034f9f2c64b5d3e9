"""What an agent or a command line asks for, as JSON strings."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidewell.functions.text import rfc3339
from tidewell.plans.search import Options, search, to_json
from tidewell.sources.embed import Embedder
from tidewell.sources.store import ChunkStore

#: Fixed value: most results that an agent may ask for.
MAX_LIMIT = 50


def search_notes(store: ChunkStore, query: str, embedder: Embedder | None = None, limit: int = 5, mode: str = "hybrid", exclude: tuple[str, ...] = (), exclude_path: tuple[str, ...] = ()) -> str:
    return to_json(search(store, query, Options(mode, min(limit, MAX_LIMIT), tuple(exclude), tuple(exclude_path)), embedder))


def index_status(store: ChunkStore) -> str:
    return json.dumps({"chunks": store.count(), "embedder": store.meta().get("embedder", "")})


def list_files(store: ChunkStore) -> str:
    rows = store.paths().orderBy("path").select("path", rfc3339(F.col("mtime")).alias("modified")).toLocalIterator()
    return json.dumps([r.asDict() for r in rows], ensure_ascii=False, indent=2)
