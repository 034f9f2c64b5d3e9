"""A thin agent server: JSON-RPC lines on stdin and stdout with the tools search_notes, list_files and index_status."""

from __future__ import annotations

import json
import logging
import sys
import time
from collections.abc import Callable
from typing import TextIO

from tidewell.plans import api
from tidewell.sources.embed import Embedder
from tidewell.sources.store import ChunkStore

log = logging.getLogger(__name__)
PROTOCOL = "2024-11-05"


def tools(store: ChunkStore, embedder: Embedder | None) -> dict[str, tuple[str, dict, Callable[[dict], str]]]:
    """name -> (description, input schema, call)."""
    text, texts = {"type": "string"}, {"type": "array", "items": {"type": "string"}}
    search = {"query": text, "limit": {"type": "integer", "minimum": 1, "maximum": api.MAX_LIMIT}, "mode": text, "exclude": texts, "exclude_path": texts}
    return {
        "search_notes": ("Search the indexed files.", {"type": "object", "properties": search, "required": ["query"]}, lambda a: api.search_notes(store, a.pop("query"), embedder, **a)),
        "list_files": ("List the indexed files.", {"type": "object", "properties": {}}, lambda a: api.list_files(store)),
        "index_status": ("Chunks and embedder of the index.", {"type": "object", "properties": {}}, lambda a: api.index_status(store)),
    }


def answer(request: dict, available: dict) -> dict | None:
    """The reply to one request; None to a notification. A failing tool is an error result, not a broken server."""
    method, params = request.get("method"), request.get("params") or {}
    if "id" not in request:
        return None
    reply = {"jsonrpc": "2.0", "id": request["id"]}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "tidewell", "version": "0.1.0"}}}
    if method == "tools/list":
        return reply | {"result": {"tools": [{"name": n, "description": d, "inputSchema": s} for n, (d, s, _) in available.items()]}}
    if method == "tools/call" and params.get("name") in available:
        began = time.time()
        try:
            text, failed = available[params["name"]][2](dict(params.get("arguments") or {})), False
        except Exception as e:  # noqa: BLE001 - reported to the caller
            text, failed = f"{type(e).__name__}: {e}", True
        log.info("tool %s took %.2f s", params["name"], time.time() - began)  # no payloads in logs
        return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}
    return reply | {"error": {"code": -32601, "message": f"no method {method!r} or no such tool"}}


def serve(store: ChunkStore, embedder: Embedder | None, read: TextIO = sys.stdin, write: TextIO = sys.stdout) -> None:
    available = tools(store, embedder)
    for line in read:
        if line.strip():
            reply = answer(json.loads(line), available)
            if reply is not None:
                print(json.dumps(reply, ensure_ascii=False), file=write, flush=True)
