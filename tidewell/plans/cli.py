"""Command line: index, reindex, search, list, flush, eval, evals, status, mcp."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.plans import api, evaluate, ingest, server
from tidewell.plans.search import Options, search, search_batch, to_json
from tidewell.session import local_session
from tidewell.sources.embed import EMBEDDERS
from tidewell.sources.store import STORES


def parser() -> argparse.ArgumentParser:
    env = os.environ.get
    p = argparse.ArgumentParser(prog="tidewell")
    p.add_argument("--db", default=env("TIDEWELL_DB", os.path.expanduser("~/.local/share/tidewell")))
    p.add_argument("--embedder", default=env("TIDEWELL_EMBEDDER", "fake"), choices=sorted(EMBEDDERS))
    p.add_argument("--store", default=env("TIDEWELL_STORE", "parquet"), choices=sorted(STORES))
    p.add_argument("--url", default=env("TIDEWELL_URL", "http://localhost:11434"))
    p.add_argument("--model", default=env("TIDEWELL_MODEL", "bge-m3"))
    p.add_argument("--evals", default=env("TIDEWELL_EVALS", os.path.expanduser("~/.config/tidewell/evals")))
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("index", "reindex"):
        c = commands.add_parser(name)
        c.add_argument("roots", nargs="+")
        c.add_argument("--force", action="store_true")
    c = commands.add_parser("search")
    c.add_argument("query", nargs="+")
    c.add_argument("--limit", type=int, default=5)
    c.add_argument("--mode", default="hybrid")
    c.add_argument("--json", action="store_true")
    c.add_argument("--exclude-path", action="append", default=[])
    c = commands.add_parser("eval")
    c.add_argument("files", nargs="*")
    c.add_argument("--limit", type=int, default=5)
    c.add_argument("--mode", default="hybrid")
    commands.add_parser("flush").add_argument("--force", action="store_true")
    commands.add_parser("list").add_argument("--json", action="store_true")
    for name in ("evals", "status", "mcp"):
        commands.add_parser(name)
    return p


def pretty_path(path: str, cwd: str | None = None, home: str | None = None) -> str:
    """Relative inside the working folder, else with ~ for the home folder."""
    cwd, home = cwd or os.getcwd(), home or os.path.expanduser("~")
    if path.startswith(cwd + "/"):
        return path[len(cwd) + 1 :]
    return "~" + path[len(home) :] if path.startswith(home + "/") else path


def paint(code: str, text: str) -> str:
    """Coloured on a terminal, unless NO_COLOR is set."""
    return f"\x1b[{code}m{text}\x1b[0m" if sys.stdout.isatty() and not os.environ.get("NO_COLOR") else text


#: Colour of each score band.
BANDS = {"green": "32", "yellow": "33", "grey": "90"}


def print_results(found) -> None:
    """One block per result: rank, score in the colour of its band, path; section; snippet."""
    rows = found.withColumns({"band": T.score_band("score"), "short": T.snippet("text", 200)}).orderBy("rank").collect()
    if not rows:
        print("nothing found")
    for r in rows:
        print(f"{r['rank']:<2d} {paint(BANDS[r['band']], format(r['score'], '.2f'))}  {paint('1', pretty_path(r['path']))}")
        if r["section"]:
            print(f"         {paint('2', r['section'])}")
        print(f"         {r['short']}\n")


def files_text(store) -> str:
    """One line per file, sorted by path, and their number."""
    stamp = F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd HH:mm")
    rows = store.paths().orderBy("path").select("path", stamp.alias("t")).collect()
    return "\n".join([f"{r['t']}  {pretty_path(r['path'])}" for r in rows] + [f"{len(rows)} files"]) if rows else "index is empty"


def main(args: list[str] | None = None, spark=None) -> int:
    o = parser().parse_args(args)
    spark = spark or local_session("*")
    store = STORES[o.store](spark, o.db)
    embedder = EMBEDDERS[o.embedder](o.url, o.model)
    if o.command in ("index", "reindex"):
        stats, failures = ingest.ingest(store, o.roots, embedder, o.force, reset=o.command == "reindex")
        for r in failures.toLocalIterator():
            print(f"{r['path']}: {r['error']}", file=sys.stderr)
        print(stats.line())
        return int(stats.failed > 0)
    if o.command == "search":
        found = search(store, " ".join(o.query), Options(o.mode, o.limit, (), tuple(o.exclude_path)), embedder)
        if o.json:
            print(to_json(found))
        else:
            print_results(found)
    elif o.command == "eval":
        files = o.files or evaluate.golden_files(o.evals)
        golden = evaluate.golden_frame(spark, {f: evaluate.load_golden(f) for f in files})
        found = search_batch(store.chunks(), golden.select("query_id", "query"), Options(o.mode, o.limit), embedder).cache()
        ranks = evaluate.first_expected_rank(found, golden).cache()
        lines = {r["set"]: r["line"] for r in evaluate.report(evaluate.metrics_by_set(ranks), o.limit, o.mode).collect()}
        cases = evaluate.case_report(found, golden).withColumn("short", T.snippet("query", 60)).orderBy("query_id").collect()
        for f in files:
            if len(files) > 1:
                print(paint("1", pretty_path(f)))
            for r in (c for c in cases if c["set"] == f):
                if r["rank"]:
                    print(f"{r['no']:<2d} {paint('32', 'hit@' + str(r['rank']))}  {r['short']}\n          {paint('2', pretty_path(r['found']))}")
                else:
                    print(f"{r['no']:<2d} {paint('31', 'miss')}   {r['short']}\n          {paint('2', 'want ' + ', '.join(r['expect']))}")
            print(f"\n{lines[f]}\n")
        if len(files) > 1:
            print("overall:", evaluate.report(evaluate.metrics_overall(ranks), o.limit).first()["line"])
    elif o.command == "evals":
        for f in evaluate.golden_files(o.evals):
            try:
                print(f"{f}: {len(evaluate.load_golden(f))} cases")
            except (evaluate.GoldenError, OSError) as e:
                print(f"{f}: {e}")
    elif o.command == "mcp":
        server.serve(store, embedder)
    elif o.command == "flush":
        if store.count() and not o.force:
            print("flush drops all chunks: repeat with --force", file=sys.stderr)
            return 1
        store.reset()
    elif o.command == "list":
        print(api.list_files(store) if o.json else files_text(store))
    else:
        print(api.index_status(store))
    return 0


if __name__ == "__main__":
    sys.exit(main())
