"""Search halves, fusion, store, ingest, evaluation and the driver's queries."""

import http.server
import json
import os
import random
import threading

import duckdb
import numpy as np
import pytest
from tidewell.operators import postings as P
from tidewell.operators import search as S
from tidewell.plans import api, cli, evaluate, ingest
from tidewell.plans.search import Options, SearchError, search, search_batch
from tidewell.sources.embed import HashEmbedder, HttpEmbedder
from tidewell.sources.store import ChunkStore, DimensionError

CHUNKS = "path string, section string, text string, ordinal int, vector array<float>"


def chunks(spark, *rows):
    return spark.createDataFrame([(p, s, t, 0, v and [float(x) for x in v]) for p, s, t, v in rows], CHUNKS)


def asked(spark, query, vector=None):
    return spark.createDataFrame([(1, query, vector and [float(x) for x in vector])], "query_id int, query string, vector array<float>")


def test_text_half(spark):
    c = chunks(spark, ("a", "", "the boathouse has a keel", None), ("b", "", "keel of two BOAs", None), ("c", "", "…Маяк", None))
    assert [r["path"] for r in S.text_topk(c, asked(spark, "BOA"), 5).collect()] == ["b"]
    assert [r["path"] for r in S.text_topk(c, asked(spark, "маяк"), 5).collect()] == ["c"]
    assert S.text_topk(c, asked(spark, "the and"), 5).count() == 0
    both = S.text_topk(c, asked(spark, "keel boas"), 5).orderBy("rank").collect()
    assert [(r["path"], r["score"]) for r in both] == [("b", 1.0), ("a", 0.5)]
    # plural query words need their raw form in the text, or another word that has it
    assert S.text_topk(chunks(spark, ("x", "", "one boa", None)), asked(spark, "boas"), 5).count() == 0


def test_vector_half(spark):
    c = chunks(spark, ("a", "", "x", [1.0, 0, 0, 0]), ("b", "", "y", [0, 1.0, 0, 0]), ("z", "", "zero", [0.0, 0, 0, 0]))
    got = S.vector_topk(c, asked(spark, "q", [1.0, 0, 0, 0]), 5).orderBy("rank").collect()
    assert [(r["path"], round(r["score"], 6)) for r in got] == [("a", 1.0), ("z", 0.5), ("b", 0.0)]
    assert S.vector_topk(c.filter("false"), asked(spark, "q", [1.0, 0, 0, 0]), 5).count() == 0


def test_fusion(spark):
    rows = lambda *paths: spark.createDataFrame([(1, p, "", f"t{i}", 0, 0.0, i + 1) for i, p in enumerate(paths)], "query_id int, path string, section string, text string, ordinal int, score double, rank int")
    got = S.rrf_merge([rows("a", "b"), rows("b", "c")], 5).orderBy("rank").collect()
    assert [r["path"] for r in got] == ["b", "a", "c"]
    assert S.rrf_merge([rows("a"), rows("a")], 5).first()["score"] == 1.0
    assert S.rrf_merge([rows("a"), rows("b")], 5).first()["score"] == 0.5


def test_modes_and_filters(spark):
    c = chunks(spark, ("d/a.md", "S", "alpha beta", [1.0, 0]), ("d/b.md", "", "alpha", [0, 1.0]), ("e/c.md", "", "alpha gamma", [1.0, 0]))
    q = asked(spark, "alpha -beta", [1.0, 0])
    assert {r["path"] for r in search_batch(c, q, Options("text")).collect()} == {"d/b.md", "e/c.md"}
    assert [r["path"] for r in search_batch(c, q, Options("vector", 1)).collect()] == ["e/c.md"]
    assert {r["path"] for r in search_batch(c, q, Options(exclude_path=("D/",))).collect()} == {"e/c.md"}
    assert search_batch(c, q, Options(exclude=("",))).count() == 0
    with pytest.raises(SearchError):
        search_batch(c, q, Options("fuzzy"))


def test_hash_embedder():
    def slow(text, dim):
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        out = []
        for _ in range(dim):
            h ^= h << 13 & (2**64 - 1)
            h ^= h >> 7
            h ^= h << 17 & (2**64 - 1)
            out.append(np.float32(h - 2**64 if h >= 2**63 else h) / np.float32(2**63))
        n = np.float32(np.sqrt(sum(float(x) ** 2 for x in out)))
        return [x / n for x in out]

    texts = ["", "a", "привет мир", "x" * 300]
    got = HashEmbedder(8).embed(texts)
    for row, t in zip(got, texts, strict=True):
        assert row == pytest.approx(slow(t, 8), abs=1e-6)
    assert HashEmbedder(4).id == "fake/4" and HashEmbedder().embed([]).shape == (0, 32)


class Server(http.server.BaseHTTPRequestHandler):
    plan: list = []
    sizes: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.sizes.append(len(body["input"]))
        code, short = self.plan.pop(0) if self.plan else (200, 0)
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps({"embeddings": [[float(len(t)), 1.0] for t in body["input"]][short:]}).encode())

    def log_message(self, *a):
        pass


@pytest.fixture
def server():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    Server.plan, Server.sizes = [], []
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_http_embedder(server):
    e = HttpEmbedder(server, "m", batch=3, backoff=0.01)
    assert e.embed(["x" * i for i in range(7)])[:, 0].tolist() == list(range(7)) and Server.sizes == [3, 3, 1]
    Server.plan[:] = [(500, 0), (503, 0)]
    assert e.embed(["a"]).tolist() == [[1.0, 1.0]]
    for plan in ([(404, 0)], [(200, 1)], [(500, 0)] * 3):
        Server.plan[:] = plan
        with pytest.raises(RuntimeError):
            e.embed(["a"])
        assert not Server.plan


def stored(spark, path, dim=2, text="t", n=1):
    return spark.createDataFrame([(path, "", f"{text}{i}", [1.0] * dim, 7, i) for i in range(n)], "path string, section string, text string, vector array<float>, mtime long, ordinal int")


def test_store(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "db"), buckets=4)
    assert (store.count(), store.meta(), store.paths().count(), store.dimension()) == (0, {}, 0, None)
    for n in (3, 3, 2):
        store.upsert(stored(spark, "a'b.md", n=n))
    store.upsert(stored(spark, "c.md"))
    assert store.count() == 3 and store.chunks().filter("path = \"a'b.md\"").count() == 2
    assert store.chunks().orderBy("id").first()["id"] == "a'b.md#0"
    pinned = ChunkStore(spark, str(tmp_path / "db"), buckets=4, fresh=False)
    assert pinned.count() == 3
    store.delete(spark.createDataFrame([("a'b.md",)], "path string"))
    assert (store.count(), pinned.count()) == (1, 3)
    with pytest.raises(DimensionError):
        store.upsert(stored(spark, "d.md", dim=3))
    store.set_meta({"embedder": "x", "k": "v"})
    store.set_meta({"embedder": "y"})
    assert store.meta() == {"embedder": "y"}
    store.reset()
    store.upsert(stored(spark, "d.md", dim=3))
    assert (store.count(), store.meta(), store.dimension()) == (1, {}, 3)


def test_ingest_and_cli(spark, tmp_path, capsys):
    root = tmp_path / "docs"
    root.mkdir()
    (root / "sea.md").write_text("# Sea\ncurrents and sandbanks")
    (root / "bad.docx").write_text("broken")
    (root / "t.csv").write_text("port,depth\nLindau,4\n")
    db = str(tmp_path / "db")
    store = ChunkStore(spark, db)
    stats, failures = ingest.ingest(store, [str(root)], HashEmbedder())
    assert (stats.total, stats.failed, stats.chunks) == (3, 1, 2) and failures.first()["path"].endswith("bad.docx")
    stats, _ = ingest.ingest(store, [str(root)], HashEmbedder())
    assert (stats.total, stats.skipped, stats.failed) == (1, 2, 1)  # the broken file is tried again
    (root / "t.csv").unlink()
    (root / "bad.docx").unlink()
    stats, _ = ingest.ingest(store, [str(root)], HashEmbedder())
    assert (stats.removed, stats.chunks) == (1, 1)
    with pytest.raises(ingest.IngestError):
        ingest.ingest(store, [str(root)], HashEmbedder(8))
    with pytest.raises(SearchError):
        search(store, "-only", Options(), HashEmbedder())
    found = json.loads(api.search_notes(store, "sandbanks", HashEmbedder()))
    assert found[0]["path"].endswith("sea.md") and found[0]["score"] == 1.0 and found[0]["section"] == "Sea"
    assert json.loads(api.index_status(store)) == {"chunks": 1, "embedder": "fake/32"}
    assert len(json.loads(api.list_files(store))) == 1
    golden = tmp_path / "g.yaml"
    golden.write_text("- query: sandbanks\n  expect: [sea.md]\n- query: nothing here\n  expect: [x.md]\n")
    assert cli.main(["--db", db, "eval", str(golden), "--mode", "text"], spark) == 0
    assert "recall@5 0.50 (1/2)   MRR 0.500   mode=text" in capsys.readouterr().out
    assert cli.main(["--db", db, "search", "currents", "--json"], spark) == 0
    assert cli.main(["--db", db, "flush", "--force"], spark) == 0 and store.count() == 0


class CountingEmbedder:
    """Notes every text that it is asked for in a folder, as it runs in worker processes."""

    id = "counting/2"

    def __init__(self, folder):
        self.folder = folder

    def embed(self, texts):
        import uuid

        for t in texts:
            with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(t)
        return np.ones((len(texts), 2), np.float32)


def test_each_text_is_embedded_once(spark, tmp_path):
    for name in ("docs", "seen"):
        (tmp_path / name).mkdir()
    for i in range(10):
        (tmp_path / "docs" / f"{i}.md").write_text(f"harbour {i}")
    store = ChunkStore(spark, str(tmp_path / "db"))
    stats, _ = ingest.ingest(store, [str(tmp_path / "docs")], CountingEmbedder(str(tmp_path / "seen")))
    assert (stats.written, stats.chunks, store.count()) == (10, 10, 10)
    assert len(list((tmp_path / "seen").iterdir())) == 10
    assert stats.line() == "10 chunks indexed, 10 in the database"


def test_unchanged_text_is_not_embedded_again(spark, tmp_path):
    """A changed file sends its new text only; a forced run over the same files sends nothing."""
    for name in ("docs", "seen"):
        (tmp_path / name).mkdir()
    seen = lambda: sorted(f.read_text() for f in (tmp_path / "seen").iterdir())
    note = tmp_path / "docs" / "log.md"
    note.write_text("# Monday\ncalm\n# Tuesday\nstorm")
    store, embedder = ChunkStore(spark, str(tmp_path / "db")), CountingEmbedder(str(tmp_path / "seen"))
    ingest.ingest(store, [str(tmp_path / "docs")], embedder)
    first = seen()
    assert len(first) == 2
    ingest.ingest(store, [str(tmp_path / "docs")], embedder, force=True)
    assert seen() == first
    note.write_text("# Sunday\nfog\n# Monday\ncalm\n# Tuesday\nstorm")
    os.utime(note, (1, 1))
    ingest.ingest(store, [str(tmp_path / "docs")], embedder)
    assert len(seen()) == 3 and any("fog" in t for t in seen())
    rows = store.chunks().orderBy("ordinal").collect()
    assert [(r["section"], r["ordinal"], len(r["vector"]), r["mtime"]) for r in rows] == [("Sunday", 0, 2, 1), ("Monday", 1, 2, 1), ("Tuesday", 2, 2, 1)]


class EditingEmbedder(CountingEmbedder):
    """Changes a file while the texts are embedded: the given number of times."""

    def __init__(self, folder, path, times):
        super().__init__(folder)
        self.path, self.times = path, times

    def embed(self, texts):
        n = len(os.listdir(self.folder))
        if texts and n < self.times:
            with open(self.path, "w") as f:
                f.write(f"edit {n + 1}")
            os.utime(self.path, (1000 + n, 1000 + n))
        return super().embed(texts)


@pytest.mark.parametrize(("times", "known"), [(1, True), (99, False)])
def test_files_edited_during_a_run(spark, tmp_path, times, known):
    """A file that is edited between read and commit is read again; one that never rests is taken up by the next run."""
    for name in ("docs", "seen"):
        (tmp_path / name).mkdir()
    note = tmp_path / "docs" / "a.md"
    note.write_text("first")
    store = ChunkStore(spark, str(tmp_path / "db"))
    ingest.ingest(store, [str(tmp_path / "docs")], EditingEmbedder(str(tmp_path / "seen"), str(note), times))
    row = store.chunks().first()
    assert store.count() == 1 and row["text"] == (f"edit {times}" if known else f"edit {ingest.ROUNDS}")
    assert (row["mtime"] == int(note.stat().st_mtime)) == known
    stats, _ = ingest.ingest(store, [str(tmp_path / "docs")], CountingEmbedder(str(tmp_path / "seen")))
    assert stats.total == (0 if known else 1) and store.chunks().first()["text"] == note.read_text()


def test_a_query_does_not_depend_on_its_neighbours(spark):
    rng = np.random.default_rng(3)
    unit = lambda v: (v / np.linalg.norm(v)).tolist()
    c = chunks(spark, *[(f"p{i:03}", "", " ".join(rng.choice(["alpha", "beta", "gamma", "zebra", "delta"], 3)), unit(rng.normal(size=4))) for i in range(200)])
    rows = [(1, "alpha beta", unit(rng.normal(size=4))), (2, "gamma delta -zebra", unit(rng.normal(size=4))), (3, "beta", unit(rng.normal(size=4)))]
    frame = lambda some: spark.createDataFrame(some, "query_id int, query string, vector array<float>")
    for mode in ("hybrid", "text", "vector"):
        out = lambda q: sorted(map(tuple, search_batch(c, q, Options(mode, 5)).collect()))  # noqa: B023, E731
        assert out(frame(rows)) == sorted(r for one in rows for r in out(frame([one]))), mode


def test_text_half_finds_documents_without_vectors(spark):
    c = chunks(spark, ("a", "", "lighthouse keeper", None), ("b", "", "harbour", [1.0, 0]))
    assert {r["path"] for r in search_batch(c, asked(spark, "lighthouse", [1.0, 0])).collect()} == {"a", "b"}


def test_ties_and_blocks_of_vectors(spark, monkeypatch):
    """Many equal vectors: the first by path, whatever the size of the blocks."""
    c = chunks(spark, *[(f"p{(i * 37) % 100:03}", "", "t", [1.0, 0]) for i in range(100)])
    for numbers in (1 << 22, 14):
        monkeypatch.setattr(S, "BLOCK_NUMBERS", numbers)
        got = S.vector_hits(c, asked(spark, "q", [1.0, 0]), 7).orderBy("rank").collect()
        assert [r["path"] for r in got] == [f"p{i:03}" for i in range(7)]


def test_long_queries_count_every_word(spark):
    words = [f"w{i}x" for i in range(150)]
    c = chunks(spark, ("a", "", " ".join(words[:130]), None), ("b", "", " ".join(words[60:70] * 3), None))
    got = S.text_topk(c, asked(spark, " ".join(words)), 5).orderBy("rank").collect()
    assert [(r["path"], round(r["score"], 9)) for r in got] == [("a", round(130 / 150, 9)), ("b", round(10 / 150, 9))]


def test_terminal_output(spark, tmp_path, capsys):
    db = str(tmp_path / "db")
    assert cli.main(["--db", db, "list"], spark) == 0 and capsys.readouterr().out == "index is empty\n"
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("# Harbour\n" + "pilot boat " * 30)
    assert cli.main(["--db", db, "index", str(tmp_path / "docs")], spark) == 0
    assert capsys.readouterr().out == "1 chunks indexed, 1 in the database\n"
    assert cli.main(["--db", db, "list"], spark) == 0
    assert capsys.readouterr().out.splitlines()[1] == "1 files"
    assert cli.main(["--db", db, "search", "pilot", "--mode", "text"], spark) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[0].startswith("1  1.00  ") and lines[0].endswith("a.md") and lines[1].strip() == "Harbour" and lines[2].endswith("…")
    assert cli.main(["--db", db, "search", "nowhere", "--mode", "text"], spark) == 0 and capsys.readouterr().out == "nothing found\n"
    for name, expect in (("g", "a.md"), ("h", "b.md")):
        (tmp_path / f"{name}.yaml").write_text(f"- query: pilot\n  expect: [{expect}]\n")
    assert cli.main(["--db", db, "eval", str(tmp_path / "g.yaml"), str(tmp_path / "h.yaml"), "--mode", "text"], spark) == 0
    out = capsys.readouterr().out
    assert "1  hit@1  pilot" in out and "1  miss   pilot" in out and "want b.md" in out
    assert out.rstrip().endswith("overall: recall@5 0.50 (1/2)   MRR 0.500")


def test_server(spark, tmp_path):
    import io

    from tidewell.plans.server import serve
    from tidewell.sources.embed import same_model

    store = ChunkStore(spark, str(tmp_path / "db"))
    calls = [
        {"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "index_status"}},
        {"id": 4, "method": "tools/call", "params": {"name": "search_notes", "arguments": {"query": "x"}}}, {"id": 5, "method": "none"},
    ]
    out = io.StringIO()
    serve(store, HashEmbedder(), io.StringIO("\n".join(map(json.dumps, calls))), out)
    got = [json.loads(line) for line in out.getvalue().splitlines()]
    assert [r["id"] for r in got] == [1, 2, 3, 4, 5] and len(got[1]["result"]["tools"]) == 3
    assert json.loads(got[2]["result"]["content"][0]["text"])["chunks"] == 0
    assert got[3]["result"]["isError"] and "error" in got[4]
    assert same_model("m", "m:latest") and not same_model("m:1", "m")
    assert cli.pretty_path("/w/a.md", "/w", "/h") == "a.md" and cli.pretty_path("/h/a.md", "/w", "/h") == "~/a.md" and cli.pretty_path("/x", "/w", "/h") == "/x"


def test_golden_files(tmp_path):
    for text in ("", "a: 1", "- query: x", "- expect: [y]"):
        (tmp_path / "a.yml").write_text(text)
        with pytest.raises(evaluate.GoldenError):
            evaluate.load_golden(str(tmp_path / "a.yml"))
    assert evaluate.golden_files(str(tmp_path)) == [str(tmp_path / "a.yml")]
    with pytest.raises(evaluate.GoldenError):
        evaluate.golden_files(str(tmp_path / "none"))


def test_rank_is_by_suffix(spark):
    golden = evaluate.golden_frame(spark, {"s": [("q", ["eval.md"])]})
    r = spark.createDataFrame([(0, "eval.en.md", 1), (0, "x/eval.md", 2)], "query_id int, path string, rank int")
    assert evaluate.first_expected_rank(r, golden).first()["rank"] == 2
    assert evaluate.first_expected_rank(r.filter("rank = 1"), golden).first()["rank"] == 0


def test_landing_stream(spark, tmp_path):
    from tidewell.streaming.landing import ingest_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# T\nhello")
    store = ChunkStore(spark, str(tmp_path / "db"))
    for _ in range(2):
        query = ingest_stream(store, str(tmp_path / "in"), HashEmbedder(), str(tmp_path / "cp"))
        query.awaitTermination(60)
    assert [r["text"] for r in store.chunks().collect()] == ["hello"]


def test_landing_stream_lists_failures_and_drops_empty_files(spark, tmp_path):
    import os

    from tidewell.streaming.landing import dead_letters, ingest_stream

    (tmp_path / "in").mkdir()
    store = ChunkStore(spark, str(tmp_path / "db"))
    assert dead_letters(store).count() == 0
    for text, when in (("# T\nhello", 1_700_000_000), ("\n", 1_700_000_100)):
        (tmp_path / "in" / "a.md").write_text(text)
        os.utime(tmp_path / "in" / "a.md", (when, when))
        (tmp_path / "in" / "x.docx").write_text("broken")
        ingest_stream(store, str(tmp_path / "in"), HashEmbedder(), str(tmp_path / f"cp{when}")).awaitTermination(60)
        assert [r["text"] for r in store.chunks().collect()] == (["hello"] if text.strip() else [])
        assert [r["path"].rsplit("/", 1)[1] for r in dead_letters(store).collect()] == ["x.docx"]


def test_core_queries_match_their_sql(spark, sf_dir):
    import os

    from tidewell.plans import oracles, queries

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    seen = queries.queries()
    assert set(oracles.ORACLES) == set(seen)
    for name in ("chunk_pack_paragraphs", "text_search", "hybrid_search", "eval_overall", "vanished_files", "query_words"):
        a, b = seen[name](spark, sf_dir), con.execute(oracles.ORACLES[name])
        names = [d[0] for d in b.description]
        assert sorted(names) == sorted(a.columns)
        rows = lambda r: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in x) for x in r)
        assert rows(a.select(*names).collect()) == rows(b.fetchall()), name


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_plans_prune_and_broadcast(spark, sf_dir):
    """Only needed columns are read, and the top-k limits before the shuffle."""
    from tidewell.plans import queries

    df = queries.queries()["paths_latest"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1]
    top = S.vector_topk(queries._vectors(spark, sf_dir), queries._queries(spark, sf_dir), 3)
    found = queries.queries()["text_search"](spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
    assert all("text#" not in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def _found(df):
    return sorted((r["query_id"], r["rank"], r["path"], r["ordinal"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("step", [50, 4096])
def test_texts_are_scored_where_they_are_read(spark, monkeypatch, step):
    """Without a table of hits: neither what a common word meets nor what rests on plurals is written; the rows are those of the index."""
    rng = random.Random(7)
    pool = ["boa", "boas", "keel", "keels", "gras", "grass", "as", "ass", "a_b", "axb", "Tide", "tides", "é", "és", "the"]
    texts = [(f"p{i % 97:02d}", " ".join(rng.choices(pool, k=rng.randint(0, 5))) + rng.choice(["", "catsuit", "a\nb"]), i // 97) for i in range(300)] + [("none", None, 0)]
    c = spark.createDataFrame(texts, "path string, text string, ordinal int").repartition(5)
    words = [*pool, "cat", "cats", "a_", "boa's"]
    q = spark.createDataFrame([(f"q{i}", " ".join(rng.choices(words, k=rng.randint(1, 4)))) for i in range(60)] + [("s", "boas"), ("t", "keels tides")], "query_id string, query string")
    monkeypatch.setattr(S, "FORM_BLOCK", 0)
    want = {k: _found(S.text_hits(c, q, k)) for k in (1, 4)}
    monkeypatch.setattr(S, "FORM_BLOCK", 1 << 16)
    monkeypatch.setattr(S, "TEXT_ROWS", step)
    postings = P.postings(c)
    for k in (1, 4):
        assert _found(S.text_hits(c, q, k, postings)) == want[k]
    monkeypatch.setattr(S, "stored", None)
    for k in (1, 4):
        assert want[k] and _found(S.text_hits(c, q, k)) == want[k]


def test_vectors_beside_the_texts(spark):
    c = spark.createDataFrame([(f"p{i}", "", f"tide {i}", 0, [float(i % 7), 1.0]) for i in range(40)], "path string, section string, text string, ordinal int, vector array<float>")
    q = asked(spark, "tide 3", [1.0, 0.5])
    for o in (Options(), Options("vector"), Options(exclude=("7",))):
        got = search_batch(c.drop("vector"), q, o, vectors=c.select("path", "ordinal", "vector"))
        assert _found(got) == _found(search_batch(c, q, o))


def test_pairs_below_the_floor_are_not_listed():
    """A chunk and a query are a pair only if they meet at the score of the k-th row held; the words they share are counted, not listed."""
    import pyarrow as pa

    raws = [["boa", "boas", "keel"], ["keels", "gras"], ["tide"], ["boas"]]
    single = {"boas": "boa", "keels": "keel"}
    asked_ = []
    for q, words in enumerate(raws):
        for no, raw in enumerate(words):
            w = single.get(raw, raw)
            asked_ += [{"query_id": f"q{q}", "of": len(words), "no": no, "raw": raw, "word": w, "form": f, "sure": raw in (w, f), "plural": raw != w} for f in (w, w + "s")]
    texts = [["boa", "boas"], ["keel", "tides", "x"], [], ["boa"], ["gras", "keel", "boas"]]
    met = {}
    for i, words in enumerate(texts):
        for q in range(len(raws)):
            rows = [r for r in asked_ if r["query_id"] == f"q{q}" and r["form"] in words]
            if rows:
                met[i, q] = (len({r["no"] for r in rows}) / len(raws[q]), any(r["sure"] for r in rows))
    terms = S._Terms(asked_)
    words = pa.array(texts, pa.list_(pa.string()))
    for floor in ([0.0] * 4, [0.5, 0.6, 1.0, 1.0], [0.9, 0.9, 0.0, 0.0]):
        row, q, score, sure = terms.scores(words, np.array(floor))
        assert {(i, j): (s, t) for i, j, s, t in zip(row.tolist(), q.tolist(), score.tolist(), sure.tolist(), strict=True)} == {k: v for k, v in met.items() if v[0] >= floor[k[1]]}
    assert not all(t for _, t in met.values())
