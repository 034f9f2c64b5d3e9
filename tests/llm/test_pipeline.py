"""The pipeline's stages over null, empty, repeated and very long rows, against brute force."""

import random
import zlib
from collections import Counter

import pytest

from tests.llm.helpers import NASTY, SCHEMA, empty, frame, words
from tests.llm.test_set_operators import shingle_set, similar
from tidewell.llm import scratch


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents and benchmark with every nasty row, and a text of several kernel slices."""
    folder = tmp_path_factory.mktemp("sf")
    rng = random.Random(12)
    rows = [*NASTY, (500, words(rng, 90_000, 5000), "en", "s1"), (501, "q " + words(rng, 30), "fr", None)]
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    items = [(1, NASTY[2][1]), (2, None), (3, ""), (4, "no such words in any document at all")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows


def test_stages_on_nasty_rows(spark, tables):
    import corpus_pipeline as c

    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in c.STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, folder))
        assert docs.columns == SCHEMA.names, name
        seen[name] = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    one, two, three, four = seen.values()
    assert not Counter(one) - Counter((i, t, s) for i, t, _, s in rows) and all(any(ch.isalpha() for ch in t) for _, t, _ in one)
    sets = [shingle_set(t) for _, t, _ in one]
    comp = list(range(len(one)))
    for i in range(len(one)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                comp = [comp[j] if x == comp[i] else x for x in comp]
    groups = {}
    for k, (i, _, _) in enumerate(one):
        groups.setdefault(comp[k], []).append((i is None, i or 0))
    assert sorted((i is None, i or 0) for i, _, _ in two) == sorted(min(g) for g in groups.values())
    assert not Counter(three) - Counter(two) and not any(NASTY[2][1] in t for _, t, _ in three)
    assert all(n <= 3 for n in Counter(four).values()) and set(four) <= set(three)

    got = c.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t, _ in four)
    shards = Counter(r["shard"] for r in got)
    assert max(shards.values()) - min(shards.get(k, 0) for k in range(8)) <= 1
    assert len({(r["shard"], r["slot"]) for r in got}) == len(got)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as c

    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0


def test_tables_go_when_read(spark):
    """Nothing but the tables that the result reads is left of an operator."""
    from tidewell.llm import ngramjoin

    def left():
        fs, path = scratch._fs(spark, scratch._tables(spark))
        return len(fs.listStatus(path))

    before = left()
    out = ngramjoin.join(frame(spark, NASTY))
    assert out.count() == len(NASTY) and left() - before <= 8


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_folder(Session())
