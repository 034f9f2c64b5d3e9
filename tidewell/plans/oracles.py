"""SQL for DuckDB that must return the rows of plans.queries."""

from __future__ import annotations

from tidewell.functions.text import STOPWORDS

_STOP = "[" + ",".join("'" + w.replace("'", "''") + "'" for w in sorted(STOPWORDS)) + "]"
_S = r"[\t\n\x0B\f\r ]"

_FILES = """f AS (SELECT doc_id, 'docs/' || source || '/' || lang || '/' || doc_id || '.md' AS path, doc_id + 1700000000 AS mtime,
  source, lang, text FROM documents)"""
_CHUNKS = _FILES + ", c AS (SELECT path, lang AS section, text, 0 AS ordinal, mtime, doc_id FROM f)"
_WORDS = rf"""w AS (SELECT item_id AS query_id, text AS query,
  list_filter(list_transform(regexp_split_to_array(lower(text), '{_S}+'),
    lambda x: trim(replace(x, '%', ''), '.,!?:;()[]{{}}«»"''`')), lambda x: x <> '' AND NOT list_contains({_STOP}, x)) AS raw
  FROM benchmark),
q AS (SELECT query_id, query, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS words FROM w)"""
_TEXT = rf"""{_CHUNKS}, {_WORDS},
tok AS (SELECT DISTINCT path, ordinal, CASE WHEN strlen(t) >= 3 AND t LIKE '%s' THEN left(t, length(t) - 1) ELSE t END AS word
  FROM (SELECT path, ordinal, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{Nd}}_]+')) AS t FROM c) WHERE t <> ''),
qt AS (SELECT query_id, len(words) AS of, unnest(words) AS raw FROM q WHERE len(words) > 0),
qs AS (SELECT query_id, of, CASE WHEN strlen(raw) >= 3 AND raw LIKE '%s' THEN left(raw, length(raw) - 1) ELSE raw END AS word FROM qt),
hit AS (SELECT query_id, path, ordinal, count(*) / any_value(of) AS score FROM tok JOIN qs USING (word) GROUP BY ALL),
ok AS (SELECT hit.*, c.section, c.text FROM hit JOIN c USING (path, ordinal) JOIN q USING (query_id)
  WHERE len(list_filter(q.words, lambda x: contains(lower(c.text), x))) > 0),
txt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, ordinal) AS rank FROM ok)"""
_VEC = """qv AS (SELECT (vec_id - 3) // 7 AS query_id, embedding FROM embeddings WHERE vec_id % 7 = 3
    AND (vec_id - 3) // 7 IN (SELECT item_id FROM benchmark)),
dist AS (SELECT qv.query_id, c.path, c.ordinal, c.section, c.text,
    round(list_sum(list_transform(list_zip(e.embedding, qv.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)), 12) AS d
  FROM c JOIN embeddings e ON e.vec_id = c.doc_id CROSS JOIN qv),
vec AS (SELECT *, 1 - d / 2 AS score, row_number() OVER (PARTITION BY query_id ORDER BY d, path, ordinal) AS rank FROM dist)"""


def _hybrid(fetch: str, where: str = "true") -> str:
    """fetch and where may use query_id; the documents of the text half need no vector."""
    return f"""WITH {_TEXT}, {_VEC},
v2 AS (SELECT query_id, path, ordinal, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM vec WHERE rank <= {fetch} AND {where}),
t2 AS (SELECT query_id, path, ordinal, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM txt WHERE rank <= {fetch} AND {where}),
u AS (SELECT query_id, path, ordinal, sum(1 / (60 + rank)) / (2.0::DOUBLE / 61) AS score
  FROM (SELECT * FROM v2 UNION ALL SELECT * FROM t2) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, path, ordinal) AS rank FROM u)
SELECT query_id, path, round(score, 6) AS score, rank FROM r WHERE rank <= 5"""


_PACK = """turns AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations)"""
_BLANK = "chr(32) || chr(9) || chr(10) || chr(13)"


def _pieces(rows: str, order: str) -> str:
    """SQL for the chunks of one-paragraph bodies: rows has path, section, body and the order column. A body above 1500 bytes is cut
    after every 1500 characters."""
    return f"""b AS ({rows}),
      cut AS (SELECT path, section, {order} AS o, body, unnest(range(CASE WHEN strlen(body) > 1500 THEN ceil(length(body) / 1500)::BIGINT ELSE 1 END)) AS i FROM b WHERE body <> ''),
      c AS (SELECT path, section, o, i, CASE WHEN strlen(body) > 1500 THEN trim(substr(body, i * 1500 + 1, 1500), {_BLANK}) ELSE body END AS text FROM cut)
      SELECT path, section, (row_number() OVER (PARTITION BY path ORDER BY o, i) - 1)::INT AS ordinal, strlen(text)::BIGINT AS bytes, md5(text) AS md5 FROM c"""


_NUMBERS = """round(v[1]::DOUBLE, 4) + 0.0::DOUBLE AS "first", round(list_sum(list_transform(v, lambda x, i: x::DOUBLE * i)), 3) + 0.0::DOUBLE AS weight, len(v)::INT AS dim,
  round(sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))), 3) AS norm"""
_RANKS = f"""WITH {_TEXT},
g AS (SELECT query_id, CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS "set",
  ['/' || query_id || '.md', '0.md', '5.md'] AS expect FROM q),
ranks AS (SELECT g.query_id, g."set", coalesce(min(txt.rank), 0)::INT AS rank
  FROM g LEFT JOIN txt ON txt.query_id = g.query_id AND txt.rank <= 10 AND len(list_filter(g.expect, lambda e: suffix(txt.path, e))) > 0
  GROUP BY ALL)"""
_METRICS = """count(*) AS cases, sum(CASE WHEN rank > 0 THEN 1 ELSE 0 END)::BIGINT AS hits, round(avg(CASE WHEN rank > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall,
  round(avg(CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr"""
_KNOWN = f"""{_FILES}, old AS (SELECT 'docs/src1/old/' || n_nationkey || '.md' AS path, 1 AS mtime FROM nation),
k AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN mtime - 1 ELSE mtime END AS mtime FROM f WHERE doc_id % 7 <> 0
  UNION ALL SELECT * FROM old UNION ALL SELECT replace(path, 'src1', 'src10'), mtime FROM old)"""
_LISTS = """n AS (SELECT n_regionkey AS query_id, 'n' || n_nationkey AS path,
  row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS up,
  row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) AS down FROM nation)"""

ORACLES = {
    "discover_dispatch": f"""WITH {_FILES}, p AS (SELECT CASE WHEN doc_id % 3 = 0 THEN regexp_replace(path, 'md$', 'CSV') WHEN doc_id % 3 = 1 THEN regexp_replace(path, 'md$', 'txt') ELSE path END AS path FROM f)
        SELECT path, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext, CASE WHEN path LIKE '%.CSV' THEN 'csv' WHEN path LIKE '%.md' THEN 'markdown' END AS format FROM p""",
    "chunk_hard_split": f"WITH {_FILES}, " + _pieces(f"SELECT path, '' AS section, trim(text, {_BLANK}) AS body, 0 AS k FROM f", "k"),
    "chunk_pdf_pages": f"WITH {_PACK}, " + _pieces(f"SELECT 'talk/' || conv_id || '.md' AS path, 'p. ' || i AS section, trim(text, {_BLANK}) AS body, i AS k FROM turns", "k"),
    "chunk_markdown_sections": f"WITH {_PACK}, " + _pieces(f"SELECT 'talk/' || conv_id || '.md' AS path, role || ' > ' || turn AS section, trim(text, {_BLANK}) AS body, i AS k FROM turns", "k"),
    "chunk_markdown_fences": f"WITH {_PACK}, " + _pieces("SELECT 'talk/' || conv_id || '.md' AS path, 'talk > turns > ' || role AS section, '```' || chr(10) || '# ' || text || chr(10) || '## no' || chr(10) || '~~~' AS body, i AS k FROM turns", "k"),
    "chunk_docx_files": f"WITH {_PACK}, " + _pieces(f"SELECT 'talk/' || conv_id || '.docx' AS path, role AS section, trim(text, {_BLANK}) AS body, i AS k FROM turns", "k"),
    "chunk_xml_subtrees": f"""WITH {_PACK}, t AS (SELECT 'talk/' || conv_id || '.xml' AS path, i, turn, role, trim(text, {_BLANK}) AS text,
        'no: ' || turn || chr(10) || 'who: ' || role || chr(10) || 'said: ' || trim(text, {_BLANK}) AS whole FROM turns),
      parts AS (SELECT path, 0 AS k, 0 AS sub, 'talk' AS section, 'at: x' AS body FROM t GROUP BY path
        UNION ALL SELECT path, i, 0, 'talk > turn', whole FROM t WHERE length(whole) <= 1500
        UNION ALL SELECT path, i, 0, 'talk > turn', 'no: ' || turn FROM t WHERE length(whole) > 1500
        UNION ALL SELECT path, i, 1, 'talk > turn > who', role FROM t WHERE length(whole) > 1500
        UNION ALL SELECT path, i, 2, 'talk > turn > said', text FROM t WHERE length(whole) > 1500
        UNION ALL SELECT path, max(i) + 1, 0, 'talk > pad > p', repeat('y', 1600) FROM t GROUP BY path),
      """ + _pieces("SELECT path, section, body, k * 4 + sub AS k FROM parts", "k"),
    "chunk_pack_paragraphs": f"""WITH RECURSIVE {_PACK},
        step AS (SELECT conv_id, i, CASE WHEN strlen(text) > 1500 THEN '' ELSE text END AS cur, CASE WHEN strlen(text) > 1500 THEN text END AS big, NULL::VARCHAR AS done FROM turns WHERE i = 1
          UNION ALL
          SELECT t.conv_id, t.i,
            CASE WHEN strlen(t.text) > 1500 THEN '' WHEN s.cur = '' THEN t.text WHEN strlen(s.cur) + 2 + strlen(t.text) > 1500 THEN t.text ELSE s.cur || chr(10) || chr(10) || t.text END,
            CASE WHEN strlen(t.text) > 1500 THEN t.text END,
            CASE WHEN s.cur <> '' AND (strlen(t.text) > 1500 OR strlen(s.cur) + 2 + strlen(t.text) > 1500) THEN s.cur END
          FROM step s JOIN turns t ON t.conv_id = s.conv_id AND t.i = s.i + 1),
        pieces AS (SELECT conv_id, i, 0 AS k, done AS text FROM step WHERE done IS NOT NULL
          UNION ALL SELECT conv_id, i, 1 + j, trim(substr(big, j * 1500 + 1, 1500), ' ' || chr(10)) FROM (SELECT conv_id, i, big, unnest(range(ceil(length(big) / 1500)::BIGINT)) AS j FROM step WHERE big IS NOT NULL)
          UNION ALL SELECT s.conv_id, s.i + 1, 0, s.cur FROM step s WHERE s.cur <> '' AND s.i = (SELECT max(i) FROM turns t WHERE t.conv_id = s.conv_id))
        SELECT 'talk/' || conv_id || '.md' AS path, row_number() OVER (PARTITION BY conv_id ORDER BY i, k) - 1 AS ordinal, strlen(text) AS bytes, md5(text) AS md5 FROM pieces""",
    "chunk_csv_rows": "SELECT c_custkey::VARCHAR AS path, 'c_custkey: ' || c_custkey || chr(10) || 'c_name: ' || c_name || chr(10) || 'col 3: ' || c_nationkey AS \"row\" FROM customer",
    "chunk_csv_files": """WITH RECURSIVE r AS (SELECT n_nationkey AS k, row_number() OVER (ORDER BY n_nationkey) + 1 AS line, length('key: ' || n_nationkey || chr(10) || 'name: ' || n_name || chr(10) || 'region: ' || n_regionkey) AS n FROM nation),
        s AS (SELECT line, 2 AS first, n + 2 AS used, n AS size FROM r WHERE line = 2
          UNION ALL SELECT r.line, CASE WHEN s.used + r.n + 2 > 1500 THEN r.line ELSE s.first END, CASE WHEN s.used + r.n + 2 > 1500 THEN r.n + 2 ELSE s.used + r.n + 2 END,
            CASE WHEN s.used + r.n + 2 > 1500 THEN r.n ELSE s.size + 2 + r.n END FROM s JOIN r ON r.line = s.line + 1)
        SELECT 'nation.csv' AS path, 'rows ' || first || '-' || max(line) AS section, max(size)::BIGINT AS characters, (row_number() OVER (ORDER BY first) - 1)::INT AS ordinal FROM s GROUP BY first""",
    # each row's next chunk, if one begins with it, by binary search in the running sizes; then the chain of chunks from the first row
    "chunk_csv_splits": """WITH RECURSIVE r AS (
          SELECT row_number() OVER (ORDER BY o_orderkey) + 1 AS no, 'order: ' || o_orderkey || chr(10) || 'customer: ' || o_custkey || chr(10) || 'status: ' || o_orderstatus
            || CASE WHEN o_custkey % 3 = 0 THEN chr(10) || 'note: of customer ' || o_custkey || chr(10) || 'by "sea", or so' ELSE '' END AS t FROM orders),
        s AS (SELECT no, t, sum(length(t) + 2) OVER (ORDER BY no) AS upto, sum(length(t) + 2) OVER (ORDER BY no) - length(t) - 2 AS below FROM r),
        j AS (SELECT a.no, b.no AS next FROM s a ASOF LEFT JOIN s b ON a.below + 1500 < b.upto),
        c AS (SELECT no, next FROM j WHERE no = 2 UNION ALL SELECT j.no, j.next FROM c JOIN j ON j.no = c.next),
        e AS (SELECT no AS first, coalesce(next - 1, (SELECT max(no) FROM r)) AS last FROM c),
        x AS (SELECT first, last, string_agg(t, chr(10) || chr(10) ORDER BY no) AS text FROM e JOIN s ON no BETWEEN first AND last GROUP BY ALL)
        SELECT 'orders.csv' AS path, CASE WHEN last > first THEN 'rows ' || first || '-' || last ELSE 'row ' || first END AS section, (row_number() OVER (ORDER BY first) - 1)::INT AS ordinal,
          strlen(text)::BIGINT AS bytes, md5(text) AS md5 FROM x""",
    "chunk_xml_catalog": "SELECT n_nationkey || '.xml' AS path, 'nation' AS section, 'id: ' || n_nationkey || chr(10) || 'name: ' || n_name || chr(10) || 'region: ' || n_regionkey AS text, 0 AS ordinal FROM nation",
    "failed_files_dead_letter": "SELECT n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '.docx' ELSE '.md' END AS path, n_nationkey % 2 = 0 AS failed, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE n_name END AS text FROM nation",
    "path_words": f"WITH {_FILES} SELECT path, 'docs ' || source || ' ' || lang || ' ' || doc_id AS words FROM f",
    "embedding_text": f"WITH {_FILES} SELECT path, md5('docs ' || source || ' ' || lang || ' ' || doc_id || chr(10) || lang || chr(10) || text) AS md5 FROM f",
    "incremental_skip": f"WITH {_KNOWN} SELECT f.path, f.mtime FROM f JOIN k USING (path, mtime)",
    "incremental_work": f"WITH {_KNOWN} SELECT f.path, f.mtime FROM f LEFT JOIN k ON k.path = f.path AND k.mtime = f.mtime WHERE k.path IS NULL",
    "vanished_files": f"WITH {_KNOWN} SELECT path, mtime FROM k WHERE path LIKE 'docs/src1/%' AND path NOT IN (SELECT path FROM f)",
    "upsert_replace_by_path": f"WITH {_FILES} SELECT path, CASE WHEN lang = 'en' THEN 'new' ELSE 'old' END AS state FROM f",
    "delete_paths": f"WITH {_FILES} SELECT path, mtime FROM f WHERE lang <> 'de'",
    "store_replace_and_delete": f"""WITH {_CHUNKS} SELECT path || '#0' AS id, path, 0 AS ordinal, section, md5(CASE WHEN section = 'en' THEN text || ' (new)' ELSE text END) AS md5,
        CASE WHEN section = 'en' THEN mtime + 1 ELSE mtime END AS mtime, len(e.embedding)::INT AS dim FROM c JOIN embeddings e ON e.vec_id = c.doc_id WHERE section <> 'de'""",
    "count_chunks": "SELECT count(*) AS chunks FROM documents",
    "paths_latest": f"WITH {_FILES} SELECT path, mtime FROM f",
    "list_files": f"WITH {_FILES} SELECT path, strftime(make_timestamp(mtime * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS modified FROM f",
    "query_words": f"WITH {_WORDS} SELECT query_id, array_to_string(words, ' ') AS words FROM q",
    "word_set_size": rf"""WITH {_FILES}, t AS (SELECT path, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{Nd}}_]+')) AS w FROM f)
        SELECT path, count(DISTINCT CASE WHEN strlen(w) >= 3 AND w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END)::INT AS words FROM t WHERE w <> '' GROUP BY path""",
    "parse_exclusions": """SELECT n_nationkey, trim(regexp_replace(n_name, '\\s+', ' ', 'g')) || ' in-word - tail -' AS positive, 'two words|' || regexp_extract(lower(n_name), '^\\S+') AS terms FROM nation""".replace(
        "|| ' in-word - tail -'", "|| ' in-word' || coalesce(nullif(' ' || trim(regexp_replace(lower(n_name), '^\\S+', '')), ' '), '') || ' tail -'"
    ),
    "text_search": f"WITH {_TEXT} SELECT query_id, path, round(score, 6) AS score, rank FROM txt WHERE rank <= 10",
    "normalize_vectors": f"""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: (x * 3)::FLOAT) AS e FROM embeddings),
        n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM s),
        u AS (SELECT vec_id, list_transform(e, lambda x: (x::DOUBLE / n::FLOAT::DOUBLE)::FLOAT) AS v FROM n) SELECT vec_id, {_NUMBERS} FROM u""",
    "vector_search": f"WITH {_CHUNKS}, {_VEC} SELECT query_id, path, round(score, 5) AS score, rank FROM vec WHERE rank <= 10",
    "vector_search_pivots": f"WITH {_CHUNKS}, {_VEC} SELECT query_id, path, round(score, 5) AS score, rank FROM vec WHERE rank <= 10",
    "filter_excluded": f"""WITH {_TEXT} SELECT query_id, path FROM txt WHERE rank <= 10
        AND NOT contains(lower(text || chr(10) || section), 'the and') AND NOT contains(lower(path), 'src1/')""",
    "rrf_merge": f"""WITH {_LISTS}, l AS (SELECT query_id, path, up AS rank, 0 AS list FROM n WHERE up <= 4 UNION ALL SELECT query_id, path, down, 1 FROM n WHERE down <= 3),
        u AS (SELECT query_id, path, sum(1 / (60 + rank)) / (2.0::DOUBLE / 61) AS score, min(list) AS list FROM l GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, path) AS rank FROM u)
        SELECT query_id, path, round(score, 9) AS score, rank, CASE WHEN list = 0 THEN 'a' ELSE 'b' END AS text FROM r WHERE rank <= 5""",
    "hybrid_search": _hybrid("15"),
    "hybrid_search_mixed": _hybrid("CASE WHEN query_id % 3 = 0 THEN 60 ELSE 15 END", "NOT (query_id % 3 = 0 AND contains(lower(text || chr(10) || section), 'the'))"),
    "search_mode_text": f"WITH {_TEXT} SELECT query_id, path, section, md5(text) AS md5, round(score, 6) AS score, rank FROM txt WHERE rank <= 4",
    "search_mode_vector": f"WITH {_CHUNKS}, {_VEC} SELECT query_id, path, section, md5(text) AS md5, round(score, 5) AS score, rank FROM vec WHERE rank <= 5",
    "hybrid_search_filtered": _hybrid("60", "NOT contains(lower(text || chr(10) || section), 'idiot') AND NOT contains(path, '/src1/')"),
    "first_expected_rank": f'{_RANKS} SELECT query_id, "set", rank FROM ranks',
    "eval_cases": f"""{_RANKS}, cases AS (SELECT "set", query_id, rank, (row_number() OVER (PARTITION BY "set" ORDER BY query_id))::INT AS no FROM ranks)
        SELECT cases."set", no, cases.query_id, cases.rank, txt.path AS found FROM cases LEFT JOIN txt ON txt.query_id = cases.query_id AND txt.rank = cases.rank""",
    "eval_recall_mrr": f'{_RANKS} SELECT "set", {_METRICS} FROM ranks GROUP BY "set"',
    "eval_overall": f"{_RANKS} SELECT {_METRICS} FROM ranks",
    "snippets": rf"""WITH {_FILES}, s AS (SELECT path, trim(regexp_replace(text, '{_S}+', ' ', 'g')) AS t FROM f)
        SELECT path, CASE WHEN length(t) > 60 THEN left(t, 60) || '…' ELSE t END AS snippet FROM s""",
    "score_bands": f"""WITH {_TEXT} SELECT CASE WHEN score >= 0.7 THEN 'green' WHEN score >= 0.5 THEN 'yellow' ELSE 'grey' END AS band, count(*) AS results FROM txt WHERE rank <= 5 GROUP BY 1""",
    "search_results_json": f"""WITH {_TEXT} SELECT query_id, rank, '{{"path":"' || path || '","section":"' || section || '","text":"' || md5(text) || '","ordinal":0,"score":'
        || round(score, 4)::DOUBLE::VARCHAR || '}}' AS json FROM txt WHERE rank <= 5""",
    # FNV-1a over the bytes, then three xorshifts for each number; 64-bit arithmetic in 128 bits, vectors in single precision
    "hash_embed": f"""WITH RECURSIVE {_FILES},
        h AS (SELECT path, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::HUGEINT)),
            lambda a, x: (xor(a, x) * 1099511628211) % 18446744073709551616) AS s FROM f),
        step AS (SELECT path, s, 0 AS i FROM h
          UNION ALL SELECT path, xor(s, (s * 131072) % 18446744073709551616), i + 1 FROM (SELECT path, xor(s, s // 128) AS s, i FROM
            (SELECT path, xor(s, (s * 8192) % 18446744073709551616) AS s, i FROM step WHERE i < 32))),
        r AS (SELECT path, list((CASE WHEN s >= 9223372036854775808 THEN s - 18446744073709551616 ELSE s END)::BIGINT::FLOAT / 9223372036854775808::FLOAT ORDER BY i) AS r FROM step WHERE i > 0 GROUP BY path),
        u AS (SELECT path, list_transform(r, lambda x: (x / sqrt(list_sum(list_transform(r, lambda y: y::DOUBLE * y::DOUBLE)))::FLOAT)::FLOAT) AS w FROM r),
        e AS (SELECT path, list_transform(w, lambda x: (x / sqrt(list_sum(list_transform(w, lambda y: y::DOUBLE * y::DOUBLE)))::FLOAT)::FLOAT) AS v FROM u)
        SELECT path, {_NUMBERS} FROM e""",
}
