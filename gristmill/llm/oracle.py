"""DuckDB SQL for the contract queries that SQL can express."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = r"""
WITH l AS (
  SELECT doc_id, i AS pos, lines[i] AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents) d, generate_series(1, len(lines)) g(i)
), k AS (
  SELECT *, """ + _LOWER.format(r"regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')") + r""" AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.*, coalesce(doc_id < keeper, false) AS gone FROM k LEFT JOIN c USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


OP3 = r"""
WITH dw AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(""" + _LOWER.format("coalesce(text, '')") + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(""" + _LOWER.format("coalesce(text, '')") + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), win AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(ws), 10) AS m, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS k
  FROM iw, generate_series(1, greatest(len(ws) - 9, 1)) g(i) WHERE len(ws) > 0
), dwin AS MATERIALIZED (
  SELECT doc_id, i AS pos, m, array_to_string(ws[i : i + m - 1], ' ') AS k
  FROM dw, (SELECT DISTINCT m FROM win) ms, generate_series(1, greatest(len(ws) - m + 1, 0)) g(i)
), occ AS MATERIALIZED (
  SELECT DISTINCT doc_id, pos, m, item_id FROM dwin JOIN win USING (m, k)
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(pos, pos + m - 1)) AS p FROM occ) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM occ) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP4 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

OP5 = r"""
WITH w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS MATERIALIZED (
  SELECT doc_id, i AS pos, md5(array_to_string(ws[i : i + 49], ' ')) AS k FROM w, generate_series(1, greatest(len(ws) - 49, 0)) g(i)
), own AS (
  SELECT k, min(doc_id) AS owner FROM win GROUP BY k HAVING count(DISTINCT doc_id) > 1
), gone AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(generate_series(pos, pos + 49)) AS p FROM win JOIN own USING (k) WHERE doc_id > owner
), each_word AS (
  SELECT doc_id, i AS p, ws[i] AS word FROM w, generate_series(1, len(ws)) g(i)
), kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) AS t, count(*) AS n FROM each_word e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

OP8 = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(""" + _LOWER.format("coalesce(text, '')") + r""", '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS sh
  FROM w, generate_series(1, greatest(len(ws) - 4, 1)) g(i) WHERE len(ws) > 0
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS MATERIALIZED (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (sh) WHERE x.doc_id < y.doc_id GROUP BY ALL
  ) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * shared >= 75 * (na.n + nb.n - shared)
), e AS MATERIALIZED (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), r AS (
  SELECT a AS node, least(a, b) AS reach FROM e
  UNION
  SELECT e.b, r.reach FROM r JOIN e ON e.a = r.node
), c AS (
  SELECT node, min(reach) AS comp FROM r GROUP BY node
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.comp, w.doc_id)::BIGINT AS component_id, coalesce(c.comp, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = w.doc_id
"""


def _op11() -> str:
    """Ten rounds are written out, each from the centroids of the one before."""
    pick = lambda c: f"""SELECT vec_id, arg_min(c, d * 8 + c) AS c, min(d) AS d FROM (
    SELECT vec_id, c, sum((x - y) * (x - y))::BIGINT AS d FROM x JOIN {c} USING (pos) GROUP BY vec_id, c) GROUP BY vec_id"""  # noqa: E731
    parts = [
        """v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda q: q IS NOT NULL AND isfinite(q))) = 64)""",
        """x AS MATERIALIZED (SELECT vec_id, i AS pos, floor(1024 * e[i])::BIGINT AS x FROM v, generate_series(1, 64) g(i))""",
        """c0 AS MATERIALIZED (SELECT c, pos, x AS y FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM v QUALIFY c < 8) USING (vec_id))""",
    ]
    for k in range(10):
        parts.append(f"a{k} AS MATERIALIZED ({pick(f'c{k}')})")
        parts.append(f"""c{k + 1} AS MATERIALIZED (SELECT c, pos, coalesce(m, y) AS y FROM c{k} LEFT JOIN (
    SELECT c, pos, ((s - ((s % n) + n) % n) // n)::BIGINT AS m FROM (SELECT c, pos, sum(x) AS s, count(*) AS n FROM x JOIN a{k} USING (vec_id) GROUP BY c, pos)) USING (c, pos))""")
    parts.append(f"a10 AS MATERIALIZED ({pick('c10')})")
    return "WITH " + ",\n".join(parts) + """
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a10 JOIN (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM c10 GROUP BY c) USING (c)
"""


def _crc_table() -> str:
    """The 256 entries of CRC-32 from its reflected polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(str(c))
    return "[" + ", ".join(out) + "]::BIGINT[]"


OP12 = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, """ + _LOWER.format("r") + r""" AS w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents)
), c AS MATERIALIZED (
  SELECT doc_id, w, count(*) AS k FROM l WHERE length(w) >= 7 GROUP BY ALL
), b AS (
  SELECT *, hex(encode(doc_id || ':' || w)) AS x, """ + _crc_table() + r""" AS t FROM c
), h AS MATERIALIZED (
  SELECT w, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: (16 * (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1)::BIGINT)),
    lambda s, y: xor(s >> 8, t[(xor(s, y) & 255) + 1])), 4294967295) AS h FROM b
), words AS MATERIALIZED (
  SELECT word, sum(k)::BIGINT AS n FROM (SELECT k, CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM h) WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), del AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, generate_series(1, length(word)) g(i)
), pairs AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n FROM del a JOIN del b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, d.word, d.n FROM words a JOIN del d ON a.word = d.rest
  UNION SELECT d.word, a.word, a.n FROM words a JOIN del d ON a.word = d.rest
), near AS (
  SELECT word, count(*) AS n_near, max(n) AS most FROM pairs GROUP BY word
), best AS (
  SELECT word, n_near, most, min(other) AS other FROM near JOIN pairs USING (word) WHERE pairs.n = most GROUP BY ALL
), f AS MATERIALIZED (
  SELECT word, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= 10 * words.n THEN other END AS form, CASE WHEN most >= 10 * words.n THEN most END AS form_n FROM words LEFT JOIN best USING (word)
), chain AS (
  SELECT word, form AS root, 1 AS step FROM f WHERE form IS NOT NULL
  UNION ALL SELECT chain.word, f.form, step + 1 FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL
)
SELECT word, form, coalesce(r.root, word) AS root, n, n_near, form_n FROM f LEFT JOIN (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word) r USING (word)
"""


OP13 = r"""
WITH b AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bs FROM documents
), win AS MATERIALIZED (
  SELECT doc_id, i AS pos, md5(array_to_string(bs[i : i + 49], '')) AS k FROM b, generate_series(1, greatest(len(bs) - 49, 0)) g(i)
), own AS (
  SELECT k, min(doc_id) AS owner FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)
), gone AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(generate_series(pos, pos + 49)) AS p FROM win JOIN own USING (k) WHERE doc_id > owner
), runs AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (lag IS NULL OR p > lag + 1) AS spans FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS lag FROM gone) GROUP BY doc_id
), kept AS (
  SELECT e.doc_id, string_agg(x, '' ORDER BY e.p) AS t FROM (SELECT doc_id, i AS p, bs[i] AS x FROM b, generate_series(1, len(bs)) g(i)) e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id
)
SELECT b.doc_id, len(bs)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256
FROM b LEFT JOIN runs USING (doc_id) LEFT JOIN kept ON kept.doc_id = b.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": OP4, "op5_substring_dedup": OP5, "op3_decontamination": OP3, "op8_minhash_near_dedup": OP8, "op9_line_dedup": OP9, "op11_centroid_clustering": _op11(), "op12_spelling_variants": OP12, "op13_suffix_dedup": OP13}
