"""DuckDB SQL of the registered queries on manifests, spelling variants and repeated passages."""

from __future__ import annotations

#: crc.t: the 256 entries of the CRC-32 table, from its polynomial.
CRC_TABLE = """crc_steps(i, k, v) AS (
  SELECT i, 0, i FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM crc_steps WHERE k = 8)"""


def crc32_sql(codes: str) -> str:
    """The unsigned CRC-32 of a list of byte values, beside table crc."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


OP13_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
parts AS (
  SELECT doc_id, source, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head, text,
    CASE WHEN {crc32_sql("list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)")} % 5 = 0
      THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS lowered
  FROM documents, crc),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM (
    SELECT doc_id, coalesce('s' || source, '') AS tree, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
      sha256(head || coalesce(strlen(lowered) || ':' || lowered, '-')) AS start FROM parts)),
nodes(tree, level, i, h, n) AS (
  SELECT tree, 0, i, leaf, count(*) OVER (PARTITION BY tree) FROM leaves
  UNION ALL
  SELECT tree, level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 15) // 16 FROM nodes WHERE n > 1 GROUP BY tree, level, i // 16),
tops AS (SELECT tree, h, level, row_number() OVER (ORDER BY tree) - 1 AS i FROM nodes WHERE n = 1),
above(level, i, h, n) AS (
  SELECT 0, i, h, count(*) OVER () FROM tops
  UNION ALL
  SELECT level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 15) // 16 FROM above WHERE n > 1 GROUP BY level, i // 16),
every AS (
  SELECT n.tree, n.level, n.i, n.h FROM nodes n WHERE n.n > 1
  UNION ALL SELECT t.tree, t.level + a.level, a.i, a.h FROM tops t, above a WHERE a.n > 1),
runs AS (SELECT tree, level, i // 16 AS p, list(h ORDER BY i) AS run FROM every GROUP BY tree, level, i // 16),
climb(tree, leaf_no, level, i, folded, proof) AS (
  SELECT tree, i, 0, CASE WHEN EXISTS (SELECT 1 FROM tops t WHERE t.tree = l.tree AND t.level = 0) THEN (SELECT t.i FROM tops t WHERE t.tree = l.tree) ELSE i END, start, '' FROM leaves l
  UNION ALL
  SELECT c.tree, leaf_no, c.level + 1, CASE WHEN t.level = c.level + 1 THEN t.i ELSE c.i // 16 END,
    sha256(array_to_string(run[:c.i % 16], '') || folded || array_to_string(run[c.i % 16 + 2:], '')),
    proof || array_to_string(run[:c.i % 16], '') || array_to_string(run[c.i % 16 + 2:], '')
  FROM climb c JOIN runs r ON r.tree = c.tree AND r.level = c.level AND r.p = c.i // 16 JOIN tops t ON t.tree = c.tree),
ends AS (SELECT *, row_number() OVER (PARTITION BY tree, leaf_no ORDER BY level DESC) AS last FROM climb),
root AS (SELECT h AS root FROM above WHERE n = 1)
SELECT l.doc_id, l.leaf, t.h AS subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM ends e JOIN leaves l ON l.tree = e.tree AND l.i = e.leaf_no JOIN tops t ON t.tree = e.tree, root WHERE last = 1
"""

OP12_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT run, n, {crc32_sql("list_transform(range(1, strlen(doc_id || ':' || run) + 1), lambda k: ('0x' || substr(hex(encode(doc_id || ':' || run)), 2 * k - 1, 2))::BIGINT)")} AS h
  FROM counted, crc),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, n, k, left(word, k) || substr(word, k + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS k FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS form_n, arg_min(near, (-n, near)) AS form FROM near GROUP BY word),
led AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
steps(word, root, step) AS (
  SELECT word, word, 0 FROM led UNION ALL SELECT s.word, l.form, step + 1 FROM steps s JOIN led l ON l.word = s.root WHERE l.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, step) AS root FROM steps GROUP BY word)
SELECT l.word, form, root, n, n_near, form_n FROM led l JOIN ends e ON e.word = l.word
"""

OP11_SQL = r"""
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT doc_id, h, unnest(range(0, greatest(strlen(h) // 2 - 99, 0), 512)) AS a FROM bytes),
cut AS (SELECT doc_id, a, substr(h, 2 * a + 1, 2 * (512 + 99)) AS h FROM parts),
starts AS (SELECT doc_id, a + k AS s, md5_number(substr(h, 2 * k + 1, 200)) AS m FROM (SELECT doc_id, a, h, unnest(range(least(512, strlen(h) // 2 - 99))) AS k FROM cut)),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY m ORDER BY doc_id, s) AS r FROM starts),
gaps AS (SELECT doc_id, s, s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 AS apart FROM ranked WHERE r > 1),
islands AS (SELECT doc_id, s, sum(coalesce(apart, true)::INT) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM gaps),
spans AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM islands GROUP BY doc_id, island),
edges AS (SELECT doc_id, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT b.doc_id, strlen(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(list_zip(list_prepend(0, ends), list_append(starts, strlen(h) // 2)), lambda x: substr(h, 2 * x[1] + 1, 2 * (x[2] - x[1]))), '') END)) AS kept_sha256
FROM bytes b LEFT JOIN edges e ON e.doc_id = b.doc_id
"""
