"""DuckDB SQL for the operators' queries that SQL can express, written from the queries' contracts."""

from __future__ import annotations

_UPPER = "".join(map(chr, range(65, 91)))
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"

_JACCARD = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], chr(32)) AS s
  FROM words, generate_series(1, greatest(len(w) - 4, 1)) g(i) WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN size a ON a.doc_id = x JOIN size b ON b.doc_id = y
  WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.y FROM reach r JOIN edge e ON e.x = r.other)
SELECT r.doc_id, CAST(coalesce(any_value(s.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM reach r LEFT JOIN size s ON s.doc_id = r.doc_id GROUP BY r.doc_id"""

_LEAKS = rf"""
WITH bw AS (SELECT item_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
win AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s
  FROM bw, generate_series(1, greatest(len(w) - 9, 1)) g(i) WHERE len(w) > 0),
dwin AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM dw, (SELECT DISTINCT n FROM win) lens, generate_series(1, len(w) - n + 1) g(i)),
hit AS (SELECT d.doc_id, d.i, d.n, x.item FROM dwin d JOIN win x ON x.n = d.n AND x.s = d.s),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, generate_series(i, i + n - 1) g(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hits h ON h.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id"""

# CRC-32, bit by bit from its polynomial.
_SHARDS = r"""
WITH RECURSIVE bits(n, c, k) AS (
  SELECT CAST(n AS BIGINT), CAST(n AS BIGINT), 0 FROM range(256) t(n)
  UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS tab FROM bits WHERE k = 8),
byte AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b
  FROM documents),
sized AS (
  SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b),
    lambda x, y: xor(x // 256, crc.tab[xor(x % 256, y) + 1])), CAST(4294967295 AS BIGINT)) AS BIGINT) AS text_crc32
  FROM byte, crc),
run AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS start,
    sum(size) OVER () AS total FROM sized),
cut AS (SELECT *, CAST(((2 * start + size) * 16) // (2 * total) AS INTEGER) AS shard FROM run)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY start) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut"""

_CHAT = r"""
WITH RECURSIVE call AS (
  SELECT conv_id, turn, turn // 2 AS k, text, len(string_split(coalesce(text, ''), ' ')) AS n,
    CASE WHEN turn // 2 >= 1 THEN 2 * ((turn // 2 - 1) // 2) + turn % 2 END AS parent
  FROM conversations WHERE role = 'user'),
level AS (
  SELECT c.conv_id, c.turn, 0 AS level FROM call c
  WHERE NOT EXISTS (SELECT 1 FROM call p WHERE p.conv_id = c.conv_id AND p.turn = c.parent)
  UNION ALL SELECT c.conv_id, c.turn, l.level + 1 FROM call c JOIN level l ON l.conv_id = c.conv_id AND l.turn = c.parent),
answer AS (SELECT conv_id, turn - 1 AS turn, turn AS own, text FROM conversations WHERE role = 'assistant'),
filled AS (
  SELECT c.*, l.level, a.turn IS NOT NULL AS answered, a.text AS result,
    ['search', 'translate', 'summarise'][c.k % 3 + 1] AS tool, ['fr', 'de', 'es', 'en', 'it'][c.n % 5 + 1] AS lang,
    c.parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM call p WHERE p.conv_id = c.conv_id AND p.turn = c.parent) AS lost
  FROM call c JOIN level l ON l.conv_id = c.conv_id AND l.turn = c.turn
  LEFT JOIN answer a ON a.conv_id = c.conv_id AND a.turn = c.turn),
judged AS (
  SELECT *, CASE tool WHEN 'search' THEN CASE WHEN n > 50 THEN 'range:limit' ELSE '' END
    WHEN 'translate' THEN CASE WHEN lang = 'it' THEN 'enum:to' ELSE '' END
    ELSE CASE WHEN n < 10 THEN 'missing:ratio' ELSE '' END END AS errors FROM filled),
stated AS (
  SELECT *, CASE WHEN errors <> '' THEN 'invalid' WHEN answered THEN 'ok' ELSE 'no_result' END AS status FROM judged),
record AS (
  SELECT conv_id, turn, 'call' AS kind, conv_id || '-' || turn AS call_id, level AS place, level, status, errors,
    '{"arguments":{' || CASE tool WHEN 'search' THEN '"limit":' || n || ',"query":' || to_json(text)
      WHEN 'translate' THEN '"text":' || to_json(text) || ',"to":"' || lang || '"'
      ELSE CASE WHEN n >= 10 THEN '"ratio":' || CASE WHEN n = 10 THEN '1' ELSE CAST(10 / n AS VARCHAR) END || ',' ELSE '' END
        || '"text":' || to_json(text) END
    || '},"depends_on":[' || CASE WHEN parent IS NULL THEN '' ELSE '"' || conv_id || '-' || parent || '"' END
    || '],"id":"' || conv_id || '-' || turn || '","missing":' || CAST(lost AS INTEGER) || ',"name":"' || tool || '",'
    || CASE WHEN result IS NULL THEN '' ELSE '"result":' || to_json(result) || ',' END
    || '"status":"' || status || '","type":"call"}' AS json
  FROM stated
  UNION ALL
  SELECT conv_id, turn, 'message', NULL, -1, NULL, 'message', '',
    '{"content":' || to_json(text) || ',"role":"' || role || '","type":"message"}'
  FROM conversations WHERE role NOT IN ('user', 'assistant')
  UNION ALL
  SELECT a.conv_id, a.own, 'result', a.conv_id || '-' || a.turn, 1073741824, NULL, 'orphan', '',
    '{"content":' || to_json(a.text) || ',"id":"' || a.conv_id || '-' || a.turn || '","status":"orphan","type":"result"}'
  FROM answer a WHERE NOT EXISTS (SELECT 1 FROM call c WHERE c.conv_id = a.conv_id AND c.turn = a.turn))
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY place, turn, kind, call_id) - 1 AS BIGINT) AS position,
  kind, call_id, CAST(level AS INTEGER) AS level, status, errors, json
FROM record"""

_LINES = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
line AS (SELECT r, doc_id, text, i, x[i] AS line, translate(trim(x[i], concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
  '{_UPPER}', '{_UPPER.lower()}') AS k FROM docs, generate_series(1, len(x)) g(i)),
often AS (SELECT k FROM line WHERE k <> '' GROUP BY k HAVING count(DISTINCT (doc_id, text)) >= 10)
SELECT any_value(l.doc_id) AS doc_id, count(*) AS n_lines, count(o.k) AS n_dropped,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (o.k IS NULL), '')) AS kept_sha256
FROM line l LEFT JOIN often o ON o.k = l.k GROUP BY l.r"""

_PHRASES = rf"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_FOLDED}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
word AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
gram AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS s, w[i:i + k - 1] AS x
  FROM word, (VALUES (1), (2), (3)) t(k), generate_series(1, len(w) - k + 1) g(i)),
f AS MATERIALIZED (SELECT lang, k, s, any_value(x) AS x, count(*) AS n FROM gram GROUP BY lang, k, s),
total AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT * FROM f WHERE k > 1 AND n >= 10),
part AS MATERIALIZED (SELECT c.lang, c.s, c.k, c.n AS a, j, array_to_string(c.x[1:j], ' ') AS u, array_to_string(c.x[j + 1:], ' ') AS v
  FROM cand c, generate_series(1, c.k - 1) g(j)),
head AS MATERIALIZED (SELECT p.*, f.n AS l FROM part p JOIN f ON f.lang = p.lang AND f.s = p.u),
cut AS (SELECT p.*, f.n AS r, (CAST(1000000 AS HUGEINT) * p.a * p.a) // (CAST(p.l AS HUGEINT) * f.n) AS score
  FROM head p JOIN f ON f.lang = p.lang AND f.s = p.v),
worst AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, j) = 1),
inside AS (SELECT lang, unnest([array_to_string(x[1:2], ' '), array_to_string(x[2:3], ' ')]) AS s, n FROM cand WHERE k = 3),
most AS (SELECT lang, s, max(n) AS n FROM inside GROUP BY lang, s),
kept AS (SELECT w.* FROM worst w LEFT JOIN most m ON m.lang = w.lang AND m.s = w.s AND w.k = 2
  WHERE m.n IS NULL OR 100 * m.n < 50 * w.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY k.score DESC, k.a DESC, k.s) AS rank, k.s AS phrase, k.a, k.l, k.r,
  CAST(t.n AS BIGINT) AS n, CAST(k.score AS BIGINT) AS score
FROM kept k JOIN total t ON t.lang = k.lang QUALIFY rank <= 2000"""

ORACLE_SQL: dict[str, str] = {"op1_tool_chat": _CHAT, "op4_jaccard_join": _JACCARD, "op5_decontaminate": _LEAKS,
                              "op6_sharding": _SHARDS, "op11_collocations": _PHRASES, "op13_line_dedup": _LINES}
