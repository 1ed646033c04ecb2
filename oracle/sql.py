"""DuckDB oracle SQL for every key of ``__spark_entry__.queries()``.

Written from the same specification; the creation and rename plans follow the
Spark code's steps closely (tests/test_batches.py checks those against models
that carry changes out one after another). The fixture input construction (the file listing built from the driver's
tables) is shared text between the engines. Tables ``part documents orders
events pages`` are views registered by the driver.
"""

from __future__ import annotations

# Input construction: the file listing built from the driver's tables.
_RAW_FILES = r"""
raw_files AS (
  SELECT CAST(p_partkey AS BIGINT) AS ordinal,
    concat('C:/Users/me/',
      CASE p_size % 5 WHEN 0 THEN 'Downloads' WHEN 1 THEN 'Documents' WHEN 2 THEN 'Desktop' WHEN 3 THEN 'Pictures' ELSE 'Pictures/Samsung Flow' END, '/',
      CASE WHEN p_partkey % 37 = 0 THEN '.' ELSE '' END,
      CASE WHEN p_partkey % 10 = 5 THEN upper(replace(p_name, ' ', '_'))
           WHEN p_partkey % 10 = 0 THEN replace(p_name, ' ', '_')
           ELSE concat(replace(p_name, ' ', '_'), '-', CAST(p_partkey AS VARCHAR(20))) END,
      CASE p_type WHEN 'ECONOMY' THEN '.TXT' WHEN 'SMALL' THEN '.txt' WHEN 'MEDIUM' THEN '.tar.gz' WHEN 'LARGE' THEN '' WHEN 'PROMO' THEN '.pdf' ELSE '.jpg' END) AS path
  FROM part
  UNION ALL
  SELECT 1000000000 + doc_id, concat('D:/work/', lang, '_documents/', source, '/doc', CAST(doc_id AS VARCHAR(20)), '.txt') FROM documents
  UNION ALL
  SELECT 2000000000 + o_orderkey, concat('E:/Archive/', CAST(extract(year FROM o_orderdate) AS VARCHAR(20)), '/', replace(o_orderpriority, ' ', '_'), '/order_', CAST(o_orderkey AS VARCHAR(20)), '.pdf') FROM orders
  UNION ALL
  SELECT 3000000000 + event_id, concat('F:/logs/', CASE WHEN event_id % 50 = 0 THEN 'AppData/' ELSE '' END, event_type, '/ev-', CAST(event_id AS VARCHAR(20)), '.json') FROM events
  UNION ALL
  SELECT 4000000000 + page_id, concat('W:/', CASE WHEN page_id % 20 = 0 THEN 'node_modules/' ELSE '' END,
    regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/$', '')) FROM pages
)"""


def _norm(expr: str) -> str:
    return rf"regexp_replace(regexp_replace({expr}, '[\\/]+', '/', 'g'), '^(.*[^:/])/$', '\1')"


def _parent(expr: str) -> str:
    return rf"regexp_replace({expr}, '^([A-Za-z]:/|/)?(.*?)/?[^/]*$', '\1\2')"


def _strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '^\s+|\s+$', '', 'g')"


def _unsafe(expr: str) -> str:
    return (rf"CASE WHEN {expr} IS NULL OR {_strip(expr)} = '' THEN 'blank' "
            rf"WHEN contains(lower({expr}), '../') OR contains(lower({expr}), '..\') THEN 'traversal' "
            rf"""WHEN regexp_matches({expr}, '[<>:"|?*]') THEN 'reserved_char' END""")


_QUERY_BATCH = [
    "blue", "blue_anvil.txt", "doc", "doc1.txt", "Anvil  BOLT", "order_1", "en_documents",
    ".txt", "825", "small_ring-", "json error", "zz", "ev-1", "old", "  Pictures ", "pdf",
    "samsung flow", "my-file", "a", "log",
]
_K = 50

_BASE = _RAW_FILES + rf""",
listing AS (SELECT ordinal * 100 + 99 AS ordinal, path, false AS is_dir FROM raw_files),
norm AS (SELECT ordinal, {_norm('path')} AS path, is_dir FROM listing),
anc AS (
  SELECT s.ordinal, array_to_string(s.p[1:g.i], '/') AS path, g.i AS depth
  FROM (SELECT ordinal, string_split(path, '/') AS p FROM norm) s, generate_series(2, len(s.p) - 1) g(i)),
folders AS (SELECT min(ordinal) - min(ordinal) % 100 + min(depth) AS ordinal, path, true AS is_dir FROM anc GROUP BY path),
expanded AS (SELECT ordinal, path, is_dir FROM norm UNION ALL SELECT ordinal, path, is_dir FROM folders),
itemcols AS (
  SELECT ordinal, path, lower(path) AS path_key,
    string_split(path, '/')[-1] AS name,
    lower(string_split(path, '/')[-1]) AS name_lc,
    {_parent('path')} AS parent,
    CASE WHEN regexp_matches(path, '^[A-Za-z]:/[^/]*$') THEN '' ELSE regexp_extract(path, '([^/]+)/[^/]*$', 1) END AS parent_name,
    regexp_extract(lower(string_split(path, '/')[-1]), '^.+(\.[^.]+)$', 1) AS suffix,
    is_dir,
    upper(regexp_extract(path, '^([A-Za-z]):', 1)) AS drive
  FROM expanded),
kept AS (SELECT * FROM itemcols
  WHERE NOT regexp_matches(lower(parent), 'system32|windows|programdata|\$recycle|appdata|\.git|node_modules|__pycache__')),
catalog AS (
  SELECT ordinal, path, path_key, name, name_lc, parent, parent_name, suffix, is_dir, drive FROM kept
  QUALIFY row_number() OVER (PARTITION BY path_key ORDER BY ordinal, path) = 1),
cat_t AS (SELECT *, list_filter(string_split_regex(translate(name_lc, '._-', '   '), '\s+'), lambda x: length(x) > 2) AS tokens FROM catalog),
drives AS (SELECT DISTINCT upper(substr(path, 1, 1)) AS letter FROM catalog WHERE regexp_matches(path, '^[C-Zc-z]:')),
roots AS (
  SELECT root, root AS root_key FROM (VALUES ('C:/Users/me/Downloads'), ('C:/Users/me/Documents'), ('C:/Users/me/Desktop'),
    ('C:/Users/me/Videos'), ('C:/Users/me/Pictures'), ('C:/Users/me/Pictures/Samsung Flow')) t(root)
  UNION ALL SELECT letter || ':/', letter || ':/' FROM drives WHERE letter <> 'C'),
valid AS (SELECT root, regexp_replace(lower(root_key), '/+$', '') AS below FROM roots WHERE
  regexp_replace(lower(root_key), '/+$', '') IN (SELECT path_key FROM catalog WHERE is_dir UNION ALL SELECT lower(letter) || ':' FROM drives)),
scat AS (SELECT * FROM cat_t c WHERE EXISTS (SELECT 1 FROM valid v WHERE starts_with(c.path_key, v.below || '/'))),
qbatch AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{q}')" for i, q in enumerate(_QUERY_BATCH))}) t(query_id, raw)),
qn AS (SELECT CAST(query_id AS BIGINT) AS query_id, raw, lower({_strip('raw')}) AS q FROM qbatch WHERE {_strip('raw')} <> ''),
qw AS (SELECT *, list_distinct(list_filter(string_split_regex(translate(q, '._', '  '), '\s+'), lambda x: x <> '')) AS q_words FROM qn),
hits AS (
  SELECT qw.query_id, c.ordinal, c.path, c.name, c.parent, c.is_dir, c.name_lc,
    c.name_lc = qw.q AS is_exact, starts_with(c.name_lc, qw.q) AS is_prefix,
    contains(c.name_lc, qw.q) AS is_contains, list_has_any(c.tokens, qw.q_words) AS is_word,
    CAST((CASE WHEN c.name_lc = qw.q THEN 100 WHEN starts_with(c.name_lc, qw.q) THEN 80
               WHEN contains(c.name_lc, qw.q) THEN 50 ELSE 0 END)
         + greatest(0, 30 - length(c.name_lc))
         + (CASE WHEN regexp_matches(lower(c.parent_name), 'documents|desktop|downloads') THEN 10 ELSE 0 END) AS BIGINT) AS score
  FROM scat c JOIN qw ON contains(c.name_lc, qw.q) OR list_has_any(c.tokens, qw.q_words)),
pref AS (SELECT query_id, ordinal, row_number() OVER (PARTITION BY query_id ORDER BY ordinal) AS prn FROM hits WHERE is_prefix),
memb AS (
  SELECT h.*, (h.is_exact OR h.is_word OR coalesce(p.prn <= {2 * _K}, false)) AS is_member
  FROM hits h LEFT JOIN pref p ON p.query_id = h.query_id AND p.ordinal = h.ordinal),
cnt AS (SELECT query_id, count(*) FILTER (WHERE is_member) AS n FROM memb GROUP BY query_id),
cands AS (SELECT m.* FROM memb m JOIN cnt ON cnt.query_id = m.query_id WHERE m.is_member OR cnt.n < {_K}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal) AS rank FROM cands),
results AS (SELECT * FROM ranked WHERE rank <= {_K}),
tq AS (
  SELECT ordinal AS query_id,
    CASE ordinal % 3 WHEN 0 THEN '  ' || upper(name) || ' ' WHEN 1 THEN name || chr(9) ELSE '   ' END AS raw
  FROM catalog),
tqn AS (SELECT CAST(query_id AS BIGINT) AS query_id, lower({_strip('raw')}) AS q FROM tq WHERE {_strip('raw')} <> ''),
renames AS (
  SELECT ordinal AS change_id,
    CASE WHEN ordinal % 11 = 3 THEN path || '_gone' ELSE path END AS path,
    CASE ordinal % 11 WHEN 0 THEN name WHEN 1 THEN name || '?' WHEN 2 THEN upper(name) WHEN 3 THEN name || '_x'
      WHEN 4 THEN 'shared_' || parent_name ELSE name || '_v2' END AS new_name
  FROM catalog),
rq AS (
  SELECT r.change_id, r.path, r.new_name, c.ordinal, c.parent AS item_parent
  FROM (SELECT change_id, {_norm('path')} AS path, new_name FROM renames) r
  LEFT JOIN catalog c ON c.path_key = lower(r.path)),
rq2 AS (SELECT *, {_norm("coalesce(item_parent, " + _parent('path') + ") || '/' || new_name")} AS new_path FROM rq),
rst AS (
  SELECT *, lower(new_path) AS tgt_key, lower(path) AS src_key,
    CASE WHEN new_name = string_split(path, '/')[-1] THEN 'unchanged'
         WHEN ({_unsafe('new_name')}) IS NOT NULL OR regexp_matches(new_name, '[/\\]') THEN 'invalid_name'
         WHEN lower(new_path) IN (SELECT path_key FROM catalog) THEN 'exists'
         WHEN ordinal IS NULL THEN 'missing'
         ELSE 'pending' END AS status0
  FROM rq2),
rt1 AS (
  SELECT *, CASE WHEN status0 = 'pending'
    AND change_id > min(CASE WHEN status0 = 'pending' THEN change_id END) OVER (PARTITION BY tgt_key)
    THEN 'exists' ELSE status0 END AS status1 FROM rst),
rt2 AS (
  SELECT *, CASE WHEN status1 = 'pending'
    AND change_id > min(CASE WHEN status1 = 'pending' THEN change_id END) OVER (PARTITION BY src_key) THEN 'missing'
    WHEN status1 = 'pending' THEN 'ok' ELSE status1 END AS status2 FROM rt1),
rplan AS (
  SELECT r.*, CASE WHEN r.status2 = 'missing' AND o.change_id < r.change_id THEN 'exists' ELSE r.status2 END AS status
  FROM rt2 r LEFT JOIN (SELECT tgt_key, change_id FROM rt2 WHERE status2 = 'ok') o ON o.tgt_key = r.tgt_key)
"""


def _with(body: str) -> str:
    return "WITH " + _BASE + "\n" + body


def _prefix_hits(n: int) -> str:
    return f"""(SELECT qw.query_id, c.ordinal, c.path,
        row_number() OVER (PARTITION BY qw.query_id ORDER BY c.ordinal) AS prn
      FROM scat c JOIN qw ON starts_with(c.name_lc, qw.q) WHERE qw.q <> '') p WHERE prn <= {n}"""



def _plan_reason(expr: str) -> str:
    parts = rf"string_split(replace({expr}, '\', '/'), '/')"
    return (f"coalesce({_unsafe(expr)}, CASE WHEN regexp_matches({expr}, '^[/\\\\]') THEN 'absolute' "
            f"WHEN list_contains({parts}, '.') OR list_contains({parts}, '..') THEN 'dot_part' END)")


def _create_sql(p: str, man: str, cat: str) -> str:
    """CTEs ``{p}_folders(change_id, path, role, status)`` and ``{p}_files(change_id, path, content, status)``."""
    target = _norm("location || '/' || name")
    return f""",
{p}_fr AS (SELECT change_id, {_plan_reason('name')} AS reason, {target} AS target FROM {man} WHERE kind = 'folder'),
{p}_fa AS (SELECT r.change_id, g.d AS depth, array_to_string(r.s[1:g.d], '/') AS anc_path
  FROM (SELECT change_id, string_split(target, '/') AS s FROM {p}_fr WHERE reason IS NULL) r, generate_series(2, len(r.s)) g(d)),
{p}_fj AS (SELECT a.*, c.is_dir AS exists_dir FROM {p}_fa a LEFT JOIN {cat} c ON c.path_key = lower(a.anc_path)),
{p}_fv AS (SELECT change_id, max(CASE WHEN exists_dir = false THEN 1 ELSE 0 END) AS fiw, max(depth) AS td
  FROM {p}_fj GROUP BY change_id),
{p}_fall AS (
  SELECT j.change_id, j.anc_path AS path, CASE WHEN j.depth = v.td THEN 'target' ELSE 'ancestor' END AS role,
    CASE WHEN v.fiw = 1 THEN 'conflict' WHEN j.exists_dir THEN 'kept' ELSE 'created' END AS status
  FROM {p}_fj j JOIN {p}_fv v ON v.change_id = j.change_id
  WHERE j.depth = v.td OR (j.exists_dir IS NULL AND v.fiw <> 1)
  UNION ALL SELECT change_id, target, 'target', 'invalid_name' FROM {p}_fr WHERE reason IS NOT NULL),
{p}_fn AS (SELECT *, row_number() OVER (PARTITION BY lower(path), status ORDER BY change_id) AS nth FROM {p}_fall),
{p}_folders AS (  -- a path is created by the first request that makes it and is there for the later ones
  SELECT change_id, path, role, CASE WHEN status = 'created' AND nth > 1 THEN 'kept' ELSE status END AS status
  FROM {p}_fn WHERE nth = 1 OR role = 'target' OR status <> 'created'),
{p}_gr AS (SELECT change_id, coalesce(content, '') AS content, make_parents, {_plan_reason('name')} AS reason,
  {target} AS target FROM {man} WHERE kind = 'file'),
{p}_ga AS (SELECT r.change_id, g.d AS depth, len(r.s) AS td, array_to_string(r.s[1:g.d], '/') AS anc_path
  FROM (SELECT change_id, string_split(target, '/') AS s FROM {p}_gr WHERE reason IS NULL) r, generate_series(2, len(r.s)) g(d)),
{p}_gj AS (SELECT a.*, c.is_dir AS exists_dir FROM {p}_ga a LEFT JOIN {cat} c ON c.path_key = lower(a.anc_path)),
{p}_gv AS (SELECT change_id,
    max(CASE WHEN depth < td AND exists_dir = false THEN 1 ELSE 0 END) AS file_above,
    max(CASE WHEN depth = td THEN CAST(exists_dir AS INT) END) AS tgt,
    max(CASE WHEN depth = td - 1 THEN CAST(exists_dir AS INT) END) AS par,
    max(CASE WHEN depth = td - 1 THEN 1 ELSE 0 END) AS has_par
  FROM {p}_gj GROUP BY change_id),
{p}_fw AS (
  SELECT r.change_id, r.target AS path, r.content,
    CASE WHEN v.file_above = 1 OR v.tgt = 1 THEN 'conflict'
         WHEN NOT (coalesce(v.par, 0) = 1 OR v.has_par = 0 OR r.make_parents) THEN 'missing'
         WHEN lower(r.target) IN (SELECT lower(path) FROM {p}_folders WHERE status = 'created') THEN 'conflict'
         WHEN v.tgt = 0 THEN 'overwritten' ELSE 'write' END AS outcome
  FROM {p}_gr r JOIN {p}_gv v ON v.change_id = r.change_id WHERE r.reason IS NULL),
{p}_files AS (
  SELECT change_id, path, content, CASE WHEN outcome <> 'write' THEN outcome
    WHEN EXISTS (SELECT 1 FROM {p}_fw o WHERE o.outcome = 'write' AND lower(o.path) = lower(w.path) AND o.change_id < w.change_id)
    THEN 'overwritten' ELSE 'created' END AS status
  FROM {p}_fw w
  UNION ALL SELECT change_id, target, content, 'invalid_name' FROM {p}_gr WHERE reason IS NOT NULL)"""


_MANIFEST = r""",
man AS (
  SELECT o AS change_id,
    CASE WHEN o % 7 IN (0, 1) THEN par WHEN o % 7 = 5 THEN p || '_nodir' WHEN o % 7 = 6 THEN p ELSE par END AS location,
    CASE WHEN o % 7 IN (0, 1) THEN nm WHEN o % 7 = 2 THEN 'new_' || nm || '/inner' WHEN o % 7 = 3 THEN nm || '.new'
         WHEN o % 7 = 4 THEN nm || '*' WHEN o % 7 = 5 THEN 'note.txt' ELSE 'sub' END AS name,
    CASE WHEN o % 7 IN (0, 2, 6) THEN 'folder' ELSE 'file' END AS kind,
    CASE WHEN o % 7 = 3 THEN 'about ' || nm ELSE '' END AS content,
    o % 7 <> 5 AS make_parents
  FROM (SELECT ordinal AS o, path AS p, parent AS par, name AS nm FROM catalog))"""

_NESTED = rf""",
nest AS (SELECT ordinal AS cid, path AS loc, name AS nm, ordinal % 4 = 0 AS bad FROM catalog WHERE is_dir),
nman AS (
  SELECT cid || ':' AS change_id, loc AS location, 'bundle' AS name, 'folder' AS kind, NULL AS content, true AS make_parents FROM nest
  UNION ALL SELECT cid || ':a', {_norm("loc || '/bundle'")}, 'readme.txt', 'file', nm, false FROM nest
  UNION ALL SELECT cid || ':b', {_norm("loc || '/bundle'")}, CASE WHEN bad THEN nm || '?' ELSE nm END, 'file', '', false FROM nest
  UNION ALL SELECT cid || ':c', {_norm("loc || '/bundle'")}, 'sub', 'folder', NULL, true FROM nest
  UNION ALL SELECT cid || ':d', {_norm(_norm("loc || '/bundle'") + " || '/sub'")}, 'a.txt', 'file', 'x', false FROM nest)"""


_FOLDER = "📁 Folder"
_FILE = "📄 File"

ORACLE_SQL: dict[str, str] = {
    "catalog_scan": _with("SELECT ordinal, path, is_dir FROM norm"),
    "scope_to_roots": _with("""SELECT r.root, c.ordinal, c.path FROM catalog c
        JOIN roots r ON starts_with(c.path_key, regexp_replace(lower(r.root_key), '/+$', '') || '/')"""),
    "expand_ancestors": _with("SELECT ordinal, path, is_dir FROM expanded"),
    "valid_roots": _with("""SELECT root FROM roots WHERE
        (CASE WHEN regexp_matches(lower(root_key), '^[a-z]:/?$') THEN substr(lower(root_key), 1, 2) || '/'
              ELSE regexp_replace(lower(root_key), '/+$', '') END)
        IN (SELECT path_key FROM catalog WHERE is_dir UNION ALL SELECT lower(letter) || ':/' FROM drives)"""),
    "available_drives": _with("SELECT letter, letter || ':/' AS root FROM drives"),
    "list_directory": _with("SELECT ordinal, path, name, is_dir FROM catalog WHERE lower(parent) = 'c:/users/me/documents'"),
    "persist_indexes": _with("SELECT ordinal, path_key, drive FROM catalog"),
    "item_metadata": _with("SELECT ordinal, name, suffix, is_dir FROM catalog"),
    "parent_columns": _with("SELECT ordinal, parent, parent_name FROM catalog"),
    "drive_path": _with("""SELECT DISTINCT lower(substr(path, 1, 1)) AS letter, upper(substr(path, 1, 1)) || ':/' AS root
        FROM catalog WHERE regexp_matches(path, '^[A-Za-z]:')"""),
    "item_type": _with("SELECT ordinal, CASE WHEN is_dir THEN 'folder' ELSE 'file' END AS item_type FROM catalog"),
    "item_label": _with(f"SELECT ordinal, CASE WHEN is_dir THEN '{_FOLDER}' ELSE '{_FILE}' END AS item_label FROM catalog"),
    "relevance_score": _with("SELECT query_id, ordinal, score FROM hits"),
    "skip_system_dirs": _with("SELECT ordinal, path FROM kept"),
    "safe_names": _with(f"""SELECT change_id, new_name, reason IS NULL AS is_safe, reason
        FROM (SELECT change_id, new_name, {_unsafe('new_name')} AS reason FROM renames)"""),
    "hide_dotfiles": _with("SELECT ordinal, name FROM catalog WHERE NOT starts_with(name, '.')"),
    "content_type_filter": _with("SELECT ordinal, path FROM catalog WHERE is_dir"),
    "min_word_length": _with("SELECT ordinal, unnest(list_distinct(tokens)) AS word FROM cat_t"),
    "blank_query_filter": _with("SELECT query_id FROM tqn"),
    "case_fold": _with("SELECT ordinal, lower(path) AS path_key, lower(name) AS name_lc FROM catalog"),
    "normalise_query": _with(f"SELECT CAST(query_id AS BIGINT) AS query_id, lower({_strip('raw')}) AS q FROM tq"),
    "tokenise_name": _with("SELECT ordinal, array_to_string(list_sort(tokens), '|') AS words FROM cat_t"),
    "tokenise_query": _with("""SELECT query_id, array_to_string(list_sort(list_distinct(list_filter(
        string_split_regex(translate(q, '._', '  '), '\\s+'), lambda x: x <> ''))), '|') AS words FROM tqn"""),
    "exact_match": _with("SELECT t.query_id, c.ordinal FROM tqn t JOIN catalog c ON c.name_lc = t.q"),
    "prefix_match": _with(f"SELECT query_id, ordinal, prn AS prefix_rank FROM {_prefix_hits(2 * _K)}"),
    "word_match": _with("SELECT DISTINCT qw.query_id, c.ordinal FROM scat c JOIN qw ON list_has_any(c.tokens, qw.q_words)"),
    "substring_match": _with("SELECT qw.query_id, c.ordinal FROM scat c JOIN qw ON contains(c.name_lc, qw.q)"),
    "already_indexed": _with(f"""SELECT ordinal, k AS path_key FROM (
          SELECT ordinal, lower({_norm("CASE WHEN (ordinal // 100) % 3 = 0 THEN path || '.bak' ELSE path END")}) AS k
          FROM listing) WHERE k NOT IN (SELECT path_key FROM catalog)"""),
    "target_exists": _with(f"""SELECT change_id FROM renames
        WHERE lower({_norm(_parent(_norm('path')) + " || '/' || new_name")}) IN (SELECT path_key FROM catalog)"""),
    "items_per_root": _with("""SELECT r.root, CAST(count(c.ordinal) AS BIGINT) AS items FROM roots r
        LEFT JOIN catalog c ON starts_with(c.path_key, regexp_replace(lower(r.root_key), '/+$', '') || '/')
        GROUP BY r.root"""),
    "total_items": _with("SELECT CAST(count(DISTINCT path_key) AS BIGINT) AS total_items FROM catalog"),
    "exact_index": _with("SELECT name_lc, ordinal, path FROM catalog"),
    "word_index": _with("SELECT unnest(list_distinct(tokens)) AS word, ordinal, path FROM cat_t"),
    "prefix_index": _with("""SELECT substr(c.name_lc, 1, g.i) AS prefix, CAST(count(*) AS BIGINT) AS n_items,
        min(c.ordinal) AS first_ordinal
        FROM catalog c, generate_series(1, length(c.name_lc)) g(i) WHERE length(c.name_lc) > 0
        GROUP BY 1"""),
    "result_counts": _with("""SELECT q.query_id, CAST(count(r.ordinal) AS BIGINT) AS hits,
        CAST(greatest(0, count(r.ordinal) - 20) AS BIGINT) AS more_hits
        FROM (SELECT CAST(query_id AS BIGINT) AS query_id FROM qbatch) q LEFT JOIN results r ON r.query_id = q.query_id
        GROUP BY q.query_id"""),
    "catalog_statistics": _with("""SELECT CAST(count(*) AS BIGINT) AS items,
        CAST(count(*) FILTER (WHERE NOT is_dir) AS BIGINT) AS files,
        CAST(count(*) FILTER (WHERE is_dir) AS BIGINT) AS folders,
        CAST(count(DISTINCT name_lc) AS BIGINT) AS distinct_names,
        (SELECT CAST(count(DISTINCT w) AS BIGINT) FROM (SELECT unnest(tokens) AS w FROM cat_t)) AS distinct_words
        FROM catalog"""),
    "dedup_first_wins": _with("""SELECT ordinal, path, lower(path) AS path_key FROM expanded
        QUALIFY row_number() OVER (PARTITION BY lower(path) ORDER BY ordinal, path) = 1"""),
    "prefix_truncate": _with(f"SELECT query_id, ordinal FROM {_prefix_hits(40)}"),
    "display_page": _with(f"""SELECT query_id, rank AS row_no, name,
        CASE WHEN is_dir THEN '{_FOLDER}' ELSE '{_FILE}' END AS item_label, parent AS location
        FROM results WHERE rank <= 20"""),
    "rank_results": _with("""SELECT query_id, ordinal, score,
        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal) AS rank FROM cands"""),
    "top_k": _with("SELECT query_id, rank, ordinal, score FROM results"),
    "pick_by_number": _with("""SELECT pw.query_id, pw.n, r.rank, r.path FROM (
          SELECT p.query_id, p.n, CASE WHEN hc.hits = 1 THEN 1 ELSE p.n END AS want, hc.hits
          FROM (SELECT CAST(query_id AS BIGINT) AS query_id, CAST(query_id % 25 + 1 AS BIGINT) AS n FROM qbatch) p
          JOIN (SELECT query_id, count(*) AS hits FROM results GROUP BY query_id) hc ON hc.query_id = p.query_id) pw
        JOIN results r ON r.query_id = pw.query_id AND r.rank = pw.want
        WHERE pw.want BETWEEN 1 AND least(pw.hits, 20)"""),
    "union_strategies": _with("SELECT query_id, ordinal FROM memb WHERE is_member"),
    "fallback_union": _with("SELECT query_id, ordinal FROM cands"),
    "autocomplete": _with(f"SELECT query_id, prn AS rank, ordinal, path FROM {_prefix_hits(20)}"),
    "multi_strategy_search": _with("""SELECT query_id, rank, path, name,
        CASE WHEN is_dir THEN 'folder' ELSE 'file' END AS item_type, parent, score FROM results"""),
    "build_catalog": _with("SELECT * FROM catalog"),
    "folder_listing": _with(f"""SELECT f.path AS location,
        row_number() OVER (PARTITION BY f.path ORDER BY c.name, c.ordinal) AS row_no, c.name,
        CASE WHEN c.is_dir THEN '{_FOLDER}' ELSE '{_FILE}' END AS item_label, c.path
        FROM catalog c JOIN (SELECT path, lower(path) AS k FROM catalog WHERE is_dir) f ON lower(c.parent) = f.k
        WHERE NOT starts_with(c.name, '.')"""),
    "rename_plan": _with("SELECT change_id, path, new_name, new_path, status FROM rplan"),
    "apply_renames": _with(rf"""SELECT ordinal, path, lower(path) AS path_key, string_split(path, '/')[-1] AS name,
          {_parent('path')} AS parent,
          CASE WHEN regexp_matches(path, '^[A-Za-z]:/[^/]*$') THEN '' ELSE regexp_extract(path, '([^/]+)/[^/]*$', 1) END AS parent_name,
          regexp_extract(lower(string_split(path, '/')[-1]), '^.+(\.[^.]+)$', 1) AS suffix
        FROM (
          SELECT pe.ordinal, string_agg(coalesce(o.new_name, pe.part), '/' ORDER BY pe.i) AS path
          FROM (SELECT s.ordinal, g.i, s.p[g.i] AS part, lower(array_to_string(s.p[1:g.i], '/')) AS anc_key
                FROM (SELECT ordinal, string_split(path, '/') AS p FROM catalog) s, generate_series(1, len(s.p)) g(i)) pe
          LEFT JOIN (SELECT lower(path) AS anc_key, new_name FROM rplan WHERE status = 'ok') o ON o.anc_key = pe.anc_key
          GROUP BY pe.ordinal)"""),
    # undo(apply(c)) == c: the oracle of undo is the catalog itself.
    "undo_renames": _with("SELECT ordinal, path, name, parent FROM catalog"),
    "resolve_location": _with(f"""SELECT r.request_id, {_norm('coalesce(l.path, r.custom)')} AS location
        FROM (SELECT ordinal AS request_id,
                CASE ordinal % 5 WHEN 0 THEN 'Desktop' WHEN 1 THEN 'documents' WHEN 2 THEN 'Downloads'
                  WHEN 3 THEN substr(path, 1, 1) || ':' ELSE 'custom' END AS label, path AS custom
              FROM catalog WHERE is_dir) r
        LEFT JOIN (SELECT * FROM (VALUES ('Desktop', 'C:/Users/me/Desktop'), ('Documents', 'C:/Users/me/Documents'),
                     ('Downloads', 'C:/Users/me/Downloads')) t(label, path)
                   UNION ALL SELECT letter || ':', letter || ':/' FROM drives) l
          ON lower(l.label) = lower(r.label)"""),
    "quarantine": _with("SELECT change_id, path, new_name, status FROM rplan WHERE status <> 'ok'"),
    "status_summary": _with("SELECT status, CAST(count(*) AS BIGINT) AS n FROM rplan GROUP BY status"),
    "stream_catalog_ingest": _with("SELECT ordinal, path, path_key, is_dir, name, parent, suffix, drive FROM catalog"),
}

_C1 = _MANIFEST + _create_sql("m", "man", "catalog")
_C2 = (_NESTED + _create_sql("n1", "nman", "catalog")
       + """,
nview AS (SELECT path_key, is_dir FROM catalog
  UNION ALL SELECT lower(path), true FROM n1_folders WHERE status IN ('created', 'kept'))"""
       + _create_sql("n2", "nman", "nview"))

ORACLE_SQL.update({
    "create_folders": "WITH " + _BASE + _C1 + "\nSELECT change_id, path, role, status FROM m_folders",
    "create_files": "WITH " + _BASE + _C1 + "\nSELECT change_id, path, status FROM m_files",
    "write_created_files": "WITH " + _BASE + _C1 + """
SELECT arg_min(path, change_id) AS path, arg_max(content, change_id) AS content
FROM m_files WHERE status IN ('created', 'overwritten') GROUP BY lower(path)""",
    "created_counts": "WITH " + _BASE + _C1 + f"""
SELECT {_parent('path')} AS folder, CAST(count(*) FILTER (WHERE status IN ('created', 'overwritten')) AS BIGINT) AS created
FROM m_files GROUP BY 1""",
    "create_folder_with_files": "WITH " + _BASE + _C2 + """
SELECT CAST(split_part(change_id, ':', 1) AS BIGINT) AS change_id, path, 'folder' AS kind, status FROM n1_folders
UNION ALL SELECT CAST(split_part(change_id, ':', 1) AS BIGINT), path, 'file', status FROM n2_files""",
})
