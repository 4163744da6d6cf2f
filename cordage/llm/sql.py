"""DuckDB SQL that gives the same rows as the queries that SQL can express."""

from __future__ import annotations

from . import chat

URLS = """
WITH p AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) v(action, rule_host, rule_path)),
f AS (SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(action, length(rule_host || rule_path)) AS action
      FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN f ON u.page_id = f.page_id"""

# Written out here, so that a wrong pattern of the operator can't pass on both sides.
_PATTERNS = [
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    ("access", r"AKIA[A-Z0-9]{16,}"),
    ("hex", r"[0-9a-f]{24,}"),
    ("owned", r"[A-Za-z0-9+/_-]{24,}"),
]
_PLACES = " UNION ALL ".join(
    f"SELECT doc_id, source, {k} AS rank, '{kind}' AS kind, string_split_regex(text, $p${pattern}$p$) AS pieces, regexp_extract_all(text, $p${pattern}$p$) AS matches FROM documents WHERE regexp_matches(text, $p${pattern}$p$)"
    for k, (kind, pattern) in enumerate(_PATTERNS)
)

SECRETS = f"""
WITH s AS ({_PLACES}),
x AS (SELECT doc_id, source, rank, kind, unnest(range(1, len(matches) + 1)) AS i, pieces, matches FROM s),
y AS (SELECT doc_id, source, rank, kind, matches[i] AS m, CAST(sum(length(pieces[i]) + length(matches[i])) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop FROM x),
z AS (SELECT *, stop - length(m) AS start, CASE WHEN kind = 'assign' THEN regexp_extract(m, $p${_PATTERNS[0][1]}$p$, 2) ELSE m END AS value FROM y),
c AS (SELECT * FROM z WHERE CASE kind WHEN 'assign' THEN length(value) >= 6 WHEN 'owned' THEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') ELSE true END),
k AS (SELECT * FROM c WHERE kind <> 'owned' OR NOT EXISTS (SELECT 1 FROM c b WHERE b.doc_id = c.doc_id AND b.kind <> 'owned' AND b.start < c.stop AND b.stop > c.start)),
o AS (SELECT value, count(DISTINCT coalesce(source, '')) AS owners, count(DISTINCT doc_id) AS repos FROM k GROUP BY value),
l AS (SELECT * FROM (SELECT k.*, owners, repos, owners <= 2 AND repos <= 8 AS live FROM k JOIN o USING (value)) WHERE kind <> 'owned' OR live),
g AS (SELECT doc_id, max(owners) AS max_owners, max(repos) AS max_repos, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'owned') AS n_owned, count(*) FILTER (live) AS n_live,
      string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (kind <> 'owned') AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned, coalesce(n_live, 0) AS n_live, coalesce(max_owners, 0) AS max_owners, coalesce(max_repos, 0) AS max_repos
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id"""


def chat_sql(control: str) -> str:
    escaped = "replace(replace({0}, '\\', '\\b'), '<|', '<\\p|')"
    order = "(PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{control}'), (-1, 1, 'assistant', '{control}'))),
a AS (SELECT *, CAST(ceil(strlen(text) / 4.0) AS BIGINT) + 4 AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM t),
b AS (SELECT *, place = 1 AND role = 'system' AS sys FROM a),
c AS (SELECT *, sum(CASE WHEN sys THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS kept, sum(CASE WHEN sys THEN 0 ELSE tokens END) OVER {order} AS until FROM b),
d AS (SELECT *, greatest(1, floor(({chat.BUDGET - chat.HISTORY} - kept) / 2)) AS half, until - CASE WHEN sys THEN 0 ELSE tokens END AS since FROM c),
e AS (SELECT *, floor((until - 1) / half) AS bin, NOT sys AND tokens > half AS long FROM d),
f AS (SELECT *, CASE WHEN sys OR lag(sys) OVER w IS NULL OR lag(sys) OVER w THEN 0 WHEN long OR lag(long) OVER w OR bin <> lag(bin) OVER w THEN 1 ELSE 0 END AS begins FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
g AS (SELECT *, sum(begins) OVER (PARTITION BY conv_id ORDER BY place) AS span FROM f),
h AS (SELECT *, max(span) OVER (PARTITION BY conv_id) AS spans, max(until) OVER (PARTITION BY conv_id, span) AS ends FROM g),
i AS (SELECT *, CASE WHEN sys THEN spans + 1 WHEN span < spans AND ends - since <= {chat.HISTORY} THEN 2 ELSE 1 END * ({len(chat.START) + len(chat.END) + 2} + length(replace({escaped.format("role")}, chr(10), '\\l')) + length({escaped.format("text")})) AS chars FROM h)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM i GROUP BY conv_id"""

# Words are split by a pattern of their own, all scores are computed, then ranked.
SEARCH = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS words FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item_id, text, term, count(*) AS times FROM i GROUP BY ALL),
s AS (SELECT count(*) AS docs, CAST(sum(len(words)) AS BIGINT) AS terms FROM d WHERE len(words) > 0),
x AS (SELECT r, doc_id, len(words) AS n, unnest(words) AS term FROM d),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM x WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
c AS (SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)) AS c FROM p, s),
y AS (SELECT item_id, text, r, doc_id, CAST(sum(times * w * c) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN c USING (term) GROUP BY ALL),
z AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM y WHERE score > 0)
SELECT * FROM z WHERE rank <= 10"""

# Near words meet in what is left when the letter at one place is taken out, or is any letter.
SPELLING = """
WITH RECURSIVE t AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY b) AS crcs FROM range(256) r(b)),
x AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')) AS run FROM documents),
l AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times FROM x WHERE length(run) >= 5 GROUP BY ALL),
b AS (SELECT run, times, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END)) AS bytes FROM l),
h AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, c: xor(a >> 8, crcs[xor(a & 255, c) + 1])), 4294967295) AS h FROM b, t),
k AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM h),
v AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM k WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
o AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
g AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM o),
a AS (SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS pattern FROM o),
near AS (SELECT g.word, v.word AS other, v.n AS other_n FROM g JOIN v ON v.word = g.less
  UNION ALL SELECT v.word, g.word, g.n FROM g JOIN v ON v.word = g.less
  UNION ALL SELECT a.word, c.word, c.n FROM a JOIN a c ON a.pattern = c.pattern AND a.word <> c.word),
f AS (SELECT word, n, (SELECT count(*) FROM near WHERE near.word = v.word) AS n_near FROM v),
m AS (SELECT word, other, other_n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place FROM near) WHERE place = 1),
e AS (SELECT f.word, n, n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM f LEFT JOIN m ON m.word = f.word),
u AS (SELECT word, form, word AS at, form AS up FROM e UNION ALL SELECT u.word, u.form, e.word, e.form FROM u JOIN e ON e.word = u.up)
SELECT e.word, e.form, u.at AS root, e.n, e.n_near, e.form_n FROM e JOIN u ON u.word = e.word AND u.up IS NULL"""
