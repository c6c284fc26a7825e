"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import string

from samplewell.llm import secrets

_PATTERNS = [(*k, rank) for rank, k in enumerate((*secrets.BASE, secrets.GENERIC))]


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _kind(name: str, pattern: str, group: int, least: int, rank: int) -> str:
    p = _quoted(pattern)
    return f"""SELECT doc_id, owner, '{name}' kind, {rank} rank, m, g, v, unnest(range(1, len(m) + 1)) k, {least} least FROM
(SELECT doc_id, owner, regexp_extract_all(text, {p}) m, string_split_regex(text, {p}) g, regexp_extract_all(text, {p}, {group}) v FROM d) WHERE len(m) > 0"""


OP1 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner FROM documents),
raw AS ({' UNION ALL '.join(_kind(*k) for k in _PATTERNS)}),
placed AS (SELECT doc_id, owner, kind, rank, least, v[k] AS value, length(m[k]) AS n,
 coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) AS s FROM raw),
kept AS (SELECT doc_id, owner, kind, rank, value, CAST(s AS BIGINT) s, CAST(s + n AS BIGINT) e FROM placed WHERE length(value) >= least
 AND (kind <> 'generic' OR (regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')))),
cand AS (SELECT * FROM kept a WHERE kind <> 'generic' OR NOT EXISTS (SELECT 1 FROM kept b WHERE b.doc_id = a.doc_id AND b.kind <> 'generic' AND b.s < a.e AND a.s < b.e)),
freq AS (SELECT value, count(DISTINCT owner) <= {secrets.LIVE_OWNERS} AS live FROM cand GROUP BY value),
spans AS (SELECT DISTINCT doc_id, kind, rank, s, e, live FROM cand JOIN freq USING (value) WHERE kind <> 'generic' OR live),
agg AS (SELECT doc_id, count(*) FILTER (kind = 'assign') n_assign, count(*) FILTER (kind = 'access') n_access, count(*) FILTER (kind = 'hex') n_hex,
 coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (kind <> 'generic'), '') base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) spans,
 count(*) FILTER (live) n_live, count(*) FILTER (NOT live) n_copied FROM spans GROUP BY doc_id)
SELECT i.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans, coalesce(n_live, 0) n_live, coalesce(n_copied, 0) n_copied
FROM (SELECT DISTINCT doc_id FROM documents) i LEFT JOIN agg USING (doc_id)"""

OP5 = r"""WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM documents), iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM benchmark),
it AS (SELECT item_id, w, least(5, len(w)) size, len(w) - least(5, len(w)) + 1 m FROM iw WHERE len(w) > 0),
ish AS (SELECT item_id, size, m, array_to_string(w[q:q + size - 1], ' ') sh FROM (SELECT *, unnest(range(1, m + 1)) q FROM it)),
dsh AS (SELECT doc_id, size, n, CAST(p - 1 AS BIGINT) p, array_to_string(w[p:p + size - 1], ' ') sh FROM (SELECT doc_id, w, size, len(w) - size + 1 n, unnest(range(1, len(w) - size + 2)) p FROM dw, (SELECT DISTINCT size FROM it) WHERE len(w) >= size)),
ic AS (SELECT item_id, size, m, sh, count(*) c FROM ish GROUP BY ALL), dc AS (SELECT doc_id, size, n, sh, count(*) c FROM dsh GROUP BY ALL),
pairs AS (SELECT doc_id, item_id, size, m, n FROM dc JOIN ic USING (size, sh) GROUP BY ALL HAVING sum(least(dc.c, ic.c)) * 1.8 >= 0.8 * (m + least(m, n)) - 1e-9),
win AS (SELECT *, unnest(range(0, greatest(0, n - m) + 1)) s FROM pairs),
hits AS (SELECT pairs.doc_id, pairs.item_id, p, sh, c FROM pairs JOIN dsh USING (doc_id, size) JOIN ic USING (item_id, size, sh)),
wc AS (SELECT win.doc_id, win.item_id, m, n, s, sh, c, count(*) k FROM win JOIN hits ON hits.doc_id = win.doc_id AND hits.item_id = win.item_id AND p >= s AND p < s + m GROUP BY ALL),
b AS (SELECT doc_id, item_id, m, n, s, sum(least(k, c)) b FROM wc GROUP BY ALL),
sim AS (SELECT doc_id, item_id, s, b / (m + least(m, n) - b) similarity FROM b)
SELECT doc_id, item_id, round(CAST(max(similarity) AS DOUBLE), 6) similarity, CAST(arg_max(s, (similarity, -s)) AS BIGINT) start_word FROM sim WHERE similarity >= 0.8 GROUP BY doc_id, item_id"""

OP10 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+') w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id x, b.doc_id y, count(*) i FROM sh a JOIN sh b USING (s) JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id WHERE a.doc_id <> b.doc_id AND na.n * 100 >= nb.n * 90 AND nb.n * 100 >= na.n * 90 GROUP BY ALL),
links AS (SELECT x, y FROM both_ JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * i >= 90 * (na.n + nb.n - i)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) m FROM reach GROUP BY x) c ON c.x = d.doc_id"""

ORACLES: dict[str, str] = {"op1_secret_scan": OP1, "op5_decontaminate": OP5, "op10_jaccard_join": OP10}
