"""SQL counterparts of the queries in this package, for DuckDB over the same tables."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

_LINE_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '{_WORD}') AS ws FROM d),
windows AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
),
repeated AS (
  SELECT rid, count(*) AS n_repeat_words FROM (
    SELECT DISTINCT rid, i + unnest([0, 1, 2]) AS word
    FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM windows) WHERE n >= 2
  ) GROUP BY rid
),
lines AS (
  SELECT rid, line, len(regexp_extract_all(line, '{_WORD}')) AS lw,
         coalesce(list_sum(list_transform(regexp_extract_all(line, '{_WORD}'), lambda x: length(x))), 0) AS chars
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
),
judged AS (
  SELECT *, (
      NOT regexp_matches(line, '[.!?…]["''”’»)\]]*([\x20\x09-\x0D]|$)')
      OR len(regexp_extract_all(line, '[#*$%&|<>]')) * 10 > length(line)
      OR (len(regexp_extract_all(line, '[|»›•·]')) >= 2 AND len(regexp_extract_all(line, '[|»›•·]')) * 4 >= lw)
      OR (lw <= 15 AND regexp_matches(lower(line), 'accept cookies|all rights reserved|click here|cookie policy|enable javascript|log in|lorem ipsum|powered by|privacy policy|read more|sign in|sign up|subscribe to|terms of service|terms of use'))
    ) AS bad
  FROM lines WHERE lw > 0
),
per_doc AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
         count(*) FILTER (bad) AS n_failed_lines, coalesce(sum(chars) FILTER (bad), 0) AS failed_chars
  FROM judged GROUP BY rid
),
counts AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0)::BIGINT AS n_lines,
         coalesce(n_failed_lines, 0)::BIGINT AS n_failed_lines,
         coalesce(failed_chars, 0)::BIGINT AS failed_chars
  FROM d JOIN w USING (rid) LEFT JOIN per_doc USING (rid) LEFT JOIN repeated USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND failed_chars <= 0.5 * word_chars) AS kept,
       n_lines, n_failed_lines, failed_chars
FROM counts
"""

_SECRETS = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS owner, doc_id AS repo, coalesce(text, '') AS text FROM documents),
kinds(rank, kind, pattern, grp, least_chars) AS (VALUES
  (0, 'assign', '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 20), (2, 'hex', '[0-9a-f]{24,}', 0, 24), (3, 'bare', '[A-Za-z0-9_-]{32,}', 0, 32)),
parts AS (
  SELECT rid, owner, repo, 0 AS rank, 6 AS least_chars, string_split_regex(text, (SELECT pattern FROM kinds WHERE rank = 0)) AS gaps,
         regexp_extract_all(text, (SELECT pattern FROM kinds WHERE rank = 0), 0) AS hits,
         regexp_extract_all(text, (SELECT pattern FROM kinds WHERE rank = 0), 2) AS vals FROM d
  UNION ALL
  SELECT rid, owner, repo, rank, least_chars, string_split_regex(text, pattern), regexp_extract_all(text, pattern, 0),
         regexp_extract_all(text, pattern, 0) FROM d, kinds WHERE rank > 0
),
each AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM parts WHERE len(hits) > 0),
spans AS (
  SELECT rid, owner, repo, rank, vals[i] AS value, least_chars,
         list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS b,
         length(hits[i]) AS n
  FROM each
),
ok AS (SELECT rid, owner, repo, rank, value, b::BIGINT AS b, (b + n)::BIGINT AS e FROM spans WHERE length(value) >= least_chars),
cand AS (
  SELECT * FROM ok o WHERE rank < 3 OR NOT EXISTS (
    SELECT 1 FROM ok p WHERE p.rid = o.rid AND p.rank < 3 AND p.b < o.e AND o.b < p.e)
),
own AS (
  SELECT value, count(DISTINCT coalesce(owner, chr(0))) AS n_owners,
         count(DISTINCT struct_pack(o := coalesce(owner, chr(0)), r := coalesce(repo::VARCHAR, ''))) AS n_repos FROM cand GROUP BY value
),
classed AS (
  SELECT c.*, n_repos, n_owners >= 2 OR n_repos >= 5 AS copied,
         n_owners < 2 AND n_repos < 5 AND length(value) >= 20 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
         AND NOT regexp_matches(value, '(?i)example|sample|changeme|placeholder|your|dummy|xxxx|0000|1234') AS live
  FROM cand c JOIN own USING (value)
),
reported AS (
  SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
         string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) FILTER (rank < 3) AS base,
         string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) AS spans,
         count(*) FILTER (copied) AS n_copied, count(*) FILTER (live) AS n_live, max(n_repos) AS n_repos
  FROM classed JOIN kinds USING (rank) WHERE rank < 3 OR live GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_copied, 0)::BIGINT AS n_copied, coalesce(n_live, 0)::BIGINT AS n_live,
       coalesce(n_repos, 0)::BIGINT AS n_repos
FROM d LEFT JOIN reported USING (rid)
"""

_NEAR_DUP = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws
  FROM documents
),
sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 2 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0)
),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM pairs JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(doc_id, to_id) AS (SELECT a, a FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.to_id),
smallest AS (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, w.doc_id) AS component_id,
       coalesce(component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN size USING (doc_id) LEFT JOIN smallest USING (doc_id)
"""

_SET_JOIN = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws
  FROM documents
),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) < 4 THEN ws ELSE ws[i:i + 3] END, ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)
),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM pairs JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(doc_id, to_id) AS (SELECT a, a FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.to_id),
smallest AS (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, w.doc_id) AS component_id
FROM w LEFT JOIN size USING (doc_id) LEFT JOIN smallest USING (doc_id)
"""

# The response among equal payloads is the one with the smallest page_id; the others revisit it.
_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
f AS (SELECT payload, min(page_id) AS first_id FROM p GROUP BY payload),
h AS (SELECT page_id, first_id, payload, unhex(sha1(payload)) AS raw FROM p JOIN f USING (payload)),
bits AS (
  SELECT page_id, first_id, payload,
         list_reduce(list_transform(range(1, 41), lambda i: lpad(bin(('0x' || substr(hex(raw), i, 1))::INT), 4, '0')), lambda x, y: x || y) AS b
  FROM h
)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
       list_reduce(list_transform(range(0, 32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         list_reduce(list_transform(range(1, 6), lambda k: substr(b, g * 5 + k, 1)::INT), lambda x, y: x * 2 + y) + 1, 1)), lambda x, y: x || y) AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM bits
"""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_MARKS = "[.!?…‼⁇⁈⁉。！．？｡؟۔।॥։።፧။។⸮]"
_CLOSERS = "[\"'')\\]}»’”›》」』】）]"


def _wrapped(value: str) -> str:
    return f"(({value}) % 18446744073709551616::UHUGEINT)"


def _scrambled(value: str, factor: int) -> str:
    """One step of ``tokens.mix``: fold the upper half in, then multiply."""
    return _wrapped(f"xor({value}, ({value}) >> 33) * {factor}::UHUGEINT")


# The hash of a word, of which only the order matters here: a polynomial in its bytes modulo 2**64, scrambled.
_WORD_HASHES = f"""
words AS (SELECT DISTINCT w FROM tok),
poly AS (
  SELECT w, list_reduce(list_prepend(0::UHUGEINT, list_reverse(list_transform(range(0, octet_length(encode(w))),
           lambda i: (('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::INT + 1)::UHUGEINT))),
         lambda h, byte: {_wrapped(f'h * {0x9E3779B97F4A7C15}::UHUGEINT + byte')}) AS h FROM words
),
long0 AS (SELECT w, {_wrapped(f'h + octet_length(encode(w))::UHUGEINT * {0xD6E8FEB86659FD93}::UHUGEINT')} AS h FROM poly),
long1 AS (SELECT w, {_scrambled('h', 0xFF51AFD7ED558CCD)} AS h FROM long0),
long2 AS (SELECT w, {_scrambled('h', 0xC4CEB9FE1A85EC53)} AS h FROM long1),
hashed AS (SELECT w, xor(h, h >> 33) AS h FROM long2)"""

_SPANS = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_FOLD} AS t FROM documents),
lines AS (
  SELECT rid, doc_id, li, regexp_extract_all(line, '{_WORD}') AS ws
  FROM (SELECT rid, doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS li FROM d)
),
tok AS (SELECT rid, doc_id, li, unnest(ws) AS w, generate_subscripts(ws, 1) AS wi FROM lines WHERE len(ws) > 0),
{_WORD_HASHES},
flag AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY li, wi) - 1 AS g,
         (regexp_matches(w, '{_MARKS}$') OR regexp_matches(w, '{_MARKS}{_CLOSERS}$'))::INT AS done
  FROM tok JOIN hashed USING (w)
),
sent AS (
  SELECT *, coalesce(sum(done) OVER (PARTITION BY rid, li ORDER BY wi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sn
  FROM flag
),
sized AS (SELECT *, count(*) OVER (PARTITION BY rid, li, sn) AS size FROM sent),
-- Of every eight words running in a long sentence the one with the least hash, the last of equals, ends a piece.
least AS (
  SELECT rid, min(struct_pack(h := h, back := -g)) OVER win AS m, count(*) OVER win AS n FROM sized WHERE size > 15
  WINDOW win AS (PARTITION BY rid, li, sn ORDER BY wi ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)
),
ends AS (SELECT DISTINCT rid, -m.back AS g FROM least WHERE n = 8),
piece AS (
  SELECT z.*, coalesce(sum((e.g IS NOT NULL)::INT) OVER (
           PARTITION BY z.rid, z.li, z.sn ORDER BY z.wi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pc
  FROM sized z LEFT JOIN ends e ON e.rid = z.rid AND e.g = z.g
),
s AS (
  SELECT rid, doc_id, a, b, row_number() OVER (PARTITION BY rid ORDER BY a) AS k
  FROM (SELECT rid, doc_id, min(g) AS a, max(g) + 1 AS b FROM piece GROUP BY rid, doc_id, li, sn, pc)
),
runs AS (
  SELECT x.rid, x.doc_id, x.a, min(y.b) AS b
  FROM s x JOIN s y ON y.rid = x.rid AND y.k > x.k AND y.k <= x.k + 20 AND y.b - x.a >= 20 GROUP BY ALL
),
named AS (
  SELECT r.doc_id, a, b, array_to_string(ws[a + 1:b], ' ') AS run
  FROM runs r JOIN (SELECT rid, regexp_extract_all(t, '{_WORD}') AS ws FROM d) USING (rid)
),
firsts AS (SELECT run, min(struct_pack(id := doc_id, at := a)) AS f FROM named GROUP BY run HAVING count(*) > 1),
again AS (
  SELECT DISTINCT doc_id, a, b, f.id AS first_id FROM named JOIN firsts USING (run) WHERE NOT (doc_id = f.id AND a = f.at)
),
opened AS (
  SELECT *, CASE WHEN a > coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)
                 THEN 1 ELSE 0 END AS o
  FROM again
),
grouped AS (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY a, b) AS stretch FROM opened)
SELECT doc_id, min(a)::BIGINT AS first_word, (max(b) - min(a))::BIGINT AS n_words, min(first_id) AS first_doc_id
FROM grouped GROUP BY doc_id, stretch
"""

# Fingerprints only save work: the rows are those of the exact similarity over every window.
_LEAKS = rf"""
WITH i AS (
  SELECT row_number() OVER () AS iid, item_id, ws, len(ws) AS n, least(5, len(ws)) AS k
  FROM (SELECT item_id, regexp_extract_all({_FOLD}, '{_WORD}') AS ws FROM benchmark) WHERE len(ws) > 0
),
ig AS (
  SELECT iid, k, g, count(*) AS c, max(w) AS w FROM (
    SELECT iid, k, array_to_string(ws[p:p + k - 1], ' ') AS g,
           list_sum(list_transform(ws[p:p + k - 1], lambda x: octet_length(encode(x)))) AS w
    FROM (SELECT *, unnest(range(1, n - k + 2)) AS p FROM i)
  ) GROUP BY ALL
),
total AS (SELECT iid, sum(c * w) AS t FROM ig GROUP BY iid),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_FOLD}, '{_WORD}') AS ws FROM documents
),
dg AS (
  SELECT rid, k, p, array_to_string(ws[p:p + k - 1], ' ') AS g
  FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i) WHERE len(ws) >= k)
),
hits AS (SELECT rid, iid, p - 1 AS p, g, c, w FROM dg JOIN ig USING (k, g)),
windows AS (
  SELECT h.rid, h.iid, least(i.n, len(d.ws)) AS m, i.k, unnest(range(0, len(d.ws) - least(i.n, len(d.ws)) + 1)) AS s
  FROM (SELECT DISTINCT rid, iid FROM hits) h JOIN i USING (iid) JOIN d USING (rid)
),
shared AS (
  SELECT q.rid, q.iid, q.s, q.m, sum(least(q.found, q.c) * q.w) AS common FROM (
    SELECT x.rid, x.iid, x.s, x.m, h.g, h.c, h.w, count(*) AS found
    FROM windows x JOIN hits h ON h.rid = x.rid AND h.iid = x.iid AND h.p BETWEEN x.s AND x.s + x.m - x.k
    GROUP BY ALL
  ) q GROUP BY ALL
),
ranked AS (
  SELECT *, common::DOUBLE / t::DOUBLE AS similarity,
         row_number() OVER (PARTITION BY rid, iid ORDER BY common DESC, s) AS place
  FROM shared JOIN total USING (iid)
)
SELECT doc_id, item_id, similarity, s::BIGINT AS first_word, m::BIGINT AS n_words
FROM ranked JOIN d USING (rid) JOIN i USING (iid) WHERE place = 1 AND similarity >= 0.8
"""


def mix_ctes(table: str) -> str:
    """CTEs ending in ``mixed`` (rid, doc_id, source, n_tokens, block, slot) over ``table``."""
    return rf"""
md AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce('=' || source, '') AS ms,
         len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS n_tokens
  FROM {table}
),
src AS (SELECT ms, sum(n_tokens)::BIGINT AS t FROM md GROUP BY ms),
lists AS (SELECT list(t::DOUBLE) AS ts, sum(t)::DOUBLE AS total FROM src WHERE t > 0),
bisect(step, lo, hi) AS (
  SELECT 0, 0::BIGINT, 16777216::BIGINT
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM (
    SELECT step, lo, hi, (lo + hi) // 2 AS mid,
           list_max(list_transform(ts, lambda t: power(t / total, ((lo + hi) // 2) / 16777216.0::DOUBLE) / t))
           * list_max(list_transform(ts, lambda t: t / power(t / total, ((lo + hi) // 2) / 16777216.0::DOUBLE))) <= 2.0 AS ok
    FROM bisect, lists WHERE step < 24
  )
),
expo AS (SELECT CASE WHEN total IS NULL THEN 1.0 ELSE hi / 16777216.0::DOUBLE END AS a FROM bisect, lists WHERE step = 24),
pw AS (SELECT ms, t, CASE WHEN t > 0 THEN power(t / total, a) ELSE 0 END AS p FROM src, lists, expo),
plan AS (
  SELECT ms, t, CASE WHEN t > 0 THEN b // t ELSE 1 END AS full_blocks, CASE WHEN t > 0 THEN b - (b // t) * t ELSE 0 END AS rest
  FROM (SELECT ms, t, greatest(t, round(p * (SELECT max(t / p) FROM pw WHERE t > 0))::BIGINT) AS b FROM pw)
),
uses AS (
  SELECT rid, md.doc_id, source, md.ms, n_tokens, full_blocks, rest, block, md5(concat_ws(':', md.doc_id, block)) AS k
  FROM (SELECT *, unnest(range(0, full_blocks + 1)) AS block FROM plan) q JOIN md ON md.ms = q.ms
),
fits AS (SELECT *, sum(n_tokens) OVER (PARTITION BY ms, block ORDER BY k) AS run FROM uses),
mixed AS (
  SELECT rid, doc_id, source, n_tokens, block::BIGINT AS block,
         row_number() OVER (PARTITION BY ms, block ORDER BY k, n_tokens) - 1 AS slot
  FROM fits WHERE block < full_blocks OR (rest > 0 AND run <= rest)
)"""


_MIX = f"WITH RECURSIVE {mix_ctes('documents')} SELECT doc_id, source, n_tokens, block, slot FROM mixed"


_UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"

_INFILL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
  SELECT *, regexp_extract_all(t, '{_UNITS}') AS us, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d
),
f AS (
  SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM u
),
p AS (
  SELECT *, coalesce(array_to_string(us[1:a], ''), '') AS pre, coalesce(array_to_string(us[a + 1:b], ''), '') AS mid,
         coalesce(array_to_string(us[b + 1:], ''), '') AS suf FROM f
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


def _counted(value: str) -> str:
    return f"coalesce(octet_length(encode(({value})::VARCHAR)) || ':' || ({value})::VARCHAR, '-')"


def _tree(name: str, levels: int) -> str:
    """CTEs ``{name}1`` to ``{name}{levels}`` over ``{name}0`` (k, p, h), the runs below them, and every group's end."""
    parts = []
    for j in range(levels):
        parts.append(f"""
{name}r{j} AS (
  SELECT k, p // 16 AS r, list(h ORDER BY p) AS hs FROM {name}{j}
  WHERE k IN (SELECT k FROM {name}{j} GROUP BY k HAVING count(*) > 1) GROUP BY k, p // 16
),
{name}{j + 1} AS (SELECT k, r AS p, sha256(array_to_string(hs, '')) AS h FROM {name}r{j})""")
    ends = " UNION ALL ".join(f"SELECT k, any_value(h) AS h FROM {name}{j} GROUP BY k HAVING count(*) = 1" for j in range(levels + 1))
    return ",".join(parts) + f",\n{name}end AS ({ends})"


def _climb(name: str, tree: str, levels: int) -> str:
    """CTEs that carry ``{name}0`` (rid, k, p, v, sib) up: the folded value and the siblings met."""
    parts = []
    for j in range(levels):
        left, right = "array_to_string(hs[1:p % 16], '')", "array_to_string(hs[p % 16 + 2:], '')"
        parts.append(f"""
{name}{j + 1} AS (
  SELECT rid, a.k, p // 16 AS p, CASE WHEN hs IS NULL THEN v ELSE sha256(coalesce({left}, '') || v || coalesce({right}, '')) END AS v,
         sib || coalesce({left}, '') || coalesce({right}, '') AS sib
  FROM {name}{j} a LEFT JOIN {tree}r{j} b ON a.k = b.k AND b.r = a.p // 16
)""")
    return ",".join(parts)


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, range(0, 8 * length(doc_id::VARCHAR))), lambda c, j:
  xor((CASE WHEN j % 8 = 0 THEN xor(c, ascii(substr(doc_id::VARCHAR, j // 8 + 1, 1))::BIGINT) ELSE c END) >> 1,
      ((CASE WHEN j % 8 = 0 THEN xor(c, ascii(substr(doc_id::VARCHAR, j // 8 + 1, 1))::BIGINT) ELSE c END) & 1) * 3988292384::BIGINT)), 4294967295::BIGINT)"""

# Six levels hold sixteen million rows per source, four levels 65,536 sources.
_MERKLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS k, text, {_CRC} AS crc,
         {' || '.join(_counted(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} AS head FROM documents
),
l AS (
  SELECT rid, doc_id, k, sha256(head || {_counted('text')}) AS leaf,
         CASE WHEN crc % 5 = 0 THEN sha256(head || {_counted("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS changed FROM d
),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM l),
s0 AS (SELECT k, p, leaf AS h FROM o),{_tree('s', 6)},
t0 AS (SELECT '' AS k, row_number() OVER (ORDER BY encode(k)) - 1 AS p, h FROM send),{_tree('t', 4)},
a0 AS (SELECT rid, k, p, coalesce(changed, leaf) AS v, '' AS sib FROM o),{_climb('a', 's', 6)},
b0 AS (
  SELECT rid, '' AS k, q.p, v, sib FROM a6 JOIN (SELECT k, row_number() OVER (ORDER BY encode(k)) - 1 AS p FROM send) q USING (k)
),{_climb('b', 't', 4)}
SELECT o.doc_id, o.leaf, send.h AS subroot, tend.h AS root, sha256(b4.sib) AS proof_sha256, b4.v AS folded_root, b4.v = tend.h AS verified
FROM o JOIN send USING (k) JOIN b4 USING (rid) CROSS JOIN tend
"""


def llm_oracles() -> dict[str, str]:
    """Query name to SQL."""
    return {
        "op1_warc_salvage": _WARC,
        "op2_minmax_near_dup": _NEAR_DUP,
        "op4_sentence_spans": _SPANS,
        "op5_temperature_mix": _MIX,
        "op6_secret_ownership": _SECRETS,
        "op9_simhash_leaks": _LEAKS,
        "op10_line_rules": _LINE_RULES,
        "op11_partition_join": _SET_JOIN,
        "op12_merkle_manifest": _MERKLE,
        "op13_infill": _INFILL,
    }
