"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

LINE_DEDUP = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
w AS (SELECT doc_id, pos, line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS win FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
later AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS n FROM w WHERE win IS NOT NULL) WHERE n > 1),
cov AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, (VALUES (0), (1), (2)) AS t(k)),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(cov.pos) AS n_removed, string_agg(line, chr(10) ORDER BY l.pos) FILTER (cov.pos IS NULL) AS text FROM l LEFT JOIN cov ON cov.doc_id = l.doc_id AND cov.pos = l.pos GROUP BY 1)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text FROM d LEFT JOIN k USING (doc_id)
"""

MIXING = r"""
WITH s AS (SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || size || '/mix') AS h FROM (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents)),
n AS (SELECT source, source_size, CAST([5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS DOUBLE) AS w FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY 1)),
v AS (SELECT *, 3 * source_size AS cap, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM n
 WINDOW b AS (ORDER BY 3 * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT first(level ORDER BY cap / w) AS final FROM v WHERE level * w < cap),
t AS (SELECT source, source_size, CASE WHEN final IS NULL OR final * w >= cap THEN CAST(cap AS DOUBLE) ELSE final * w END AS target FROM v LEFT JOIN f ON true),
q AS (SELECT s.doc_id, s.source, s.size, t.source_size, t.target, sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS upto FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, e.k, CAST(e.k * source_size + upto AS DOUBLE) / greatest(target, 1e-9) AS finish FROM q, (VALUES (0), (1), (2)) AS e(k) WHERE e.k < greatest(1, least(3, CAST(ceil(target / greatest(source_size, 1)) AS INTEGER) + 1))),
o AS (SELECT finish, sum(size) OVER (ORDER BY finish) AS spent FROM c WHERE size > 0),
cut AS (SELECT max(finish) AS cut FROM o WHERE spent <= (SELECT sum(size) FROM s))
SELECT doc_id, source, size, source_size, target, CAST(size * count(*) FILTER (finish <= cut) AS BIGINT) AS taken FROM c, cut GROUP BY doc_id, source, size, source_size, target, upto
"""

_ASSIGN = """((?i:password|passwd|secret|token|api_?key))["\']?\\x20*[:=]\\x20*["\']?([A-Za-z0-9+/_.=-]+)""".replace("'", "''")


def _matches(kind: str, rank: int, pattern: str, group: int, keep: str) -> str:
    return f"""SELECT doc_id, owner, '{kind}' AS kind, {rank} AS rank, sum(length(piece)) OVER o + coalesce(sum(length(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, m, v, {keep} AS keep
FROM (SELECT doc_id, owner, unnest(ms) AS m, unnest(regexp_extract_all(text, '{pattern}', {group})) AS v, unnest(list_slice(string_split_regex(text, '{pattern}'), 1, len(ms))) AS piece, generate_subscripts(ms, 1) AS i
FROM (SELECT *, regexp_extract_all(text, '{pattern}') AS ms FROM d)) WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)"""


SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, chr(1)) AS owner FROM documents),
found AS ({_matches('assign', 1, _ASSIGN, 2, 'length(v) >= 12')} UNION ALL {_matches('access', 2, 'AKIA[A-Z0-9]+', 0, 'length(v) >= 18')} UNION ALL {_matches('hex', 3, '[0-9a-f]+', 0, 'length(v) >= 16')}
UNION ALL {_matches('owned', 4, '[A-Za-z0-9+/_.=-]+', 0, "length(v) >= 12")}),
spans AS (SELECT doc_id, owner, kind, rank, CAST(start AS BIGINT) AS start, CAST(start + length(m) AS BIGINT) AS stop, v FROM found WHERE keep),
base AS (SELECT * FROM spans WHERE rank < 4),
counts AS (SELECT v, list_distinct(string_split(v, '')) AS kinds, count(DISTINCT owner) > 1 OR count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), chr(1))) > 8 AS copied FROM base GROUP BY v),
values_ AS (SELECT v, copied, NOT copied AND len(kinds) >= 6 AND list_max(list_transform(kinds, lambda c: length(v) - length(replace(v, c, '')))) * 3 <= length(v) AND NOT contains(substring(v || v, 2, 2 * length(v) - 2), v)
 AND NOT regexp_matches(lower(v), 'example|sample|dummy|placeholder|changeme|change_me|your[_-]?|redacted|xxxx|1234567|abcdefg|qwerty|password|secret') AS live FROM counts),
word AS (SELECT v, (SELECT w FROM (SELECT unnest(string_split_regex(v, '[./=-]')) AS w) ORDER BY length(w) DESC, w DESC LIMIT 1) AS w FROM values_ WHERE live),
run AS (SELECT DISTINCT doc_id, start, v, unnest(string_split_regex(v, '[./=-]')) AS w FROM spans WHERE rank = 4),
place AS (SELECT doc_id, start, r.v AS run, word.v, list_filter(range(1, length(r.v) - length(word.v) + 2), lambda i: substring(r.v, i, length(word.v)) = word.v
  AND (i = 1 OR contains('./=-', substring(r.v, i - 1, 1)) OR contains('./=-', substring(word.v, 1, 1)))
  AND (i + length(word.v) > length(r.v) OR contains('./=-', substring(r.v, i + length(word.v), 1)) OR contains('./=-', right(word.v, 1)))) AS firsts FROM run r JOIN word USING (w)),
alone AS (SELECT doc_id, start, v, unnest(list_reduce(list_transform(firsts, lambda i: [i]), lambda a, x: CASE WHEN x[1] >= a[-1] + length(v) THEN list_concat(a, x) ELSE a END)) AS i FROM place WHERE len(firsts) > 0),
more AS (SELECT DISTINCT doc_id, 'owned' AS kind, 4 AS rank, start + i - 1 AS start, start + i - 1 + length(v) AS stop FROM alone),
kept AS (SELECT m.* FROM more m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = m.doc_id AND m.start < b.stop AND b.start < m.stop)),
b AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS w,
 count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied, count(*) FILTER (NOT live AND NOT copied) AS n_plain FROM base JOIN values_ USING (v) GROUP BY 1),
e AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans FROM (SELECT doc_id, kind, rank, start, stop FROM base UNION ALL SELECT doc_id, kind, rank, start, stop FROM kept) GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(w, '')) AS base_sha256, coalesce(spans, '') AS spans,
coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(n_plain, 0) AS n_plain FROM d LEFT JOIN b USING (doc_id) LEFT JOIN e USING (doc_id)
"""


RECIPES = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents) WINDOW w AS (PARTITION BY t)
"""


TRIE = """
WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS x FROM conversations WHERE conv_id IS NOT NULL),
tab AS (SELECT list(crc ORDER BY n) AS tab FROM (SELECT n, list_reduce(list_concat([n], range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS crc FROM (SELECT unnest(range(256)) AS n))),
ids AS (SELECT c, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))), lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 9 AS h FROM (SELECT DISTINCT c FROM o), tab),
turns AS (SELECT ids.c, o.i, 0 AS own, o.x FROM ids JOIN o ON o.c = ids.c - ids.c % 5 AND o.i <= h UNION ALL SELECT ids.c, o.i, 1, o.x FROM ids JOIN o ON o.c = ids.c AND o.i > h),
built AS (SELECT ids.c, coalesce(list(x ORDER BY own, i) FILTER (i IS NOT NULL), []) AS l FROM ids LEFT JOIN turns ON turns.c = ids.c GROUP BY ids.c),
pre AS (SELECT c, d, l[1:d] AS p, len(l) = d AS ends FROM built, unnest(range(len(l) + 1)) AS u(d)),
node AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256, (count(*) - 1) * coalesce(octet_length(encode(p[d].t)), 0) AS saved FROM pre GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
full_ AS (SELECT node.*, coalesce(kids.n, 0) AS n_children, up.conv_id AS parent_conv_id FROM node LEFT JOIN kids ON kids.p = node.p LEFT JOIN node up ON up.p = node.p[1:node.d - 1] AND up.d = node.d - 1),
sums AS (SELECT p[1:k] AS p, CAST(sum(saved) AS BIGINT) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM full_, unnest(range(d + 1)) AS u(k) GROUP BY 1)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM full_ JOIN sums USING (p)
"""


def _lloyd(rounds: int = 4) -> str:
    near = "SELECT id, p, x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT v.id, v.p, v.x, b.e, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM part v JOIN {book} b USING (p)) GROUP BY id, p, x"
    steps = []
    for n in range(rounds):
        steps.append(f"""near{n} AS ({near.format(book=f'book{n}')}),
book{n + 1} AS (SELECT b.p, b.e, CASE WHEN m.x IS NULL THEN b.x ELSE m.x END AS x FROM book{n} b LEFT JOIN (SELECT p, e, list(CAST(floor(s / c) AS BIGINT) ORDER BY i) AS x FROM (SELECT p, e, i, sum(y) AS s, count(*) AS c FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM near{n}) GROUP BY ALL) GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)""")
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
part AS (SELECT id, p, x[p * (len(x) // 4) + 1:(p + 1) * (len(x) // 4)] AS x FROM kept, (VALUES (0), (1), (2), (3)) AS t(p)),
book0 AS (SELECT p, id - 1 AS e, x FROM part WHERE id <= 256),
{','.join(steps)},
last AS ({near.format(book=f'book{rounds}')}),
coded AS (SELECT vec_id, label, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM last JOIN kept USING (id) GROUP BY id, vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256 FROM coded
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_lloyd": _lloyd(), "op3_line_dedup": LINE_DEDUP, "op6_secrets": SECRETS, "op7_mixing": MIXING, "op12_trie": TRIE, "op13_recipes": RECIPES}
