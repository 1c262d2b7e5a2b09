"""The results of queries as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from .fingerprint import LANES, SHIFTS, WORDS
from .quality import BOILERPLATE

WORD = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
  [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '{WORD}')] AS ls FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n > 1) GROUP BY doc_id),
k AS (SELECT doc_id, [x for x in ls if regexp_matches(x, '[.!?…。]([ \t\n\x0B\f\r"''”’»)\]]|$)') AND 10 * length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) <= length(x)
  AND NOT regexp_matches(x, '[|»›•].*[|»›•]') AND NOT regexp_matches(x, '(?i){"|".join(BOILERPLATE)}')] AS good FROM w),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in ws]), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
  length(array_to_string(ls, chr(10))) AS held, length(array_to_string(good, chr(10))) AS kept_chars FROM w JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * (held - kept_chars) <= 30 * held AS kept FROM f"""

NEAR_DUP = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, CASE WHEN len(ws) > 0 THEN 2 ELSE 1 END))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, u.b FROM reach JOIN u ON u.a = reach.b),
k AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT k.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, k.doc_id = component_id AS kept FROM k LEFT JOIN n USING (doc_id)"""

_HALF = 1 << 60
FINGERPRINT = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, coalesce(lead(coalesce(text, '')) OVER o, first_value(coalesce(text, '')) OVER o) AS nx,
  coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id FROM documents WINDOW o AS (ORDER BY doc_id DESC)),
d AS (SELECT *, substr(t, 1, n - n // 2) || substr(nx, 1, n // 2) AS edited FROM t),
x AS (SELECT doc_id, 'f' AS k, t AS body FROM d UNION ALL SELECT doc_id, 'g', edited FROM d),
l AS (SELECT doc_id, k, sha256(line) AS h FROM (SELECT doc_id, k, unnest(string_split(body, chr(10))) AS line FROM x)),
w AS (SELECT doc_id, k, [('0x' || substr(h, 1 + 15 * j, 15))::BIGINT for j in range({WORDS})] AS w FROM l),
v AS (SELECT doc_id, k, list_concat([1::BIGINT], w, flatten([[(w[j] >> s) & {LANES} for s in range({SHIFTS})] for j in range(1, {WORDS + 1})])) AS v FROM w),
s AS (SELECT doc_id, k, i, (sum(v[i + 1]) % {_HALF})::BIGINT AS c FROM v, range({1 + WORDS + WORDS * SHIFTS}) r(i) GROUP BY ALL),
p AS (SELECT doc_id, k, string_agg(printf('%015x', c), '' ORDER BY i) AS p FROM s GROUP BY ALL),
q AS (SELECT s.doc_id, s.k, s.i, lane, 2 * ((s.c >> (20 * lane)::INT) & 1048575) - z.c AS a FROM s JOIN s z ON z.doc_id = s.doc_id AND z.k = s.k AND z.i = 0, range(3) r(lane) WHERE s.i > {WORDS}),
pairs AS (SELECT doc_id, doc_id AS other, 'g' AS k FROM d UNION ALL SELECT doc_id, next_id, 'f' FROM d),
y AS (SELECT pairs.doc_id, pairs.k, sum((a.a - b.a) * (a.a - b.a))::DOUBLE AS apart, sum(a.a * a.a + b.a * b.a)::DOUBLE AS size FROM pairs
  JOIN q a ON a.doc_id = pairs.doc_id AND a.k = 'f' JOIN q b ON b.doc_id = pairs.other AND b.k = pairs.k AND b.i = a.i AND b.lane = a.lane GROUP BY ALL),
z AS (SELECT y.doc_id, y.k, CASE WHEN pf.p = po.p THEN 1.0::DOUBLE WHEN size = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - apart / size) END AS near FROM y
  JOIN pairs ON pairs.doc_id = y.doc_id AND pairs.k = y.k JOIN p pf ON pf.doc_id = y.doc_id AND pf.k = 'f' JOIN p po ON po.doc_id = pairs.other AND po.k = y.k)
SELECT d.doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, f.p AS fingerprint, g.p AS edited_fingerprint, zg.near AS near_edited, zf.near AS near_next FROM d
JOIN p f ON f.doc_id = d.doc_id AND f.k = 'f' JOIN p g ON g.doc_id = d.doc_id AND g.k = 'g' JOIN z zg ON zg.doc_id = d.doc_id AND zg.k = 'g' JOIN z zf ON zf.doc_id = d.doc_id AND zf.k = 'f'"""
