"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from ramus.llm.quality_rules import MAX_REPEATED_PERCENT, MEASURES, MIN_GROUP, MIN_WORDS

_SPACE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_ALNUM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH d AS (SELECT doc_id, {_SPACE_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, ws[i:i + 12] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
early AS (SELECT k, min(doc_id) AS e FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(13)) AS j FROM win JOIN early USING (k) WHERE e < doc_id)),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT w.doc_id, count(g.p) AS n_removed, string_agg(w.w, ' ' ORDER BY w.p) FILTER (g.p IS NULL) AS t FROM word w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.p = w.p GROUP BY w.doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

OP4 = f"""
WITH it AS (SELECT item_id::VARCHAR AS item, {_ALNUM_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item, ws[i:i + 9] AS k FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM it WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT len(k) AS l FROM win),
d AS (SELECT doc_id, {_ALNUM_WORDS} AS ws FROM documents),
dw AS (SELECT doc_id, l, i, ws[i:i + l - 1] AS k FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM d, lens WHERE len(ws) >= l)),
hit AS (SELECT doc_id, i, l, item FROM dw JOIN win USING (k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list_distinct(list(item))) AS found FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_hit, coalesce(len(found), 0) AS n_items, sha256(coalesce(array_to_string(found, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _fences() -> tuple[str, str, str]:
    """Quartiles of each level, limits, and the condition that a text lies within them."""
    quartiles = ", ".join(f"quantile_disc({m}, {q}) AS {m}_{n}" for m in MEASURES for n, q in (("q1", 0.25), ("q3", 0.75)))
    pick = ", ".join(f"CASE WHEN g.n >= {MIN_GROUP} THEN g.{m}_{q} WHEN l.n >= {MIN_GROUP} THEN l.{m}_{q} ELSE a.{m}_{q} END AS {m}_{q}" for m in MEASURES for q in ("q1", "q3"))
    inside = []
    for m, (up, down) in MEASURES.items():
        inside.append(f"{m} <= {m}_q3 + 3.0 * ({m}_q3 - {m}_q1) + {up}")
        if down is not None:
            inside.append(f"{m} >= {m}_q1 - 3.0 * ({m}_q3 - {m}_q1) - {down}")
    return quartiles, pick, " AND ".join(f"coalesce({c}, true)" for c in inside)


_QUARTILES, _PICK, _INSIDE = _fences()
_SYMBOLS = r"len(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))"
_LINES = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"

OP8 = f"""
WITH d AS (SELECT doc_id, lang, source, {_SPACE_WORDS} AS ws, {_SYMBOLS} AS n_symbols, {_LINES} AS ls FROM documents),
tri AS (SELECT doc_id, i, ws[i:i + 2] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3)),
often AS (SELECT doc_id, k FROM tri GROUP BY doc_id, k HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM tri JOIN often USING (doc_id, k)) GROUP BY doc_id),
m AS (SELECT doc_id, lang, source, len(ws) AS n_words, len(array_to_string(ws, '')) AS word_chars, n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines, coalesce(r, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
x AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed, n_symbols / greatest(word_chars, 1) AS symbols, n_dup_lines / greatest(n_lines, 1) AS dup_lines, n_repeat_words / greatest(n_words, 1) AS repeats, word_chars / greatest(n_words, 1) AS word_length FROM m),
g AS (SELECT lang, source, count(*) AS n, {_QUARTILES} FROM x WHERE NOT base_failed GROUP BY lang, source),
l AS (SELECT lang, count(*) AS n, {_QUARTILES} FROM x WHERE NOT base_failed GROUP BY lang),
a AS (SELECT count(*) AS n, {_QUARTILES} FROM x WHERE NOT base_failed),
f AS (SELECT g.lang, g.source, {_PICK} FROM g JOIN l ON l.lang IS NOT DISTINCT FROM g.lang CROSS JOIN a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_INSIDE} AS kept
FROM x LEFT JOIN f ON f.lang IS NOT DISTINCT FROM x.lang AND f.source IS NOT DISTINCT FROM x.source
"""


OP11 = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(ws) AS term FROM d) GROUP BY ALL),
voc AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ws)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10),
size AS (SELECT lang, count(*) AS v FROM voc GROUP BY lang),
full_n AS (SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n FROM grp g JOIN voc t USING (lang) LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
own AS (SELECT lang, source, sum(n) AS total FROM full_n GROUP BY ALL),
p AS (SELECT f.lang, f.source, f.term, f.n, 1 + (1000000000::HUGEINT * (f.n + 2)) // (o.total + 2 * s.v)::HUGEINT AS p FROM full_n f JOIN own o USING (lang, source) JOIN size s USING (lang)),
all_n AS (SELECT lang, term, sum(n) AS n FROM full_n GROUP BY ALL),
q AS (SELECT a.lang, a.term, 1 + (1000000000::HUGEINT * (a.n + 2)) // (sum(a.n) OVER (PARTITION BY a.lang) + 2 * s.v)::HUGEINT AS q FROM all_n a JOIN size s USING (lang)),
sums AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM p x JOIN p y USING (lang, term) WHERE x.source <> y.source GROUP BY ALL),
pairs AS (SELECT g.lang, g.source, h.source AS item, coalesce(s.value, 0) AS value FROM grp g JOIN grp h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
terms AS (SELECT p.lang, p.source, p.term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT *, 'pair' AS part FROM pairs UNION ALL BY NAME SELECT *, 'term' AS part FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


OP12 = r"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
-- crc32 by its bits over the bytes of short ASCII keys.
crc AS (SELECT DISTINCT k, 4294967295::BIGINT AS c, 0 AS j FROM raw
  UNION ALL
  SELECT k, list_reduce([xor(c, ascii(k[j + 1])::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), j + 1 FROM crc WHERE j < len(k)),
code AS (SELECT k, xor(c, 4294967295) % 20 AS d FROM crc WHERE j = len(k)),
hurt AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM raw JOIN code USING (k) WHERE d <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt),
told AS (SELECT *, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault FROM num),
stat AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM told GROUP BY conv_id),
-- Edits by the state before: 0 nothing, 1 system, 2 user, 3 assistant; insertions before a row lead from x to y.
ins(x, y, l, c, t) AS (VALUES (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''), (0, 2, 'I', 5, chr(10) || 'user:'), (1, 2, 'I', 5, chr(10) || 'user:'), (3, 2, 'I', 5, chr(10) || 'user:'), (2, 3, 'I', 5, chr(10) || 'assistant:'), (0, 3, 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:')),
edit AS (SELECT conv_id, i, x, x AS y, 'D' AS l, 2 AS c, '' AS t FROM told, range(4) s(x)
  UNION ALL SELECT conv_id, i, x, y, 'K', CASE fault WHEN 't' THEN 5 ELSE 0 END, chr(10) || role || ':' || text FROM told JOIN (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)) k(x, r, y) USING (r) WHERE fault IN ('', 't')
  UNION ALL SELECT conv_id, i, x, y, 'R', CASE fault WHEN 't' THEN 6 ELSE 1 END, chr(10) || n || ':' || text FROM told, (VALUES (0, 'user', 2), (1, 'user', 2), (3, 'user', 2), (2, 'assistant', 3)) k(x, n, y) WHERE fault IN ('', 't')),
way AS (SELECT conv_id, 0 AS i, 0 AS y, {'c': 0, 'l': '', 't': ''} AS b FROM stat
  UNION ALL
  SELECT w.conv_id, w.i + 1, e.y, min({'c': w.b.c + ins.c + e.c, 'l': w.b.l || ins.l || e.l, 't': w.b.t || ins.t || e.t}) FROM way w JOIN ins ON ins.x = w.y JOIN edit e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.x = ins.y GROUP BY w.conv_id, w.i, e.y),
best AS (SELECT w.conv_id, min({'c': w.b.c + ins.c, 'l': w.b.l || ins.l, 't': w.b.t || ins.t}) AS b FROM way w JOIN stat s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.i JOIN ins ON ins.x = w.y WHERE ins.y IN (0, 3) GROUP BY w.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.l, '') AS audit, sha256(coalesce(b.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN stat s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best z ON z.conv_id IS NOT DISTINCT FROM o.conv_id
"""


OP13 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
-- Blocks of 256 window starts, as places in a long string are slow to reach.
block AS (SELECT doc_id, j, substring(h, 512 * j + 1, 710) AS x FROM (SELECT doc_id, h, unnest(range((len(h) // 2 - 100) // 256 + 1)) AS j FROM d WHERE len(h) >= 200)),
win AS (SELECT doc_id, 256 * j + i AS i, md5_number(substring(x, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, j, x, unnest(range(least(256, len(x) // 2 - 99))) AS i FROM block)),
early AS (SELECT k, min({'d': doc_id, 'i': i}) AS e FROM win GROUP BY k HAVING count(*) > 1),
late AS (SELECT doc_id, i FROM win JOIN early USING (k) WHERE {'d': doc_id, 'i': i} > e),
-- Windows no more than 100 bytes apart cover one run.
island AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM late)),
run AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM island GROUP BY doc_id, g),
part AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM run),
kept AS (SELECT p.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(h[2 * before + 1:2 * a], '' ORDER BY a) || any_value(h)[2 * max(b) + 1:] AS t FROM part p JOIN d USING (doc_id) GROUP BY p.doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1, "op4_decontaminate": OP4, "op8_quality_rules": OP8, "op11_source_divergence": OP11, "op12_conversation_repair": OP12, "op13_suffix_dedup": OP13}
