"""SQL that gives the rows of operators 3, 4 and 6 in another way, for the checking engine."""

from __future__ import annotations

from .quality_rules import DOUBT, RISK, RULES

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = f"regexp_extract_all({LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SPACED = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"

DECONTAMINATION = f"""
WITH dw AS (SELECT doc_id, coalesce({ALNUM}, []) AS ws FROM documents), iw AS (SELECT item_id, {ALNUM} AS ws FROM benchmark),
ig AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM iw WHERE len(ws) > 0)),
dg AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM ig))),
hit AS (SELECT doc_id, i, dg.n, item_id FROM dg JOIN ig ON ig.g = dg.g AND ig.n = dg.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM hit GROUP BY 1)
SELECT dw.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""

_SHARES = {"symbols": "n_symbols / greatest(word_chars, 1)::DOUBLE", "capitals": "n_capitals / greatest(word_chars, 1)::DOUBLE", "repeats": "n_repeat_words / greatest(n_words, 1)::DOUBLE", "lines": "n_dup_lines / greatest(n_words, 1)::DOUBLE"}
_GRID = ", ".join(f"('{rule}', {i}, {c}::DOUBLE)" for rule, cs in RULES.items() for i, c in enumerate(cs))
_LONG = " UNION ALL ".join(f"SELECT doc_id, stratum, base_failed, '{rule}' AS rule, {share} AS share FROM f" for rule, share in _SHARES.items())

QUALITY_RULES = f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents), w AS (SELECT *, {SPACED.format('text')} AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM g WHERE (doc_id, g) IN (SELECT doc_id, g FROM g GROUP BY 1, 2 HAVING count(*) > 1)) GROUP BY 1),
b AS (SELECT doc_id, stratum, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_capitals FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b), l AS ({_LONG}), grid(rule, i, c) AS (VALUES {_GRID}),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY 1 HAVING min(quality) = 1),
held AS (SELECT stratum, rule, i, c, count(*) AS n, count(*) FILTER (WHERE share > c) AS k FROM l JOIN grid USING (rule) WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY 1, 2, 3, 4),
p AS (SELECT *, CASE WHEN k >= n * {RISK / len(RULES)} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({RISK / len(RULES)}) + (n - j) * ln(1 - {RISK / len(RULES)})))) END AS cdf FROM held),
s AS (SELECT *, bool_and(cdf <= {DOUBT / len(RULES)} / (SELECT count(DISTINCT stratum) FROM held)) OVER (PARTITION BY stratum, rule ORDER BY i) AS certified FROM p),
cut AS (SELECT stratum, rule, min(c) AS cut FROM s WHERE certified GROUP BY 1, 2), away AS (SELECT doc_id FROM l JOIN cut USING (stratum, rule) WHERE share > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM away) AS kept FROM f"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({SPACED.format(LOWER.format('text'))}, []) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c2 FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c2 >= 85 * (p.n + q.n - c2)), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT reach.doc_id, u.b FROM reach JOIN u ON u.a = reach.other), c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN c ON c.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id"""

ORACLES = {"op3_decontamination": DECONTAMINATION, "op4_quality_rules": QUALITY_RULES, "op6_near_duplicates": NEAR_DUPLICATES}
