"""Statements and their state (family J)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import state
from ..plans.fixture import view
from ..registry import query

PAIRS = "FROM statements x JOIN statements y ON x.subject_id = y.subject_id AND x.statement_id < y.statement_id"
COUNTED = """ct AS (SELECT s.*, (SELECT count(*) FROM evidence v WHERE v.statement_id = s.statement_id) AS n_evidence, CASE WHEN c >= 0.95 THEN 0 WHEN c >= 0.8 THEN 1 WHEN c >= 0.6 THEN 2 WHEN c >= 0.4 THEN 3 WHEN c >= 0.2 THEN 4 ELSE 5 END AS level FROM (SELECT *, CASE WHEN speculative_ancestor THEN least(score, 0.55) ELSE score END AS c FROM statements) s)"""
ABSTRACT = "regexp_matches(claim, 'business logic abstraction|core domain concept|primary workflow|enterprise pattern|architectural pattern|ontology completion|auto-generated summary|smart compression')"
RULES = "(VALUES (' does ', ' does not '), (' is ', ' is not '), (' has ', ' does not have '), (' supports ', ' does not support '), ('increases', 'decreases'), ('enables', 'disables'), ('valid', 'invalid'), ('correct', 'incorrect'), ('true', 'false')) r(p, q)"
DIRECT = f"SELECT DISTINCT x.statement_id AS a, y.statement_id AS b {PAIRS} JOIN {RULES} ON (contains(x.claim, p) AND contains(y.claim, q)) OR (contains(y.claim, p) AND contains(x.claim, q))"
GAP = f"SELECT x.statement_id AS a, y.statement_id AS b {PAIRS} WHERE round(abs(x.score - y.score), 9) >= 0.4"
APART = f"SELECT x.statement_id AS a, y.statement_id AS b {PAIRS} WHERE EXISTS (SELECT 1 FROM evidence e WHERE e.statement_id = x.statement_id) AND EXISTS (SELECT 1 FROM evidence e WHERE e.statement_id = y.statement_id) AND NOT EXISTS (SELECT 1 FROM evidence e JOIN evidence f ON e.source_file = f.source_file WHERE e.statement_id = x.statement_id AND f.statement_id = y.statement_id)"
TONES = f"SELECT x.statement_id AS a, y.statement_id AS b {PAIRS} WHERE x.tone <> y.tone"


def each(pairs: str) -> str:
    """Of all pairs, the number of each statement's."""
    return f"SELECT a, count(*) AS n FROM (SELECT a FROM ({pairs}) u UNION ALL SELECT b FROM ({pairs}) v) w GROUP BY 1"


def both(spark, d):
    return view(spark, d, "statements"), view(spark, d, "evidence")


@query("J01_direct_conflicts", each(DIRECT))
def direct_conflicts(spark, d):
    return state.direct_conflicts(view(spark, d, "statements"))


@query("J02_shadow_abstractions", f"WITH {COUNTED} SELECT statement_id AS a FROM ct WHERE level >= 4 AND n_evidence = 0 AND {ABSTRACT}")
def shadow_abstractions(spark, d):
    return state.shadow_abstractions(*both(spark, d))


@query("J03_unsupported", f"WITH {COUNTED} SELECT statement_id AS a FROM ct WHERE level >= 3 AND n_evidence = 0 AND NOT {ABSTRACT}")
def unsupported(spark, d):
    return state.unsupported(*both(spark, d))


@query("J04_confidence_conflicts", each(GAP))
def confidence_conflicts(spark, d):
    return state.confidence_conflicts(view(spark, d, "statements"))


@query("J05_divergent_sources", each(APART))
def divergent(spark, d):
    return state.divergent(*both(spark, d))


@query("J06_stale_grounding", "SELECT DISTINCT statement_id AS a FROM evidence WHERE score < 0.6 AND speculative_ancestor")
def stale(spark, d):
    return state.stale(*both(spark, d))


@query("J07_tone_drift", each(TONES))
def tone_drift(spark, d):
    return state.tone_drift(view(spark, d, "statements"))


@query("J09_shared_evidence", """WITH sy AS (SELECT statement_id, list_sort(list_distinct(list(symbol))) AS s FROM evidence GROUP BY 1), cl AS (SELECT subject_id, s, min(statement_id) AS rep, count(*) AS n FROM statements JOIN sy USING (statement_id) GROUP BY 1, 2)
SELECT x.subject_id, x.rep AS a, y.rep AS b, x.n AS n_a, y.n AS n_b, CAST(len(list_intersect(x.s, y.s)) AS INT) AS n_shared, CAST(len(x.s) + len(y.s) - 2 * len(list_intersect(x.s, y.s)) AS INT) AS n_divergent FROM cl x JOIN cl y ON x.subject_id = y.subject_id AND (x.rep < y.rep OR x.rep = y.rep AND x.n > 1)""")
def shared_evidence(spark, d):
    return state.shared_evidence(*both(spark, d))


FOUND = f"""fd AS (SELECT 'direct' AS kind, a, n FROM ({each(DIRECT)}) UNION ALL SELECT 'shadow', statement_id, 1 FROM ct WHERE level >= 4 AND n_evidence = 0 AND {ABSTRACT} UNION ALL SELECT 'unsupported', statement_id, 1 FROM ct WHERE level >= 3 AND n_evidence = 0 AND NOT {ABSTRACT}
UNION ALL SELECT 'confidence', a, n FROM ({each(GAP)}) UNION ALL SELECT 'divergent', a, n FROM ({each(APART)}) UNION ALL SELECT DISTINCT 'stale', statement_id, 1 FROM evidence WHERE score < 0.6 AND speculative_ancestor UNION ALL SELECT 'drift', a, n FROM ({each(TONES)}))"""


@query("J10_numbered_findings", f"WITH {COUNTED}, {FOUND} SELECT CASE kind WHEN 'direct' THEN 'dc' WHEN 'shadow' THEN 'sa' WHEN 'unsupported' THEN 'ui' WHEN 'confidence' THEN 'cc' WHEN 'divergent' THEN 'di' WHEN 'stale' THEN 'sg' ELSE 'sd' END || '-' || lpad(CAST(row_number() OVER (PARTITION BY kind ORDER BY a) - 1 AS STRING), 5, '0') AS finding_id, a, CAST(n AS BIGINT) AS n FROM fd")
def numbered(spark, d):
    return state.numbered(state.findings(*both(spark, d))).select("finding_id", "a", "n")


@query("J11_severity_gates", f"WITH {COUNTED}, {FOUND}, sv AS (SELECT CAST(CASE WHEN kind = 'direct' THEN 3 WHEN kind IN ('shadow', 'stale') THEN 2 WHEN kind IN ('confidence', 'divergent') THEN 1 ELSE 0 END AS INT) AS severity, n FROM fd) SELECT severity, count(*) AS n, CAST(sum(n) AS BIGINT) AS n_links, severity >= 3 AS suppress, severity >= 1 AS qualify FROM sv GROUP BY 1")
def gates(spark, d):
    return state.gates(state.findings(*both(spark, d)))


def strong(rows: str, evidence: str) -> str:
    """Statements of ``rows`` with their level and counts of all, weak and strong evidence."""
    lv = "CASE WHEN c >= 0.95 THEN 0 WHEN c >= 0.8 THEN 1 WHEN c >= 0.6 THEN 2 WHEN c >= 0.4 THEN 3 WHEN c >= 0.2 THEN 4 ELSE 5 END"
    return f"""(SELECT s.*, {lv} AS level, coalesce(ne, 0) AS ne, coalesce(nw, 0) AS nw, coalesce(ns, 0) AS ns FROM (SELECT *, CASE WHEN speculative_ancestor THEN least(score, 0.55) ELSE score END AS c FROM {rows}) s LEFT JOIN (
SELECT statement_id, count(*) AS ne, count(*) FILTER (WHERE c < 0.4) AS nw, count(*) FILTER (WHERE c >= 0.6) AS ns FROM (SELECT statement_id, CASE WHEN speculative_ancestor THEN least(score, 0.55) ELSE score END AS c FROM {evidence}) GROUP BY 1) v USING (statement_id))"""


ON = strong("statements", "evidence")


@query("J12_consistency", f"""WITH st AS {ON}, pr AS (SELECT x.statement_id AS a, y.statement_id AS b FROM st x JOIN st y ON x.subject_id = y.subject_id AND x.statement_id < y.statement_id WHERE NOT x.suppressed AND NOT y.suppressed AND x.level <= 2 AND y.level <= 2 AND x.ne > 0 AND y.ne > 0)
SELECT 'confidence_non_monotonic' AS "check", count(*) AS n FROM st WHERE NOT suppressed AND speculative_ancestor AND level < 4 UNION ALL SELECT 'speculative_escalation', count(*) FROM st WHERE NOT suppressed AND nw > 0 AND ns = 0 AND level <= 2
UNION ALL SELECT 'incompatible_evidence', count(*) FROM pr WHERE NOT EXISTS (SELECT 1 FROM evidence e JOIN evidence f ON e.source_file = f.source_file WHERE e.statement_id = a AND f.statement_id = b) UNION ALL SELECT 'contradictory_assertions', count(*) FROM ({DIRECT})
UNION ALL SELECT 'shared_symbols', count(*) FROM (SELECT symbol FROM evidence WHERE statement_id IN (SELECT statement_id FROM statements WHERE NOT suppressed) GROUP BY 1 HAVING count(DISTINCT statement_id) > 1)
UNION ALL SELECT 'broken_chain', count(*) FROM evidence WHERE statement_id IN (SELECT statement_id FROM statements WHERE NOT suppressed) AND evidence_id NOT IN (SELECT evidence_id FROM chain)""")
def consistency(spark, d):
    return state.consistency(*both(spark, d), view(spark, d, "chain"))


ROLLUP = f"WITH {COUNTED} SELECT count(*) AS n, count(*) FILTER (WHERE level <= 2) AS n_grounded, count(*) FILTER (WHERE level = 4) AS n_speculative, count(*) FILTER (WHERE suppressed) AS n_suppressed, round(avg(score), 6) AS mean_score, round(min(score), 6) AS least_score FROM ct"


@query("J13_state_rollup", ROLLUP)
def rollup(spark, d):
    return state.rollup(view(spark, d, "statements"))


@query("J14_provenance", "SELECT count(*) AS n, count(DISTINCT symbol) AS n_symbols, count(DISTINCT source_file) AS n_files, round(avg(score), 6) AS mean_score, round(min(score), 6) AS least_score FROM evidence")
def provenance(spark, d):
    return view(spark, d, "evidence").agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("n_symbols"), F.countDistinct("source_file").alias("n_files"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.min("score"), 6).alias("least_score"))


PRINT = f"{COUNTED}, fp AS (SELECT subject_id, sha256(array_to_string(list_sort(list(statement_id || ':' || printf('%.6f', round(score, 6)) || ':' || level || ':' || suppressed)), '|')) AS fingerprint FROM ct GROUP BY 1)"


@query("J15_fingerprints", f"WITH {PRINT} SELECT subject_id, fingerprint FROM fp")
def fingerprints(spark, d):
    return state.fingerprint(view(spark, d, "statements"))


@query("J15_state_fingerprint", f"WITH {PRINT}, bk AS (SELECT substr(sha256(subject_id), 1, 2) AS b, sha256(array_to_string(list_sort(list(subject_id || '=' || fingerprint)), '|')) AS f FROM fp GROUP BY 1) SELECT sha256(array_to_string(list_sort(list(f)), '|')) AS fingerprint FROM bk")
def state_fingerprint(spark, d):
    return state.state_fingerprint(view(spark, d, "statements"))


@query("J16_invariants", f"""WITH st AS {ON} SELECT 'ConfidenceMonotonicity' AS invariant, count(*) AS n FROM st WHERE speculative_ancestor AND level < 4 UNION ALL SELECT 'NoSpeculativeEscalation', count(*) FROM st WHERE NOT suppressed AND ne > 0 AND nw = ne AND level <= 2
UNION ALL SELECT 'NoUnsupportedInfluence', count(*) FROM st WHERE NOT suppressed AND level = 5 UNION ALL SELECT 'ConfidenceDecayOnly', count(*) FROM st WHERE NOT suppressed AND (score > 1 OR score < 0)
UNION ALL SELECT 'EvidenceChainIntegrity', count(*) FROM evidence JOIN st USING (statement_id) WHERE NOT suppressed AND evidence_id NOT IN (SELECT evidence_id FROM chain)
UNION ALL SELECT name, CAST(CASE WHEN name LIKE '%Fingerprint%' AND (SELECT count(*) FROM st) = 0 THEN 1 ELSE 0 END AS BIGINT) FROM (VALUES ('ProvenanceImmutability'), ('ContradictionVisibility'), ('ReplayFingerprintStability'), ('DeterministicFingerprint')) v(name)""")
def invariants(spark, d):
    return state.invariants(*both(spark, d), view(spark, d, "chain"))


def changes(name: str, rows: str, evidence: str) -> str:
    """Counts of a state, from its pairs."""
    swap = lambda q: re.sub(r"\bevidence\b", evidence, re.sub(r"\bstatements\b", rows, q))
    single = f"(SELECT count(*) FROM {strong(rows, evidence)} WHERE level >= 4 AND ne = 0 AND {ABSTRACT}) + (SELECT count(*) FROM {strong(rows, evidence)} WHERE level >= 3 AND ne = 0 AND NOT {ABSTRACT}) + (SELECT count(DISTINCT statement_id) FROM {evidence} WHERE score < 0.6 AND speculative_ancestor)"
    pairs = " + ".join(f"(SELECT count(*) FROM ({swap(q)}))" for q in (DIRECT, GAP, APART, TONES))
    return f"""{name} AS (SELECT *, CASE WHEN severe > 0 THEN 2 WHEN findings > 0 OR weak > 0 THEN 1 ELSE 0 END AS severity FROM (SELECT (SELECT count(*) FROM {rows}) AS n, (SELECT avg(score) FROM {rows}) AS mean, (SELECT count(*) FROM {strong(rows, evidence)} WHERE level >= 4 AND NOT suppressed) AS weak,
(SELECT count(*) FROM {strong(rows, evidence)} WHERE level <= 2 AND NOT suppressed) AS strong, (SELECT count(*) FROM ({swap(DIRECT)})) AS severe, {pairs} + {single} AS findings, (SELECT count(DISTINCT evidence_id) FROM {evidence}) AS chain_n, (SELECT count(*) FROM (SELECT statement_id FROM {evidence})) AS rows_n))"""


CHANGES = f"{changes('b', 'statements', 'evidence')}, {changes('a', 'later', 'later_evidence')}"
SAME = "(SELECT count(*) = 0 FROM (SELECT statement_id, round(s.score, 6) AS x, round(l.score, 6) AS y, s.suppressed AS p, l.suppressed AS q FROM statements s FULL JOIN later l USING (statement_id)) WHERE x IS DISTINCT FROM y OR p IS DISTINCT FROM q)"


def states(spark, d):
    return (view(spark, d, "statements"), view(spark, d, "evidence")), (view(spark, d, "later"), view(spark, d, "later_evidence"))


TRANSITION = f"""{CHANGES}, tn AS (SELECT 'confidence_decay' AS "check", (SELECT count(*) FROM statements s JOIN later l USING (statement_id) WHERE NOT s.suppressed AND NOT l.suppressed AND l.score > s.score + 0.0001) AS n UNION ALL SELECT 'contradiction_escalation', CAST(a.severe > b.severe AS BIGINT) FROM a, b UNION ALL SELECT 'contradiction_suppressed', CAST(a.findings < b.findings AS BIGINT) FROM a, b
UNION ALL SELECT 'evidence_lineage', CAST(count(*) > 0 AS BIGINT) FROM evidence WHERE evidence_id NOT IN (SELECT evidence_id FROM later_evidence) UNION ALL SELECT 'fingerprint_stability', CAST(NOT {SAME} AND a.n = b.n AS BIGINT) FROM a, b UNION ALL SELECT 'confidence_inflation', CAST(a.mean > b.mean + 0.05 AS BIGINT) FROM a, b
UNION ALL SELECT 'speculative_escalation', CAST(a.weak > b.weak + 2 AND b.strong >= a.weak AS BIGINT) FROM a, b UNION ALL SELECT 'severity_monotonicity', CAST(a.severity < b.severity AND b.findings > 0 AS BIGINT) FROM a, b)"""


@query("J17_transition", f'WITH {TRANSITION} SELECT "check", n FROM tn')
def transition(spark, d):
    return state.transition(*states(spark, d))


@query("J18_runtime_drift", f"""WITH {CHANGES}, fl AS (SELECT count(*) AS n FROM (SELECT s.statement_id AS x, l.statement_id AS y FROM statements s FULL JOIN later l ON s.statement_id = l.statement_id) WHERE x IS NULL OR y IS NULL)
SELECT 'inflation' AS signal, round(a.mean - b.mean, 6) AS value, a.mean - b.mean > 0.05 AS drifting FROM a, b UNION ALL SELECT 'contradictions', (a.findings - b.findings)::DOUBLE, a.findings - b.findings > 1 FROM a, b UNION ALL SELECT 'severe', (a.severe - b.severe)::DOUBLE, a.severe > b.severe FROM a, b
UNION ALL SELECT 'erosion', (b.chain_n - a.chain_n)::DOUBLE, b.chain_n - a.chain_n > 1 FROM a, b UNION ALL SELECT 'fingerprint', (NOT {SAME})::INT::DOUBLE, NOT {SAME} UNION ALL SELECT 'flux', n::DOUBLE, n > 3 FROM fl""")
def runtime_drift(spark, d):
    return state.runtime_drift(*states(spark, d))


@query("J19_governance", f"""WITH st AS {ON}, iv AS (SELECT CAST((SELECT count(*) > 0 FROM st WHERE speculative_ancestor AND level < 4) AS INT) + CAST((SELECT count(*) > 0 FROM st WHERE NOT suppressed AND ne > 0 AND nw = ne AND level <= 2) AS INT) + CAST((SELECT count(*) > 0 FROM st WHERE NOT suppressed AND level = 5) AS INT) + CAST((SELECT count(*) > 0 FROM st WHERE NOT suppressed AND (score > 1 OR score < 0)) AS INT) + CAST((SELECT count(*) > 0 FROM evidence JOIN st USING (statement_id) WHERE NOT suppressed AND evidence_id NOT IN (SELECT evidence_id FROM chain)) AS INT) AS n)
SELECT 0 AS seq, 'invariants-before' AS step, CASE WHEN n > 0 THEN 'Reject' ELSE 'Allow' END AS decision, n::BIGINT AS n FROM iv UNION ALL SELECT 1, 'verdict', 'Reject', 0 FROM iv WHERE n > 0""")
def governance(spark, d):
    before, after = states(spark, d)
    return state.governance((*before, view(spark, d, "chain")), (*after, view(spark, d, "chain")))


@query("J19_governance_of_a_calm_state", """SELECT 0 AS seq, 'invariants-before' AS step, 'Allow' AS decision, 0::BIGINT AS n UNION ALL SELECT 1, 'invariants-after', 'Allow', 0 UNION ALL SELECT 2, 'transition', 'Reject', (SELECT 1 + CAST(count(*) > 0 AS BIGINT) FROM calm WHERE hop = 3)
UNION ALL SELECT 3, 'verdict', 'Reject', 0""")
def calm_governance(spark, d):
    rows, e = view(spark, d, "calm"), view(spark, d, "calm_evidence")
    later = rows.withColumn("score", F.col("score") * 0.99)
    kept = e.join(rows.filter("hop <> 3").select("statement_id"), "statement_id", "left_semi")
    return state.governance((rows, e, e), (later, kept, kept))


@query("J20_response_tones", "SELECT tone, count(*) AS n, round(avg(score), 6) AS mean_score FROM statements WHERE NOT suppressed GROUP BY tone")
def tones(spark, d):
    return state.tones(view(spark, d, "statements"))
