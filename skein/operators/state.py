"""Statements: contradictions, consistency, invariants, transitions, drift, fingerprints.

Statements are (statement_id, subject_id, claim, tone, score, hop,
speculative_ancestor, suppressed); evidence is (statement_id, evidence_id, seq,
symbol, source_file, score, hop, speculative_ancestor).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.confidence import level
from ..session import cut
from .cognition import any_of

#: Pairs of phrases that contradict each other.
OPPOSITES = (
    (" does ", " does not "),
    (" is ", " is not "),
    (" has ", " does not have "),
    (" supports ", " does not support "),
    ("increases", "decreases"),
    ("enables", "disables"),
    ("valid", "invalid"),
    ("correct", "incorrect"),
    ("true", "false"),
)
#: Phrases of abstractions that need evidence.
ABSTRACT = (
    "business logic abstraction",
    "core domain concept",
    "primary workflow",
    "enterprise pattern",
    "architectural pattern",
    "ontology completion",
    "auto-generated summary",
    "smart compression",
)
CONFLICT_GAP = 0.4
PREFIX = {"direct": "dc", "shadow": "sa", "unsupported": "ui", "confidence": "cc", "divergent": "di", "stale": "sg", "drift": "sd"}


def _level() -> Column:
    return level(F.col("score"), F.col("speculative_ancestor"))


def linked(rows: DataFrame, key: str, test) -> DataFrame:
    """(a, n): rows with the number of others on their subject that they are linked with.

    ``rows``: (subject_id, statement_id, ``key``). Rows of a subject with one key are a class; ``test`` joins classes and
    not rows, so what is made does not grow with the square of a subject's rows.
    """
    classes = cut(rows.groupBy("subject_id", key).agg(F.count("*").alias("size")))
    others = classes.select("subject_id", F.col(key).alias("other"), "size")
    pairs = classes.select("subject_id", key).join(others, "subject_id").filter(test(F.col(key), F.col("other")))
    links = cut(pairs.groupBy("subject_id", key).agg(F.sum(F.col("size") - (F.col(key) == F.col("other")).cast("long")).alias("n")))
    return rows.join(links, ["subject_id", key]).filter("n > 0").select(F.col("statement_id").alias("a"), "n")


def direct_conflicts(statements: DataFrame) -> DataFrame:
    """(a, n): statements with how many others on their subject hold the opposite of a phrase of theirs.

    Classes are sets of sides of the pairs of phrases: 2i and 2i + 1 are opposites.
    """
    sides = F.filter(F.array(*[F.when(F.lower("claim").contains(p), 2 * i + s) for i, pair in enumerate(OPPOSITES) for s, p in enumerate(pair)]), lambda x: x.isNotNull())
    rows = statements.select("subject_id", "statement_id", sides.alias("sides")).filter(F.size("sides") > 0)
    return linked(rows, "sides", lambda x, y: F.arrays_overlap(F.transform(x, lambda k: k.bitwiseXOR(F.lit(1))), y))


def counted(statements: DataFrame, evidence: DataFrame) -> DataFrame:
    n = evidence.groupBy("statement_id").agg(F.count("*").alias("n_evidence"))
    return statements.join(n, "statement_id", "left").na.fill(0, ["n_evidence"]).withColumn("level", _level())


def shadow_abstractions(statements: DataFrame, evidence: DataFrame) -> DataFrame:
    rows = counted(statements, evidence)
    return rows.filter((F.col("level") >= 4) & (F.col("n_evidence") == 0) & any_of(F.lower("claim"), ABSTRACT)).select(F.col("statement_id").alias("a"))


def unsupported(statements: DataFrame, evidence: DataFrame) -> DataFrame:
    rows = counted(statements, evidence)
    return rows.filter((F.col("level") >= 3) & (F.col("n_evidence") == 0) & ~any_of(F.lower("claim"), ABSTRACT)).select(F.col("statement_id").alias("a"))


def confidence_conflicts(statements: DataFrame, gap: float = CONFLICT_GAP) -> DataFrame:
    """(a, n): statements with how many others on their subject score ``gap`` more or less, counted along the sorted scores."""
    rows = statements.select("subject_id", "statement_id", F.round(F.col("score") * 1e9).cast("long").alias("at"))
    far, order = round(gap * 1e9), W.partitionBy("subject_id").orderBy("at")
    below, above = (F.coalesce(F.sum("size").over(order.rangeBetween(x, y)), F.lit(0)) for x, y in ((W.unboundedPreceding, -far), (far, W.unboundedFollowing)))
    counts = cut(rows.groupBy("subject_id", "at").agg(F.count("*").alias("size")).select("subject_id", "at", (below + above).alias("n")))
    return rows.join(counts, ["subject_id", "at"]).filter("n > 0").select(F.col("statement_id").alias("a"), "n")


def tone_drift(statements: DataFrame) -> DataFrame:
    """(a, n): statements with how many others on their subject have another tone."""
    return linked(statements.select("subject_id", "statement_id", "tone"), "tone", lambda x, y: x != y)


def sets_of(statements: DataFrame, evidence: DataFrame, column: str, name: str) -> DataFrame:
    """(subject_id, statement_id, name): each statement's sorted set of a column of its evidence, for those that have any."""
    own = evidence.groupBy("statement_id").agg(F.array_sort(F.collect_set(column)).alias(name))
    return statements.select("subject_id", "statement_id").join(own, "statement_id").select("subject_id", "statement_id", name)


def divergent(statements: DataFrame, evidence: DataFrame) -> DataFrame:
    """(a, n): statements with sources, with how many others on their subject have sources and none in common."""
    return linked(sets_of(statements, evidence, "source_file", "files"), "files", lambda x, y: ~F.arrays_overlap(x, y))


def stale(statements: DataFrame, evidence: DataFrame) -> DataFrame:
    weak = evidence.filter((level(F.col("score")) >= 3) & F.col("speculative_ancestor")).select("statement_id").distinct()
    return statements.join(weak, "statement_id", "left_semi").select(F.col("statement_id").alias("a"))


def shared_evidence(statements: DataFrame, evidence: DataFrame) -> DataFrame:
    """(subject_id, a, b, n_a, n_b, n_shared, n_divergent): classes of statements with the same symbols, and what two of a subject share.

    ``a`` and ``b`` are the smallest statements of both classes, of which ``n_a`` and ``n_b`` statements are members; a class of two
    and more meets itself.
    """
    rows = sets_of(statements, evidence, "symbol", "symbols")
    classes = cut(rows.groupBy("subject_id", "symbols").agg(F.min("statement_id").alias("a"), F.count("*").alias("n_a")))
    pairs = classes.join(classes.withColumnsRenamed({"a": "b", "n_a": "n_b", "symbols": "others"}), "subject_id").filter("a < b or a = b and n_a > 1")
    apart = F.size(F.array_except("symbols", "others")) + F.size(F.array_except("others", "symbols"))
    return pairs.select("subject_id", "a", "b", "n_a", "n_b", F.size(F.array_intersect("symbols", "others")).alias("n_shared"), apart.alias("n_divergent"))


#: Findings that two statements are part of.
PAIRED = ("direct", "confidence", "divergent", "drift")


def findings(statements: DataFrame, evidence: DataFrame) -> DataFrame:
    """(kind, a, n) of all detectors: a statement and, for findings on pairs, how many others it is in conflict with."""
    one = F.lit(1).cast("long").alias("n")
    parts = [
        direct_conflicts(statements).select(F.lit("direct").alias("kind"), "a", "n"),
        shadow_abstractions(statements, evidence).select(F.lit("shadow"), "a", one),
        unsupported(statements, evidence).select(F.lit("unsupported"), "a", one),
        confidence_conflicts(statements).select(F.lit("confidence"), "a", "n"),
        divergent(statements, evidence).select(F.lit("divergent"), "a", "n"),
        stale(statements, evidence).select(F.lit("stale"), "a", one),
        tone_drift(statements).select(F.lit("drift"), "a", "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def totals(found: DataFrame) -> DataFrame:
    """One row (n_findings, n_severe): findings, each pair once, and those of the severest kind."""
    each = F.when(F.col("kind").isin(*PAIRED), F.col("n") / 2).otherwise(F.col("n"))
    return found.agg(F.coalesce(F.sum(each), F.lit(0.0)).cast("long").alias("n_findings"), F.coalesce(F.sum(F.when(severity(F.col("kind")) >= 3, each)), F.lit(0.0)).cast("long").alias("n_severe"))


def severity(kind: Column) -> Column:
    return F.when(kind == "direct", 3).when(kind.isin("shadow", "stale"), 2).when(kind.isin("confidence", "divergent"), 1).otherwise(0)


def numbered(found: DataFrame) -> DataFrame:
    """Findings with ids: a prefix by kind and a number in order of ``a`` within the kind.

    Rows are sorted by range and numbered within their parts; a part's first number comes from the counts of those before it.
    """
    parted = cut(found.repartitionByRange("kind", "a").withColumn("part", F.spark_partition_id()))
    counts = parted.groupBy("kind", "part").agg(F.count("*").alias("size"))  # a row a part
    before = cut(counts.withColumn("before", F.coalesce(F.sum("size").over(W.partitionBy("kind").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("size"))
    own = F.row_number().over(W.partitionBy("part", "kind").orderBy("a"))
    prefix = F.element_at(F.create_map(*[F.lit(x) for kv in PREFIX.items() for x in kv]), F.col("kind"))
    number = (F.col("before") + own - 1).cast("string")
    rows = parted.join(before, ["kind", "part"])
    return rows.withColumn("finding_id", F.concat(prefix, F.lit("-"), F.lpad(number, F.greatest(F.length(number), F.lit(5)), F.lit("0")))).drop("part", "before")


def gates(found: DataFrame) -> DataFrame:
    """(severity, n, n_links, suppress, qualify): statements and their links."""
    counts = found.groupBy(severity(F.col("kind")).alias("severity")).agg(F.count("*").alias("n"), F.sum("n").alias("n_links"))
    return counts.withColumns({"suppress": F.col("severity") >= 3, "qualify": F.col("severity") >= 1})


def rollup(statements: DataFrame) -> DataFrame:
    rows = statements.withColumn("level", _level())
    return rows.agg(
        F.count("*").alias("n"), F.count_if(F.col("level") <= 2).alias("n_grounded"), F.count_if(F.col("level") == 4).alias("n_speculative"),
        F.count_if("suppressed").alias("n_suppressed"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.min("score"), 6).alias("least_score"),
    )


def fingerprint(statements: DataFrame) -> DataFrame:
    """(subject_id, fingerprint): SHA-256 over a subject's statements in order of id."""
    line = F.concat_ws(":", "statement_id", F.format_string("%.6f", F.round("score", 6)), _level().cast("string"), F.col("suppressed").cast("string"))
    return statements.groupBy("subject_id").agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(line))), 256).alias("fingerprint"))


def state_fingerprint(statements: DataFrame) -> DataFrame:
    """One row: the SHA-256 of the sorted fingerprints of 256 buckets, each of the sorted ones of its subjects."""
    line = F.concat_ws("=", "subject_id", "fingerprint")
    buckets = fingerprint(statements).groupBy(F.substr(F.sha2("subject_id", 256), F.lit(1), F.lit(2)).alias("bucket")).agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(line))), 256).alias("f"))
    return buckets.agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list("f"))), 256).alias("fingerprint"))


def response_severity(statements: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row (n_findings, n_severe, n_speculative, severity): 2 blocked, 1 qualified, 0 assertive."""
    weak = statements.agg(F.count_if((_level() >= 4) & ~F.col("suppressed")).alias("n_speculative"))
    rows = totals(findings(statements, evidence)).crossJoin(weak)  # one row each
    return rows.withColumn("severity", F.when(F.col("n_severe") > 0, 2).when((F.col("n_findings") > 0) | (F.col("n_speculative") > 0), 1).otherwise(0))


def by_evidence(statements: DataFrame, evidence: DataFrame) -> DataFrame:
    """Statements with their level and counts of their evidence: all, weak (speculative and below) and strong (moderate and above)."""
    own = evidence.withColumn("l", _level()).groupBy("statement_id").agg(F.count("*").alias("n_evidence"), F.count_if(F.col("l") >= 4).alias("n_weak"), F.count_if(F.col("l") <= 2).alias("n_strong"))
    return statements.withColumn("level", _level()).join(own, "statement_id", "left").na.fill(0, ["n_evidence", "n_weak", "n_strong"])


def broken_chain(statements: DataFrame, evidence: DataFrame, chain: DataFrame) -> DataFrame:
    """Evidence of active statements that the global chain (evidence_id) does not have."""
    active = statements.filter("not suppressed").select("statement_id")
    return evidence.filter("evidence_id <> ''").join(active, "statement_id", "left_semi").join(chain.select("evidence_id"), "evidence_id", "left_anti")


def _counts(one: DataFrame, by: str) -> DataFrame:
    """A row of counts as rows (name, n)."""
    return one.unpivot([], one.columns, by, "n")


def invariants(statements: DataFrame, evidence: DataFrame, chain: DataFrame) -> DataFrame:
    """(invariant, n): violations of each of the nine. A state's chains cannot change, and its fingerprint is always there unless it has no statements."""
    on = ~F.col("suppressed")
    rows = by_evidence(statements, evidence).agg(
        F.count_if(F.col("speculative_ancestor") & (F.col("level") < 4)).alias("ConfidenceMonotonicity"),
        F.count_if(on & (F.col("n_evidence") > 0) & (F.col("n_weak") == F.col("n_evidence")) & (F.col("level") <= 2)).alias("NoSpeculativeEscalation"),
        F.lit(0).cast("long").alias("ProvenanceImmutability"),
        F.count_if(on & (F.col("level") == 5)).alias("NoUnsupportedInfluence"),
        F.count_if(on & ((F.col("score") > 1) | (F.col("score") < 0))).alias("ConfidenceDecayOnly"),
        F.when(F.count("*") == 0, 1).otherwise(0).cast("long").alias("ReplayFingerprintStability"),
        F.when(F.count("*") == 0, 1).otherwise(0).cast("long").alias("DeterministicFingerprint"),
    )
    hidden = response_severity(statements, evidence).select(F.when((F.col("n_findings") > 0) & (F.col("severity") == 0), 1).otherwise(0).cast("long").alias("ContradictionVisibility"))
    lost = broken_chain(statements, evidence, chain).agg(F.count("*").alias("EvidenceChainIntegrity"))
    return _counts(rows.crossJoin(hidden).crossJoin(lost), "invariant").orderBy("invariant")


def _changes(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """One row: counts, means, fingerprints and lost and new rows of two states (statements, evidence)."""
    out = None
    for tag, (statements, evidence) in (("0", before), ("1", after)):
        level_ = statements.withColumn("level", _level())
        own = level_.agg(
            F.count("*").alias(f"n{tag}"), F.coalesce(F.avg("score"), F.lit(0.0)).alias(f"mean{tag}"),
            F.count_if((F.col("level") >= 4) & ~F.col("suppressed")).alias(f"weak{tag}"), F.count_if((F.col("level") <= 2) & ~F.col("suppressed")).alias(f"strong{tag}"),
        ).crossJoin(state_fingerprint(statements).withColumnRenamed("fingerprint", f"print{tag}"))
        own = own.crossJoin(response_severity(statements, evidence).drop("n_speculative").withColumnsRenamed({c: f"{c}{tag}" for c in ("n_findings", "n_severe", "severity")}))
        own = own.crossJoin(evidence.agg(F.countDistinct("evidence_id").alias(f"chain{tag}")))
        out = own if out is None else out.crossJoin(own)
    ids, rows = "statement_id", [d[0].select("statement_id", F.col("score").alias(f"s{t}"), (~F.col("suppressed")).alias(f"on{t}")) for t, d in (("0", before), ("1", after))]
    moved = rows[0].join(rows[1], ids, "full").agg(
        F.count_if(F.col("on0") & F.col("on1") & (F.col("s1") > F.col("s0") + EPSILON)).alias("grown"), F.count_if(F.col("on1").isNull()).alias("gone"), F.count_if(F.col("on0").isNull()).alias("new"),
    )
    lost = before[1].select("evidence_id").distinct().join(after[1].select("evidence_id"), "evidence_id", "left_anti").agg(F.count("*").alias("lost"))
    return cut(out.crossJoin(moved).crossJoin(lost))


#: What counts as growth of a score and of a mean, new speculative statements, contradictions, lost evidence and changed statements that are let pass.
EPSILON, INFLATION, ESCALATION, MORE_FINDINGS, EROSION, FLUX = 0.0001, 0.05, 2, 1, 1, 3


def transition(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(check, n): violations between two states (statements, evidence)."""
    as_long = lambda c: c.cast("int").cast("long")
    one = _changes(before, after).select(
        F.col("grown").alias("confidence_decay"),
        as_long(F.col("n_severe1") > F.col("n_severe0")).alias("contradiction_escalation"),
        as_long(F.col("n_findings1") < F.col("n_findings0")).alias("contradiction_suppressed"),
        as_long(F.col("lost") > 0).alias("evidence_lineage"),
        as_long((F.col("print0") != F.col("print1")) & (F.col("n0") == F.col("n1"))).alias("fingerprint_stability"),
        as_long(F.col("mean1") > F.col("mean0") + INFLATION).alias("confidence_inflation"),
        as_long((F.col("weak1") > F.col("weak0") + ESCALATION) & (F.col("strong0") >= F.col("weak1"))).alias("speculative_escalation"),
        as_long((F.col("severity1") < F.col("severity0")) & (F.col("n_findings0") > 0)).alias("severity_monotonicity"),
    )
    return _counts(one, "check")


def runtime_drift(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(signal, value, drifting) of two states (statements, evidence)."""
    row = _changes(before, after)
    signal = lambda name, value, drifting: F.struct(F.lit(name).alias("signal"), value.cast("double").alias("value"), drifting.alias("drifting"))
    more = {c: F.col(f"{c}1") - F.col(f"{c}0") for c in ("mean", "n_findings", "n_severe")}
    flux, eroded, changed = F.col("gone") + F.col("new"), F.col("chain0") - F.col("chain1"), F.col("print0") != F.col("print1")
    return row.select(F.explode(F.array(
        signal("inflation", F.round(more["mean"], 6), more["mean"] > INFLATION),
        signal("contradictions", more["n_findings"], more["n_findings"] > MORE_FINDINGS),
        signal("severe", more["n_severe"], more["n_severe"] > 0),
        signal("erosion", eroded, eroded > EROSION),
        signal("fingerprint", changed.cast("int"), changed),
        signal("flux", flux, flux > FLUX),
    )).alias("r")).select("r.*")


def consistency(statements: DataFrame, evidence: DataFrame, chain: DataFrame) -> DataFrame:
    """(check, n): issues of each of the six checks."""
    rows = by_evidence(statements, evidence)
    on, active = ~F.col("suppressed"), rows.filter("not suppressed")
    one = rows.agg(
        F.count_if(on & F.col("speculative_ancestor") & (F.col("level") < 4) & (F.col("subject_id") != "")).alias("confidence_non_monotonic"),
        F.count_if(on & (F.col("n_weak") > 0) & (F.col("n_strong") == 0) & (F.col("level") <= 2)).alias("speculative_escalation"),
    )
    grounded = active.filter("level <= 2 and subject_id <> ''").select("subject_id", "statement_id")
    apart = divergent(grounded, evidence).agg(F.coalesce(F.sum("n") / 2, F.lit(0)).cast("long").alias("incompatible_evidence"))
    direct = totals(direct_conflicts(statements).select(F.lit("direct").alias("kind"), "a", "n")).select(F.col("n_severe").alias("contradictory_assertions"))
    symbols = evidence.filter("symbol <> ''").join(active.select("statement_id"), "statement_id", "left_semi").groupBy("symbol").agg(F.countDistinct("statement_id").alias("k"))
    shared = symbols.agg(F.count_if(F.col("k") > 1).alias("shared_symbols"))
    lost = broken_chain(statements, evidence, chain).agg(F.count("*").alias("broken_chain"))
    return _counts(one.crossJoin(apart).crossJoin(direct).crossJoin(shared).crossJoin(lost), "check")


def governance(before: tuple[DataFrame, DataFrame, DataFrame], after: tuple[DataFrame, DataFrame, DataFrame], reject_transition: bool = True, reject_drift: bool = False) -> DataFrame:
    """(seq, step, decision, n): the audit trail of a change from one state (statements, evidence, chain) to another, and the verdict last.

    Invariants of both states come first, then the transition, then drift; what rejects ends the trail. Steps after that are not taken.
    """
    spark, trail = before[0].sparkSession, []

    def done(verdict: str) -> DataFrame:
        return spark.createDataFrame([(i, *r) for i, r in enumerate([*trail, ("verdict", verdict, 0)])], "seq int, step string, decision string, n bigint")

    def failed(step: str, counts: DataFrame, column: str, refuse: bool) -> bool:
        n = counts.agg(F.count_if(F.expr(column))).first()[0]
        trail.append((step, "Allow" if not n else "Reject" if refuse else "Warn", n))
        return bool(n)

    for step, held in (("invariants-before", before), ("invariants-after", after)):
        if failed(step, invariants(*held), "n > 0", True):
            return done("Reject")
    moved = failed("transition", transition(before[:2], after[:2]), "n > 0", reject_transition)
    if moved and reject_transition or failed("drift", runtime_drift(before[:2], after[:2]), "drifting", reject_drift) and reject_drift:
        return done("Reject")
    return done("Warn" if moved else "Allow")


def tones(statements: DataFrame) -> DataFrame:
    """(tone, n, mean_score): a response's statements by tone, those suppressed left out."""
    return statements.filter("not suppressed").groupBy("tone").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))
