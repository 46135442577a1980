"""Truth of edges, grounding of entities and claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.confidence import evidence_truth
from .cognition import any_of

#: Phrases that a grounded claim must not hold.
FORBIDDEN = (
    "business logic abstraction",
    "core domain concept",
    "primary workflow",
    "enterprise pattern",
    "architectural pattern",
    "auto-generated summary",
    "smart compression",
    "ontology completion",
    "this section was auto-completed",
    "generated by ontology expansion",
    "inferred entity relationship",
    "derived business abstraction",
    "propagated entity",
    "inferred from",
    "ungrounded edge",
    "inferred path",
    "speculative relationship",
    "likely implementation",
    "probable pattern",
)


def edge_layer(kind: Column) -> Column:
    return F.when(kind == "call", "execution").when(kind == "entity-access", "data").otherwise("structure")


def edge_truth(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with truth and grounded: base by evidence, half if neither end is grounded (nodes: id, grounded)."""
    ends = nodes.select("id", "grounded")
    rows = edges.join(ends.withColumnsRenamed({"id": "from_id", "grounded": "a"}), "from_id", "left").join(ends.withColumnsRenamed({"id": "to_id", "grounded": "b"}), "to_id", "left")
    grounded = F.coalesce("a", F.lit(False)) | F.coalesce("b", F.lit(False))
    kind = F.when(F.col("evidence") == "analyzer", F.concat(F.lit("analyzer-"), "confidence")).otherwise(F.col("evidence"))
    return rows.withColumn("grounded", grounded).withColumn("truth", evidence_truth(kind, F.col("grounded"))).drop("a", "b")


def may_propagate(edges: DataFrame, most: int = 4, least: float = 0.4) -> DataFrame:
    return edges.filter((F.col("depth") < most) & F.coalesce("grounded", F.lit(True)) & (F.col("truth") >= least))


def entity_grounding(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_evidence, weight, state) of each entity."""
    facts = edges.filter("kind = 'entity-access'").groupBy(F.col("to_id").alias("id")).agg(
        F.count("*").alias("n_evidence"), F.sum("weight").alias("weight"), F.count_if(F.col("confidence").isin("exact", "high")).alias("strong")
    )
    rows = nodes.filter("kind = 'entity'").select("id").join(facts, "id", "left").na.fill(0, ["n_evidence", "weight", "strong"])
    return rows.select("id", "n_evidence", "weight", F.when(F.col("strong") > 0, "grounded").when(F.col("n_evidence") > 0, "partial").otherwise("ungrounded").alias("state"))


def drift(edges: DataFrame, nodes: DataFrame, most_depth: int = 4) -> DataFrame:
    """(finding, subject, severity): methods without a symbol or with one that no index knows, edges too far out or not grounded, entities without edges.

    ``nodes`` have ``symbol`` and ``indexed``; ``edges`` have ``depth`` and ``grounded``.
    """
    pair = F.concat_ws(">", "from_id", "to_id").alias("subject")
    own = nodes.filter("kind = 'method' and not is_external")
    bare = own.filter(F.coalesce("symbol", F.lit("")) == "").select(F.lit("missing-symbol").alias("finding"), F.col("id").alias("subject"), F.lit(0.7).alias("severity"))
    orphan = own.filter((F.coalesce("symbol", F.lit("")) != "") & ~F.col("indexed")).select(F.lit("orphan-symbol"), "id", F.lit(0.8))
    far = edges.filter(F.col("depth") > most_depth).select(F.lit("propagation-overreach"), pair, F.round(0.5 + (F.col("depth") - most_depth) * 0.1, 6))
    loose = edges.filter("not grounded").select(F.lit("ungrounded-edge"), pair, F.lit(0.6))
    tied = edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    entities = nodes.filter("kind = 'entity'").select("id").join(tied, "id", "left_anti").select(F.lit("orphan-entity"), "id", F.lit(0.3))
    return bare.union(orphan).union(far).union(loose).union(entities)


def claims(statements: DataFrame, evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """Statements with their subject node, evidence count, failures and class.

    Class 0 grounded, 1 plausible, 2 unsupported, 3 hallucinated.
    """
    counts = evidence.groupBy("statement_id").agg(F.count("*").alias("n_evidence"), F.countDistinct("source_file").alias("n_files"), F.countDistinct(F.nullif("symbol", F.lit(""))).alias("n_symbols"))
    rows = statements.join(nodes.select(F.col("id").alias("subject"), F.lit(True).alias("known")), "subject", "left").join(counts, "statement_id", "left").na.fill(0, ["n_evidence", "n_files", "n_symbols"])
    lost, bare = F.col("known").isNull(), F.col("n_evidence") == 0
    forbidden = any_of(F.lower("claim"), FORBIDDEN)
    failures = lost.cast("int") + bare.cast("int") + forbidden.cast("int")
    kind = F.when(lost | forbidden, 3).when(bare, 2).when(F.col("score") >= 0.6, 0).otherwise(1)
    abstract = any_of(F.lower("claim"), FORBIDDEN[:8])
    names = ("n_evidence", "n_files", "n_symbols")
    return rows.select("statement_id", "score", *names, lost.alias("lost"), bare.alias("bare"), forbidden.alias("forbidden"), abstract.alias("abstract"), failures.alias("n_failures"), kind.alias("class"))


def derived(score: Column, bound: Column) -> Column:
    """What a piece of evidence makes of a claim: 3 hallucinated, 0 grounded, 1 inferred, 2 speculative."""
    return F.when(score <= 0.3, 3).when((score >= 0.8) & bound, 0).when((score >= 0.4) & (score < 0.8), 1).otherwise(2)


def combined(statements: DataFrame, evidence: DataFrame) -> DataFrame:
    """(statement_id, class): the best of what a statement's evidence makes of it, hallucinated without any."""
    best = evidence.groupBy("statement_id").agg(F.min(derived(F.col("score"), F.col("symbol") != "")).alias("best"))
    return statements.select("statement_id").join(best, "statement_id", "left").select("statement_id", F.coalesce("best", F.lit(3)).alias("class"))


def blocked(rows: DataFrame, edges: int = 1, files: int = 1) -> DataFrame:
    """(statement_id, reasons, blocked): claims that may not be made, and why. ``edges`` and ``files``: least evidence."""
    none = (F.col("n_evidence") == 0) & (F.col("n_files") == 0) & (F.col("n_symbols") == 0)
    reasons = F.concat_ws(
        ",", F.when(F.col("class") == 3, "hallucinated"), F.when(F.col("n_evidence") < edges, "edges"), F.when(F.col("n_files") < files, "files"), F.when(F.col("n_symbols") == 0, "symbol"), F.when(F.col("lost"), "graph"),
        F.when(F.col("bare"), "provenance"), F.when(F.col("forbidden"), "forbidden"), F.when(none, "nothing"), F.when(F.col("abstract"), "abstraction"),
    )
    return rows.select("statement_id", reasons.alias("reasons")).withColumn("blocked", F.col("reasons") != "")
