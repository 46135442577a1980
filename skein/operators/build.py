"""Graph construction: nodes and edges from code units, merges and incremental scopes.

Units are (id, project_name, namespace, class_name, method_name, content); calls
are (unit_id, project_name, target, external), the target qualified.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most edges that text search adds up to, and those within classes.
TEXT_CAP, CLASS_CAP = 5_000, 3_000
NAME = r"([A-Za-z_]\w*)\("

Analyzer = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame, DataFrame]]


def merged_units(units: DataFrame) -> DataFrame:
    """One unit an id: the first content that is not empty, calls united. ``units``: (id, ord, content, calls)."""
    first = F.min_by(F.nullif("content", F.lit("")), F.when(F.col("content") != "", F.col("ord")))
    return units.groupBy("id").agg(F.coalesce(first, F.lit("")).alias("content"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("calls")))).alias("calls"))


def unit_nodes(units: DataFrame) -> DataFrame:
    label = F.concat("class_name", F.lit("."), "method_name", F.lit("()"))
    return units.groupBy("id").agg(F.min(F.struct("project_name", "namespace", "class_name", "method_name")).alias("u")).select("id", "u.*").select("id", F.lit("method").alias("kind"), label.alias("label"), "project_name", "namespace", "class_name", "method_name")


def resolved(calls: DataFrame, units: DataFrame) -> DataFrame:
    """(from_id, to_id, confidence): external, else the project's own method, else the only one of that name."""
    name = F.concat_ws(".", "namespace", "class_name", "method_name")
    known = units.select(F.col("id").alias("to_id"), "project_name", name.alias("target"))
    own = known.groupBy("project_name", "target").agg(F.min("to_id").alias("own_id"))
    only = known.groupBy("target").agg(F.countDistinct("to_id").alias("n"), F.min("to_id").alias("only_id")).filter("n = 1").drop("n")
    rows = calls.join(own, ["project_name", "target"], "left").join(only, "target", "left")
    to = F.when(F.col("external"), F.concat(F.lit("ext::"), "target")).otherwise(F.coalesce("own_id", "only_id"))
    sure = F.when(F.col("external") | F.col("own_id").isNotNull(), "high").otherwise("medium")
    found = rows.select(F.col("unit_id").alias("from_id"), to.alias("to_id"), sure.alias("confidence")).filter("to_id is not null")
    return found.groupBy("from_id", "to_id").agg(F.min("confidence").alias("confidence"))


def called_in_text(units: DataFrame) -> DataFrame:
    """(from_id, name): names that stand before a bracket in a unit's text, and their endings.

    A text holds ``name(`` exactly if an identifier before a bracket ends in the
    name, so an equal join on endings replaces a search of every text for every name.
    """
    words = units.select(F.col("id").alias("from_id"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(NAME), 1))).alias("w"))
    ends = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.substr("w", i))
    return words.select("from_id", F.explode(ends).alias("name")).distinct()


def text_edges(units: DataFrame, existing: DataFrame, cap: int = TEXT_CAP) -> DataFrame:
    """(from_id, to_id, confidence): edges by text, but not those that exist; the first by order up to the cap."""
    known = units.select(F.col("id").alias("to_id"), F.col("method_name").alias("name"), F.col("project_name").alias("p2"), F.col("class_name").alias("c2")).distinct()
    own = units.select(F.col("id").alias("from_id"), "project_name", "class_name").distinct()
    near = F.when((F.col("project_name") == F.col("p2")) & (F.col("class_name") == F.col("c2")), "medium").otherwise("low")
    rows = called_in_text(units).join(known, "name").join(own, "from_id").select("from_id", "to_id", near.alias("confidence"))
    fresh = rows.distinct().join(existing.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti")
    room = max(0, cap - existing.count())
    return fresh.orderBy("from_id", "to_id").limit(room)


def class_edges(units: DataFrame, least: int = 2, most: int = 100, cap: int = CLASS_CAP) -> DataFrame:
    """(from_id, to_id): calls by text within classes of ``least`` to ``most`` units, not to a method of one's own name."""
    by = ["project_name", "class_name"]
    sizes = units.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n").between(least, most)).select(*by)
    own = units.join(sizes, by, "left_semi").select(*by, F.col("id").alias("from_id"), F.col("method_name").alias("caller"))
    other = units.select(*by, F.col("id").alias("to_id"), F.col("method_name").alias("name"))
    rows = called_in_text(units).join(own, "from_id").join(other, [*by, "name"]).filter("name <> caller")
    return rows.select("from_id", "to_id").distinct().orderBy("from_id", "to_id").limit(cap)


def dependency_types(edges: DataFrame, units: DataFrame) -> DataFrame:
    """Edges with dependency_type: same class, direct or transitive, interface kinds first."""
    of = units.select("id", F.concat_ws(".", "project_name", "class_name").alias("c")).distinct()
    rows = edges.join(of.withColumnsRenamed({"id": "from_id", "c": "a"}), "from_id", "left").join(of.withColumnsRenamed({"id": "to_id", "c": "b"}), "to_id", "left")
    kind = F.col("kind") if "kind" in edges.columns else F.lit("call")
    typed = F.when(kind.isin("implements", "property-ref"), "interface").when(F.col("a") == F.col("b"), "same-class").when(F.col("confidence") == "high", "direct").otherwise("transitive")
    return rows.select("from_id", "to_id", typed.alias("dependency_type"))


def external_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes for targets that have none."""
    missing = edges.select(F.col("to_id").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    return missing.select("id", F.when(F.col("id").contains("::entity::"), "entity").otherwise("external").alias("kind"), F.substring_index("id", "::", -1).alias("label"))


def called_by(edges: DataFrame) -> DataFrame:
    """(id, callers): distinct, sorted."""
    return edges.groupBy(F.col("to_id").alias("id")).agg(F.array_sort(F.collect_set("from_id")).alias("callers"))


def unique_ids(nodes: DataFrame) -> DataFrame:
    """The nodes; a ValueError where an id repeats."""
    if not nodes.groupBy("id").count().filter("count > 1").isEmpty():
        raise ValueError("node ids repeat")
    return nodes


def symbols(methods: DataFrame, handles: DataFrame) -> DataFrame:
    """(class_name, method_name, params, handle): by name and parameters, else by name alone."""
    exact = handles.select("class_name", "method_name", "params", F.col("handle").alias("exact"))
    named = handles.groupBy("class_name", "method_name").agg(F.min("handle").alias("named"))
    rows = methods.join(exact, ["class_name", "method_name", "params"], "left").join(named, ["class_name", "method_name"], "left")
    return rows.select("class_name", "method_name", "params", F.coalesce("exact", "named").alias("handle"))


def by_symbol(rows: DataFrame) -> DataFrame:
    return rows.filter("handle is not null").groupBy("handle").agg(F.count("*").alias("n"), F.min(F.concat_ws(".", "class_name", "method_name", "params")).alias("first"))


def run_analyzers(nodes: DataFrame, edges: DataFrame, analyzers: list[Analyzer]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts, annotations and extra edges of analyzers that all see the same graph."""
    facts, notes, more = analyzers[0](nodes, edges)
    for run in analyzers[1:]:
        a, b, c = run(nodes, edges)
        facts, notes, more = facts.unionByName(a), notes.unionByName(b), more.unionByName(c)
    return facts, notes, more


def annotated(facts: DataFrame) -> DataFrame:
    """(subject_id, attributes): a map a node, keys ``analyzer:type``; of equal keys the last by file stands."""
    key = F.concat_ws(":", "analyzer", "fact_type")
    last = facts.groupBy("subject_id", key.alias("k")).agg(F.max_by("value", "source_file").alias("v"))
    return last.groupBy("subject_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attributes"))


def rescoped(facts: DataFrame, fresh: DataFrame, analyzers: list[str], files: list[str]) -> DataFrame:
    """Facts after a change: those of the analyzers in the changed files go, the fresh ones come."""
    gone = F.col("analyzer").isin(*analyzers) & F.col("source_file").isin(*files)
    return facts.filter(~F.coalesce(gone, F.lit(False))).unionByName(fresh)
