"""Point lookups, searches and summaries over nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ensure_exists(nodes: DataFrame, node_id: str) -> DataFrame:
    """The node's row; a KeyError where there is none."""
    found = nodes.filter(F.col("id") == node_id)
    if found.isEmpty():
        raise KeyError(node_id)
    return found


def neighbours(edges: DataFrame, ids: DataFrame, direction: str = "forward") -> DataFrame:
    """(id, neighbour): distinct callees (forward) or callers (backward)."""
    here, there = ("from_id", "to_id") if direction == "forward" else ("to_id", "from_id")
    pairs = edges.select(F.col(here).alias("id"), F.col(there).alias("neighbour"))
    return pairs.join(ids.select("id").distinct(), "id", "left_semi").distinct()


def search(nodes: DataFrame, text: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """Nodes whose label, class or namespace holds the text, in any case; the first by id."""
    low = text.lower()
    hit = F.lit(False)
    for c in ("label", "class_name", "namespace"):
        hit = hit | F.coalesce(F.lower(c).contains(low), F.lit(False))
    found = nodes.filter(hit) if kind is None else nodes.filter(hit & (F.col("kind") == kind))
    return found.orderBy("id").limit(limit)


def entities_of_table(nodes: DataFrame, name: str, prefix: bool = False) -> DataFrame:
    """Entity nodes of a table; ``prefix`` also takes tables whose names begin so."""
    match = F.col("table_name").startswith(name) if prefix else F.col("table_name") == name
    return nodes.filter((F.col("kind") == "entity") & match)


def entities_of_class(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.filter((F.col("kind") == "entity") & (F.lower("class_name") == name.lower()))


def first_edges(edges: DataFrame) -> DataFrame:
    """One edge for each pair of nodes: the first by kind."""
    return edges.groupBy("from_id", "to_id").agg(F.min(F.struct("kind", "confidence", "weight")).alias("e")).select("from_id", "to_id", "e.*")


def stats(nodes: DataFrame) -> DataFrame:
    """(kind, n, n_entry_points)."""
    return nodes.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.coalesce("entry_point", F.lit(False))).alias("n_entry_points"))


def labelled(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the labels of both ends; an unknown end's label is its id."""
    label = nodes.select("id", "label")
    out = edges.join(label.withColumnsRenamed({"id": "from_id", "label": "from_label"}), "from_id", "left")
    out = out.join(label.withColumnsRenamed({"id": "to_id", "label": "to_label"}), "to_id", "left")
    return out.select("from_id", "to_id", "kind", F.coalesce("from_label", "from_id").alias("from_label"), F.coalesce("to_label", "to_id").alias("to_label"))


def layer() -> Column:
    """A node's layer: its route, its kind, else what its class name ends in."""
    name = F.coalesce("class_name", F.lit(""))
    return (
        F.when(F.coalesce("entry_point", F.lit(False)) | F.col("route").isNotNull(), "route")
        .when(F.col("kind") == "entity", "entity")
        .when(F.col("kind") == "table", "table")
        .when((F.col("kind") == "external") & F.col("id").contains("::entity::"), "entity")
        .when((F.col("kind") == "external") & F.col("id").contains("::table::"), "table")
        .when(name.rlike("Controller$"), "controller")
        .when(name.rlike("(Service|BLL|Manager|Provider|Handler)$"), "service")
        .when(name.rlike("(Repository|DAO)$|Dao"), "repository")
        .otherwise("method")
    )
