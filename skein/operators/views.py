"""Projections of nodes, edges and paths for export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.traverse import confidence_value
from .lookup import layer

MODES = {
    "compact": ("id", "label"),
    "detailed": ("id", "label", "kind", "project_name", "namespace", "class_name", "method_name"),
    "visualization": ("id", "label", "kind", "layer", "entry_point"),
    "debug": ("id", "label", "kind", "layer", "project_name", "namespace", "class_name", "method_name", "entry_point", "route", "table_name", "is_external"),
    "ai": ("id", "label", "kind", "layer", "route", "table_name"),
}


def node_projection(nodes: DataFrame, mode: str = "compact") -> DataFrame:
    return nodes.withColumn("layer", layer()).select(*MODES[mode])


def edge_projection(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat("from_id", F.lit("→"), "to_id", F.lit("|"), "kind").alias("id"), "kind", "confidence")


def path_steps(paths: DataFrame) -> DataFrame:
    """(path_id, seq, node, via): a row for each node of each path."""
    rows = paths.select("path_id", "edge_kinds", F.posexplode("node_ids").alias("seq", "node"))
    return rows.select("path_id", "seq", "node", F.get("edge_kinds", F.col("seq") - 1).alias("via"))


def path_totals(paths: DataFrame) -> DataFrame:
    return paths.agg(
        F.count("*").alias("n_paths"), F.countDistinct("root").alias("n_roots"), F.countDistinct("leaf").alias("n_leaves"),
        F.max("length").alias("longest"), F.round(F.avg("length"), 6).alias("mean_length"),
    )


def path_scores(paths: DataFrame, edges: DataFrame, nodes: DataFrame, limit: int = 20, least: float = 0.3) -> DataFrame:
    """(path_id, score): 0.4 x the product of its edges' confidences, 0.35 x its share of grounded nodes (id, grounded), 0.25 x by length."""
    hops = paths.select("path_id", "length", F.explode(F.zip_with(F.slice("node_ids", F.lit(1), F.size("node_ids") - 1), F.slice("node_ids", F.lit(2), F.size("node_ids")), lambda a, b: F.struct(a.alias("from_id"), b.alias("to_id")))).alias("h"))
    level = edges.groupBy("from_id", "to_id").agg(F.max(confidence_value(F.col("confidence"))).alias("c"))
    rows = hops.select("path_id", "length", "h.from_id", "h.to_id").join(level, ["from_id", "to_id"]).groupBy("path_id").agg(F.first("length").alias("length"), F.product("c").alias("conf"))
    known = paths.select("path_id", F.explode("node_ids").alias("id")).join(nodes.select("id", "grounded"), "id", "left")
    rows = rows.join(known.groupBy("path_id").agg(F.avg(F.coalesce("grounded", F.lit(False)).cast("int")).alias("share")), "path_id")
    by_length = F.when(F.col("length") <= 3, 1.0).when(F.col("length") <= 6, 0.7).otherwise(0.4)
    return rows.select("path_id", F.round(0.4 * F.col("conf") + 0.35 * F.col("share") + 0.25 * by_length, 6).alias("score")).filter(F.col("score") >= least).orderBy(F.desc("score"), "path_id").limit(limit)
