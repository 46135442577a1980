"""Graph features: degrees, fans, distances, centrality, business value, importance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import traverse
from .lookup import layer

#: A fan's walk stops at so many visited nodes, itself included.
FAN_CAP = 200
LAYER_DEPTH = {"route": 0, "controller": 1, "service": 2, "repository": 3, "entity": 4, "table": 5}


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_callers, n_callees), distinct."""
    out = edges.groupBy(F.col("from_id").alias("id")).agg(F.countDistinct("to_id").alias("n_callees"))
    back = edges.groupBy(F.col("to_id").alias("id")).agg(F.countDistinct("from_id").alias("n_callers"))
    return nodes.select("id").join(back, "id", "left").join(out, "id", "left").na.fill(0, ["n_callers", "n_callees"]).select("id", "n_callers", "n_callees")


def fans(nodes: DataFrame, edges: DataFrame, direction: str = "forward", cap: int = FAN_CAP) -> DataFrame:
    """(id, fan): nodes within reach, itself excluded; from ``cap`` - 1 on, the direct neighbours or ``cap`` - 1."""
    reach = traverse.closure(edges, nodes, direction=direction, most=cap).filter("id <> start")
    counted = reach.groupBy("start").agg(F.count("*").alias("reach"), F.count_if(F.col("distance") == 1).alias("direct"))
    fan = F.when(F.col("direct") >= cap - 1, F.col("direct")).otherwise(F.least(F.coalesce("reach", F.lit(0)), F.lit(cap - 1)))
    return nodes.select(F.col("id").alias("start")).join(counted, "start", "left").select(F.col("start").alias("id"), F.coalesce(fan, F.lit(0)).cast("long").alias("fan"))


def related(nodes: DataFrame, edges: DataFrame, members: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_entities, n_tables, first_table, n_routes, first_route): what the nodes of each set (id, by) reach in one step, and their routes."""
    entities = nodes.filter("kind = 'entity'").select(F.col("id").alias("to_id"), F.col("table_name").alias("t"))
    reached = edges.select(F.col("from_id").alias("id"), "to_id").distinct().join(entities, "to_id")
    rows = members.join(nodes.select("id", "route"), "id").join(reached, "id", "left")
    return rows.groupBy(*by).agg(
        F.countDistinct("to_id").alias("n_entities"), F.countDistinct("t").alias("n_tables"), F.min("t").alias("first_table"), F.countDistinct("route").alias("n_routes"), F.min("route").alias("first_route"),
    )


def centrality(degree: DataFrame) -> DataFrame:
    """(id, centrality): (callers + callees) / (3 x the largest of both), at most 1."""
    top = degree.agg(F.greatest(F.max("n_callers"), F.max("n_callees")).alias("top"))
    value = F.least((F.col("n_callers") + F.col("n_callees")) / F.greatest(3 * F.col("top"), F.lit(1)), F.lit(1.0))
    return degree.crossJoin(F.broadcast(top)).select("id", F.round(value, 6).alias("centrality"))


def dependency(nodes: DataFrame, edges: DataFrame, entry_hops: int = 15, data_hops: int = 10) -> DataFrame:
    """(id, entry_distance, data_distance, layer, layer_depth, depth); -1 where out of reach."""
    entry = traverse.distances(edges, nodes.filter("entry_point"), max_hops=entry_hops).withColumnRenamed("distance", "entry_distance")
    data = traverse.distances(edges, nodes.filter("kind = 'entity'"), direction="backward", max_hops=data_hops).withColumnRenamed("distance", "data_distance")
    depth_of = F.lit(3)
    for name, depth in LAYER_DEPTH.items():
        depth_of = F.when(F.col("layer") == name, depth).otherwise(depth_of)
    rows = nodes.withColumn("layer", layer()).select("id", "layer", depth_of.alias("layer_depth")).join(entry, "id", "left").join(data, "id", "left").na.fill(-1, ["entry_distance", "data_distance"])
    e, d = F.col("entry_distance"), F.col("data_distance")
    return rows.withColumn("depth", F.when((e >= 0) & (d >= 0), e + d).when(e >= 0, e).when(d >= 0, d).otherwise(-1))


def business(entry_distance: Column, data_distance: Column, is_entry: Column, has_access: Column) -> Column:
    near = F.when(entry_distance.between(0, 5), F.greatest(F.lit(0.0), 2 - 0.4 * entry_distance)).otherwise(0.0)
    data = F.when(data_distance.between(0, 3), F.greatest(F.lit(0.0), 2 - 0.6 * data_distance)).otherwise(0.0)
    return F.least((near + data + F.when(is_entry, 2.0).otherwise(0.0) + F.when(has_access, 1.5).otherwise(0.0)) / 5, F.lit(1.0))


def importance(central: Column, value: Column, traffic: Column, is_entry: Column, has_access: Column, entry_distance: Column, data_distance: Column) -> Column:
    near = F.when(entry_distance.between(0, 2), 0.5).otherwise(0.0) + F.when(data_distance.between(0, 2), 0.5).otherwise(0.0)
    raw = 0.20 * central + 0.25 * value + 0.15 * F.least(traffic / 50, F.lit(1.0)) + 0.20 * F.when(is_entry, 1.0).otherwise(0.0) + 0.15 * F.when(has_access, 1.0).otherwise(0.0) + 0.05 * near
    return F.round(10 * F.round(raw, 3), 2)


def features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All features of each node in one row."""
    degree = degrees(nodes, edges)
    access = edges.filter("kind = 'entity-access'").select(F.col("from_id").alias("id")).distinct().withColumn("has_access", F.lit(True))
    rows = nodes.select("id", "kind", "project_name", "class_name", "namespace", "entry_point", "is_external").join(degree, "id").join(centrality(degree), "id").join(dependency(nodes, edges), "id").join(access, "id", "left").na.fill(False, ["has_access"])
    value = F.round(business(F.col("entry_distance"), F.col("data_distance"), F.col("entry_point"), F.col("has_access")), 6)
    return rows.withColumn("business", value).withColumn(
        "importance",
        importance(F.col("centrality"), F.col("business"), F.col("n_callers") + F.col("n_callees"), F.col("entry_point"), F.col("has_access"), F.col("entry_distance"), F.col("data_distance")),
    )


def class_metadata(rows: DataFrame) -> DataFrame:
    """Features of classes of two members and more, from those of their nodes."""
    found = rows.filter("not is_external").groupBy("project_name", "namespace", "class_name").agg(
        F.count("*").alias("n"), F.sum("n_callers").alias("n_callers"), F.sum("n_callees").alias("n_callees"),
        F.coalesce(F.min(F.when(F.col("entry_distance") >= 0, F.col("entry_distance"))), F.lit(-1)).alias("entry_distance"),
        F.coalesce(F.min(F.when(F.col("data_distance") >= 0, F.col("data_distance"))), F.lit(-1)).alias("data_distance"),
        F.max("layer_depth").alias("layer_depth"), F.bool_or("entry_point").alias("is_entry"), F.bool_or("has_access").alias("has_access"),
        F.round(F.avg("centrality"), 3).alias("centrality"), F.max("business").alias("business"),
    )
    return found.filter("n >= 2")


def path_frequency(paths: DataFrame) -> DataFrame:
    """(node, share): the share of paths that touch each node."""
    total = paths.agg(F.count("*").alias("total"))
    touched = paths.select("path_id", F.explode("node_ids").alias("node")).distinct().groupBy("node").agg(F.count("*").alias("n"))
    return touched.crossJoin(F.broadcast(total)).select("node", F.round(F.col("n") / F.col("total"), 6).alias("share"))
