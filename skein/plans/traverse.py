"""Bounded walks over a graph of two tables: nodes (id, ...) and edges (from_id, to_id, kind, ...).

Each round is one join of a frontier with the edges and is cut into the shared
folder, so plans stay short. Set-valued questions (closures, distances) carry
nodes and never paths.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

LEVELS = {"exact": 1.0, "high": 0.75, "medium": 0.5, "low": 0.25}


def confidence_value(level: Column) -> Column:
    """A confidence level's number; 0 where it is none of them."""
    out = F.lit(0.0)
    for name, value in LEVELS.items():
        out = F.when(level == name, value).otherwise(out)
    return out


def steps(edges: DataFrame, direction: str = "forward", kinds: Sequence[str] | None = None) -> DataFrame:
    """(src, dst, kind, confidence, evidence): a row for each way to go. ``both`` goes either way."""
    if kinds is not None:
        edges = edges.filter(F.col("kind").isin(*kinds))
    level = F.col("confidence") if "confidence" in edges.columns else F.lit(None).cast("string")
    proof = F.col("evidence") if "evidence" in edges.columns else F.lit(None).cast("string")
    ahead = edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "kind", level.alias("confidence"), proof.alias("evidence"))
    back = edges.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"), "kind", level.alias("confidence"), proof.alias("evidence"))
    return {"forward": ahead, "backward": back}.get(direction) or ahead.unionByName(back)


def typed_paths(
    nodes: DataFrame,
    edges: DataFrame,
    starts: DataFrame,
    *,
    kinds: Sequence[str] | None = None,
    direction: str = "forward",
    max_depth: int = 15,
    max_paths: int | None = None,
    target: Column | None = None,
    min_confidence: float | None = None,
    node_kinds: Sequence[str] | None = None,
) -> DataFrame:
    """(path_id, node_ids, edge_kinds, length, root, leaf): the simple paths from ``starts`` (id), in depth-first order.

    A path ends at a ``target`` node (a condition on nodes), after ``max_depth``
    edges, or where no step is left. Steps of unknown confidence pass; so do
    steps to unknown nodes. Of parallel steps the first stands. The order is
    that of the steps' (kind, node) along a path; ``max_paths`` cuts it there,
    and in each round: every open path ends somewhere, so the first ones come
    from the first open ones.
    """
    way = steps(edges, direction, kinds)
    if min_confidence is not None:
        way = way.filter(F.col("confidence").isNull() | (confidence_value(F.col("confidence")) >= min_confidence) | ~F.col("confidence").isin(*LEVELS))
    way = way.groupBy("src", "dst").agg(F.min("kind").alias("kind"))
    known = nodes.select(F.col("id").alias("dst"), F.col("kind").alias("node_kind"), (F.coalesce(target, F.lit(False)) if target is not None else F.lit(False)).alias("hit"))
    way = way.join(known, "dst", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    if node_kinds is not None:
        way = way.filter(F.col("node_kind").isNull() | F.col("node_kind").isin(*node_kinds))
    way = cut(way.select("src", "dst", "kind", "hit"))
    first = starts.select(F.col("id").alias("dst")).distinct().join(known, "dst", "left")
    here = cut(first.select(F.array("dst").alias("node_ids"), F.array().cast("array<string>").alias("edge_kinds"), F.col("dst").alias("leaf"), F.coalesce("hit", F.lit(False)).alias("hit")))
    done = []
    for _ in range(max_depth):
        done.append(here.filter("hit"))
        open_ = here.filter("not hit")
        # one outer join gives both the next paths and the ends: a path with no valid step keeps one empty row
        joined = open_.withColumnRenamed("hit", "_").drop("_").join(way.withColumnRenamed("src", "leaf"), "leaf", "left")
        valid = F.col("dst").isNotNull() & ~F.array_contains("node_ids", F.col("dst"))
        grown = joined.filter(valid).select(F.concat("node_ids", F.array("dst")).alias("node_ids"), F.concat("edge_kinds", F.array("kind")).alias("edge_kinds"), F.col("dst").alias("leaf"), "hit")
        ends = joined.groupBy("node_ids", "edge_kinds", "leaf").agg(F.max(valid.cast("int")).alias("v")).filter("v = 0").drop("v").withColumn("hit", F.lit(False))
        done.append(ends)
        here = cut(grown if max_paths is None else grown.orderBy(_order()).limit(max_paths))
        if here.isEmpty():
            break
    else:
        done.append(here)
    paths = done[0]
    for part in done[1:]:
        paths = paths.unionByName(part)
    out = paths.select(
        F.concat_ws("|", "node_ids").alias("path_id"), "node_ids", "edge_kinds", (F.size("node_ids") - 1).alias("length"),
        F.element_at("node_ids", 1).alias("root"), F.element_at("node_ids", -1).alias("leaf"),
    )
    if max_paths is not None:
        out = out.orderBy(_order()).limit(max_paths)
    return out


def _order() -> Column:
    """Where a path stands in depth-first order."""
    return F.concat(F.array(F.element_at("node_ids", 1)), F.zip_with("edge_kinds", F.slice("node_ids", F.lit(2), F.size("node_ids")), lambda k, n: F.concat_ws(":", k, n)))


#: Rounds after which the parts of what was seen are written as one table; before, only the new part is written.
PARTS = 10


def closure(
    edges: DataFrame, starts: DataFrame, *, direction: str = "forward", kinds: Sequence[str] | None = None, max_hops: int | None = None, most: int | None = None
) -> DataFrame:
    """(start, id, distance): all nodes within reach of each start, itself at distance 0.

    A start that has ``most`` nodes and more after a round goes no further.
    """
    way = cut(steps(edges, direction, kinds).select("src", "dst").distinct())
    seen = cut(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("distance")).distinct())
    frontier, hop = seen, 0
    while max_hops is None or hop < max_hops:
        hop += 1
        if most is not None and hop > 1:
            full = seen.groupBy("start").count().filter(F.col("count") >= most)
            frontier = frontier.join(full.select("start"), "start", "left_anti")
        reached = frontier.join(way, frontier["id"] == way["src"]).select("start", F.col("dst").alias("id")).distinct()
        frontier = cut(reached.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("distance", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if hop % PARTS == 0:
            seen = cut(seen)
    return seen


def distances(edges: DataFrame, starts: DataFrame, *, direction: str = "forward", kinds: Sequence[str] | None = None, max_hops: int = 15) -> DataFrame:
    """(id, distance): hops from the nearest start, of all nodes within ``max_hops``."""
    way = cut(steps(edges, direction, kinds).select("src", "dst").distinct())
    seen = cut(starts.select("id").distinct().withColumn("distance", F.lit(0)))
    frontier = seen
    for hop in range(1, max_hops + 1):
        reached = frontier.join(way, frontier["id"] == way["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = cut(reached.join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if hop % PARTS == 0:
            seen = cut(seen)
    return seen


def entry_points(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(id, entry): ancestors of each node in ``of``, or the node itself, that nothing calls.

    The walk goes ahead from the entries, so a node meets its entries and no other ancestors.
    """
    called = edges.select(F.col("to_id").alias("id")).distinct()
    entries = of.select("id").unionByName(edges.select(F.col("from_id").alias("id"))).distinct().join(called, "id", "left_anti")
    found = closure(edges, entries).join(of.select("id").distinct(), "id", "left_semi")
    return found.select("id", F.col("start").alias("entry"))


def call_chains(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(chain, length): all simple call chains of up to ``depth`` edges from each start."""
    if depth < 0:
        raise ValueError("depth must not be negative")
    nodes = edges.select(F.col("from_id").alias("id")).limit(0).withColumn("kind", F.lit("method"))
    return typed_paths(nodes, edges, starts, max_depth=depth).select(F.col("path_id").alias("chain"), "length")


#: How much a step of each kind keeps of a confidence, and what kind a step is by its edge's kind and evidence.
DECAY = {
    "direct-symbol-binding": 1.00, "explicit-invocation": 0.95, "control-flow": 0.92, "data-flow": 0.90, "inheritance": 0.88,
    "configuration-binding": 0.85, "semantic-similarity": 0.75, "propagation-inference": 0.60, "speculative-expansion": 0.40,
}
CALLS = {"semantic": "explicit-invocation", "semantic-inferred": "semantic-similarity", "syntax": "control-flow", "syntax-pattern": "semantic-similarity"}
OTHERS = {"entity-access": "data-flow", "implements": "configuration-binding", "property-ref": "configuration-binding"}
UNKNOWN = "propagation-inference"
DEFAULT_DECAY, SPECULATIVE_DECAY, MAX_HOPS = 0.7, 0.5, 5


def decay_kind(kind: Column, evidence: Column) -> Column:
    """What kind of step an edge is."""
    call, other = F.lit(UNKNOWN), F.lit(UNKNOWN)
    for name, value in CALLS.items():
        call = F.when(evidence == name, value).otherwise(call)
    for name, value in OTHERS.items():
        other = F.when(kind == name, value).otherwise(other)
    return F.when(kind == "call", call).otherwise(other)


def decay(kind: Column) -> Column:
    """What a step of a kind (of ``DECAY``) keeps; a step of another kind keeps DEFAULT_DECAY."""
    out = F.lit(DEFAULT_DECAY)
    for name, value in DECAY.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def propagate(edges: DataFrame, starts: DataFrame, *, direction: str = "forward", max_hops: int = MAX_HOPS, least: float = 0.2, literal_stop: bool = False) -> DataFrame:
    """(start, id, score, hop, via): the best product of decays over walks of up to ``max_hops`` steps.

    Steps of low confidence do not carry. A score below ``least`` (unsupported)
    does not spread; with ``literal_stop`` nothing spreads. Ties go to fewer
    hops, then to the smaller predecessor.
    """
    way = steps(edges, direction).filter(F.coalesce(F.col("confidence") != "low", F.lit(True)))
    way = cut(way.groupBy("src", "dst").agg(F.max(decay(decay_kind(F.col("kind"), F.col("evidence")))).alias("keep")))
    best = cut(starts.select(F.col("id").alias("start"), "id", F.lit(1.0).alias("score"), F.lit(0).alias("hop"), F.lit("").alias("via")).distinct())
    frontier = best
    for _ in range(0 if literal_stop else max_hops):
        spread = frontier.filter(F.col("score") >= least).withColumnRenamed("id", "src").drop("via").join(way, "src")
        arrived = spread.select("start", F.col("dst").alias("id"), (F.col("score") * F.col("keep")).alias("score"), (F.col("hop") + 1).alias("hop"), F.col("src").alias("via"))
        arrived = arrived.filter(F.col("score") >= least)
        both = best.withColumn("old", F.lit(True)).unionByName(arrived.withColumn("old", F.lit(False)))
        rank = F.struct(F.round("score", 9).alias("s"), (-F.col("hop")).alias("h"), F.col("old").alias("o"))
        top = both.groupBy("start", "id").agg(F.max(rank).alias("r"))
        won = both.join(top, ["start", "id"]).filter(rank == F.col("r")).groupBy("start", "id", "old").agg(F.max("score").alias("score"), F.min("hop").alias("hop"), F.min("via").alias("via"))
        won = cut(won)
        best = won.drop("old")
        frontier = won.filter("not old").drop("old")
        if frontier.isEmpty():
            break
    return best
