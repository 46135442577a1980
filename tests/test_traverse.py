"""Walks over small graphs drawn by hand."""

import pytest
from pyspark.sql import functions as F

from skein.operators import lookup, metrics
from skein.plans import traverse

GRAPHS = {
    "chain4": [("a", "b"), ("b", "c"), ("c", "d")],
    "diamond": [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")],
    "cycle3": [("a", "b"), ("b", "c"), ("c", "a")],
    "selfloop": [("a", "a"), ("a", "b")],
    "twoparts": [("a", "b"), ("x", "y")],
}


def graph(spark, pairs):
    rows = [(*p, "call", "high") if len(p) == 2 else p for p in pairs]
    edges = spark.createDataFrame(rows, "from_id string, to_id string, kind string, confidence string")
    ids = sorted({x for r in rows for x in r[:2]})
    nodes = spark.createDataFrame([(i, "entity" if i == "e" else "method", i == "r") for i in ids], "id string, kind string, entry_point boolean")
    return nodes, edges


def starts(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def chains(spark, name, start, depth):
    _, edges = graph(spark, GRAPHS[name])
    return sorted(r.chain for r in traverse.call_chains(edges, starts(spark, start), depth).collect())


@pytest.mark.parametrize(
    ("name", "start", "depth", "want"),
    [
        ("chain4", "a", 2, ["a|b|c"]),
        ("chain4", "a", 9, ["a|b|c|d"]),
        ("chain4", "d", 3, ["d"]),
        ("chain4", "a", 0, ["a"]),
        ("diamond", "a", 5, ["a|b|d", "a|c|d"]),
        ("cycle3", "a", 5, ["a|b|c"]),
        ("selfloop", "a", 3, ["a|b"]),
        ("twoparts", "x", 3, ["x|y"]),
    ],
)
def test_call_chains(spark, name, start, depth, want):
    assert chains(spark, name, start, depth) == want


def test_negative_depth(spark):
    with pytest.raises(ValueError):
        chains(spark, "chain4", "a", -1)


def test_entry_points(spark):
    _, edges = graph(spark, GRAPHS["diamond"])
    assert {(r.id, r.entry) for r in traverse.entry_points(edges, starts(spark, "d", "a")).collect()} == {("d", "a"), ("a", "a")}
    _, edges = graph(spark, GRAPHS["cycle3"])
    assert traverse.entry_points(edges, starts(spark, "b")).count() == 0


def test_distances_of_unreachable(spark):
    nodes, edges = graph(spark, [("r", "s"), ("s", "e", "entity-access", "high"), ("x", "y")])
    got = {r.id: (r.entry_distance, r.data_distance, r.depth) for r in metrics.dependency(nodes.withColumns({"route": F.lit(None).cast("string"), "class_name": F.lit("")}), edges).collect()}
    assert got == {"r": (0, 2, 2), "s": (1, 1, 2), "e": (2, 0, 2), "x": (-1, -1, -1), "y": (-1, -1, -1)}


def test_typed_paths_both_ways(spark):
    nodes, edges = graph(spark, [("r", "s"), ("s", "e", "entity-access", "high")])
    ahead = traverse.typed_paths(nodes, edges, starts(spark, "r"), target=F.col("kind") == "entity").collect()
    assert [(r.path_id, r.edge_kinds) for r in ahead] == [("r|s|e", ["call", "entity-access"])]
    back = traverse.typed_paths(nodes, edges, starts(spark, "e"), direction="backward", target=F.col("entry_point")).collect()
    assert [r.path_id for r in back] == ["e|s|r"]
    only = traverse.typed_paths(nodes, edges, starts(spark, "e"), direction="backward", kinds=["entity-access"]).collect()
    assert [r.path_id for r in only] == ["e|s"]


def test_both_directions_is_a_union(spark):  # Q-04
    nodes, edges = graph(spark, GRAPHS["chain4"])
    got = {r.path_id for r in traverse.typed_paths(nodes, edges, starts(spark, "b"), direction="both").collect()}
    assert got == {"b|a", "b|c|d"}


def test_parallel_edges_give_one_path(spark):
    nodes, edges = graph(spark, [("a", "b", "call", "high"), ("a", "b", "implements", "low")])
    got = traverse.typed_paths(nodes, edges, starts(spark, "a")).collect()
    assert [(r.path_id, r.edge_kinds) for r in got] == [("a|b", ["call"])]


def test_unknown_target_passes_and_confidence_filters(spark):
    nodes, edges = graph(spark, [("a", "b", "call", "low"), ("a", "c", "call", "high"), ("a", "z", "call", "odd")])
    nodes = nodes.filter("id <> 'z'")
    got = {r.path_id for r in traverse.typed_paths(nodes, edges, starts(spark, "a"), min_confidence=0.5).collect()}
    assert got == {"a|c", "a|z"}


def test_max_paths_takes_the_first_in_order(spark):
    nodes, edges = graph(spark, GRAPHS["diamond"])
    got = traverse.typed_paths(nodes, edges, starts(spark, "a"), max_paths=1).collect()
    assert [r.path_id for r in got] == ["a|b|d"]


def test_propagation(spark):
    _, edges = graph(spark, [("a", "b"), ("b", "d"), ("a", "c", "entity-access", "high"), ("c", "d", "entity-access", "high"), ("a", "x", "call", "low")])
    edges = edges.withColumn("evidence", F.lit("semantic"))
    got = {r.id: (round(r.score, 6), r.hop, r.via) for r in traverse.propagate(edges, starts(spark, "a")).collect()}
    assert got == {"a": (1.0, 0, ""), "b": (0.95, 1, "a"), "c": (0.9, 1, "a"), "d": (0.9025, 2, "b")}
    assert traverse.propagate(edges, starts(spark, "a"), literal_stop=True).count() == 1  # Q-01


def test_propagation_decays_with_each_hop(spark):
    _, edges = graph(spark, [(f"n{i}", f"n{i + 1}") for i in range(8)])
    reach = lambda e: {r.id: r.hop for r in traverse.propagate(e, starts(spark, "n0")).collect()}
    assert reach(edges.withColumn("evidence", F.lit("semantic"))) == {f"n{i}": i for i in range(6)}
    assert reach(edges) == {f"n{i}": i for i in range(4)}  # calls of unknown evidence keep 0.6 a step


def test_first_paths_of_a_dense_graph(spark):
    """The first paths in depth-first order, without all of them at once."""
    nodes, edges = graph(spark, [(f"{a}{i}", f"{b}{j}") for a, b in zip("abcd", "bcde", strict=True) for i in range(4) for j in range(4)])
    of = starts(spark, "a0", "a1")
    all_ = [r.path_id for r in traverse.typed_paths(nodes, edges, of, max_depth=5).collect()]
    some = [r.path_id for r in traverse.typed_paths(nodes, edges, of, max_depth=5, max_paths=7).collect()]
    assert len(all_) == 2 * 4**4 and some == sorted(all_)[:7]


def test_entries_of_shared_ancestors(spark):
    nodes, edges = graph(spark, [("r", "a"), ("s", "a"), ("a", "b"), ("b", "c"), ("c", "b"), ("x", "x")])
    got = {(r.id, r.entry) for r in traverse.entry_points(edges, starts(spark, "a", "c", "r", "x", "lone")).collect()}
    assert got == {("a", "r"), ("a", "s"), ("c", "r"), ("c", "s"), ("r", "r"), ("lone", "lone")}


def test_partitioning_changes_nothing(spark):
    nodes, edges = graph(spark, GRAPHS["diamond"] + GRAPHS["cycle3"] + [("d", "q")])
    def run(n):
        return sorted(tuple(r) for r in traverse.typed_paths(nodes.repartition(n), edges.repartition(n), starts(spark, "a", "b").repartition(n), max_depth=4).collect())
    assert run(1) == run(13)


def test_fan_excludes_itself(spark):
    nodes, edges = graph(spark, GRAPHS["selfloop"])
    assert {r.id: r.fan for r in metrics.fans(nodes, edges).collect()} == {"a": 1, "b": 0}


def test_fan_cap(spark):
    nodes, edges = graph(spark, [("a", "b")] + [("b", f"c{i}") for i in range(30)])
    got = {r.id: r.fan for r in metrics.fans(nodes, edges, cap=10).collect()}
    assert got["a"] == 9 and got["b"] == 30


def test_missing_node(spark):
    nodes, _ = graph(spark, GRAPHS["chain4"])
    with pytest.raises(KeyError):
        lookup.ensure_exists(nodes, "nope")
