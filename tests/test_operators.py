"""Operators on small tables, and the decisions about surprising behaviour."""

from pyspark.sql import functions as F

from skein.functions import confidence, fusion
from skein.functions import text as t
from skein.operators import analyzers, build, retrieval, state, text, truth
from skein.sources import graphs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_unreachable_distance_counts_as_near_by_default(spark):  # Q-08
    assert one(spark, fusion.graph_score(F.lit(-1), F.lit(-1), F.lit(0))) == 0.5
    assert one(spark, fusion.graph_score(F.lit(-1), F.lit(-1), F.lit(0), strict=True)) == 0.0


def test_cosine_of_odd_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, fusion.cosine(v(1, 0), v(1, 0))) == 1.0
    assert one(spark, fusion.cosine(v(1, 0), v(1, 0, 0))) == 0.0
    assert one(spark, fusion.cosine(v(0, 0), v(1, 0))) == 0.0


def test_levels(spark):
    assert [one(spark, confidence.level(F.lit(x))) for x in (1.0, 0.95, 0.9, 0.6, 0.5, 0.2, 0.1)] == [0, 0, 1, 2, 3, 4, 5]
    assert one(spark, confidence.level(F.lit(0.99), F.lit(True))) == 3


def test_names(spark):
    assert one(spark, t.called_name(F.lit("this.dao.Find<Order>(x)"))) == "Find"
    assert one(spark, t.camel_words(F.lit("LoadXMLFile"))) == ["Load", "XML", "File"]
    assert one(spark, t.action(F.lit("GetOrder"))) == "query"
    assert one(spark, t.action(F.lit("LoadOrder"))) == "query"
    assert one(spark, t.folder_of(F.lit("OrderDto"))) == "Models"
    assert one(spark, t.token_estimate(F.lit(""))) == 0
    assert one(spark, t.token_estimate(F.lit("日本"))) == 2


def test_hash_embedding_is_a_unit_vector(spark):
    v = one(spark, t.hash_embedding(F.lit("x")))
    assert len(v) == 384 and abs(sum(x * x for x in v) - 1) < 1e-9


def test_batches(spark):
    rows = spark.createDataFrame([("g", i, n) for i, n in enumerate([5000, 3000, 200, 9000, 1])] + [("h", i, 1) for i in range(70)], "g string, id int, tokens int")
    got = {(r.g, r.id): r.batch for r in text.batches(rows, "g").collect()}
    assert [got["g", i] for i in range(5)] == [0, 0, 1, 2, 3]
    assert [got["h", i] for i in (0, 31, 32, 64, 69)] == [0, 0, 1, 2, 2]


def test_cached_embedding_keeps_its_own_id(spark):  # Q-22
    rows = spark.createDataFrame([(1, "same"), (2, "same")], "id int, text string")
    cache = text.embed(rows.filter("id = 1"))
    assert {(r.id, r.cached) for r in text.embed(rows, cache).collect()} == {(1, True), (2, True)}


def test_last_assignment_before_use(spark):
    accesses = spark.createDataFrame([(1, "m", "v", 50)], "access_id int, method string, argument string, pos int")
    assigned = spark.createDataFrame([("m", "v", 10, "old"), ("m", "v", 40, "new"), ("m", "v", 60, "late")], "method string, variable string, pos int, expression string")
    assert [r.expression for r in analyzers.traced(accesses, assigned).collect()] == ["new"]


def test_bindings_follow_parameters(spark):  # Q-28
    bases = spark.createDataFrame([("A", "B", 0, "Order"), ("B", "C", 0, "T"), ("C", "D", 0, "T")], "class_name string, base_name string, arg int, argument string")
    params = spark.createDataFrame([("B", "T", 0), ("C", "T", 0)], "class_name string, parameter string, ord int")
    got = {(r.class_name, r.base_name, r.argument, r.depth) for r in analyzers.bindings(bases, params).collect()}
    assert got == {("A", "B", "Order", 1), ("A", "C", "Order", 2), ("A", "D", "Order", 3)}


def test_table_lookup_is_exact_unless_asked(spark):  # Q-07
    from skein.operators import lookup

    nodes = spark.createDataFrame([("1", "entity", "LBQC"), ("2", "entity", "LBQCItem")], "id string, kind string, table_name string")
    assert [r.id for r in lookup.entities_of_table(nodes, "LBQC").collect()] == ["1"]
    assert lookup.entities_of_table(nodes, "LBQC", prefix=True).count() == 2


def test_text_edges_find_name_endings(spark):
    units = spark.createDataFrame([("u1", "P", "n", "A", "Run", "x.TryFind(1); Go (2)"), ("u2", "P", "n", "B", "Find", ""), ("u3", "Q", "n", "C", "Go", "")], "id string, project_name string, namespace string, class_name string, method_name string, content string")
    none = spark.createDataFrame([], "from_id string, to_id string")
    assert {(r.from_id, r.to_id) for r in build.text_edges(units, none).collect()} == {("u1", "u2")}


def test_later_annotation_wins(spark):
    facts = spark.createDataFrame([("a", "n", "t", "1.cs", "x"), ("a", "n", "t", "2.cs", "y")], "analyzer string, subject_id string, fact_type string, source_file string, value string")
    assert build.annotated(facts).first().attributes == {"a:t": "y"}


def test_fingerprint_does_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(f"s{i}", f"c{i % 3}", "x", "user", i / 50, 1, i % 2 == 0, False) for i in range(50)], "statement_id string, subject_id string, claim string, tone string, score double, hop int, speculative_ancestor boolean, suppressed boolean")
    assert state.state_fingerprint(rows.repartition(1)).first() == state.state_fingerprint(rows.repartition(13)).first()
    changed = rows.withColumn("score", F.when(F.col("statement_id") == "s7", 0.99).otherwise(F.col("score")))
    assert state.state_fingerprint(rows).first() != state.state_fingerprint(changed).first()


def test_symbols_of_two_statements_are_flagged(spark):  # Q-29
    s = spark.createDataFrame([("a", "c", "", "t", 0.5, 0, False, False), ("b", "c", "", "t", 0.5, 0, False, False)], "statement_id string, subject_id string, claim string, tone string, score double, hop int, speculative_ancestor boolean, suppressed boolean")
    e = spark.createDataFrame([("a", "1", "sym", "f", 0.5, False), ("b", "2", "sym", "g", 0.5, False)], "statement_id string, evidence_id string, symbol string, source_file string, score double, speculative_ancestor boolean")
    assert {r.check: r.n for r in state.consistency(s, e, e).collect()}["shared_symbols"] == 1


def test_governance_trail(spark):
    s = spark.createDataFrame([(f"s{i}", "c", f"claim {i}", "t", 0.9, 0, False, False) for i in range(4)], "statement_id string, subject_id string, claim string, tone string, score double, hop int, speculative_ancestor boolean, suppressed boolean")
    e = spark.createDataFrame([(f"s{i}", str(i), f"sym{i}", "f", 0.9, False) for i in range(4)], "statement_id string, evidence_id string, symbol string, source_file string, score double, speculative_ancestor boolean")
    trail = lambda *x, **k: [(r.step, r.decision) for r in state.governance(*x, **k).orderBy("seq").collect()]
    assert trail((s, e, e), (s, e, e)) == [("invariants-before", "Allow"), ("invariants-after", "Allow"), ("transition", "Allow"), ("drift", "Allow"), ("verdict", "Allow")]
    up = s.withColumn("score", F.lit(0.99))
    assert trail((s, e, e), (up, e, e))[-2:] == [("transition", "Reject"), ("verdict", "Reject")]
    assert trail((s, e, e), (up, e, e), reject_transition=False)[-3:] == [("transition", "Warn"), ("drift", "Warn"), ("verdict", "Warn")]
    assert trail((s, e, e.limit(0)), (s, e, e))[-2:] == [("invariants-before", "Reject"), ("verdict", "Reject")]


def test_truth_halves_without_grounding(spark):
    edges = spark.createDataFrame([("a", "b", "call", "high", "semantic"), ("a", "c", "call", "high", "semantic")], "from_id string, to_id string, kind string, confidence string, evidence string")
    nodes = spark.createDataFrame([("a", False), ("b", True), ("c", False)], "id string, grounded boolean")
    assert {r.to_id: r.truth for r in truth.edge_truth(edges, nodes).collect()} == {"b": 1.0, "c": 0.5}


def test_vector_search_in_blocks(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(30)]
    vectors = spark.createDataFrame(rows, "chunk_id int, v array<float>")
    queries = spark.createDataFrame(rows[:9], "query_id int, q array<float>")
    whole = sorted(tuple(r) for r in retrieval.vector_top_k(queries, vectors, 4).collect())
    assert sorted(tuple(r) for r in retrieval.vector_top_k(queries, vectors, 4, block=2).collect()) == whole


def test_cache_misses(spark, tmp_path):
    assert graphs.load_cache(spark, str(tmp_path / "none")) is None
    graphs.save_cache({"nodes": spark.range(3)}, str(tmp_path / "c"))
    assert graphs.load_cache(spark, str(tmp_path / "c"))["nodes"].count() == 3
    spark.createDataFrame([("{broken",)], "value string").write.mode("overwrite").text(str(tmp_path / "c" / "manifest"))
    assert graphs.load_cache(spark, str(tmp_path / "c")) is None


def test_corrupt_snapshots_are_left_out(spark, tmp_path):
    spark.createDataFrame([('{"case_id": 1, "label": "x"}',), ("not json",)], "value string").coalesce(1).write.text(str(tmp_path / "s" / "mode=Hybrid"))
    assert [(r.case_id, r.mode) for r in graphs.read_snapshots(spark, str(tmp_path / "s")).collect()] == [(1, "Hybrid")]


def test_graph_document(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"schemaVersion": 1, "nodes": [{"id": "a", "attributes": {"route": "/x"}}], "edges": [{"from": "a", "to": "b", "kind": "call"}], "facts": []}')
    nodes, edges, facts = graphs.read_graph_json(spark, str(tmp_path / "g.json"))
    assert nodes.first().attributes == {"route": "/x"} and edges.first()["to"] == "b" and facts.count() == 0


def test_units_of_a_source():
    from skein.sources import code

    text = """namespace A.B;
    public class C<T> : D where T : new() {
        string s = "void No() {"; char c = '{';
        public C(int x) { }
        [Route("x")] public async Task<List<int>> Get(Dictionary<int, string> m, ref int n, T t = default(T)) where T : class { foreach (var x in m) { Run(x, "a, b"); } return new List<int>(Make()); }
        int Twice(int x) => x * Mul(2);
        class Inner { void Deep() { /* } */ base.Go(); } }
    }"""
    found = list(code.declared_units(text))
    assert [u[:4] for u in found] == [("A.B", "C", "Get", ["Dictionary<int, string>", "int", "T"]), ("A.B", "C", "Twice", ["int"]), ("A.B", "C.Inner", "Deep", [])]
    body = dict((u[2], u[4]) for u in found)
    assert body["Twice"] == "x * Mul(2)" and list(code.invocations_of(body["Get"])) == [("", "Run", 2), ("", "Make", 0)]
    assert list(code.invocations_of(body["Deep"])) == [("base", "Go", 0)] and list(code.declared_units("")) == []


def test_tools(spark):
    import json

    from skein.tools import Server

    nodes = spark.createDataFrame([("a", "method", "A.Get", "P", "n", "AController", "Get", True, "/a", None, False), ("b", "method", "B.Load", "Q", "n", "BService", "Load", False, None, None, False), ("t", "entity", "T", "Q", "n", "T", "", False, None, "T", True)], "id string, kind string, label string, project_name string, namespace string, class_name string, method_name string, entry_point boolean, route string, table_name string, is_external boolean")
    edges = spark.createDataFrame([("a", "b", "call", "exact", "semantic", 1), ("b", "t", "entity-access", "high", "analyzer", 1)], "from_id string, to_id string, kind string, confidence string, evidence string, weight int")
    server = Server(nodes, edges)
    ask = lambda method, **params: json.loads(server.handle(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})))
    rows = lambda tool, **a: json.loads(ask("tools/call", name=tool, arguments=a)["result"]["content"][0]["text"])
    assert {t["name"] for t in ask("tools/list")["result"]["tools"]} == set(server.tools) and "protocolVersion" in ask("initialize")["result"]
    assert rows("callees", id="a") == [{"id": "b"}] and rows("entry_points", id="t") == [{"id": "a"}]
    assert rows("table_impact", table="T") == [{"path_id": "t|b|a", "length": 2, "root": "t", "leaf": "a"}]
    assert rows("route", text="What breaks if BService.Load changes")[0]["engine"] == "impact"
    some = {"id": "a", "text": "load", "table": "T", "name": "T"}
    for name, (_, needed, _) in server.tools.items():
        assert isinstance(rows(name, **{n: some[n] for n in needed}), list)
    assert ask("tools/call", name="none")["error"]["code"] == ask("tools/call", name="node")["error"]["code"] == ask("tools/call", name="node", arguments={"id": "zz"})["error"]["code"] == -32602
    assert ask("nothing")["error"]["code"] == -32601 and json.loads(server.handle("{"))["error"]["code"] == -32700 and server.handle('{"method": "ping"}') is None
