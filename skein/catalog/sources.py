"""Sources, sinks and sessions (family A, K-20 to K-22)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..operators import session_state
from ..plans.fixture import edges, nodes, view
from ..registry import query
from ..session import shared_dir, table
from ..sources import code, graphs


def place(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/sink-{uuid.uuid4().hex}"


SOLUTION = """Project("{F}") = "App", "src\\App\\App.csproj", "{1}"
Project("{F}") = "Data", "src\\Data\\Data.csproj", "{2}"
Project("{F}") = "Again", "SRC\\app\\App.csproj", "{3}"
Project("{F}") = "Out", "src\\obj\\Gone.csproj", "{4}"
"""


@query("A01_projects", "SELECT * FROM (VALUES ('SRC/app/App.csproj'), ('src/Data/Data.csproj')) t(path)")
def projects(spark, d):
    return code.projects(spark.createDataFrame([("a.sln", SOLUTION)], "path string, text string"))


@query("A02_source_files", "SELECT 'Load' || CAST(n_nationkey AS STRING) AS method_name FROM nation")
def source_files(spark, d):
    at = place(spark)
    text = F.concat(F.lit("class A { public int Load"), F.col("n_nationkey").cast("string"), F.lit("(int x) { } }"))
    table(spark, d, "nation").select(text.alias("value")).write.text(at)
    return code.methods(code.files(spark, at, "*.txt")).select("method_name")


def sources(spark, d):
    """A file a nation: a class of two methods in blocks and one by an expression, with comments and literals that look like code."""
    k, j = F.col("n_nationkey").cast("string"), ((F.col("n_nationkey") + 1) % 25).cast("string")
    text = F.concat(
        F.lit("using System;\nnamespace App.N { // class Gone { void No() { } }\n  public class N"), k, F.lit("Service : Base { /* int Old(int x) { return 1; } */\n    private int count = 0;\n    public int Load"), k,
        F.lit("(int x, string y = \"(\") { if (x > 0) { return Find(x); } return N"), j, F.lit("Service.Load"), j, F.lit("(1, \"a(b)}\"); }\n    static void Find(int z) { other.Load3(z, null); done.Invoke(z); Log.Write(); }\n    int Twice(Map<int, string> m) => Find(2);\n  }\n}\n"),
    )
    return table(spark, d, "nation").select(F.concat(F.lit("N"), k, F.lit(".cs")).alias("path"), text.alias("text"))


BODIES = """un AS (SELECT n_nationkey AS k, CAST(n_nationkey AS STRING) AS s, CAST((n_nationkey + 1) % 25 AS STRING) AS j FROM nation),
bd AS (SELECT 'N' || s || '.cs' AS path, 'App.N' AS namespace, 'N' || s || 'Service' AS class_name, 'Load' || s AS method_name, 'int,string' AS parameters, 'if (x > 0) { return Find(x); } return N' || j || 'Service.Load' || j || '(1, "a(b)}");' AS content FROM un
UNION ALL SELECT 'N' || s || '.cs', 'App.N', 'N' || s || 'Service', 'Find', 'int', 'other.Load3(z, null); done.Invoke(z); Log.Write();' FROM un UNION ALL SELECT 'N' || s || '.cs', 'App.N', 'N' || s || 'Service', 'Twice', 'Map<int, string>', 'Find(2)' FROM un)"""


@query("A03_code_units", f"WITH {BODIES} SELECT * FROM bd")
def code_units(spark, d):
    return code.units(sources(spark, d)).withColumn("parameters", F.array_join("parameters", ","))


@query("A04_invocations", """WITH un AS (SELECT n_nationkey AS k, CAST(n_nationkey AS STRING) AS s, CAST((n_nationkey + 1) % 25 AS STRING) AS j FROM nation)
SELECT 'N' || s || 'Service.Load' || s AS unit_id, 0 AS seq, 'N' || s || 'Service.Find' AS target, 'symbol' AS way FROM un UNION ALL SELECT 'N' || s || 'Service.Load' || s, 1, 'N' || j || 'Service.Load' || j, 'symbol' FROM un UNION ALL SELECT 'N' || s || 'Service.Find', 0, 'N3Service.Load3', 'candidate' FROM un
UNION ALL SELECT 'N' || s || 'Service.Find', 1, 'done', 'delegate' FROM un UNION ALL SELECT 'N' || s || 'Service.Find', 2, 'Write', 'external' FROM un UNION ALL SELECT 'N' || s || 'Service.Twice', 0, 'N' || s || 'Service.Find', 'symbol' FROM un""")
def invocations(spark, d):
    found = code.units(sources(spark, d)).withColumn("unit_id", F.concat_ws(".", "class_name", "method_name"))
    return code.resolved(code.invocations(found), found).select("unit_id", "seq", "target", "way")


@query("A07_xml_beans", "SELECT DISTINCT bean_id, type_name, ref FROM beans")
def xml_beans(spark, d):
    at = place(spark)
    rows = view(spark, d, "beans").groupBy("bean_id", "type_name").agg(F.array_sort(F.collect_set("ref")).alias("refs"))
    props = F.array_join(F.transform(F.filter("refs", lambda r: r != ""), lambda r: F.concat(F.lit('<property name="p" ref="'), r, F.lit('"/>'))), "")
    rows.select(F.concat(F.lit('<objects><object id="'), "bean_id", F.lit('" type="'), "type_name", F.lit('">'), props, F.lit("</object></objects>")).alias("value")).write.text(at)
    return code.beans(spark, at)


@query("A08_xml_mappings", "SELECT class_name, table_name FROM mappings")
def xml_mappings(spark, d):
    at = place(spark)
    line = F.concat(F.lit('<hibernate-mapping><class name="app.'), "class_name", F.lit(', app" table="'), "table_name", F.lit('"/></hibernate-mapping>'))
    one = F.concat_ws("-", "class_name", "file").alias("k")  # a document a file
    view(spark, d, "mappings").select(line.alias("value"), one).write.partitionBy("k").text(at)
    return code.mappings(spark, at).select("class_name", "table_name")


@query("A09_graph_cache", "SELECT id, kind, label FROM nodes")
def graph_cache(spark, d):
    at = place(spark)
    graphs.save_cache({"nodes": nodes(spark, d), "edges": edges(spark, d)}, at)
    found = graphs.load_cache(spark, at)
    assert found is not None
    return found["nodes"].select("id", "kind", "label")


@query("A10_embedding_cache", "SELECT count(*) AS n, count(DISTINCT upper(substr(sha256(text), 1, 16))) AS n_hashes FROM benchmark")
def embedding_cache(spark, d):
    from ..operators import text

    at = place(spark)
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    text.embed(rows).select("content_hash", "vector").dropDuplicates(["content_hash"]).write.parquet(at)
    again = text.embed(rows, spark.read.parquet(at)).filter("cached")
    return again.agg(F.count("*").alias("n"), F.countDistinct("content_hash").alias("n_hashes"))


@query("A11_scan_sink", "SELECT project_name, count(*) AS n FROM units GROUP BY 1")
def scan_sink(spark, d):
    at = place(spark)
    graphs.write_scan(view(spark, d, "units"), at)
    rows = spark.read.schema("project_name string, items array<struct<class_name: string, method_name: string>>").json(at)
    return rows.select("project_name", F.size("items").cast("long").alias("n"))


@query("A12_graph_json", "SELECT from_id AS \"from\", to_id AS \"to\", kind, confidence FROM edges")
def graph_json(spark, d):
    at = place(spark)
    e = edges(spark, d).select(F.col("from_id").alias("from"), F.col("to_id").alias("to"), "kind", F.create_map(F.lit("confidence"), F.col("confidence")).alias("attributes"))
    n = nodes(spark, d).select("id", "kind", "label", F.col("project_name").alias("projectName"))
    facts = view(spark, d, "facts").select("analyzer", F.col("subject_id").alias("subjectId"))
    graphs.write_graph_json(n, e, facts, at)
    _, back, _ = graphs.read_graph_parts(spark, at)
    return back.select("from", "to", "kind", F.col("attributes")["confidence"].alias("confidence"))


@query("A13_chunk_sink", "SELECT chunk_id, title, table_name, entity_name, importance, n_nodes FROM chunks")
def chunk_sink(spark, d):
    at, chunks = place(spark), view(spark, d, "chunks")
    graphs.write_chunks(chunks, at)
    return spark.read.schema(chunks.schema).json(at).select("chunk_id", "title", "table_name", "entity_name", "importance", "n_nodes")


@query("A13_embedding_sink", "SELECT vec_id AS chunk_id, 64 AS dimensions, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def embedding_sink(spark, d):
    at = place(spark)
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.size("embedding").alias("dimensions"), F.col("embedding").alias("vector"))
    graphs.write_chunks(rows, at)
    return spark.read.schema("chunk_id bigint, dimensions int, vector array<float>").json(at).select("chunk_id", "dimensions", F.round(F.element_at("vector", 1).cast("double"), 6).alias("first"))


@query("A17_tools", "SELECT tool, id FROM (SELECT 'callees' AS tool, to_id AS id FROM edges WHERE from_id = 'region:1' UNION SELECT 'callers', from_id FROM edges WHERE to_id = 'nation:2' UNION SELECT 'entry_points', 'region:' || CAST(n_regionkey AS STRING) FROM nation WHERE n_nationkey = 2 UNION SELECT 'search', id FROM nodes WHERE contains(lower(label), 'loadnation_1'))")
def tools(spark, d):
    """Tools called as an agent calls them: a request of JSON each."""
    from .. import tools as agent

    server = agent.Server(nodes(spark, d), edges(spark, d))
    asked = (("callees", {"id": "region:1"}), ("callers", {"id": "nation:2"}), ("entry_points", {"id": "nation:2"}), ("search", {"text": "LoadNATION_1", "limit": 100}))
    rows = []
    for i, (name, arguments) in enumerate(asked):
        answer = json.loads(server.handle(json.dumps({"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": name, "arguments": arguments}})))
        rows += [(name, r["id"]) for r in json.loads(answer["result"]["content"][0]["text"])]
    return spark.createDataFrame(rows, "tool string, id string")


@query("A14_view_sink", "SELECT from_id || '→' || to_id || '|' || kind AS id FROM edges")
def view_sink(spark, d):
    from ..operators import views

    at = place(spark)
    views.edge_projection(edges(spark, d)).write.json(at)
    return spark.read.schema("id string").json(at)


@query("A15_failure_snapshots", "SELECT item_id AS case_id, CASE WHEN item_id % 2 = 0 THEN 'Hybrid' ELSE 'KeywordOnly' END AS mode FROM benchmark")
def failure_snapshots(spark, d):
    at = place(spark)
    mode = F.when(F.col("item_id") % 2 == 0, "Hybrid").otherwise("KeywordOnly")
    graphs.write_snapshots(table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), F.lit("A.Save()").alias("label"), mode.alias("mode")), at)
    return graphs.read_snapshots(spark, at).select("case_id", "mode")


@query("A16_history", "SELECT 'repo' || CAST(user_id % 20 AS STRING) AS path, max(event_id) AS last_used FROM events GROUP BY 1")
def repository_history(spark, d):
    rows = table(spark, d, "events").select(F.concat(F.lit("repo"), (F.col("user_id") % 20).cast("string")).alias("path"), F.col("event_type").alias("name"), F.col("event_id").alias("last_used"))
    return graphs.history(rows).select("path", "last_used")


@query("K20_follow_ups", "SELECT CAST(n_nationkey AS INT) AS seq, CASE WHEN n_nationkey % 3 = 0 THEN 'what calls ' || upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) ELSE CASE WHEN n_nationkey % 3 = 1 THEN 'who changes ' ELSE 'show ' END || (SELECT upper(substr(m.n_name, 1, 1)) || lower(substr(m.n_name, 2)) FROM nation m WHERE m.n_nationkey = n.n_nationkey - n.n_nationkey % 3) END AS question FROM nation n")
def follow_ups(spark, d):
    """A session of one question a nation (a table of 25): a name, then two that refer to it."""
    s, asked = session_state.Session(), []
    for r in table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect():
        asked.append((r.n_nationkey, s.resolve((f"what calls {r.n_name.capitalize()}", "who changes it", "show that")[r.n_nationkey % 3])))
    return spark.createDataFrame(asked, "seq int, question string")


@query("K21_confidence_bars", "SELECT statement_id, repeat('#', CAST(round(score * 10) AS INT)) || repeat('.', 10 - CAST(round(score * 10) AS INT)) AS bar FROM (SELECT statement_id, round(score, 1) AS score FROM statements)")
def confidence_bars(spark, d):
    return view(spark, d, "statements").select("statement_id", session_state.confidence_bar(F.round("score", 1)).alias("bar"))


@query("K21_citations", "SELECT source_file, count(*) AS n, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS symbols FROM evidence GROUP BY 1")
def citations(spark, d):
    return session_state.citations(view(spark, d, "evidence"))


@query("K22_build_errors", "SELECT 'src/S' || CAST(s_suppkey AS STRING) || '.cs' AS file, CAST(s_suppkey * 3 AS INT) AS line, 'CS' || lpad(CAST(s_suppkey % 1000 AS STRING), 4, '0') AS code, 'no ' || s_name || ', expected' AS message FROM supplier WHERE s_suppkey % 3 = 0")
def build_errors(spark, d):
    at = lambda kind: F.concat(F.lit("src/S"), F.col("s_suppkey").cast("string"), F.lit(".cs("), (F.col("s_suppkey") * 3).cast("string"), F.lit(f",5): {kind} CS"), F.lpad((F.col("s_suppkey") % 1000).cast("string"), 4, "0"), F.lit(": no "), F.col("s_name"), F.lit(", expected"))
    line = F.when(F.col("s_suppkey") % 3 == 0, at("error")).when(F.col("s_suppkey") % 3 == 1, at("warning")).otherwise(F.concat(F.lit("built "), "s_name"))
    return session_state.build_errors(table(spark, d, "supplier").select(line.alias("value")))


@query("K22_contexts", "SELECT id, content AS context, false AS changed FROM units WHERE contains(content, 'Find')")
def contexts(spark, d):
    rows = view(spark, d, "units")
    near = session_state.context_lines(F.col("content"), F.lit("Find"))
    return rows.select("id", near.alias("context"), session_state.signature_changed(F.col("content"), F.concat(F.lit(" "), "content")).alias("changed")).filter("context <> ''")


@query("B14_analyzer_pipeline", "SELECT DISTINCT analyzer, count(*) AS n FROM (SELECT 'entries' AS analyzer, id FROM nodes WHERE entry_point UNION ALL SELECT 'entities', id FROM nodes WHERE kind = 'entity') GROUP BY 1")
def analyzer_pipeline(spark, d):
    from ..operators import build

    def producer(name, condition):
        def run(n, e):
            found = n.filter(condition).select(F.lit(name).alias("analyzer"), F.col("id").alias("subject_id"))
            return found, found.limit(0), e.select("from_id", "to_id").limit(0)

        return run

    facts, _, _ = build.run_analyzers(nodes(spark, d), edges(spark, d), [producer("entries", "entry_point"), producer("entities", "kind = 'entity'")])
    return facts.groupBy("analyzer").agg(F.count("*").alias("n"))


@query("N_streaming_scope", "SELECT analyzer, count(*) AS n FROM (SELECT analyzer FROM facts WHERE NOT (analyzer = 'routes' AND source_file = 'a.cs') UNION ALL SELECT 'routes' UNION ALL SELECT 'routes') GROUP BY 1")
def streaming_scope(spark, d):
    from ..streaming import incremental

    at = place(spark)
    facts = view(spark, d, "facts")
    facts.write.parquet(f"{at}/table/v0")
    spark.createDataFrame([("routes", "n7", "route", "a.cs", "/x"), ("routes", "n8", "route", "a.cs", "/y")], facts.schema).coalesce(1).write.json(f"{at}/in")
    incremental.keep_current(spark, f"{at}/in", f"{at}/table", f"{at}/state").awaitTermination()
    return incremental.version(spark, f"{at}/table", 1).groupBy("analyzer").agg(F.count("*").alias("n"))
