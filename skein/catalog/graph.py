"""Lookups, traversals, paths and impact (families D, K, V) over the fixture graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cognition, lookup, views
from ..plans import traverse
from ..plans.fixture import edges, nodes, view
from ..registry import query

@query("D01_get_node", "SELECT id, kind, label FROM nodes WHERE id = 'nation:3'")
def get_node(spark, d):
    return lookup.ensure_exists(nodes(spark, d), "nation:3").select("id", "kind", "label")


@query("D02_all_nodes", "SELECT id, kind, label, project_name, class_name, method_name FROM nodes ORDER BY id")
def all_nodes(spark, d):
    return nodes(spark, d).select("id", "kind", "label", "project_name", "class_name", "method_name").orderBy("id")


@query("D03_callees", "SELECT DISTINCT from_id AS id, to_id AS neighbour FROM edges")
def callees(spark, d):
    return lookup.neighbours(edges(spark, d), nodes(spark, d))


@query("D03_callers", "SELECT DISTINCT to_id AS id, from_id AS neighbour FROM edges")
def callers(spark, d):
    return lookup.neighbours(edges(spark, d), nodes(spark, d), "backward")


def paths_sql(start: str, step: str, depth: int, target: str = "false", kinds: str = "true") -> str:
    """Simple paths by recursion: ``step`` is 'from,to' as columns of edges."""
    src, dst = step.split(",")
    return f"""
way AS (SELECT {src} AS src, {dst} AS dst FROM edges WHERE {kinds} GROUP BY 1, 2),
walk AS (
  SELECT id AS leaf, id AS root, [id] AS p, coalesce({target}, false) AS hit FROM nodes WHERE {start}
  UNION ALL
  SELECT w.dst, x.root, list_append(x.p, w.dst), coalesce((SELECT {target} FROM nodes n2 WHERE n2.id = w.dst), false)
  FROM walk x JOIN way w ON w.src = x.leaf WHERE NOT x.hit AND NOT list_contains(x.p, w.dst) AND len(x.p) <= {depth}
),
paths AS (
  SELECT array_to_string(p, '|') AS path_id, CAST(len(p) - 1 AS INT) AS length, root, leaf FROM walk x
  WHERE hit OR len(p) = {depth + 1} OR NOT EXISTS (SELECT 1 FROM way w WHERE w.src = x.leaf AND NOT list_contains(x.p, w.dst))
)"""


PATH_COLUMNS = ("path_id", "length", "root", "leaf")


@query("D04_call_chains", f"WITH RECURSIVE {paths_sql('true', 'from_id,to_id', 2)} SELECT path_id AS chain, length FROM paths")
def call_chains(spark, d):
    return traverse.call_chains(edges(spark, d), nodes(spark, d), 2)


CYCLIC_PATHS = """
WITH RECURSIVE walk AS (
  SELECT DISTINCT from_id AS leaf, [from_id] AS p FROM cyclic
  UNION ALL SELECT c.to_id, list_append(x.p, c.to_id) FROM walk x JOIN cyclic c ON c.from_id = x.leaf WHERE NOT list_contains(x.p, c.to_id) AND len(x.p) <= 3
)
SELECT array_to_string(p, '|') AS chain, CAST(len(p) - 1 AS INT) AS length FROM walk x
WHERE len(p) = 4 OR NOT EXISTS (SELECT 1 FROM cyclic c WHERE c.from_id = x.leaf AND NOT list_contains(x.p, c.to_id))"""


@query("D04_call_chains_cyclic", CYCLIC_PATHS)
def call_chains_cyclic(spark, d):
    cyclic = view(spark, d, "cyclic")
    return traverse.call_chains(cyclic, cyclic.select(F.col("from_id").alias("id")), 3)


@query(
    "D05_entry_points",
    f"""WITH RECURSIVE up AS (SELECT id, id AS entry FROM nodes UNION SELECT u.id, e.from_id FROM up u JOIN edges e ON e.to_id = u.entry)
SELECT id, entry FROM up WHERE entry NOT IN (SELECT to_id FROM edges)""",
)
def entry_points(spark, d):
    return traverse.entry_points(edges(spark, d), nodes(spark, d))


@query("D06_typed_paths", f"WITH RECURSIVE {paths_sql('entry_point', 'from_id,to_id', 3, kinds=chr(39) + 'call' + chr(39) + ' = kind')} SELECT * FROM paths")
def typed_paths(spark, d):
    n = nodes(spark, d)
    return traverse.typed_paths(n, edges(spark, d), n.filter("entry_point"), kinds=["call"], max_depth=3).select(*PATH_COLUMNS)


IMPACT = paths_sql("kind = 'entity'", "to_id,from_id", 15, "entry_point")


def impact(spark, d):
    """Backward from each table's entity to the entry points that reach it."""
    n = nodes(spark, d)
    return traverse.typed_paths(n, edges(spark, d), n.filter("kind = 'entity'"), direction="backward", target=F.col("entry_point"), max_depth=15)


@query("D08_table_impact", f"WITH RECURSIVE {IMPACT} SELECT * FROM paths")
def table_impact(spark, d):
    return impact(spark, d).select(*PATH_COLUMNS)


@query("D07_routes_to_table", f"WITH RECURSIVE {IMPACT} SELECT array_to_string(list_reverse(string_split(path_id, '|')), '|') AS path_id, length, leaf AS root, root AS leaf FROM paths")
def routes_to_table(spark, d):
    return impact(spark, d).select(F.concat_ws("|", F.reverse("node_ids")).alias("path_id"), "length", F.col("leaf").alias("root"), F.col("root").alias("leaf"))


@query("D09_apis_by_entity", f"WITH RECURSIVE {IMPACT} SELECT DISTINCT leaf AS api, root AS entity FROM paths WHERE leaf LIKE 'region:%'")
def apis_by_entity(spark, d):
    return impact(spark, d).filter(F.col("leaf").startswith("region:")).select(F.col("leaf").alias("api"), F.col("root").alias("entity")).distinct()


@query("D10_repositories_by_table", "SELECT DISTINCT e.from_id AS repository, e.to_id AS entity FROM edges e WHERE e.kind = 'entity-access' ORDER BY repository, entity LIMIT 100")
def repositories_by_table(spark, d):
    n = nodes(spark, d)
    back = traverse.typed_paths(n, edges(spark, d), n.filter("kind = 'entity'"), direction="backward", kinds=["entity-access"], max_depth=1, max_paths=None)
    return back.filter("length = 1").select(F.col("leaf").alias("repository"), F.col("root").alias("entity")).distinct().orderBy("repository", "entity").limit(100)


@query("D11_impact_by_method", f"WITH RECURSIVE {paths_sql('class_name = ' + chr(39) + 'NationService' + chr(39), 'from_id,to_id', 8)} SELECT root, count(*) AS n, CAST(sum(length) AS BIGINT) AS total FROM paths GROUP BY root")
def impact_by_method(spark, d):
    n = nodes(spark, d)
    found = traverse.typed_paths(n, edges(spark, d), n.filter("class_name = 'NationService'"), max_depth=8)
    return found.groupBy("root").agg(F.count("*").alias("n"), F.sum("length").alias("total"))


@query("D12_semantic_path", f"WITH RECURSIVE {paths_sql('entry_point', 'from_id,to_id', 3)} SELECT * FROM paths WHERE leaf IN (SELECT id FROM nodes WHERE kind = 'entity')")
def semantic_path(spark, d):
    n = nodes(spark, d)
    found = traverse.typed_paths(n, edges(spark, d), n.filter("entry_point"), max_depth=3)
    return found.join(n.filter("kind = 'entity'").select(F.col("id").alias("leaf")), "leaf", "left_semi").select(*PATH_COLUMNS)


@query("D13_entities_by_table", "SELECT id, table_name FROM nodes WHERE kind = 'entity' AND starts_with(table_name, 'Brand#1')")
def entities_by_table(spark, d):
    return lookup.entities_of_table(nodes(spark, d), "Brand#1", prefix=True).select("id", "table_name")


@query("D14_entities_by_class", "SELECT id, class_name FROM nodes WHERE kind = 'entity' AND lower(class_name) = 'brand#13'")
def entities_by_class(spark, d):
    return lookup.entities_of_class(nodes(spark, d), "BRAND#13").select("id", "class_name")


@query("D15_entry_point_nodes", "SELECT id, route FROM nodes WHERE entry_point ORDER BY id")
def entry_point_nodes(spark, d):
    return nodes(spark, d).filter("entry_point").select("id", "route").orderBy("id")


@query("D16_first_edge", "SELECT from_id, to_id, min(kind) AS kind, CAST(min(weight) AS BIGINT) AS weight FROM edges GROUP BY from_id, to_id")
def first_edge(spark, d):
    return lookup.first_edges(edges(spark, d)).select("from_id", "to_id", "kind", "weight")


@query("D17_search_nodes", "SELECT id, label FROM nodes WHERE (lower(label) LIKE '%supplier%' OR lower(class_name) LIKE '%supplier%' OR lower(namespace) LIKE '%supplier%') AND kind = 'method' ORDER BY id LIMIT 20")
def search_nodes(spark, d):
    return lookup.search(nodes(spark, d), "Supplier", "method").select("id", "label")


@query("D18_graph_stats", "SELECT kind, count(*) AS n, count(*) FILTER (WHERE entry_point) AS n_entry_points FROM nodes GROUP BY kind")
def graph_stats(spark, d):
    return lookup.stats(nodes(spark, d))


@query("D19_edge_summaries", "SELECT e.from_id, e.to_id, e.kind, coalesce(a.label, e.from_id) AS from_label, coalesce(b.label, e.to_id) AS to_label FROM edges e LEFT JOIN nodes a ON a.id = e.from_id LEFT JOIN nodes b ON b.id = e.to_id")
def edge_summaries(spark, d):
    return lookup.labelled(edges(spark, d), nodes(spark, d))


PROPAGATED = """
WITH RECURSIVE way AS (SELECT from_id AS src, to_id AS dst, max(CASE kind WHEN 'call' THEN CASE evidence WHEN 'semantic' THEN 0.95 WHEN 'syntax' THEN 0.92 ELSE 0.6 END WHEN 'entity-access' THEN 0.90 ELSE 0.6 END::DOUBLE) AS keep FROM edges WHERE confidence <> 'low' GROUP BY 1, 2),
walk AS (SELECT id AS start, id, 1.0::DOUBLE AS score, 0 AS hop FROM nodes WHERE entry_point
  UNION ALL SELECT w.start, y.dst, w.score * y.keep, w.hop + 1 FROM walk w JOIN way y ON y.src = w.id WHERE w.hop < 5 AND w.score >= 0.2),
best AS (SELECT start, id, max(round(score, 6)) AS score, min(hop) AS hop FROM walk WHERE score >= 0.2 GROUP BY 1, 2)"""


@query("I07_confidence_propagation", PROPAGATED + " SELECT start, id, score, CAST(hop AS INT) AS hop FROM best")
def confidence_propagation(spark, d):
    n = nodes(spark, d)
    found = traverse.propagate(edges(spark, d), n.filter("entry_point"))
    return found.select("start", "id", F.round("score", 6).alias("score"), "hop")


LEVEL = "CASE WHEN score >= 0.95 THEN 0 WHEN score >= 0.8 THEN 1 WHEN score >= 0.6 THEN 2 WHEN score >= 0.4 THEN 3 WHEN score >= 0.2 THEN 4 ELSE 5 END"


@query("I10_propagation_snapshot", PROPAGATED + f" SELECT CAST({LEVEL} AS INT) AS level, count(*) AS n, CAST(max(hop) AS INT) AS max_hop, round(avg(score), 6) AS avg_score FROM best GROUP BY 1")
def propagation_snapshot(spark, d):
    n = nodes(spark, d)
    found = traverse.propagate(edges(spark, d), n.filter("entry_point")).withColumn("score", F.round("score", 6))
    from ..functions.confidence import level

    return found.groupBy(level(F.col("score")).alias("level")).agg(F.count("*").alias("n"), F.max("hop").alias("max_hop"), F.round(F.avg("score"), 6).alias("avg_score"))


RISK = "round(greatest(0.0, least(1.0, 1 - score + least(0.1 * hop, 0.4) + CASE WHEN kind = 'entity' THEN 0.1 ELSE 0.0 END)), 6)"


@query("K06_downstream_impact", PROPAGATED + f", r AS (SELECT b.start, b.id, b.score, CAST(b.hop AS INT) AS hop, {RISK} AS risk FROM best b JOIN nodes n ON n.id = b.id WHERE b.id <> b.start) SELECT start, id, score, hop, risk, CASE WHEN risk <= 0.2 THEN 'low' WHEN risk <= 0.4 THEN 'moderate' WHEN risk <= 0.7 THEN 'high' ELSE 'critical' END AS risk_level FROM r")
def downstream_impact(spark, d):
    n = nodes(spark, d)
    return cognition.downstream(edges(spark, d), n, n.filter("entry_point"))


@query("K09_impact_summary", PROPAGATED + f", r AS (SELECT b.start, b.id, {RISK} AS risk FROM best b JOIN nodes n ON n.id = b.id WHERE b.id <> b.start), t AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY risk DESC, id) AS place FROM r) SELECT start, id, risk, CAST(place AS INT) AS place FROM t WHERE place <= 15")
def impact_summary(spark, d):
    n = nodes(spark, d)
    return cognition.riskiest(cognition.downstream(edges(spark, d), n, n.filter("entry_point")), 15)


@query("K08_upstream_dependents", """WITH RECURSIVE up AS (SELECT id, id AS entry FROM nodes UNION SELECT u.id, e.from_id FROM up u JOIN edges e ON e.to_id = u.entry)
SELECT id, entry, 0.3::DOUBLE AS risk FROM up WHERE entry <> id AND entry NOT IN (SELECT to_id FROM edges)""")
def upstream_dependents(spark, d):
    return traverse.entry_points(edges(spark, d), nodes(spark, d)).filter("entry <> id").withColumn("risk", F.lit(0.3))


@query("K05_impact_targets", "SELECT id FROM nodes WHERE lower(label) LIKE '%loadnation_1%' OR lower(class_name) LIKE '%repository%' ORDER BY id LIMIT 5")
def impact_targets(spark, d):
    return cognition.targets(nodes(spark, d), ["LoadNATION_1", "Repository"])


@query("K01_subsystems", """SELECT project_name, count(*) AS n_nodes, count(*) FILTER (WHERE entry_point) AS n_entry_points, count(*) FILTER (WHERE class_name LIKE '%Service') AS n_services, count(*) FILTER (WHERE class_name LIKE '%Controller') AS n_controllers,
array_to_string(list_slice(list_sort(list(id)), 1, 5), ',') AS samples FROM nodes WHERE NOT is_external GROUP BY project_name""")
def subsystems(spark, d):
    return cognition.subsystems(nodes(spark, d))


@query("K02_orchestration_layers", """SELECT 'entry' AS layer, count(*) AS n FROM nodes WHERE entry_point UNION ALL SELECT 'service', count(*) FROM nodes WHERE class_name LIKE '%Service'
UNION ALL SELECT 'data', count(*) FROM nodes WHERE class_name LIKE '%Repository' UNION ALL SELECT 'entity', count(*) FROM nodes WHERE kind = 'entity'""")
def orchestration_layers(spark, d):
    return cognition.layers(nodes(spark, d))


CROSS = "SELECT DISTINCT least(a.project_name, b.project_name) AS left_project, greatest(a.project_name, b.project_name) AS right_project FROM edges e JOIN nodes a ON a.id = e.from_id JOIN nodes b ON b.id = e.to_id WHERE a.project_name <> b.project_name"


@query("K03_integration_points", CROSS + " ORDER BY 1, 2 LIMIT 10")
def integration_points(spark, d):
    return cognition.integration_points(nodes(spark, d), edges(spark, d))


@query("K04_dependency_directions", f"WITH RECURSIVE {paths_sql(chr(105) + 'd IN (SELECT id FROM nodes n9 WHERE n9.entry_point ORDER BY id LIMIT 10)', 'from_id,to_id', 4)}, t AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY path_id) AS r FROM paths) SELECT root, path_id, length FROM t WHERE r <= 3")
def dependency_directions(spark, d):
    n = nodes(spark, d)
    return cognition.directions(n, edges(spark, d))


@query("K10_capabilities", """WITH c AS (SELECT n.id, n.label, n.class_name, (SELECT count(DISTINCT e.to_id) FROM edges e WHERE e.from_id = n.id) AS n_callees, (SELECT count(DISTINCT e.from_id) FROM edges e WHERE e.to_id = n.id) AS n_callers FROM nodes n WHERE n.class_name LIKE '%Service' ORDER BY n.label, n.id LIMIT 50)
SELECT id, regexp_replace(class_name, 'Service$', '') AS capability, n_callees, n_callers, CASE WHEN n_callees >= 5 THEN 1 WHEN n_callees > 0 THEN 2 ELSE 3 END AS confidence FROM c""")
def capabilities(spark, d):
    return cognition.capabilities(nodes(spark, d), edges(spark, d))


@query("K11_capability_match", """WITH c AS (SELECT id, lower(class_name || ' ' || label) AS t FROM nodes WHERE class_name LIKE '%Service')
SELECT id, CAST(score AS INT) AS score FROM (SELECT id, 3 * ((CASE WHEN contains(t, 'nation') THEN 1 ELSE 0 END) + (CASE WHEN contains(t, 'nation_3') THEN 1 ELSE 0 END)) AS score FROM c) WHERE score > 0 ORDER BY score DESC, id LIMIT 10""")
def capability_match(spark, d):
    return cognition.capability_match(nodes(spark, d), ["nation", "nation_3"])


@query("K13_root_cause_targets", """WITH c AS (SELECT id, lower(label) AS t FROM nodes)
SELECT id, CAST(s AS INT) AS score FROM (SELECT id, 2 * (CASE WHEN contains(t, 'supplier') THEN 1 ELSE 0 END) + 2 * (CASE WHEN contains(t, '000007') THEN 1 ELSE 0 END) + CASE WHEN regexp_matches(t, 'fail|retry|timeout|exception|error|reconnect|sync|lock') THEN 1 ELSE 0 END AS s FROM c) WHERE s > 0 ORDER BY s DESC, id LIMIT 5""")
def root_cause_targets(spark, d):
    return cognition.root_cause_targets(nodes(spark, d), ["supplier", "of", "000007"])


TARGETS = ["region", "get"]
TARGET_SQL = "tg AS (SELECT id FROM nodes WHERE contains(lower(label), 'region') AND contains(lower(label), 'get') ORDER BY id LIMIT 5)"


@query("K14_failure_paths", f"""WITH {TARGET_SQL}, a AS (SELECT from_id, to_id, row_number() OVER (PARTITION BY from_id ORDER BY to_id) AS r FROM (SELECT DISTINCT from_id, to_id FROM edges))
SELECT x.from_id AS target, x.to_id AS callee, y.to_id AS sub_callee FROM a x JOIN a y ON y.from_id = x.to_id WHERE x.r <= 3 AND y.r <= 2 AND x.from_id IN (SELECT id FROM tg)""")
def failure_paths(spark, d):
    return cognition.failure_paths(edges(spark, d), cognition.root_cause_targets(nodes(spark, d), TARGETS))


@query("K15_external_dependencies", "SELECT e.from_id AS target, count(DISTINCT e.to_id) AS n, min(e.to_id) AS first FROM edges e JOIN nodes n ON n.id = e.to_id WHERE n.is_external GROUP BY 1")
def external_dependencies(spark, d):
    return cognition.external_dependencies(nodes(spark, d), edges(spark, d))


CALLED = TARGET_SQL.replace("'region'", "'nation'").replace("'get'", "'load'")


@query("K16_interaction_points", f"""WITH {CALLED}, p AS (SELECT DISTINCT from_id, to_id FROM edges), c AS (SELECT to_id AS target, from_id AS caller, row_number() OVER (PARTITION BY to_id ORDER BY from_id) AS r FROM p WHERE to_id IN (SELECT id FROM tg))
SELECT DISTINCT c.target, c.caller, p.to_id AS sibling FROM c JOIN p ON p.from_id = c.caller WHERE c.r <= 5 AND p.to_id <> c.target""")
def interaction_points(spark, d):
    return cognition.interaction_points(edges(spark, d), cognition.root_cause_targets(nodes(spark, d), ["nation", "load"]))


def phrases_sql(intent: str) -> str:
    return " OR ".join("contains(lower(t), '" + p.replace("'", "''") + "')" for p in cognition.INTENTS[intent])


READ = f"""nq AS (SELECT item_id, replace(replace(replace(replace(replace(trim(text), '  ', ' '), '?', ''), ',', ' '), chr(39), ''), '"', '') AS t FROM questions),
ni AS (SELECT item_id, t, CASE {' '.join(f"WHEN {phrases_sql(i)} THEN '{i}'" for i in cognition.INTENTS)} ELSE 'general' END AS intent, list_filter(list_slice(list_filter(string_split(t, ' '), lambda w: w <> ''), 1, 10), lambda w: (regexp_matches(w, '^\\p{{Lu}}') AND length(w) > 2) OR (contains(w, '.') AND length(w) > 3)) AS names FROM nq),
ne AS (SELECT item_id, t, intent, list_sort(list_filter(names, lambda w, i: list_position(list_transform(names, lambda x: lower(x)), lower(w)) = i)) AS entities FROM ni)"""


@query("K18_query_interpretation", f"WITH {READ} SELECT item_id, t AS question, intent, array_to_string(entities, ',') AS entities, CAST((intent <> 'general')::INT + (len(entities) > 0)::INT AS INT) AS confidence FROM ne")
def query_interpretation(spark, d):
    return cognition.interpret(view(spark, d, "questions")).select("item_id", F.col("t").alias("question"), "intent", F.array_join("entities", ",").alias("entities"), "confidence")


@query("V01_node_projection", f"SELECT id, label, kind, CASE WHEN entry_point OR route IS NOT NULL THEN 'route' WHEN kind = 'entity' THEN 'entity' WHEN class_name LIKE '%Controller' THEN 'controller' WHEN class_name LIKE '%Service' THEN 'service' WHEN class_name LIKE '%Repository' THEN 'repository' ELSE 'method' END AS layer FROM nodes")
def node_projection(spark, d):
    return views.node_projection(nodes(spark, d), "visualization").select("id", "label", "kind", "layer")


@query("V02_edge_projection", "SELECT from_id || '→' || to_id || '|' || kind AS id, kind, confidence FROM edges")
def edge_projection(spark, d):
    return views.edge_projection(edges(spark, d))


@query("V03_path_steps", f"WITH RECURSIVE {IMPACT}, s AS (SELECT path_id, unnest(string_split(path_id, '|')) AS node, generate_subscripts(string_split(path_id, '|'), 1) - 1 AS seq FROM paths) SELECT path_id, CAST(seq AS INT) AS seq, node FROM s")
def path_steps(spark, d):
    return views.path_steps(impact(spark, d)).select("path_id", "seq", "node")


@query("V04_path_nodes", f"WITH RECURSIVE {IMPACT}, s AS (SELECT unnest(string_split(path_id, '|')) AS node FROM paths) SELECT node, count(*) AS n_paths FROM s GROUP BY node")
def path_nodes(spark, d):
    return views.path_steps(impact(spark, d)).groupBy("node").agg(F.count("*").alias("n_paths"))


@query("V05_path_totals", f"WITH RECURSIVE {IMPACT} SELECT count(*) AS n_paths, count(DISTINCT root) AS n_roots, count(DISTINCT leaf) AS n_leaves, CAST(max(length) AS INT) AS longest, round(avg(length), 6) AS mean_length FROM paths")
def path_totals(spark, d):
    return views.path_totals(impact(spark, d))


SHORT = "CASE WHEN length(string_split(x, '::')[-1]) > 40 THEN substr(string_split(x, '::')[-1], 1, 37) || '...' ELSE string_split(x, '::')[-1] END"


@query("S08_path_summary", f"WITH RECURSIVE {paths_sql('entry_point', 'from_id,to_id', 3)} SELECT path_id, array_to_string(list_transform(string_split(path_id, '|'), lambda x, i: CASE WHEN i = 1 THEN '' WHEN starts_with(x, 'brand:') THEN ' ─[entity-access]→ ' ELSE ' ─[call]→ ' END || {SHORT}), '') AS summary FROM paths")
def path_summary(spark, d):
    from ..functions import text

    n = nodes(spark, d)
    found = traverse.typed_paths(n, edges(spark, d), n.filter("entry_point"), max_depth=3)
    return found.select("path_id", text.path_summary(F.col("node_ids"), F.col("edge_kinds")).alias("summary"))


@query("H08_path_scores", f"""WITH RECURSIVE {paths_sql('entry_point', 'from_id,to_id', 3)}, s AS (SELECT path_id, length, unnest(list_slice(string_split(path_id, '|'), 1, -2)) AS a, unnest(list_slice(string_split(path_id, '|'), 2, -1)) AS b FROM paths WHERE length > 0),
f AS (SELECT from_id, to_id, max(CASE confidence WHEN 'exact' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.5 ELSE 0.25 END::DOUBLE) AS c FROM edges GROUP BY 1, 2),
p AS (SELECT path_id, any_value(length) AS length, product(c) AS conf FROM s JOIN f ON f.from_id = a AND f.to_id = b GROUP BY path_id),
g AS (SELECT path_id, avg((NOT starts_with(x, 'customer:'))::INT) AS grounded FROM (SELECT path_id, unnest(string_split(path_id, '|')) AS x FROM paths) GROUP BY 1),
r AS (SELECT path_id, round(0.4 * conf + 0.35 * grounded + 0.25 * CASE WHEN length <= 3 THEN 1.0 WHEN length <= 6 THEN 0.7 ELSE 0.4 END, 6) AS score FROM p JOIN g USING (path_id))
SELECT path_id, score FROM r WHERE score >= 0.3 ORDER BY score DESC, path_id LIMIT 20""")
def path_scores(spark, d):
    n = nodes(spark, d)
    e = edges(spark, d)
    found = traverse.typed_paths(n, e, n.filter("entry_point"), max_depth=3).filter("length > 0")
    return views.path_scores(found, e, n.select("id", (~F.col("id").startswith("customer:")).alias("grounded")), limit=20)


@query("K12_execution_chains", f"WITH RECURSIVE {paths_sql(chr(105) + 'd IN (SELECT id FROM nodes n9 WHERE n9.class_name LIKE ' + chr(39) + '%Service' + chr(39) + ' ORDER BY n9.label, n9.id LIMIT 5)', 'from_id,to_id', 3)} SELECT root, count(*) AS n_chains, CAST(max(length) AS INT) AS longest FROM paths GROUP BY root")
def execution_chains(spark, d):
    n = nodes(spark, d)
    starts = n.filter(F.col("class_name").endswith("Service")).orderBy("label", "id").limit(5)
    found = traverse.typed_paths(n, edges(spark, d), starts, max_depth=3)
    return found.groupBy("root").agg(F.count("*").alias("n_chains"), F.max("length").alias("longest"))


@query("K19_routing", f"""WITH {READ}, nm AS (SELECT ne.*, CASE WHEN intent = 'general' THEN (SELECT min(id) FROM nodes n WHERE contains(lower(label), lower(t)) OR contains(lower(class_name), lower(t)) OR contains(lower(method_name), lower(t))) END AS target FROM ne)
SELECT item_id, CASE intent WHEN 'architecture' THEN 'architecture' WHEN 'impact' THEN 'impact' WHEN 'debug' THEN 'rootcause' WHEN 'capability' THEN 'capability' ELSE CASE WHEN target IS NOT NULL THEN 'impact' ELSE 'architecture' END END AS engine,
CAST(CASE WHEN intent IN ('impact', 'debug') THEN CASE WHEN len(entities) > 0 THEN 2 ELSE 1 END WHEN intent <> 'general' THEN 2 WHEN target IS NOT NULL THEN 1 ELSE 0 END AS INT) AS confidence, target FROM nm""")
def routing(spark, d):
    return cognition.route(view(spark, d, "questions"), nodes(spark, d))
