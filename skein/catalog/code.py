"""Graph construction and analyzers (families B, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analyzers, build
from ..plans.fixture import edges, nodes, view
from ..registry import query

QUALIFIED = "uq AS (SELECT *, namespace || '.' || class_name || '.' || method_name AS q FROM units)"
RESOLVED = (
    QUALIFIED
    + """, rv AS (SELECT DISTINCT c.unit_id AS from_id, CASE WHEN external THEN 'ext::' || target ELSE coalesce((SELECT min(id) FROM uq WHERE uq.q = c.target AND uq.project_name = c.project_name), (SELECT min(id) FROM uq WHERE uq.q = c.target HAVING count(DISTINCT id) = 1)) END AS to_id,
CASE WHEN external OR EXISTS (SELECT 1 FROM uq WHERE uq.q = c.target AND uq.project_name = c.project_name) THEN 'high' ELSE 'medium' END AS confidence FROM calls c), rs AS (SELECT * FROM rv WHERE to_id IS NOT NULL)"""
)


@query("A06_merged_units", "SELECT u.id, u.content, CAST(count(DISTINCT c.target) AS INT) AS n_calls FROM units u LEFT JOIN calls c ON c.unit_id = u.id GROUP BY 1, 2")
def merged_units(spark, d):
    calls = view(spark, d, "calls").select(F.col("unit_id").alias("id"), "target")
    rows = view(spark, d, "units").join(calls, "id", "left").withColumn("ord", F.row_number().over(build_order())).select("id", "ord", F.when(F.col("ord") == 1, "").otherwise(F.col("content")).alias("content"), F.array_compact(F.array("target")).alias("calls"))
    empty = view(spark, d, "units").select("id", F.lit(9).alias("ord"), "content", F.array().cast("array<string>").alias("calls"))
    return build.merged_units(rows.unionByName(empty)).select("id", "content", F.size("calls").alias("n_calls"))


def build_order():
    from pyspark.sql import Window as W

    return W.partitionBy("id").orderBy("target")


@query("A05_distinct_calls", "SELECT unit_id, target, bool_or(external) AS external FROM calls GROUP BY 1, 2")
def distinct_calls(spark, d):
    return view(spark, d, "calls").groupBy("unit_id", "target").agg(F.bool_or("external").alias("external"))


@query("B01_unit_nodes", "SELECT DISTINCT id, class_name || '.' || method_name || '()' AS label, project_name FROM units")
def unit_nodes(spark, d):
    return build.unit_nodes(view(spark, d, "units")).select("id", "label", "project_name")


@query("B02_call_targets", f"WITH {RESOLVED} SELECT from_id, to_id FROM rs")
def call_targets(spark, d):
    return resolved(spark, d).select("from_id", "to_id")


def resolved(spark, d):
    return build.resolved(view(spark, d, "calls"), view(spark, d, "units"))


@query("B03_resolved_edges", f"WITH {RESOLVED} SELECT from_id, to_id, min(confidence) AS confidence FROM rs GROUP BY 1, 2")
def resolved_edges(spark, d):
    return resolved(spark, d)


@query("B04_text_edges", f"WITH {RESOLVED}, tx AS (SELECT DISTINCT a.id AS from_id, b.id AS to_id, CASE WHEN a.project_name = b.project_name AND a.class_name = b.class_name THEN 'medium' ELSE 'low' END AS confidence FROM units a JOIN units b ON contains(a.content, b.method_name || '(')) SELECT * FROM tx WHERE NOT EXISTS (SELECT 1 FROM rs WHERE rs.from_id = tx.from_id AND rs.to_id = tx.to_id) ORDER BY from_id, to_id LIMIT (SELECT 5000 - count(*) FROM rs)")
def text_edges(spark, d):
    return build.text_edges(view(spark, d, "units"), resolved(spark, d))


@query("B05_class_edges", "WITH sz AS (SELECT project_name, class_name FROM units GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 100) SELECT DISTINCT a.id AS from_id, b.id AS to_id FROM units a JOIN units b ON a.project_name = b.project_name AND a.class_name = b.class_name AND contains(a.content, b.method_name || '(') AND a.method_name <> b.method_name JOIN sz ON sz.project_name = a.project_name AND sz.class_name = a.class_name ORDER BY 1, 2 LIMIT 3000")
def class_edges(spark, d):
    return build.class_edges(view(spark, d, "units"))


@query("B06_dependency_types", f"WITH {RESOLVED} SELECT rs.from_id, rs.to_id, CASE WHEN a.project_name || '.' || a.class_name = b.project_name || '.' || b.class_name THEN 'same-class' WHEN min(rs.confidence) = 'high' THEN 'direct' ELSE 'transitive' END AS dependency_type FROM rs LEFT JOIN units a ON a.id = rs.from_id LEFT JOIN units b ON b.id = rs.to_id GROUP BY rs.from_id, rs.to_id, a.project_name, a.class_name, b.project_name, b.class_name")
def dependency_types(spark, d):
    return build.dependency_types(resolved(spark, d), view(spark, d, "units"))


@query("B07_external_nodes", f"WITH {RESOLVED} SELECT DISTINCT to_id AS id, string_split(to_id, '::')[-1] AS label FROM rs WHERE to_id NOT IN (SELECT id FROM units)")
def external_nodes(spark, d):
    return build.external_nodes(resolved(spark, d), view(spark, d, "units")).select("id", "label")


@query("B08_called_by", "SELECT to_id AS id, array_to_string(list_sort(list(DISTINCT from_id)), ',') AS callers FROM edges GROUP BY 1")
def called_by(spark, d):
    return build.called_by(edges(spark, d)).select("id", F.array_join("callers", ",").alias("callers"))


@query("B09_adjacency", "SELECT DISTINCT from_id, to_id FROM edges")
def adjacency(spark, d):
    build.unique_ids(nodes(spark, d))
    return edges(spark, d).select("from_id", "to_id").distinct()


@query("B10_edge_directions", "SELECT from_id AS id, 'out' AS direction, count(*) AS n FROM edges GROUP BY 1 UNION ALL SELECT to_id, 'in', count(*) FROM edges GROUP BY 1")
def edge_directions(spark, d):
    e = edges(spark, d)
    out = e.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("n")).select("id", F.lit("out").alias("direction"), "n")
    return out.unionByName(e.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("n")).select("id", F.lit("in").alias("direction"), "n"))


HANDLES = "hd AS (SELECT class_name, method_name, params, 'M:' || class_name || '.' || method_name || '(' || params || ')' AS handle FROM methods WHERE params <> 'string')"


def handles(spark, d):
    m = view(spark, d, "methods")
    known = m.filter("params <> 'string'").withColumn("handle", F.concat(F.lit("M:"), "class_name", F.lit("."), "method_name", F.lit("("), "params", F.lit(")")))
    return build.symbols(m, known)


@query("B11_symbols", f"WITH {HANDLES} SELECT m.class_name, m.method_name, m.params, coalesce(h.handle, (SELECT min(handle) FROM hd WHERE hd.class_name = m.class_name AND hd.method_name = m.method_name)) AS handle FROM methods m LEFT JOIN hd h ON h.class_name = m.class_name AND h.method_name = m.method_name AND h.params = m.params")
def symbols(spark, d):
    return handles(spark, d)


@query("B12_by_symbol", f"WITH {HANDLES}, sm AS (SELECT m.*, coalesce(h.handle, (SELECT min(handle) FROM hd WHERE hd.class_name = m.class_name AND hd.method_name = m.method_name)) AS handle FROM methods m LEFT JOIN hd h ON h.class_name = m.class_name AND h.method_name = m.method_name AND h.params = m.params) SELECT handle, count(*) AS n, min(class_name || '.' || method_name || '.' || params) AS first FROM sm GROUP BY 1")
def by_symbol(spark, d):
    return build.by_symbol(handles(spark, d))


@query("B13_base_chains", "WITH RECURSIVE bc AS (SELECT class_name, base_name AS ancestor, 1 AS depth FROM bases UNION SELECT bc.class_name, b.base_name, bc.depth + 1 FROM bc JOIN bases b ON b.class_name = bc.ancestor WHERE bc.depth < 10) SELECT class_name, ancestor, CAST(min(depth) AS INT) AS depth FROM bc WHERE class_name <> ancestor GROUP BY 1, 2")
def base_chains(spark, d):
    return analyzers.base_chain(view(spark, d, "bases"))


@query("B15_annotations", "SELECT subject_id, string_agg(k || '=' || v, ',' ORDER BY k) AS attributes FROM (SELECT subject_id, analyzer || ':' || fact_type AS k, max_by(value, source_file) AS v FROM facts GROUP BY 1, 2) GROUP BY 1")
def annotations(spark, d):
    rows = build.annotated(view(spark, d, "facts"))
    return rows.select("subject_id", F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("attributes"))


@query("B16_incremental_scope", "SELECT * FROM facts WHERE NOT (analyzer = 'routes' AND source_file IN ('a.cs', 'd.cs')) UNION ALL SELECT 'routes', 'n9', 'route', 'a.cs', '/new'")
def incremental_scope(spark, d):
    facts = view(spark, d, "facts")
    fresh = spark.createDataFrame([("routes", "n9", "route", "a.cs", "/new")], facts.schema)
    return build.rescoped(facts, fresh, ["routes"], ["a.cs", "d.cs"])


VERB = "CASE WHEN starts_with(attribute, 'Http') THEN upper(substr(attribute, 5)) WHEN regexp_matches(method_name, '^Get([A-Z]|$)') THEN 'GET' WHEN regexp_matches(method_name, '^(Post|Create)([A-Z]|$)') THEN 'POST' WHEN regexp_matches(method_name, '^(Put|Update)([A-Z]|$)') THEN 'PUT' WHEN regexp_matches(method_name, '^(Delete|Remove)([A-Z]|$)') THEN 'DELETE' WHEN regexp_matches(method_name, '^Patch([A-Z]|$)') THEN 'PATCH' ELSE 'GET' END"
ACTION = "(class_name LIKE '%Controller' OR base_type IN ('Controller', 'ControllerBase')) AND is_public AND NOT is_static AND attribute <> 'NonAction'"


@query("C01_actions", f"SELECT class_name, method_name FROM actions WHERE {ACTION}")
def actions(spark, d):
    return analyzers.routes(view(spark, d, "actions")).select("class_name", "method_name")


@query("C02_verbs", f"SELECT class_name, method_name, {VERB} AS verb FROM actions WHERE {ACTION}")
def verbs(spark, d):
    return analyzers.routes(view(spark, d, "actions")).select("class_name", "method_name", "verb")


@query("C03_routes", f"WITH c AS (SELECT *, lower(regexp_replace(class_name, 'Controller$', '')) AS ctl, concat_ws('/', nullif(trim(class_route, '/'), ''), nullif(trim(method_route, '/'), '')) AS t FROM actions WHERE {ACTION}) SELECT class_name, method_name, '/' || rtrim(replace(replace(CASE WHEN t = '' THEN ctl || '/' || lower(method_name) ELSE t END, '[controller]', ctl), '[action]', lower(method_name)), '/') AS route FROM c")
def routes(spark, d):
    return analyzers.routes(view(spark, d, "actions")).select("class_name", "method_name", "route")


@query("C04_bean_references", "SELECT DISTINCT a.type_name AS from_type, b.type_name AS to_type FROM beans a JOIN beans b ON a.ref = b.bean_id")
def bean_references(spark, d):
    return analyzers.bean_edges(view(spark, d, "beans"))


@query("C04_implementations", "SELECT b.base_name AS interface, b.class_name, i.method_name, i.params FROM bases b JOIN methods i ON i.class_name = b.base_name AND i.is_interface JOIN methods m ON m.class_name = b.class_name AND m.method_name = i.method_name AND m.params = i.params WHERE b.base_name LIKE 'I%'")
def implementations(spark, d):
    return analyzers.implementations(view(spark, d, "methods"), view(spark, d, "bases"))


@query("C04_bean_anchors", "SELECT DISTINCT bean_id, (SELECT min(method_name) FROM methods m WHERE m.class_name = string_split(type_name, '.')[-1]) AS anchor FROM beans")
def bean_anchors(spark, d):
    return analyzers.anchors(view(spark, d, "beans"), view(spark, d, "methods"))


@query("C05_interface_namespaces", """WITH bn AS (SELECT DISTINCT string_split(type_name, '.')[-1] AS class_name, regexp_replace(type_name, '\\.?[^.]*$', '') AS home FROM beans), bs AS (SELECT DISTINCT class_name, base_name AS written, string_split(base_name, '.')[-1] AS interface FROM bases WHERE starts_with(string_split(base_name, '.')[-1], 'I')),
us AS (SELECT class_name, string_split(name, '.')[-1] AS interface, min(regexp_replace(name, '\\.?[^.]*$', '')) AS used FROM usings WHERE contains(name, '.') GROUP BY 1, 2)
SELECT DISTINCT class_name, interface, CASE WHEN contains(written, '.') THEN regexp_replace(written, '\\.?[^.]*$', '') ELSE coalesce(used, home) END AS namespace FROM bs JOIN bn USING (class_name) LEFT JOIN us USING (class_name, interface)""")
def interface_namespaces(spark, d):
    return analyzers.interface_namespaces(view(spark, d, "bases"), view(spark, d, "usings"), view(spark, d, "beans"))


LAST = "mp AS (SELECT class_name, coalesce(nullif(max_by(table_name, file), ''), class_name || 's') AS table_name FROM mappings GROUP BY 1)"
HQL = "coalesce(nullif(regexp_extract({0}, '(?i)delete\\s+from\\s+(\\w+)', 1), ''), nullif(regexp_extract({0}, '(?i)update\\s+(\\w+)', 1), ''), nullif(regexp_extract({0}, '(?i)from\\s+(\\w+)', 1), ''), nullif(regexp_extract({0}, '(?i)join\\s+(\\w+)', 1), ''))"
ACCESS = f"""{LAST}, tr AS (SELECT access_id, max_by(s.expression, s.pos) AS expression FROM accesses a JOIN assignments s ON s.method = a.method AND s.variable = a.argument AND s.pos < a.pos GROUP BY 1),
ea AS (SELECT a.*, {HQL.format('argument')} AS by_text, coalesce(nullif(generic, ''), {HQL.format('argument')}, {HQL.format('expression')}) AS entity FROM accesses a LEFT JOIN tr USING (access_id) WHERE contains(lower(receiver), 'session') AND api IN ('Query','Get','Save','Update','Delete','SaveOrUpdate','CreateQuery','CreateSQLQuery','CreateCriteria')),
ac AS (SELECT access_id, method, entity, coalesce(mp.table_name, entity || 's') AS table_name, CASE WHEN mp.table_name IS NOT NULL AND generic <> '' THEN 'exact' WHEN mp.table_name IS NOT NULL THEN 'high' WHEN generic <> '' OR by_text IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence FROM ea LEFT JOIN mp ON mp.class_name = entity WHERE entity IS NOT NULL)"""


def found(spark, d):
    return analyzers.entity_accesses(view(spark, d, "accesses"), view(spark, d, "mappings"), view(spark, d, "assignments"))


@query("C06_entity_accesses", f"WITH {ACCESS} SELECT access_id, method, entity, table_name FROM ac")
def entity_accesses(spark, d):
    return found(spark, d).select("access_id", "method", "entity", "table_name")


@query("C07_access_confidence", f"WITH {ACCESS} SELECT access_id, confidence FROM ac")
def access_confidence(spark, d):
    return found(spark, d).select("access_id", "confidence")


@query("C08_hql_entities", f"SELECT access_id, {HQL.format('argument')} AS entity FROM accesses")
def hql_entities(spark, d):
    return view(spark, d, "accesses").select("access_id", analyzers.hql_entity(F.col("argument")).alias("entity"))


@query("C09_traced_variables", "SELECT access_id, max_by(s.expression, s.pos) AS expression FROM accesses a JOIN assignments s ON s.method = a.method AND s.variable = a.argument AND s.pos < a.pos GROUP BY 1")
def traced_variables(spark, d):
    return analyzers.traced(view(spark, d, "accesses"), view(spark, d, "assignments"))


@query("C10_table_inference", f"WITH {LAST} SELECT * FROM mp")
def table_inference(spark, d):
    return analyzers.last_mappings(view(spark, d, "mappings"))


BOUND = """inn AS (SELECT b.class_name AS mid, p.ord AS place, b.base_name AS top, b.arg AS top_arg FROM bases b JOIN type_parameters p ON p.class_name = b.class_name AND p.parameter = b.argument WHERE b.argument <> ''),
bw AS (SELECT class_name, base_name, arg, argument, 1 AS depth FROM bases WHERE argument <> '' UNION ALL SELECT x.class_name, i.top, i.top_arg, x.argument, x.depth + 1 FROM bw x JOIN inn i ON i.mid = x.base_name AND i.place = x.arg WHERE x.depth < 10),
bd AS (SELECT class_name, base_name, arg, argument, min(depth) AS depth FROM bw WHERE NOT regexp_matches(argument, '^T\\d*$') GROUP BY 1, 2, 3, 4)"""


@query("C12_type_bindings", f"WITH RECURSIVE {BOUND} SELECT class_name, base_name, arg, argument, CAST(depth AS INT) AS depth FROM bd")
def type_bindings(spark, d):
    return analyzers.bindings(view(spark, d, "bases"), view(spark, d, "type_parameters"))


@query("C11_inheritance", """WITH RECURSIVE w AS (SELECT DISTINCT class_name AS src, base_name AS dst FROM bases), up AS (SELECT src AS c, dst AS a FROM w UNION SELECT c, w.dst FROM up JOIN w ON w.src = up.a)
SELECT src AS class_name, count(DISTINCT dst) AS n_bases, min(dst) AS first_base, (SELECT count(*) FROM type_parameters p WHERE p.class_name = src) AS n_parameters, (SELECT count(DISTINCT a) FROM up WHERE c = src AND a <> src) AS n_ancestors FROM w GROUP BY 1""")
def inheritance(spark, d):
    b = view(spark, d, "bases")
    up = analyzers.base_chain(b).groupBy("class_name").agg(F.countDistinct("ancestor").alias("n_ancestors"))
    own = view(spark, d, "type_parameters").groupBy("class_name").agg(F.count("*").alias("n_parameters"))
    rows = b.groupBy("class_name").agg(F.countDistinct("base_name").alias("n_bases"), F.min("base_name").alias("first_base"))
    return rows.join(own, "class_name", "left").join(up, "class_name", "left").na.fill(0)


@query("C13_generic_arguments", f"""WITH RECURSIVE {BOUND}, al AS (SELECT class_name, base_name, arg, argument, CASE WHEN depth = 1 THEN 'exact' ELSE 'high' END AS confidence FROM bd UNION ALL SELECT class_name, base_name, arg, argument, 'medium' FROM bases WHERE regexp_matches(argument, '^T\\d*$'))
SELECT DISTINCT al.class_name, al.base_name, coalesce(p.parameter, '') AS parameter, argument, confidence FROM al LEFT JOIN type_parameters p ON p.class_name = al.base_name AND p.ord = al.arg""")
def generic_arguments(spark, d):
    return analyzers.generic_arguments(view(spark, d, "bases"), view(spark, d, "type_parameters"))


@query("C14_entity_registry", "SELECT class_name, min_by(argument, ord * 100 + arg) AS entity, min(CASE WHEN base_name IN ('BaseBLL', 'IBGenericManager') THEN 'bll' ELSE 'dao' END) AS role FROM bases WHERE base_name IN ('BaseBLL', 'IBGenericManager', 'BaseDaoNHB', 'HibernateDaoSupport', 'IDBaseDao') AND argument <> '' AND NOT regexp_matches(argument, '^T\\d*$') GROUP BY 1")
def entity_registry(spark, d):
    return analyzers.entity_registry(view(spark, d, "bases"))


ENDINGS = {"repository": "['Repository','Repo','Dao','DAO','Dal','DataAccess','DataProvider','QueryProvider']", "service": "['Service','ServiceImpl','Manager','Handler','Provider','Processor','Controller']"}
GENERIC = "('repository','baserepository','genericrepository','dao','basedao','genericdao','baseservice','genericservice','crudrepository','pagingandsortingrepository','jparepository','mongorepository')"


def ending(kind: str) -> str:
    return f"list_filter({ENDINGS[kind]}, lambda x: ends_with(lower(s), lower(x)))[1]"


@query("C15_names_to_entities", f"""WITH n AS (SELECT DISTINCT class_name, string_split(class_name, '.')[-1] AS s FROM methods), e AS (SELECT *, {ending('repository')} AS rp, {ending('service')} AS sv FROM n),
k AS (SELECT class_name, CASE WHEN lower(s) IN {GENERIC} THEN 'generic-repository' WHEN starts_with(s, 'I') AND lower(substr(s, 2)) IN {GENERIC} THEN 'generic-repository-interface' WHEN lower(s) IN ('irepository','idao','ireadrepository','iwriterepository','icrudservice','ientityservice') THEN 'interface-repository'
 WHEN rp IS NOT NULL THEN 'repository-suffix:' || rp WHEN sv IS NOT NULL THEN 'service-suffix:' || sv END AS kind, s, coalesce(rp, sv) AS x FROM e)
SELECT class_name, kind, CASE WHEN contains(kind, 'suffix') AND length(s) > length(x) THEN regexp_replace(substr(s, 1, length(s) - length(x)), '(?i)Impl$', '') END AS entity FROM k WHERE kind IS NOT NULL""")
def names_to_entities(spark, d):
    rows = view(spark, d, "methods").select("class_name", analyzers.name_pattern(F.col("class_name")).alias("p")).distinct()
    return rows.filter("p is not null").select("class_name", "p.kind", "p.entity")


@query("C16_first_arguments", "SELECT DISTINCT base_name || '<' || argument || ', List<A, B>>' AS type_name, argument FROM bases WHERE argument <> '' UNION SELECT 'Map<List<' || argument || ', B>, C>', 'List<' || argument || ', B>' FROM bases WHERE argument <> '' UNION SELECT class_name, '' FROM bases")
def first_arguments(spark, d):
    b = view(spark, d, "bases")
    own = b.filter("argument <> ''")
    rows = own.select(F.concat("base_name", F.lit("<"), "argument", F.lit(", List<A, B>>")).alias("type_name")).union(own.select(F.concat(F.lit("Map<List<"), "argument", F.lit(", B>, C>")))).union(b.select("class_name"))
    return rows.distinct().select("type_name", analyzers.first_argument(F.col("type_name")).alias("argument"))


@query("C17_resolved_types", f"WITH {ACCESS} SELECT method, min_by(entity, p) AS entity FROM (SELECT method, entity, CASE confidence WHEN 'exact' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END AS p FROM ac) GROUP BY 1")
def resolved_types(spark, d):
    rank = F.when(F.col("confidence") == "exact", 1).when(F.col("confidence") == "high", 2).when(F.col("confidence") == "medium", 3).otherwise(4)
    return analyzers.by_priority(found(spark, d).select("method", "entity", rank.alias("priority")), ["method"]).select("method", "entity")


TYPED = """iv AS (SELECT DISTINCT method, split_part(method, '.', 1) AS class_name, receiver AS raw, regexp_replace(receiver, '^this\\.', '') AS receiver, api FROM accesses),
mt AS (SELECT iv.method, iv.raw, iv.receiver, iv.api, arg_max(type, CASE scope WHEN 'param' THEN 3 WHEN 'local' THEN 2 ELSE 1 END) AS type FROM iv JOIN declared d ON d.class_name = iv.class_name AND d.name = iv.receiver AND (d.method = '' OR d.method = iv.method AND NOT starts_with(raw, 'this.')) GROUP BY 1, 2, 3, 4)"""


def invocations(spark, d):
    return view(spark, d, "accesses").select("access_id", "method", F.substring_index("method", ".", 1).alias("class_name"), "receiver", "api")


@query("C18_typed_invocations", f"WITH {TYPED} SELECT DISTINCT method, receiver || '.' || api AS expression, trim(regexp_extract(type, '^[^<]*<([^,>]*)', 1)) AS entity FROM mt WHERE regexp_extract(type, '^[^<]*<([^,>]*)', 1) <> '' AND NOT regexp_matches(regexp_extract(type, '^[^<]*<([^,>]*)', 1), '^T\\d*$')")
def typed_invocations(spark, d):
    return analyzers.typed_invocations(invocations(spark, d), view(spark, d, "declared"))


@query("C19_dao_call_sites", """SELECT access_id, d.type AS dao, trim(regexp_extract(d.type, '^[^<]*<([^,>]*)', 1)) AS entity FROM accesses a JOIN declared d ON d.class_name = split_part(a.method, '.', 1) AND d.scope = 'field' AND (a.receiver = d.name OR a.receiver = 'this.' || d.name) WHERE contains(lower(d.type), 'basedao')""")
def dao_call_sites(spark, d):
    return analyzers.dao_call_sites(invocations(spark, d), view(spark, d, "declared"))


@query("C20_name_hints", "SELECT DISTINCT m.class_name, m.method_name, e.entity FROM methods m JOIN (SELECT DISTINCT class_name AS entity FROM mappings UNION SELECT 'Stock') e ON contains(lower(m.method_name), lower(e.entity)) OR contains(lower(m.class_name), lower(e.entity))")
def name_hints(spark, d):
    known = view(spark, d, "mappings").select(F.col("class_name").alias("entity")).union(spark.createDataFrame([("Stock",)], "entity string")).distinct()
    return analyzers.name_hints(view(spark, d, "methods"), known)


@query("C21_access_edges", f"WITH {ACCESS} SELECT DISTINCT method, 'ext::entity::' || entity || '::' || table_name AS to_id FROM ac WHERE confidence <> 'low'")
def access_edges(spark, d):
    return analyzers.access_edges(found(spark, d))


@query("C22_resolution_stats", f"WITH {ACCESS} SELECT entity, count(*) AS n, count(DISTINCT method) AS n_methods, min(table_name) AS table_name FROM ac GROUP BY 1")
def resolution_stats(spark, d):
    return analyzers.resolution_stats(found(spark, d))


@query("C23_diagnostics", f"WITH {ACCESS} SELECT 'duplicate-mapping' AS problem, class_name AS subject FROM mappings GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'unresolved', CAST(access_id AS STRING) FROM accesses WHERE contains(lower(receiver), 'session') AND access_id NOT IN (SELECT access_id FROM ac) UNION ALL SELECT DISTINCT 'unmapped', entity FROM ac WHERE entity NOT IN (SELECT class_name FROM mappings)")
def diagnostics(spark, d):
    return analyzers.diagnostics(found(spark, d), view(spark, d, "mappings"), view(spark, d, "accesses"))
