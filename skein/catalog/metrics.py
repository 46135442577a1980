"""Graph features, truth and retrieval (families F, I, H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import confidence
from ..operators import metrics, retrieval, truth
from ..operators.lookup import layer
from ..plans import traverse
from ..plans.fixture import edges, nodes, view
from ..registry import query
from ..session import table
from .graph import IMPACT, impact

DEGREE = """dg AS (SELECT n.id, coalesce(b.c, 0) AS n_callers, coalesce(a.c, 0) AS n_callees FROM nodes n
LEFT JOIN (SELECT from_id, count(DISTINCT to_id) AS c FROM edges GROUP BY 1) a ON a.from_id = n.id LEFT JOIN (SELECT to_id, count(DISTINCT from_id) AS c FROM edges GROUP BY 1) b ON b.to_id = n.id)"""
CENTRAL = DEGREE + ", ce AS (SELECT id, round(least((n_callers + n_callees) / greatest(3 * (SELECT greatest(max(n_callers), max(n_callees)) FROM dg), 1)::DOUBLE, 1.0), 6) AS centrality FROM dg)"
DEPTH = """fw AS (SELECT id, 0 AS d FROM nodes WHERE entry_point UNION SELECT e.to_id, fw.d + 1 FROM fw JOIN edges e ON e.from_id = fw.id WHERE fw.d < 15),
bw AS (SELECT id, 0 AS d FROM nodes WHERE kind = 'entity' UNION SELECT e.from_id, bw.d + 1 FROM bw JOIN edges e ON e.to_id = bw.id WHERE bw.d < 10),
ly AS (SELECT id, CASE WHEN entry_point OR route IS NOT NULL THEN 'route' WHEN kind = 'entity' THEN 'entity' WHEN class_name LIKE '%Controller' THEN 'controller' WHEN class_name LIKE '%Service' THEN 'service' WHEN class_name LIKE '%Repository' THEN 'repository' ELSE 'method' END AS layer FROM nodes),
dp AS (SELECT ly.id, layer, CAST(CASE layer WHEN 'route' THEN 0 WHEN 'controller' THEN 1 WHEN 'service' THEN 2 WHEN 'repository' THEN 3 WHEN 'entity' THEN 4 WHEN 'table' THEN 5 ELSE 3 END AS INT) AS layer_depth,
CAST(coalesce((SELECT min(d) FROM fw WHERE fw.id = ly.id), -1) AS INT) AS entry_distance, CAST(coalesce((SELECT min(d) FROM bw WHERE bw.id = ly.id), -1) AS INT) AS data_distance FROM ly)"""
FEATURES = (
    "WITH RECURSIVE "
    + CENTRAL
    + ", "
    + DEPTH
    + """, fa AS (SELECT n.*, dg.n_callers, dg.n_callees, ce.centrality, dp.layer, dp.layer_depth, dp.entry_distance, dp.data_distance, EXISTS (SELECT 1 FROM edges e WHERE e.from_id = n.id AND e.kind = 'entity-access') AS has_access FROM nodes n JOIN dg ON dg.id = n.id JOIN ce ON ce.id = n.id JOIN dp ON dp.id = n.id),
fb AS (SELECT *, round(least(((CASE WHEN entry_distance BETWEEN 0 AND 5 THEN greatest(0.0, 2 - 0.4 * entry_distance) ELSE 0.0 END) + (CASE WHEN data_distance BETWEEN 0 AND 3 THEN greatest(0.0, 2 - 0.6 * data_distance) ELSE 0.0 END) + (CASE WHEN entry_point THEN 2.0 ELSE 0.0 END) + (CASE WHEN has_access THEN 1.5 ELSE 0.0 END)) / 5.0::DOUBLE, 1.0), 6) AS business FROM fa),
fc AS (SELECT *, round(10 * round(0.2::DOUBLE * centrality + 0.25::DOUBLE * business + 0.15::DOUBLE * least((n_callers + n_callees) / 50.0::DOUBLE, 1.0) + 0.2::DOUBLE * entry_point::INT + 0.15::DOUBLE * has_access::INT + 0.05::DOUBLE * ((CASE WHEN entry_distance BETWEEN 0 AND 2 THEN 0.5 ELSE 0.0 END) + (CASE WHEN data_distance BETWEEN 0 AND 2 THEN 0.5 ELSE 0.0 END)), 3), 2) AS importance FROM fb)"""
)


@query("F01_degrees", f"WITH {DEGREE} SELECT id, n_callers, n_callees FROM dg")
def degrees(spark, d):
    return metrics.degrees(nodes(spark, d), edges(spark, d))


def fan_sql(a: str, b: str) -> str:
    return f"""WITH RECURSIVE cl AS (SELECT id AS start, id, 0 AS d FROM nodes UNION SELECT cl.start, e.{b}, cl.d + 1 FROM cl JOIN edges e ON e.{a} = cl.id WHERE cl.d < 6),
m AS (SELECT start, id, min(d) AS d FROM cl WHERE id <> start GROUP BY 1, 2), f AS (SELECT start, count(*) AS reach, count(*) FILTER (WHERE d = 1) AS direct FROM m GROUP BY 1)
SELECT n.id, CAST(coalesce(CASE WHEN direct >= 199 THEN direct ELSE least(coalesce(reach, 0), 199) END, 0) AS BIGINT) AS fan FROM nodes n LEFT JOIN f ON f.start = n.id"""


@query("F02_fan_out", fan_sql("from_id", "to_id"))
def fan_out(spark, d):
    return metrics.fans(nodes(spark, d), edges(spark, d))


@query("F02_fan_in", fan_sql("to_id", "from_id"))
def fan_in(spark, d):
    return metrics.fans(nodes(spark, d), edges(spark, d), "backward")


@query("F03_distances", f"WITH RECURSIVE {DEPTH} SELECT id, entry_distance, data_distance FROM dp")
def distances(spark, d):
    return metrics.dependency(nodes(spark, d), edges(spark, d)).select("id", "entry_distance", "data_distance")


@query("F04_layer_depth", f"WITH RECURSIVE {DEPTH} SELECT layer, layer_depth, count(*) AS n FROM dp GROUP BY 1, 2")
def layer_depth(spark, d):
    return metrics.dependency(nodes(spark, d), edges(spark, d)).groupBy("layer", "layer_depth").agg(F.count("*").alias("n"))


@query("F05_dependency_depth", f"WITH RECURSIVE {DEPTH} SELECT id, CAST(CASE WHEN entry_distance >= 0 AND data_distance >= 0 THEN entry_distance + data_distance WHEN entry_distance >= 0 THEN entry_distance ELSE data_distance END AS INT) AS depth FROM dp")
def dependency_depth(spark, d):
    return metrics.dependency(nodes(spark, d), edges(spark, d)).select("id", "depth")


@query("F06_centrality", f"WITH {CENTRAL} SELECT id, centrality FROM ce")
def centrality(spark, d):
    return metrics.centrality(metrics.degrees(nodes(spark, d), edges(spark, d)))


@query("F07_path_frequency", f"WITH RECURSIVE {IMPACT}, s AS (SELECT path_id, unnest(string_split(path_id, '|')) AS node FROM paths) SELECT node, round(count(DISTINCT path_id) / (SELECT count(*) FROM paths)::DOUBLE, 6) AS share FROM s GROUP BY node")
def path_frequency(spark, d):
    return metrics.path_frequency(impact(spark, d))


@query("F08_business_score", f"{FEATURES} SELECT id, business FROM fc")
def business_score(spark, d):
    return metrics.features(nodes(spark, d), edges(spark, d)).select("id", "business")


@query("F09_related", """SELECT n.class_name, n.project_name, count(DISTINCT m.id) AS n_entities, count(DISTINCT m.table_name) AS n_tables, min(m.table_name) AS first_table, count(DISTINCT n.route) AS n_routes, min(n.route) AS first_route FROM nodes n LEFT JOIN edges e ON e.from_id = n.id LEFT JOIN nodes m ON m.id = e.to_id AND m.kind = 'entity' GROUP BY 1, 2""")
def related(spark, d):
    n = nodes(spark, d)
    return metrics.related(n, edges(spark, d), n.select("id", "class_name", "project_name"), ["class_name", "project_name"])


@query("F10_class_metadata", f"""{FEATURES} SELECT project_name, namespace, class_name, count(*) AS n, CAST(sum(n_callers) AS BIGINT) AS n_callers, CAST(sum(n_callees) AS BIGINT) AS n_callees, coalesce(min(entry_distance) FILTER (WHERE entry_distance >= 0), -1) AS entry_distance,
coalesce(min(data_distance) FILTER (WHERE data_distance >= 0), -1) AS data_distance, max(layer_depth) AS layer_depth, bool_or(entry_point) AS is_entry, bool_or(has_access) AS has_access, round(avg(centrality), 3) AS centrality, max(business) AS business FROM fc WHERE NOT is_external GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def class_metadata(spark, d):
    return metrics.class_metadata(metrics.features(nodes(spark, d), edges(spark, d)))


@query("F11_importance", f"{FEATURES} SELECT id, importance FROM fc")
def importance(spark, d):
    return metrics.features(nodes(spark, d), edges(spark, d)).select("id", "importance")


@query("F12_layers", f"WITH RECURSIVE {DEPTH} SELECT id, layer FROM ly")
def layers(spark, d):
    return nodes(spark, d).select("id", layer().alias("layer"))


@query("F13_edge_layers", "SELECT CASE kind WHEN 'call' THEN 'execution' WHEN 'entity-access' THEN 'data' ELSE 'structure' END AS layer, count(*) AS n FROM edges GROUP BY 1")
def edge_layers(spark, d):
    return edges(spark, d).groupBy(truth.edge_layer(F.col("kind")).alias("layer")).agg(F.count("*").alias("n"))


TRUTH = """tr AS (SELECT e.*, CASE e.evidence WHEN 'semantic' THEN 1.0 WHEN 'syntax' THEN 0.8 WHEN 'analyzer' THEN CASE e.confidence WHEN 'exact' THEN 0.9 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.55 ELSE 0.3 END ELSE 0.1 END::DOUBLE * CASE WHEN a.project_name <> 'P3' OR b.project_name <> 'P3' THEN 1.0 ELSE 0.5 END::DOUBLE AS truth, (a.project_name <> 'P3' OR b.project_name <> 'P3') AS grounded FROM edges e JOIN nodes a ON a.id = e.from_id JOIN nodes b ON b.id = e.to_id)"""


def truths(spark, d):
    return truth.edge_truth(edges(spark, d), nodes(spark, d).withColumn("grounded", F.col("project_name") != "P3"))


@query("I01_edge_truth", f"WITH {TRUTH} SELECT from_id, to_id, kind, round(truth, 6) AS truth FROM tr")
def edge_truth(spark, d):
    return truths(spark, d).select("from_id", "to_id", "kind", F.round("truth", 6).alias("truth"))


@query("I02_truth_decay", f"WITH {TRUTH} SELECT kind, s AS steps, round(avg(truth * pow(0.7, s)), 6) AS mean_truth, pow(0.7, s) > 0.3 AS grounded FROM tr CROSS JOIN (SELECT CAST(unnest([0, 1, 2, 3, 4]) AS INT) AS s) GROUP BY 1, 2")
def truth_decay(spark, d):
    s = spark.range(5).select(F.col("id").cast("int").alias("steps"))
    rows = truths(spark, d).crossJoin(F.broadcast(s))
    return rows.groupBy("kind", "steps").agg(F.round(F.avg(confidence.decayed(F.col("truth"), F.col("steps"))), 6).alias("mean_truth")).withColumn("grounded", F.pow(F.lit(0.7), F.col("steps")) > 0.3)


@query("I03_truth_classes", f"WITH {TRUTH} SELECT CASE WHEN grounded AND truth >= 0.8 THEN 'fact' WHEN truth >= 0.4 THEN 'inferred' ELSE 'uncertain' END AS class, count(*) AS n, count(*) FILTER (WHERE truth >= 0.5) AS n_context, count(*) FILTER (WHERE truth >= 0.4) AS n_propagate FROM tr GROUP BY 1")
def truth_classes(spark, d):
    rows = truths(spark, d)
    return rows.groupBy(confidence.truth_class(F.col("truth"), F.col("grounded")).alias("class")).agg(F.count("*").alias("n"), F.count_if(F.col("truth") >= 0.5).alias("n_context"), F.count_if(F.col("truth") >= 0.4).alias("n_propagate"))


@query("I04_propagation_filter", f"WITH {TRUTH} SELECT kind, count(*) AS n FROM tr WHERE grounded AND truth >= 0.4 GROUP BY 1")
def propagation_filter(spark, d):
    return truth.may_propagate(truths(spark, d).withColumn("depth", F.lit(1))).groupBy("kind").agg(F.count("*").alias("n"))


@query("I05_entity_grounding", "SELECT n.id, count(e.from_id) AS n_evidence, coalesce(CAST(sum(e.weight) AS BIGINT), 0) AS weight, CASE WHEN count(e.from_id) FILTER (WHERE e.confidence IN ('exact','high')) > 0 THEN 'grounded' WHEN count(e.from_id) > 0 THEN 'partial' ELSE 'ungrounded' END AS state FROM nodes n LEFT JOIN edges e ON e.to_id = n.id AND e.kind = 'entity-access' WHERE n.kind = 'entity' GROUP BY n.id")
def entity_grounding(spark, d):
    return truth.entity_grounding(nodes(spark, d), edges(spark, d))


@query("I06_graph_drift", f"""WITH {TRUTH} SELECT 'missing-symbol' AS finding, id AS subject, 0.7::DOUBLE AS severity FROM nodes WHERE kind = 'method' AND NOT is_external AND length(id) % 4 = 0 UNION ALL SELECT 'orphan-symbol', id, 0.8 FROM nodes WHERE kind = 'method' AND NOT is_external AND length(id) % 4 <> 0 AND length(label) % 3 = 0
UNION ALL SELECT 'propagation-overreach', from_id || '>' || to_id, round(0.5 + (weight % 7 - 4) * 0.1, 6) FROM edges WHERE weight % 7 > 4 UNION ALL SELECT 'ungrounded-edge', from_id || '>' || to_id, 0.6 FROM tr WHERE NOT grounded
UNION ALL SELECT 'orphan-entity', id, 0.3 FROM nodes WHERE kind = 'entity' AND id NOT IN (SELECT to_id FROM edges) AND id NOT IN (SELECT from_id FROM edges)""")
def graph_drift(spark, d):
    symbol = F.when(F.length("id") % 4 == 0, "").otherwise(F.concat(F.lit("M:"), "id"))
    own = nodes(spark, d).withColumns({"symbol": symbol, "indexed": F.length("label") % 3 != 0})
    return truth.drift(truths(spark, d).withColumn("depth", (F.col("weight") % 7).cast("int")), own)


KIND = """CASE WHEN kind = 'call' THEN CASE evidence WHEN 'semantic' THEN 'explicit-invocation' WHEN 'semantic-inferred' THEN 'semantic-similarity' WHEN 'syntax' THEN 'control-flow' WHEN 'syntax-pattern' THEN 'semantic-similarity' ELSE 'propagation-inference' END
ELSE CASE kind WHEN 'entity-access' THEN 'data-flow' WHEN 'implements' THEN 'configuration-binding' WHEN 'property-ref' THEN 'configuration-binding' ELSE 'propagation-inference' END END"""
#: Edges of every kind and evidence, by their weight.
MIXED = "mx AS (SELECT from_id, to_id, CASE weight % 4 WHEN 0 THEN 'call' WHEN 1 THEN kind WHEN 2 THEN 'implements' ELSE 'other' END AS kind, CASE weight % 5 WHEN 0 THEN 'semantic-inferred' WHEN 1 THEN 'syntax-pattern' WHEN 2 THEN 'guess' ELSE evidence END AS evidence FROM edges)"


def mixed(spark, d):
    return spark.sql(f"WITH {MIXED.replace('FROM edges', 'FROM {edges}')} SELECT * FROM mx", edges=edges(spark, d))


@query("I08_decay_policy", f"WITH {MIXED}, k AS (SELECT {KIND} AS decay_kind FROM mx) SELECT decay_kind, count(*) AS n, CASE decay_kind WHEN 'direct-symbol-binding' THEN 1.0 WHEN 'explicit-invocation' THEN 0.95 WHEN 'control-flow' THEN 0.92 WHEN 'data-flow' THEN 0.90 WHEN 'inheritance' THEN 0.88 WHEN 'configuration-binding' THEN 0.85 WHEN 'semantic-similarity' THEN 0.75 WHEN 'propagation-inference' THEN 0.60 WHEN 'speculative-expansion' THEN 0.40 ELSE 0.70 END::DOUBLE AS keep FROM k GROUP BY 1")
def decay_policy(spark, d):
    rows = mixed(spark, d).groupBy(traverse.decay_kind(F.col("kind"), F.col("evidence")).alias("decay_kind")).agg(F.count("*").alias("n"))
    return rows.withColumn("keep", traverse.decay(F.col("decay_kind")))


@query("I09_decay_kind", f"WITH {MIXED} SELECT kind, evidence, {KIND} AS decay_kind, count(*) AS n FROM mx GROUP BY 1, 2, 3")
def decay_kind(spark, d):
    return mixed(spark, d).groupBy("kind", "evidence", traverse.decay_kind(F.col("kind"), F.col("evidence")).alias("decay_kind")).agg(F.count("*").alias("n"))


TOP = """vq AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, label AS query_label FROM embeddings WHERE vec_id % 20 = 0),
sc AS (SELECT query_id, vec_id AS chunk_id, round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) AS similarity FROM embeddings, vq),
tk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS INT) AS place FROM sc)"""
GRAPH = "least((CASE WHEN entry_distance BETWEEN 0 AND 2 THEN 0.5 WHEN entry_distance <= 5 THEN 0.25 ELSE 0.0 END + CASE WHEN data_distance BETWEEN 0 AND 1 THEN 0.5 WHEN data_distance <= 3 THEN 0.25 ELSE 0.0 END + CASE WHEN max_fan > 20 THEN 0.3 WHEN max_fan > 5 THEN 0.15 ELSE 0.0 END)::DOUBLE, 1.0)"
SYMBOL = "CASE WHEN n_grounded / n_nodes::DOUBLE >= 0.8 THEN 1.0 WHEN n_grounded / n_nodes::DOUBLE >= 0.5 THEN 0.7 WHEN n_grounded / n_nodes::DOUBLE >= 0.2 THEN 0.4 ELSE 0.1 END::DOUBLE"
FUSED = f"fu AS (SELECT query_id, c.*, similarity, place, round(round(0.35::DOUBLE * (similarity + 1) / 2 + 0.25::DOUBLE * {GRAPH} + 0.15::DOUBLE * {SYMBOL} + 0.05::DOUBLE + 0.1::DOUBLE * least(importance / 20 + 0.15 * is_entry::INT + 0.1 * has_access::INT, 1.0) + 0.05::DOUBLE * (0.4 * is_entry::INT + 0.3 * has_access::INT + CASE WHEN entry_distance BETWEEN 0 AND 2 THEN 0.3 ELSE 0.0 END)::DOUBLE, 9), 4) AS score FROM tk JOIN chunks c USING (chunk_id) WHERE tk.place <= 30 AND confidence >= 0.3)"


def vectors(spark, d):
    rows = table(spark, d, "embeddings")
    queries = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return queries, rows.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))


@query("H01_vector_top_k", f"WITH {TOP} SELECT query_id, chunk_id, similarity, place FROM tk WHERE place <= 10")
def vector_top_k(spark, d):
    return retrieval.vector_top_k(*vectors(spark, d), 10)


@query("H04_evidence_fusion", f"WITH {TOP}, {FUSED} SELECT query_id, chunk_id, score FROM fu")
def evidence_fusion(spark, d):
    rows = retrieval.scored(retrieval.vector_top_k(*vectors(spark, d), 30), view(spark, d, "chunks"))
    return rows.select("query_id", "chunk_id", "score")


@query("H02_hybrid_search", f"""WITH {TOP}, {FUSED}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM fu), t AS (SELECT query_id, chunk_id, score, table_name FROM b WHERE r <= 10),
m AS (SELECT x.query_id, c.chunk_id, c.table_name, round(c.importance / 10 * 0.5, 4) AS score, row_number() OVER (PARTITION BY x.query_id ORDER BY c.table_name, c.chunk_id) AS r FROM (SELECT DISTINCT query_id, table_name FROM t) x JOIN chunks c ON c.table_name = x.table_name WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.query_id = x.query_id AND t.chunk_id = c.chunk_id)),
u AS (SELECT query_id, chunk_id, score FROM t UNION ALL SELECT query_id, chunk_id, score FROM m WHERE r <= 10), w AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS place FROM u)
SELECT query_id, chunk_id, place FROM w WHERE place <= 10""")
def hybrid_search(spark, d):
    return retrieval.hybrid(*vectors(spark, d), view(spark, d, "chunks")).select("query_id", "chunk_id", "place")


@query("H03_expansion", f"""WITH {TOP} SELECT tk.query_id, c.chunk_id, min(c.table_name) AS table_name FROM tk JOIN chunks o ON o.chunk_id = tk.chunk_id JOIN chunks c ON c.table_name = o.table_name
WHERE tk.place <= 3 AND NOT EXISTS (SELECT 1 FROM tk z WHERE z.query_id = tk.query_id AND z.chunk_id = c.chunk_id AND z.place <= 3) GROUP BY 1, 2""")
def expansion(spark, d):
    chunks = view(spark, d, "chunks").select("chunk_id", "table_name")
    top = retrieval.vector_top_k(*vectors(spark, d), 3).select("query_id", "chunk_id")
    tables = top.join(chunks, "chunk_id").select("query_id", "table_name").distinct()
    return tables.join(chunks, "table_name").join(top, ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id", "table_name")


@query("H05_linear_fusion", f"WITH {TOP} SELECT query_id, chunk_id, round(round(0.35::DOUBLE * similarity + 0.25::DOUBLE * {GRAPH} + 0.2::DOUBLE * (0.5 * is_entry::INT + 0.5 * has_access::INT) + 0.2::DOUBLE * importance / 10, 9), 4) AS score FROM tk JOIN chunks USING (chunk_id) WHERE place <= 10")
def linear_fusion(spark, d):
    return retrieval.linear(retrieval.vector_top_k(*vectors(spark, d), 10), view(spark, d, "chunks"))


@query("H06_running_grounded", f"WITH {TOP}, g AS (SELECT query_id, chunk_id, place, sum(n_grounded) OVER w AS a, sum(n_nodes) OVER w AS b FROM tk JOIN chunks USING (chunk_id) WHERE place <= 10 WINDOW w AS (PARTITION BY query_id ORDER BY place)) SELECT query_id, chunk_id, place, CAST(a AS BIGINT) AS grounded_so_far, CASE WHEN a / b::DOUBLE >= 0.8 THEN 'semantic' WHEN a / b::DOUBLE >= 0.5 THEN 'analyzer' ELSE 'pattern' END AS evidence FROM g")
def running_grounded(spark, d):
    return retrieval.running_grounded(retrieval.vector_top_k(*vectors(spark, d), 10), view(spark, d, "chunks"))


@query("H07_graph_aware_ranking", f"WITH {TOP}, {FUSED} SELECT query_id, chunk_id, round(0.25::DOUBLE * score + 0.15::DOUBLE * CASE WHEN entry_distance BETWEEN 0 AND 2 THEN 1.0 WHEN entry_distance <= 5 THEN 0.5 ELSE 0.2 END + 0.2::DOUBLE * {SYMBOL} + 0.075::DOUBLE + 0.15::DOUBLE * CASE WHEN n_grounded > 0 THEN 1.0 ELSE 0.3 END + 0.1::DOUBLE * CASE WHEN max_fan > 30 THEN 1.0 WHEN max_fan > 15 THEN 0.7 WHEN max_fan > 5 THEN 0.4 ELSE 0.1 END, 6) AS composite FROM fu")
def graph_aware(spark, d):
    rows = retrieval.scored(retrieval.vector_top_k(*vectors(spark, d), 30), view(spark, d, "chunks"))
    return retrieval.graph_aware(rows)


WORDS = "wq AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 1)) AS words FROM benchmark UNION ALL SELECT -1, ['supplier', 'find', 'nation', 'loadnation', 'brand'])"
KEYWORD = f"""{WORDS}, pool AS (SELECT id, method_name, class_name, lower(method_name) AS m, lower(class_name) AS c FROM nodes WHERE NOT (starts_with(class_name, 'Base') AND regexp_matches(class_name, 'BLL|DAO|Dao|NHB') OR class_name = 'HibernateDaoSupport') ORDER BY id LIMIT 500), ww AS (SELECT query_id, unnest(words) AS w, len(words) AS total FROM wq),
kw AS (SELECT query_id, id, round(least(sum(CASE WHEN m = w THEN 1.0 WHEN contains(m, w) THEN 0.6 ELSE 0.4 END::DOUBLE) / any_value(total), 1.0), 6) AS score FROM ww JOIN pool ON contains(m, w) OR contains(c, w) GROUP BY 1, 2)"""


def questions(spark, d):
    more = spark.createDataFrame([(-1, "Supplier, find: nation loadnation brand")], "query_id bigint, text string")
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text").unionByName(more)


@query("H10_keyword_scores", f"WITH {KEYWORD} SELECT query_id, id, score FROM kw")
def keyword_scores(spark, d):
    return retrieval.keyword_scores(questions(spark, d), nodes(spark, d))


@query("H13_noise_rescoring", f"""WITH {KEYWORD}, r AS (SELECT kw.*, n.method_name, n.class_name, wq.words FROM kw JOIN nodes n USING (id) JOIN wq USING (query_id)),
p AS (SELECT query_id, id, round(score * (1 - least((CASE WHEN method_name IN ('Save','Update','Delete','Remove','Get','Load','LoadAll','Flush','Evict','Find') AND NOT list_contains(words, lower(method_name)) THEN 0.3 ELSE 0.0 END + CASE WHEN regexp_matches(class_name, '^Base.*(BLL|DAO|Dao|NHB)') THEN 0.4 ELSE 0.0 END + CASE WHEN length(method_name) <= 5 OR regexp_matches(method_name, '^[a-z0-9]+$') THEN 0.15 ELSE 0.0 END)::DOUBLE, 0.7)), 6) AS adjusted, CASE WHEN len(list_filter(words, lambda w: starts_with(lower(class_name), w))) > 0 THEN 0.15 ELSE 0.0 END::DOUBLE AS bonus FROM r),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, id) AS INT) AS place FROM p) SELECT * FROM o WHERE place <= 10""")
def noise_rescoring(spark, d):
    return retrieval.rescored(with_words(spark, d))


def with_words(spark, d):
    words = questions(spark, d).select("query_id", retrieval.split_words("text").alias("words"))
    return keyword_scores(spark, d).join(nodes(spark, d).select("id", "method_name", "class_name"), "id").join(words, "query_id")


@query("H14_noise_report", f"""WITH {KEYWORD}, r AS (SELECT n.method_name, n.class_name, wq.words FROM kw JOIN nodes n USING (id) JOIN wq USING (query_id)) SELECT 'LowBusinessContext' AS rule, count(*) AS n, round(count(*) * 0.15::DOUBLE, 6) AS total FROM r WHERE length(method_name) <= 5 OR regexp_matches(method_name, '^[a-z0-9]+$') HAVING count(*) > 0""")
def noise_report(spark, d):
    return retrieval.noise_report(with_words(spark, d))


@query("H14_noise_by_class", f"""WITH {KEYWORD}, r AS (SELECT n.method_name, n.class_name, wq.words FROM kw JOIN nodes n USING (id) JOIN wq USING (query_id)), x AS (SELECT 'LowBusinessContext' AS rule, class_name, count(*) AS n, round(count(*) * 0.15::DOUBLE, 6) AS total FROM r WHERE length(method_name) <= 5 OR regexp_matches(method_name, '^[a-z0-9]+$') GROUP BY 2
UNION ALL SELECT 'GenericCRUD', class_name, count(*), round(count(*) * 0.3::DOUBLE, 6) FROM r WHERE method_name IN ('Save','Update','Delete','Remove','Get','Load','LoadAll','Flush','Evict','Find') AND NOT list_contains(words, lower(method_name)) GROUP BY 2) SELECT rule, class_name, n, total FROM x QUALIFY row_number() OVER (PARTITION BY rule ORDER BY n DESC, class_name) <= 10""")
def noise_by_class(spark, d):
    return retrieval.noise_report(with_words(spark, d), "class_name")


INDEX = "ix AS (SELECT DISTINCT 'table' AS category, n.table_name AS key, e.from_id AS id FROM edges e JOIN nodes n ON n.id = e.to_id WHERE e.kind = 'entity-access' UNION SELECT DISTINCT 'http', regexp_extract(url, '//([^/]*)', 1), 'page:' || CAST(page_id AS STRING) FROM pages)"
FOUND = f"{INDEX}, ks AS (SELECT query_id, id, max(CASE category WHEN 'table' THEN 1.0 ELSE 0.6 END::DOUBLE) AS score FROM (SELECT query_id, unnest(words) AS w FROM wq) JOIN ix ON contains(lower(key), w) OR contains(w, lower(key)) GROUP BY 1, 2)"


def by_index(spark, d):
    """(query_id, id, score): what the tables that repositories use and the hosts of pages have in common with a question's words."""
    from ..operators import text

    names = nodes(spark, d).filter("table_name is not null").select(F.col("id").alias("to_id"), F.col("table_name").alias("key"))
    tables = edges(spark, d).filter("kind = 'entity-access'").join(names, "to_id").select(F.lit("table").alias("category"), "key", F.col("from_id").alias("id"))
    hosts = table(spark, d, "pages").select(F.lit("http").alias("category"), F.regexp_extract("url", "//([^/]*)", 1).alias("key"), F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("id"))
    return text.search_index(tables.unionByName(hosts).distinct(), questions(spark, d).select("query_id", F.explode(retrieval.split_words("text")).alias("word")))


@query("H11_reverse_index", f"WITH {WORDS}, {FOUND} SELECT query_id, id, score FROM ks")
def reverse_index(spark, d):
    return by_index(spark, d)


@query("H09_three_way_search", f"""WITH {KEYWORD}, {TOP}, {FOUND}, v AS (SELECT query_id, 'supplier:' || CAST(chunk_id + 1 AS STRING) AS id, similarity AS s FROM tk WHERE place <= 20), g AS (SELECT query_id, id, score AS s FROM kw), k AS (SELECT query_id, id, score AS s FROM ks)
SELECT query_id, id, round(0.6 * coalesce(v.s, 0) + 0.3 * coalesce(g.s, 0) + 0.1 * coalesce(k.s, 0), 6) AS score FROM v FULL JOIN g USING (query_id, id) FULL JOIN k USING (query_id, id)""")
def three_way_search(spark, d):
    q, v = vectors(spark, d)
    top = retrieval.vector_top_k(q, v, 20)
    by_vector = top.select("query_id", F.concat(F.lit("supplier:"), (F.col("chunk_id") + 1).cast("string")).alias("id"), F.col("similarity").alias("s"))
    by_graph = keyword_scores(spark, d).select("query_id", "id", F.col("score").alias("s"))
    return retrieval.merged(by_vector, by_graph, by_index(spark, d).withColumnRenamed("score", "s"))


@query("H12_profiles", "SELECT * FROM (VALUES ('Database', 0.2::DOUBLE, 0.1::DOUBLE, 0.7::DOUBLE), ('DTO', 0.4, 0.2, 0.4), ('Exception', 0.3, 0.2, 0.5), ('HTTP', 0.3, 0.3, 0.4), ('Architecture', 0.3, 0.6, 0.1), ('BugAnalysis', 0.5, 0.4, 0.1), ('CodeModification', 0.6, 0.3, 0.1), ('BusinessWorkflow', 0.4, 0.4, 0.2)) t(profile, embedding, graph, keyword)")
def profiles(spark, d):
    from ..functions.fusion import PROFILES

    return spark.createDataFrame([(k, *v) for k, v in PROFILES.items()], "profile string, embedding double, graph double, keyword double")


LOCATED = """ln AS (SELECT id, label, method_name, class_name, class_name || '.cs' AS source_file FROM nodes WHERE NOT is_external AND class_name <> ''),
l1 AS (SELECT 'exact' AS asked, id, 1 AS tier, row_number() OVER (ORDER BY label, id) AS place FROM ln WHERE method_name = 'LoadNATION_7'), l2 AS (SELECT 'file' AS asked, min(id) AS id, 2 AS tier, 1 AS place FROM ln WHERE lower(source_file) LIKE '%nationservice.cs' AND lower(method_name) = 'loadnation_8' HAVING count(*) > 0),
l3 AS (SELECT 'vector' AS asked, 'supplier:' || CAST(chunk_id + 1 AS STRING) AS id, 3 AS tier, place FROM tk WHERE query_id = 0 AND 'supplier:' || CAST(chunk_id + 1 AS STRING) IN (SELECT id FROM ln) AND place <= 15),
l4 AS (SELECT 'words' AS asked, id, 4 AS tier, row_number() OVER (ORDER BY s DESC, label, id) AS place FROM (SELECT id, label, sum(CASE WHEN lower(method_name) = w THEN 5 WHEN contains(lower(method_name), w) THEN 3 ELSE 0 END + CASE WHEN contains(lower(class_name), w) THEN 2 ELSE 0 END + CASE WHEN contains(lower(label), w) THEN 1 ELSE 0 END) AS s FROM ln CROSS JOIN (VALUES ('supplier'), ('loadnation_1'), ('find')) x(w) GROUP BY 1, 2) WHERE s > 0)"""


@query("H15_symbol_locator", f"WITH {TOP}, {LOCATED} SELECT asked, id, tier, CAST(place AS INT) AS place FROM (SELECT * FROM l1 WHERE place <= 10 UNION ALL SELECT * FROM l2 UNION ALL SELECT asked, id, tier, row_number() OVER (ORDER BY place) FROM l3 UNION ALL SELECT * FROM l4) WHERE place <= 10")
def symbol_locator(spark, d):
    own = nodes(spark, d).withColumn("source_file", F.when(F.col("class_name") != "", F.concat("class_name", F.lit(".cs"))))
    near = retrieval.vector_top_k(*vectors(spark, d), 15).filter("query_id = 0").select(F.concat(F.lit("supplier:"), (F.col("chunk_id") + 1).cast("string")).alias("id"), "place")
    found = {
        "exact": retrieval.locate(own, "LoadNATION_7"),
        "file": retrieval.locate(own, "loadnation_8", "NationService.cs"),
        "vector": retrieval.locate(own, "nowhere", by_vector=near),
        "words": retrieval.locate(own, question="Supplier loadnation_1 find"),
    }
    rows = [df.select(F.lit(name).alias("asked"), "id", "tier", "place") for name, df in found.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("I11_claim_validation", """WITH c AS (SELECT s.statement_id, n.id AS node, s.claim, s.score, (SELECT count(*) FROM evidence v WHERE v.statement_id = s.statement_id) AS n_evidence FROM statements s LEFT JOIN nodes n ON n.id = 'supplier:' || split_part(s.subject_id, ':', 2)),
f AS (SELECT statement_id, node IS NULL AS no_subject, n_evidence = 0 AS no_evidence, regexp_matches(claim, 'inferred from|primary workflow|probable pattern') AS forbidden, score FROM c)
SELECT statement_id, CAST(no_subject::INT + no_evidence::INT + forbidden::INT AS INT) AS n_failures, CAST(CASE WHEN no_subject THEN 3 WHEN forbidden THEN 3 WHEN no_evidence THEN 2 WHEN score >= 0.6 THEN 0 ELSE 1 END AS INT) AS class FROM f""")
def claim_validation(spark, d):
    return truth.claims(claim_rows(spark, d), view(spark, d, "evidence"), nodes(spark, d)).select("statement_id", "n_failures", "class")


def claim_rows(spark, d):
    return view(spark, d, "statements").withColumn("subject", F.concat(F.lit("supplier:"), F.split_part("subject_id", F.lit(":"), F.lit(2))))


@query("I12_classification_counts", """WITH c AS (SELECT s.statement_id, n.id AS node, s.claim, s.score, (SELECT count(*) FROM evidence v WHERE v.statement_id = s.statement_id) AS n_evidence FROM statements s LEFT JOIN nodes n ON n.id = 'supplier:' || split_part(s.subject_id, ':', 2))
SELECT CAST(CASE WHEN node IS NULL OR regexp_matches(claim, 'inferred from|primary workflow|probable pattern') THEN 3 WHEN n_evidence = 0 THEN 2 WHEN score >= 0.6 THEN 0 ELSE 1 END AS INT) AS class, count(*) AS n FROM c GROUP BY 1""")
def classification_counts(spark, d):
    return truth.claims(claim_rows(spark, d), view(spark, d, "evidence"), nodes(spark, d)).groupBy("class").agg(F.count("*").alias("n"))


@query("I12_combined", """WITH e AS (SELECT statement_id, min(CASE WHEN score <= 0.3 THEN 3 WHEN score >= 0.8 AND symbol <> '' THEN 0 WHEN score >= 0.4 AND score < 0.8 THEN 1 ELSE 2 END) AS best FROM evidence GROUP BY 1) SELECT statement_id, CAST(coalesce(best, 3) AS INT) AS class FROM statements LEFT JOIN e USING (statement_id)""")
def combined(spark, d):
    return truth.combined(view(spark, d, "statements"), view(spark, d, "evidence"))


@query("I13_block_decision", """WITH v AS (SELECT statement_id, count(*) AS n, count(DISTINCT source_file) AS files, count(DISTINCT symbol) AS symbols FROM evidence GROUP BY 1), c AS (SELECT s.statement_id, n.id IS NULL AS lost, coalesce(v.n, 0) AS n, coalesce(files, 0) AS files, coalesce(symbols, 0) AS symbols, regexp_matches(claim, 'inferred from|primary workflow|probable pattern') AS forbidden, regexp_matches(claim, 'primary workflow') AS abstract
FROM statements s LEFT JOIN nodes n ON n.id = 'supplier:' || split_part(s.subject_id, ':', 2) LEFT JOIN v USING (statement_id)), r AS (SELECT statement_id, concat_ws(',', CASE WHEN lost OR forbidden THEN 'hallucinated' END, CASE WHEN n < 1 THEN 'edges' END, CASE WHEN files < 1 THEN 'files' END, CASE WHEN symbols = 0 THEN 'symbol' END, CASE WHEN lost THEN 'graph' END, CASE WHEN n = 0 THEN 'provenance' END,
CASE WHEN forbidden THEN 'forbidden' END, CASE WHEN n = 0 AND files = 0 AND symbols = 0 THEN 'nothing' END, CASE WHEN abstract THEN 'abstraction' END) AS reasons FROM c) SELECT statement_id, reasons, reasons <> '' AS blocked FROM r""")
def block_decision(spark, d):
    return truth.blocked(truth.claims(claim_rows(spark, d), view(spark, d, "evidence"), nodes(spark, d)))
