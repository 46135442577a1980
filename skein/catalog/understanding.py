"""Understanding questions, and lexical and three-way retrieval (operators known from descriptions only)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fusion, text
from ..operators import retrieval
from ..operators import understanding as u
from ..plans.fixture import edges, nodes, view
from ..registry import query
from ..session import table
from .metrics import GRAPH, TOP, vectors

VOCABULARY = """vb AS (SELECT 'entity' AS kind, class_name AS term FROM nodes WHERE kind = 'entity' UNION SELECT 'table', table_name FROM nodes WHERE table_name IS NOT NULL UNION SELECT 'route', route FROM nodes WHERE route IS NOT NULL
UNION SELECT 'class', class_name FROM nodes WHERE kind = 'method' UNION SELECT 'method', method_name FROM nodes WHERE kind = 'method' AND method_name <> '' UNION SELECT 'normalized', unnest(string_split(namespace, '.')) FROM nodes)"""
ASKED = "(VALUES (1, 'supplier'), (1, 'brand'), (2, 'loadnation_3'), (2, 'region'), (3, 'zzz')) aw(query_id, word)"
EXPANDED = f"""{VOCABULARY}, xp AS (SELECT query_id, word, term, max(CASE WHEN lower(term) = word THEN 1.0 WHEN starts_with(lower(term), word) OR starts_with(word, lower(term)) THEN 0.7 ELSE 0.5 END::DOUBLE) AS score
FROM {ASKED} JOIN (SELECT DISTINCT term FROM vb) ON contains(lower(term), word) OR starts_with(word, lower(term)) GROUP BY 1, 2, 3)"""


def asked(spark):
    return spark.createDataFrame([(1, "supplier"), (1, "brand"), (2, "loadnation_3"), (2, "region"), (3, "zzz")], "query_id int, word string")


@query("U01_intents", """SELECT * FROM (VALUES ('which table holds data', 'EntityLookup'), ('trace the call path', 'FlowAnalysis'), ('what does a change affect', 'ImpactAnalysis'), ('api route of the table', 'RouteLookup'), ('verify the business rule', 'ValidationLookup'), ('hello', 'EntityLookup')) t(question, intent)""")
def intents(spark, d):
    rows = spark.createDataFrame([(x,) for x in ("which table holds data", "trace the call path", "what does a change affect", "api route of the table", "verify the business rule", "hello")], "question string")
    return rows.select("question", u.intent(u.tokens(F.col("question"))).alias("intent"))


@query("U02_vocabulary", f"WITH {VOCABULARY} SELECT kind, term FROM vb")
def vocabulary(spark, d):
    return u.vocabulary(nodes(spark, d))


ALIASES = """al AS (SELECT 'table:' || table_name AS a, 'entity:' || class_name AS b FROM nodes WHERE kind = 'entity' UNION SELECT 'entity:' || y.class_name, 'class:' || x.class_name FROM edges e JOIN nodes x ON x.id = e.from_id JOIN nodes y ON y.id = e.to_id WHERE e.kind = 'entity-access'
UNION SELECT 'class:' || class_name, 'route:' || route FROM nodes WHERE route IS NOT NULL), bo AS (SELECT a, b FROM al UNION SELECT b, a FROM al)"""


@query("U03_alias_expansion", f"WITH {ALIASES}, one AS (SELECT a AS start, b AS id, 1 AS d FROM bo WHERE starts_with(a, 'table:')), two AS (SELECT one.start, bo.b AS id, 2 AS d FROM bo JOIN one ON bo.a = one.id) SELECT start, id, CAST(min(d) AS INT) AS distance FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE id <> start GROUP BY 1, 2")
def alias_expansion(spark, d):
    links = u.aliases(nodes(spark, d), edges(spark, d))
    return u.expand_aliases(links, links.filter("from_id like 'table:%'").select(F.col("from_id").alias("id")))


@query("U04_tokens", "SELECT * FROM (VALUES ('GetListBySpecialtyID', 'by,get,id,list,specialty'), ('/api/reagent-flow/x', 'api,flow,reagent,x'), ('EquipGrRel', 'equip,group,relation'), ('orderSvc', 'order,service')) t(name, tokens)")
def tokens(spark, d):
    rows = spark.createDataFrame([(x,) for x in ("GetListBySpecialtyID", "/api/reagent-flow/x", "EquipGrRel", "orderSvc")], "name string")
    return rows.select("name", F.array_join(u.tokens(F.col("name")), ",").alias("tokens"))


@query("U05_expansions", f"WITH {EXPANDED} SELECT * FROM xp")
def expansions(spark, d):
    return u.expansions(asked(spark), u.vocabulary(nodes(spark, d)))


@query("U06_rewritten", f"WITH {EXPANDED}, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, word ORDER BY score DESC, term) AS r FROM xp WHERE score >= 0.6) SELECT query_id, string_agg(term, ' ' ORDER BY word, r) AS expanded FROM rk WHERE r <= 3 GROUP BY 1")
def rewritten(spark, d):
    return u.rewritten(expansions(spark, d))


@query("U07_explained", f"WITH {EXPANDED} SELECT query_id, kind, count(DISTINCT xp.term) AS n, round(avg(score), 6) AS confidence FROM xp JOIN vb ON vb.term = xp.term GROUP BY 1, 2")
def explained(spark, d):
    return u.explained(expansions(spark, d), u.vocabulary(nodes(spark, d)))


WORDS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 1)"
BM25 = f"""dw AS (SELECT doc_id, len({WORDS}) AS length, unnest({WORDS}) AS word FROM documents), qw AS (SELECT DISTINCT item_id AS query_id, unnest({WORDS}) AS word FROM benchmark),
ht AS (SELECT doc_id, length, word, count(*) AS tf FROM dw WHERE word IN (SELECT word FROM qw) GROUP BY 1, 2, 3), fq AS (SELECT word, count(*) AS df FROM ht GROUP BY 1), sz AS (SELECT count(*) AS n, avg(len({WORDS})) AS mean FROM documents),
wt AS (SELECT doc_id, ht.word, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * length / mean)) AS w FROM ht JOIN fq USING (word), sz),
bm AS (SELECT query_id, doc_id, round(sum(w), 6) AS score FROM qw JOIN wt USING (word) GROUP BY 1, 2), bp AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS place FROM bm)"""


def word_lists(df):
    return df.withColumn("words", F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: F.length(w) > 1))


def lexical(spark, d):
    queries = word_lists(table(spark, d, "benchmark")).select(F.col("item_id").alias("query_id"), F.explode("words").alias("word"))
    return u.bm25(queries, word_lists(table(spark, d, "documents")).select("doc_id", "words"))


@query("U08_bm25", f"WITH {BM25} SELECT query_id, doc_id, score, place FROM bp WHERE place <= 10")
def bm25(spark, d):
    return lexical(spark, d)


@query("U09_three_way", f"""WITH {TOP}, {BM25}, ds AS (SELECT query_id, chunk_id AS id, similarity AS s FROM tk WHERE place <= 10), lx AS (SELECT query_id, doc_id AS id, score / max(score) OVER (PARTITION BY query_id) AS s FROM bp WHERE place <= 10),
gr AS (SELECT DISTINCT tk.query_id, c.chunk_id AS id, {GRAPH} AS s FROM tk JOIN chunks o ON o.chunk_id = tk.chunk_id JOIN chunks c ON c.table_name = o.table_name WHERE tk.place <= 3)
SELECT query_id, id, round(0.4 * coalesce(ds.s, 0) + 0.3 * coalesce(lx.s, 0) + 0.3 * coalesce(gr.s, 0), 6) AS score FROM ds FULL JOIN lx USING (query_id, id) FULL JOIN gr USING (query_id, id)""".replace("entry_distance", "c.entry_distance").replace("data_distance", "c.data_distance").replace("max_fan", "c.max_fan"))
def three_way(spark, d):
    top = retrieval.vector_top_k(*vectors(spark, d), 10)
    dense = top.select("query_id", F.col("chunk_id").alias("id"), F.col("similarity").alias("s"))
    words = lexical(spark, d).select("query_id", F.col("doc_id").alias("id"), F.col("score").alias("s"))
    chunks = view(spark, d, "chunks")
    tables = top.filter("place <= 3").select("query_id", "chunk_id").join(chunks.select("chunk_id", "table_name"), "chunk_id").select("query_id", "table_name").distinct()
    near = fusion.graph_score(F.col("entry_distance"), F.col("data_distance"), F.col("max_fan"))
    graph = tables.join(chunks.select("table_name", F.col("chunk_id").alias("id"), near.alias("s")), "table_name").drop("table_name")
    return u.three_way(dense, words, graph)


@query("U10_verdicts", """WITH c AS (SELECT s.subject_id, count(*) AS total, count(*) FILTER (WHERE score >= 0.6) AS grounded, count(*) FILTER (WHERE suppressed) AS conflicts FROM statements s GROUP BY 1)
SELECT subject_id, CASE WHEN conflicts > 0 THEN 'CompetingHypothesesPresent' WHEN grounded / total::DOUBLE >= 0.8 THEN 'StronglyGrounded' WHEN grounded / total::DOUBLE >= 0.5 THEN 'PartiallyVerified' ELSE 'LimitedEvidence' END AS verdict FROM c""")
def verdicts(spark, d):
    rows = view(spark, d, "statements").groupBy("subject_id").agg(F.count("*").alias("total"), F.count_if(F.col("score") >= 0.6).alias("grounded"), F.count_if("suppressed").alias("conflicts"))
    return rows.select("subject_id", u.verdict(F.col("grounded"), F.col("total"), F.col("conflicts")).alias("verdict"))


@query("U11_self_scores", """WITH c AS (SELECT subject_id, avg((score >= 0.6)::INT) AS g, avg((hop > 0)::INT) AS c, avg(score) AS k, avg((NOT speculative_ancestor)::INT) AS h, avg((NOT suppressed)::INT) AS u FROM statements GROUP BY 1), s AS (SELECT subject_id, round(0.3 * g + 0.25 * c + 0.2 * k + 0.1 * h + 0.15 * u, 6) AS score FROM c)
SELECT subject_id, score, CASE WHEN score >= 0.8 THEN 'Approved' WHEN score >= 0.6 THEN 'Qualified' WHEN score >= 0.4 THEN 'NeedsReview' ELSE 'Rejected' END AS state FROM s""")
def self_scores(spark, d):
    share = lambda c: F.avg(c.cast("int"))
    rows = view(spark, d, "statements").groupBy("subject_id").agg(
        share(F.col("score") >= 0.6).alias("grounding"), share(F.col("hop") > 0).alias("coverage"), F.avg("score").alias("calibration"),
        share(~F.col("speculative_ancestor")).alias("hypotheses"), share(~F.col("suppressed")).alias("usability"),
    )
    return u.self_score(rows).select("subject_id", "score", "state")


@query("S07_entity_parts", "SELECT id, split_part(id, ':', 1) AS kind, split_part(id, ':', 2) AS name FROM nodes")
def entity_parts(spark, d):
    parts = F.split("id", ":", 2)
    return nodes(spark, d).select("id", F.get(parts, F.lit(0)).alias("kind"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("name"))


TYPES = "ty AS (SELECT DISTINCT argument AS name FROM bases UNION SELECT base_name FROM bases UNION SELECT class_name || 'Exception' FROM methods UNION SELECT class_name || 'EventArgs' FROM methods UNION SELECT class_name FROM methods UNION SELECT argument || 'Handler' FROM bases UNION SELECT 'Guid' FROM bases)"
PLAIN = "name IN ('int','string','bool','long','double','float','object','void','decimal','DateTime','Guid','byte','T','TEntity','TKey','TValue')"


@query("S11_entity_types", f"""WITH {TYPES} SELECT name, regexp_matches(name, '^[A-Z]') AND NOT {PLAIN} AND NOT regexp_matches(name, '^T\\d*$') AND NOT regexp_matches(name, '(Exception|Attribute|EventArgs|Delegate)$') AS resolver,
regexp_matches(name, '^[A-Z]') AND NOT {PLAIN} AND name <> 'T1' AND NOT regexp_matches(name, '(Exception|Attribute|EventArgs|Delegate|Handler|Controller|Service)$') AND length(name) >= 3 AND NOT starts_with(name, 'I') AS registry,
regexp_matches(name, '^[A-Z]') AND NOT {PLAIN} AND NOT regexp_matches(name, '^T\\d*$') AND NOT regexp_matches(name, '(Exception|Attribute|Service|BLL|Dao)$') AND length(name) >= 3 AND NOT starts_with(name, 'I') AS field FROM ty""")
def entity_types(spark, d):
    sql = TYPES.replace("FROM bases", "FROM {bases}").replace("FROM methods", "FROM {methods}")
    rows = spark.sql(f"WITH {sql} SELECT name FROM ty", bases=view(spark, d, "bases"), methods=view(spark, d, "methods"))
    return rows.select("name", *[text.entity_type(F.col("name"), test).alias(test) for test in ("resolver", "registry", "field")])


@query("G08_chunk_importance", """WITH c AS (SELECT n.id, CASE WHEN entry_point THEN 'route' WHEN kind = 'entity' THEN 'entity' ELSE 'method' END AS chunk_kind, kind = 'entity' OR id IN (SELECT from_id FROM edges WHERE kind = 'entity-access') AS has_entity, route IS NOT NULL AS has_route, entry_point, (SELECT count(DISTINCT from_id) FROM edges e WHERE e.to_id = n.id) AS callers FROM nodes n),
i AS (SELECT chunk_kind, least(CASE chunk_kind WHEN 'route' THEN 5.0 WHEN 'entity' THEN 4.0 ELSE 1.0 END + CASE WHEN has_entity THEN 2.0 ELSE 0.0 END + CASE WHEN has_route THEN 3.0 ELSE 0.0 END + CASE WHEN entry_point THEN 2.0 ELSE 0.0 END + least(0.5 * callers, 3.0), 10.0)::DOUBLE AS importance FROM c) SELECT chunk_kind, count(*) AS n, round(avg(importance), 4) AS importance FROM i GROUP BY 1""")
def chunk_importance(spark, d):
    from ..operators import text as chunks
    from ..operators.metrics import degrees

    n, e = nodes(spark, d), edges(spark, d)
    rows = n.join(degrees(n, e), "id").join(chunks.accessing(e), "id", "left").na.fill(False, ["has_entity"])
    kind = F.when(F.col("entry_point"), "route").when(F.col("kind") == "entity", "entity").otherwise("method")
    base = F.coalesce(*[F.when(kind == k, v) for k, v in chunks.BASES.items()])
    value = chunks.chunk_importance(base, F.col("has_entity") | (F.col("kind") == "entity"), F.col("route").isNotNull(), F.col("entry_point"), F.col("n_callers"))
    return rows.groupBy(kind.alias("chunk_kind")).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("importance"))


@query("J08_temporal_conflicts", "SELECT statement_id AS a, statement_id AS b FROM statements WHERE false")
def temporal_conflicts(spark, d):
    """No statement carries a time, so there are none."""
    s = view(spark, d, "statements").limit(0)
    return s.select(F.col("statement_id").alias("a"), F.col("statement_id").alias("b"))


@query("K07_risk_levels", "SELECT statement_id, round(greatest(0.0, least(1.0, 1 - score + least(0.1 * hop, 0.4) + CASE WHEN speculative_ancestor THEN 0.2 ELSE 0.0 END)), 6) AS risk FROM statements")
def risk_levels(spark, d):
    from ..operators.cognition import risk

    return view(spark, d, "statements").select("statement_id", F.round(risk(F.col("score"), F.col("hop"), F.col("speculative_ancestor"), F.lit(0.0)), 6).alias("risk"))


@query("K17_root_causes", """WITH c AS (SELECT n.id, n.is_external, (SELECT count(DISTINCT e.from_id) FROM edges e WHERE e.to_id = n.id) AS callers, (SELECT count(DISTINCT e.to_id) FROM edges e WHERE e.from_id = n.id) AS callees FROM nodes n)
SELECT id, concat_ws(',', CASE WHEN callees > 5 THEN 'fan-out' END, CASE WHEN callers > 5 THEN 'shared' END, CASE WHEN is_external THEN 'external' END) AS causes FROM c WHERE callees > 5 OR callers > 5 OR is_external""")
def root_causes(spark, d):
    from ..operators.metrics import degrees

    n = nodes(spark, d)
    rows = degrees(n, edges(spark, d)).join(n.select("id", "is_external"), "id")
    causes = F.concat_ws(",", F.when(F.col("n_callees") > 5, "fan-out"), F.when(F.col("n_callers") > 5, "shared"), F.when(F.col("is_external"), "external"))
    return rows.select("id", causes.alias("causes")).filter("causes <> ''")
