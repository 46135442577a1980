"""Text functions, chunks, documents and embeddings (families S, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import confidence
from ..functions import fusion
from ..functions import text as t
from ..operators import metrics, text
from ..plans.fixture import edges, nodes, view
from ..registry import query
from ..session import table
from .graph import IMPACT, impact
from .metrics import DEGREE


@query("S01_method_ids", "SELECT id, 'method:' || project_name || '::' || namespace || '.' || class_name || '.' || method_name || '()' AS method_id, lower(trim(replace(' C:\\App\\' || project_name || ' ', '\\', '/'))) AS path FROM nodes WHERE NOT is_external")
def method_ids(spark, d):
    n = nodes(spark, d).filter("not is_external")
    name = t.qualified_name(F.col("namespace"), F.col("class_name"), F.col("method_name"), F.array().cast("array<string>"))
    return n.select("id", t.method_id(F.col("project_name"), name).alias("method_id"), t.project_path(F.concat(F.lit(" C:\\App\\"), "project_name", F.lit(" "))).alias("path"))


@query("S02_qualified_names", "SELECT id, concat_ws('.', nullif(namespace, ''), nullif(class_name, ''), method_name) || '(int, string)' AS name FROM nodes WHERE kind = 'method'")
def qualified_names(spark, d):
    return nodes(spark, d).filter("kind = 'method'").select("id", t.qualified_name(F.col("namespace"), F.col("class_name"), F.col("method_name"), F.array(F.lit("int"), F.lit("string"))).alias("name"))


@query("S03_handles", "SELECT vec_id, substr(h, 1, 1) AS kind, split_part(h, ':', 2) AS doc FROM (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'M:' WHEN 1 THEN 'T:' ELSE 'P:' END || 'doc' || vec_id AS h FROM embeddings)")
def handles(spark, d):
    h = F.concat(F.element_at(F.array(F.lit("asm|M:"), F.lit("asm|T:"), F.lit("asm|P:")), (F.col("vec_id") % 3 + 1).cast("int")), F.lit("doc"), F.col("vec_id").cast("string"))
    doc = F.substring_index(h, "|", -1)
    return table(spark, d, "embeddings").select("vec_id", F.substr(doc, F.lit(1), F.lit(1)).alias("kind"), F.substring_index(doc, ":", -1).alias("doc"))


@query("S04_short_ids", "SELECT id, string_split(id, '::')[-1] AS short FROM units")
def short_ids(spark, d):
    return view(spark, d, "units").select("id", t.short_id(F.col("id")).alias("short"))


@query("S05_called_names", "SELECT id, string_split(string_split(string_split(content, '(')[1], '<')[1], '.')[-1] AS name FROM units")
def called_names(spark, d):
    return view(spark, d, "units").select("id", t.called_name(F.col("content")).alias("name"))


@query("S06_camel_words", "SELECT DISTINCT class_name, trim(regexp_replace(class_name, '([A-Z][a-z])', ' \\1', 'g')) AS words FROM nodes WHERE kind = 'method'")
def camel_words(spark, d):
    return nodes(spark, d).filter("kind = 'method'").select("class_name", F.array_join(t.camel_words(F.col("class_name")), " ").alias("words")).distinct()


@query("S09_confidence_values", "SELECT confidence, CASE confidence WHEN 'exact' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.25 ELSE 0 END::DOUBLE AS value, count(*) AS n FROM edges GROUP BY 1")
def confidence_values(spark, d):
    from ..plans.traverse import confidence_value

    return edges(spark, d).groupBy("confidence").agg(F.count("*").alias("n")).withColumn("value", confidence_value(F.col("confidence")))


@query("S10_type_parameters", "SELECT * FROM (VALUES ('T', true), ('T1', true), ('TEntity', false), ('Order', false), ('T22', true)) v(name, is_parameter)")
def type_parameters(spark, d):
    names = spark.createDataFrame([(x,) for x in ("T", "T1", "TEntity", "Order", "T22")], "name string")
    return names.select("name", t.type_parameter(F.col("name")).alias("is_parameter"))


@query("S12_vector_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 4) AS norm, round((list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]) + 1) / 2, 4) AS mirror FROM embeddings")
def vector_norms(spark, d):
    rows = table(spark, d, "embeddings")
    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    return rows.select("vec_id", F.round(norm, 4).alias("norm"), F.round((fusion.cosine(F.col("embedding"), F.reverse("embedding")) + 1) / 2, 4).alias("mirror"))


@query("S13_extractors", "SELECT page_id, len(list_distinct(regexp_extract_all(html, 'https?://[^\\s\"''<]+'))) AS n_urls, len(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS n_links FROM pages")
def extractors(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(t.urls_of(F.col("html"))).cast("long").alias("n_urls"), F.size(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).cast("long").alias("n_links"))


@query("S14_sql_tables", """SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(content, '(?i)(?:INSERT\\s+INTO|UPDATE|DELETE\\s+FROM|FROM|JOIN)\\s+["]?(\\w+)', 1), lambda w: upper(w) NOT IN ('SELECT','INSERT','UPDATE','DELETE','FROM','WHERE','JOIN','SET','INTO','VALUES','AND','OR','NOT','NULL','LIKE','ORDER','GROUP','HAVING')))), ',') AS tables FROM bodies""")
def sql_tables(spark, d):
    return view(spark, d, "bodies").select("id", F.array_join(t.tables_of(F.col("content")), ",").alias("tables"))


NAMES = "nm AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN replace(p_type, ' ', '') || 'Dto' WHEN 1 THEN 'Base' || replace(p_brand, '#', '') || 'DAO' WHEN 2 THEN 'OrderResponse' WHEN 3 THEN lower(replace(p_brand, '#', '')) WHEN 4 THEN 'select ' || p_name WHEN 5 THEN 'ItemVO' WHEN 6 THEN 'Basement' ELSE p_name END AS name FROM part)"


@query("S15_name_tests", f"WITH {NAMES} SELECT p_partkey, regexp_matches(name, '^[a-z0-9]+$') AS all_lower, regexp_matches(name, '([Dd][Tt][Oo]|VO|Result|Request|Response)$') AS transfer, regexp_matches(upper(name), 'SELECT|INSERT|UPDATE|DELETE|FROM|WHERE|JOIN') AS query, starts_with(name, 'Base') AND regexp_matches(name, 'BLL|DAO|Dao|NHB') AS base FROM nm")
def name_tests(spark, d):
    from ..operators.retrieval import is_base

    rows, name = spark.sql(f"WITH {NAMES.replace('FROM part', 'FROM {part}')} SELECT * FROM nm", part=table(spark, d, "part")), F.col("name")
    return rows.select("p_partkey", name.rlike("^[a-z0-9]+$").alias("all_lower"), name.rlike(f"(?:{t.TRANSFER})$").alias("transfer"), t.query_like(name).alias("query"), is_base(name).alias("base"))


@query("S16_normalized_questions", "SELECT item_id, replace(replace(replace(replace(replace(trim(text), '  ', ' '), '?', ''), ',', ' '), chr(39), ''), '\"', '') AS text FROM questions")
def normalized_questions(spark, d):
    from ..operators.cognition import normalized

    return view(spark, d, "questions").select("item_id", normalized(F.col("text")).alias("text"))


@query("S17_truncation", "SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS head FROM documents")
def truncation(spark, d):
    return table(spark, d, "documents").select("doc_id", t.truncated(F.col("text"), 80).alias("head"))


@query("S18_hashes", "SELECT doc_id, upper(substr(sha256(text), 1, 16)) AS short_hash, sha256(text) AS full_hash FROM documents")
def hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", t.content_hash(F.col("text")).alias("short_hash"), F.sha2("text", 256).alias("full_hash"))


@query("S19_rounding", "SELECT p_partkey, round(p_retailprice / 7, 2) AS two, round(p_retailprice / 7, 4) AS four FROM part")
def rounding(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(F.col("p_retailprice") / 7, 2).alias("two"), F.round(F.col("p_retailprice") / 7, 4).alias("four"))


@query("S20_clamp", "SELECT c_custkey, greatest(0.0, least(1.0, round(c_acctbal / 5000, 6))) AS value FROM customer")
def clamp(spark, d):
    return table(spark, d, "customer").select("c_custkey", confidence.clamp(F.round(F.col("c_acctbal") / 5000, 6)).alias("value"))


@query("S21_folders", "SELECT DISTINCT class_name, CASE WHEN class_name LIKE '%Controller' THEN 'Controllers' WHEN class_name LIKE '%Service' THEN 'Services' WHEN class_name LIKE '%Repository' THEN 'Repositories' ELSE 'Helpers' END AS folder FROM nodes")
def folders(spark, d):
    return nodes(spark, d).select("class_name", t.folder_of(F.col("class_name")).alias("folder")).distinct()


@query("S22_progress", "SELECT n_nationkey, CAST(CASE WHEN n_regionkey = 0 THEN 0 ELSE least(100, n_nationkey * 100 // 24) END AS BIGINT) AS percent FROM nation")
def progress(spark, d):
    done = F.when(F.col("n_regionkey") == 0, 0).otherwise(F.least(F.lit(100), F.floor(F.col("n_nationkey") * 100 / 24)))
    return table(spark, d, "nation").select("n_nationkey", done.cast("long").alias("percent"))


@query("S31_confidence_levels", "SELECT statement_id, CAST(CASE WHEN s >= 0.95 THEN 0 WHEN s >= 0.8 THEN 1 WHEN s >= 0.6 THEN 2 WHEN s >= 0.4 THEN 3 WHEN s >= 0.2 THEN 4 ELSE 5 END AS INT) AS level FROM (SELECT statement_id, CASE WHEN speculative_ancestor THEN least(score, 0.55) ELSE score END AS s FROM statements)")
def confidence_levels(spark, d):
    return view(spark, d, "statements").select("statement_id", confidence.level(F.col("score"), F.col("speculative_ancestor")).alias("level"))


@query("S32_truth_from_level", "SELECT confidence, CASE confidence WHEN 'exact' THEN 1.0 WHEN 'high' THEN 0.85 WHEN 'medium' THEN 0.6 ELSE 0.3 END::DOUBLE AS truth FROM (SELECT DISTINCT confidence FROM edges)")
def truth_from_level(spark, d):
    return edges(spark, d).select("confidence").distinct().withColumn("truth", confidence.truth_from_level(F.col("confidence")))


ACCESSING = "ax AS (SELECT DISTINCT from_id AS id FROM edges WHERE kind = 'entity-access')"


@query("G01_method_chunks", f"WITH {DEGREE}, {ACCESSING} SELECT n.id, n.label AS title, least(1.0 + CASE WHEN n.id IN (SELECT id FROM ax) THEN 2.0 ELSE 0.0 END + CASE WHEN route IS NOT NULL THEN 3.0 ELSE 0.0 END + CASE WHEN entry_point THEN 2.0 ELSE 0.0 END + least(0.5 * n_callers, 3.0), 10.0)::DOUBLE AS importance FROM nodes n JOIN dg ON dg.id = n.id WHERE NOT is_external")
def method_chunks(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    return text.method_chunks(n, e, metrics.degrees(n, e)).select("id", "title", "importance")


@query("G02_class_chunks", f"""WITH {ACCESSING}, own AS (SELECT * FROM nodes WHERE NOT is_external), ks AS (SELECT project_name, namespace, class_name, string_agg(DISTINCT e.kind, ',' ORDER BY e.kind) AS kinds FROM own JOIN edges e ON e.from_id = own.id GROUP BY 1, 2, 3)
SELECT project_name, class_name, count(*) AS n, round(least(2 + 0.3 * count(*) + CASE WHEN bool_or(entry_point) THEN 3.0 ELSE 0.0 END + CASE WHEN bool_or(id IN (SELECT id FROM ax)) THEN 2.0 ELSE 0.0 END, 10.0)::DOUBLE, 4) AS importance, coalesce(any_value(kinds), '') AS kinds, coalesce(string_agg(DISTINCT route, ',' ORDER BY route), '') AS routes, contains(lower(class_name), lower(class_name)) AS named
FROM own LEFT JOIN ks USING (project_name, namespace, class_name) GROUP BY project_name, namespace, class_name HAVING count(*) >= 2""")
def class_chunks(spark, d):
    rows = text.class_chunks(nodes(spark, d), edges(spark, d))
    return rows.select("project_name", "class_name", "n", "importance", F.array_join("kinds", ",").alias("kinds"), F.array_join("routes", ",").alias("routes"), F.array_contains("keywords", F.lower("class_name")).alias("named"))


@query("G03_path_chunks", f"WITH RECURSIVE {IMPACT} SELECT path_id, length, (6.0 + least(0.5 * length, 4.0))::DOUBLE AS importance FROM paths")
def path_chunks(spark, d):
    return text.path_chunks(impact(spark, d))


GROUPED = "s AS (SELECT root, leaf, path_id, unnest(string_split(path_id, '|')) AS node FROM paths)"


@query("G04_entity_chunks", f"WITH RECURSIVE {IMPACT}, {GROUPED} SELECT root, count(DISTINCT path_id) AS n_paths, count(DISTINCT node) AS n_nodes, round(7.0 + least(0.5 * count(DISTINCT path_id), 3.0), 4)::DOUBLE AS importance FROM s GROUP BY root")
def entity_chunks(spark, d):
    return text.group_chunks(impact(spark, d), "root", 7.0, 0.5, 3.0)


@query("G05_route_chunks", f"WITH RECURSIVE {IMPACT}, {GROUPED} SELECT leaf, count(DISTINCT path_id) AS n_paths, count(DISTINCT node) AS n_nodes, round(8.0 + least(0.3 * count(DISTINCT path_id), 2.0), 4)::DOUBLE AS importance FROM s GROUP BY leaf")
def route_chunks(spark, d):
    return text.group_chunks(impact(spark, d), "leaf", 8.0, 0.3, 2.0)


def ends_sql(by: str, other: str, most: int) -> str:
    return f"(SELECT id, list(label ORDER BY r) AS l FROM (SELECT {by} AS id, coalesce(n.label, {other}) AS label, row_number() OVER (PARTITION BY {by} ORDER BY {other}) AS r FROM (SELECT DISTINCT from_id, to_id FROM edges) e LEFT JOIN nodes n ON n.id = e.{other}) WHERE r <= {most} GROUP BY 1)"


@query("G06_contents", f"""SELECT n.id, '## ' || n.label || chr(10) || chr(10) || '- **Namespace**: ' || n.namespace || chr(10) || '- **Class**: ' || n.class_name || chr(10) || '- **Method**: ' || n.method_name || chr(10) || '- **Kind**: ' || n.kind || chr(10) || '- **Project**: ' || n.project_name
|| coalesce(chr(10) || chr(10) || '### Calls' || chr(10) || array_to_string(list_transform(o.l, lambda x: '  → ' || x), chr(10)), '') || coalesce(chr(10) || chr(10) || '### Called By' || chr(10) || array_to_string(list_transform(i.l, lambda x: '  ← ' || x), chr(10)), '') AS content
FROM nodes n LEFT JOIN {ends_sql('from_id', 'to_id', 20)} o ON o.id = n.id LEFT JOIN {ends_sql('to_id', 'from_id', 10)} i ON i.id = n.id""")
def contents(spark, d):
    return text.content(nodes(spark, d), edges(spark, d))


@query("G07_keywords", "SELECT id, array_to_string(list_sort(list_distinct(list_filter(['app', lower(split_part(namespace, '.', 2)), lower(class_name), split_part(lower(regexp_replace(class_name, '([A-Z][a-z]+)', '\\1 ', 'g')), ' ', 1), split_part(lower(regexp_replace(class_name, '([A-Z][a-z]+)', '\\1 ', 'g')), ' ', 2)], lambda w: length(w) > 1))), ',') AS words FROM nodes WHERE kind = 'method'")
def keyword_lists(spark, d):
    return nodes(spark, d).filter("kind = 'method'").select("id", F.array_join(t.keywords(F.concat_ws(".", "namespace", "class_name")), ",").alias("words"))


@query("G09_word_estimates", "SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[ \\n\\r\\t]'), lambda w: length(trim(w)) > 0)) + 3 * 2 AS INT) AS tokens FROM documents")
def word_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", t.word_estimate(F.col("text"), F.lit(2)).alias("tokens"))


@query("G10_token_estimates", "SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, c + (length(text) - c) // 4 + m // 2) END AS INT) AS tokens FROM (SELECT doc_id, text, len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')) AS c, len(regexp_extract_all(text, '[(){};.,><  /\\\\_:]')) AS m FROM documents)")
def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", t.token_estimate(F.col("text")).cast("int").alias("tokens"))


@query("G11_batches", """WITH RECURSIVE rw AS (SELECT source, doc_id AS id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, c + (length(text) - c) // 4 + m // 2) END AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM (SELECT source, doc_id, text, len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')) AS c, len(regexp_extract_all(text, '[(){};.,><  /\\\\_:]')) AS m FROM documents)),
fo AS (SELECT source, id, rn, 0 AS batch, 1 AS n, tokens AS t FROM rw WHERE rn = 1 UNION ALL SELECT source, id, rn, CASE WHEN brk THEN batch + 1 ELSE batch END, CASE WHEN brk THEN 1 ELSE n + 1 END, CASE WHEN brk THEN tokens ELSE t + tokens END FROM (SELECT r.source, r.id, r.rn, r.tokens, f.batch, f.n, f.t, f.n >= 32 OR f.t + r.tokens > 8192 AS brk FROM fo f JOIN rw r ON r.source = f.source AND r.rn = f.rn + 1))
SELECT source, id, CAST(batch AS INT) AS batch FROM fo""")
def batches(spark, d):
    rows = table(spark, d, "documents").select("source", F.col("doc_id").alias("id"), t.token_estimate(F.col("text")).alias("tokens"))
    return text.batches(rows, "source")


@query("G12_content_hashes", "SELECT upper(substr(sha256(text), 1, 16)) AS content_hash, count(*) AS n FROM documents GROUP BY 1")
def content_hashes(spark, d):
    return table(spark, d, "documents").groupBy(t.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("n"))


@query("G13_embedding_texts", "SELECT id, concat_ws(chr(10), nullif(label, ''), nullif(route, ''), nullif(table_name, '')) AS text FROM nodes")
def embedding_texts(spark, d):
    return nodes(spark, d).select("id", F.concat_ws("\n", F.nullif("label", F.lit("")), F.nullif("route", F.lit("")), F.nullif("table_name", F.lit(""))).alias("text"))


@query("G14_hash_embeddings", """WITH h AS (SELECT item_id, sha256(text) AS s FROM benchmark), r AS (SELECT item_id, list_transform(range(0, 384), lambda i: (('0x' || substr(s, CAST(2 * (i % 30) + 1 AS INT), 4))::INT - 32768) / 32768.0::DOUBLE) AS v FROM h)
SELECT item_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first, round(v[384] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS last, len(v) AS dims FROM r""")
def hash_embeddings(spark, d):
    v = t.hash_embedding(F.col("text"))
    rows = table(spark, d, "benchmark").select("item_id", v.alias("v"))
    return rows.select("item_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"), F.size("v").cast("long").alias("dims"))


@query("G15_embedding_cache", "SELECT item_id AS id, upper(substr(sha256(text), 1, 16)) AS content_hash, item_id % 3 = 0 AS cached FROM benchmark")
def embedding_cache(spark, d):
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    cache = text.embed(rows.filter("id % 3 = 0"))
    return text.embed(rows, cache).select("id", "content_hash", "cached")


def docs(spark, d):
    return text.semantic_docs(view(spark, d, "bodies"), view(spark, d, "unit_calls"))


LITERALS = "regexp_extract_all(content, '\"([^\"]*)\"', 1)"
WORDS = "('SELECT','INSERT','UPDATE','DELETE','FROM','WHERE','JOIN','SET','INTO','VALUES','AND','OR','NOT','NULL','LIKE','ORDER','GROUP','HAVING')"


def names_sql(by: str, other: str, most: int) -> str:
    """Names at the other end of calls, the first by id."""
    return f"(SELECT id, list(name ORDER BY r) AS names FROM (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY o, name) AS r FROM (SELECT c.{by} AS id, u.method_name AS name, min(c.{other}) AS o FROM unit_calls c JOIN bodies u ON u.id = c.{other} WHERE u.method_name <> '' GROUP BY 1, 2)) WHERE r <= {most} GROUP BY 1)"


def once(names: str) -> str:
    """Sorted, of names that differ in case alone the first."""
    ordered = f"list_sort(list_distinct({names}))"
    return f"list_filter({ordered}, lambda w, i: list_position(list_transform({ordered}, lambda x: lower(x)), lower(w)) = i)"


def distinct_first(found: str, most: int) -> str:
    """As they come, each once."""
    return f"list_slice(list_filter({found}, lambda w, i: list_position({found}, w) = i), 1, {most})"


SQL_NAMES = f"list_filter(regexp_extract_all(array_to_string(lt, '|'), '(?i)(?:INSERT\\s+INTO|UPDATE|DELETE\\s+FROM|FROM|JOIN)\\s+(\\w+)', 1), lambda w: length(w) > 1 AND upper(w) NOT IN {WORDS})"
ENTITY_NAMES = "list_filter(regexp_extract_all(array_to_string(lt, '|'), '\\b(?:[A-Z][a-z]+){2,}\\b'), lambda w: length(w) > 3)"
URLS = "list_concat(regexp_extract_all(array_to_string(lt, ' '), 'https?://[^\\s]+'), regexp_extract_all(content, '(?i)(?:HttpGet|HttpPost|Route)\\(@?\"([^\"]+)\"\\)', 1))"
THROWN = "regexp_extract_all(content, '\\b(?:catch\\s*\\(\\s*|throw\\s+new\\s+)([\\w.]+)', 1)"
MADE = "regexp_extract_all(content, '\\bnew\\s+(\\w*(?:[Dd][Tt][Oo]|VO|Result|Request|Response))\\b', 1)"
KEYS = "regexp_extract_all(content, '(?i)(?:Configuration\\[|ConfigHelper\\.\\w+\\(@?|AppSettings\\[|GetConfigString\\(@?)\"([^\"]+)\"', 1)"
DOCS = f"""bl AS (SELECT *, {LITERALS} AS lt FROM bodies),
dc AS (SELECT b.id, namespace, class_name, method_name, list_slice({once(f'list_concat({SQL_NAMES}, {ENTITY_NAMES})')}, 1, 10) AS tables, list_slice(list_sort(list_distinct({URLS})), 1, 8) AS urls, list_slice({once("list_filter(lt, lambda w: regexp_matches(w, '(?i)^(?:[A-Z]:|[.][.]?/|~/).*[.][a-z]{2,4}$'))")}, 1, 5) AS files,
list_slice(list_sort(list_distinct({KEYS})), 1, 5) AS settings, {distinct_first(THROWN, 5)} AS exceptions, {distinct_first(MADE, 5)} AS transfers, CASE WHEN starts_with(method_name, 'Find') THEN 'query' WHEN contains(method_name, 'Load') THEN 'query' ELSE '' END AS action, coalesce(o.names, []) AS callees, coalesce(i.names, []) AS callers
FROM bl b LEFT JOIN {names_sql('from_id', 'to_id', 10)} o ON o.id = b.id LEFT JOIN {names_sql('to_id', 'from_id', 5)} i ON i.id = b.id),
sm AS (SELECT *, concat_ws('; ', nullif(action, ''), CASE WHEN len(tables) > 0 THEN 'accesses:' || array_to_string(list_slice(tables, 1, 3), ',') END, CASE WHEN len(urls) > 0 THEN 'endpoint:' || urls[1] END, CASE WHEN len(callees) > 0 THEN 'calls:' || array_to_string(list_slice(callees, 1, 3), ',') END, CASE WHEN len(exceptions) > 0 THEN 'throws:' || array_to_string(list_slice(exceptions, 1, 2), ',') END,
CASE WHEN len(transfers) > 0 THEN 'uses:' || array_to_string(list_slice(transfers, 1, 2), ',') END, CASE WHEN len(settings) > 0 THEN 'config-aware' END, CASE WHEN len(urls) > 0 THEN 'api-entrypoint' END) AS summary FROM dc)"""
LISTS = ("tables", "urls", "files", "settings", "exceptions", "transfers", "callees", "callers")


@query("G16_semantic_docs", f"WITH {DOCS} SELECT id, {', '.join(f'array_to_string({c}, chr(44)) AS {c}' for c in LISTS)}, action FROM dc")
def semantic_docs(spark, d):
    return docs(spark, d).select("id", *[F.array_join(c, ",").alias(c) for c in LISTS], "action")


@query("G17_syntax_features", f"""WITH b AS (SELECT id, content, {LITERALS} AS lt, regexp_replace(content, '"[^"]*"', '""', 'g') AS code FROM bodies) SELECT id, CAST(len(lt) AS INT) AS n_literals, CAST(len(list_filter(lt, lambda x: regexp_matches(upper(x), 'SELECT|INSERT|UPDATE|DELETE|FROM|WHERE|JOIN'))) AS INT) AS n_queries, CAST(len(regexp_extract_all(code, '\\bcatch\\b')) AS INT) AS n_caught, CAST(len(regexp_extract_all(code, '\\bthrow\\b')) AS INT) AS n_thrown,
CAST(len(list_filter(regexp_extract_all(code, '([A-Za-z_]\\w*)\\s*\\(', 1), lambda w: w NOT IN ('if', 'for', 'while', 'switch', 'catch'))) AS INT) AS n_calls, array_to_string({distinct_first(MADE, 5)}, ',') AS transfers FROM b""")
def syntax_features(spark, d):
    return text.features(view(spark, d, "bodies"))


@query("G18_enhanced_texts", f"""WITH {DOCS} SELECT id, concat_ws(chr(10), 'Method:' || method_name, 'Class:' || class_name, 'Namespace:' || namespace, {', '.join(f"CASE WHEN len({c}) > 0 THEN '{label}:' || array_to_string({c}, ',') END" for label, c in (('Calls', 'callees'), ('SQL', 'tables'), ('HTTP', 'urls'), ('Exceptions', 'exceptions'), ('DTO', 'transfers'), ('Files', 'files'), ('Config', 'settings')))}, 'Behavior:' || nullif(summary, '')) AS text FROM sm""")
def enhanced_texts(spark, d):
    return text.enhanced(docs(spark, d))


@query("G19_reverse_index", f"WITH {DOCS} SELECT 'table' AS category, unnest(tables) AS key, id FROM dc UNION SELECT 'http', unnest(urls), id FROM dc UNION SELECT 'exception', unnest(exceptions), id FROM dc UNION SELECT 'config', unnest(settings), id FROM dc")
def reverse_index(spark, d):
    return text.reverse_index(docs(spark, d))


@query("G20_summaries", f"WITH {DOCS} SELECT id, summary FROM sm")
def summaries(spark, d):
    return text.summaries(docs(spark, d))
