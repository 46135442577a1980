"""Chunks, semantic documents, the reverse index, embeddings and their batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from .retrieval import contained

#: Weight of a category of the reverse index.
CATEGORY = {"table": 1.0, "exception": 0.8, "http": 0.6, "config": 0.5}
BATCH_ROWS, BATCH_TOKENS = 32, 8192


#: What a chunk of each kind weighs before its features.
BASES = {"method": 1.0, "class": 2.0, "path": 4.0, "entity": 4.0, "route": 5.0}


def chunk_importance(base: Column, has_entity: Column, has_route: Column, is_entry: Column, n_callers: Column) -> Column:
    """A base by kind, more for entities, routes, entries and callers, 10 at most."""
    more = F.when(has_entity, 2.0).otherwise(0.0) + F.when(has_route, 3.0).otherwise(0.0) + F.when(is_entry, 2.0).otherwise(0.0)
    return F.least(base + more + F.least(0.5 * n_callers, F.lit(3.0)), F.lit(10.0))


def accessing(edges: DataFrame) -> DataFrame:
    """(id, has_entity): nodes that reach an entity."""
    return edges.filter("kind = 'entity-access'").select(F.col("from_id").alias("id")).distinct().withColumn("has_entity", F.lit(True))


def method_chunks(nodes: DataFrame, edges: DataFrame, degree: DataFrame) -> DataFrame:
    """(id, title, n_keywords, importance): a chunk for each internal method."""
    rows = nodes.filter("not is_external").join(degree, "id").join(accessing(edges), "id", "left").na.fill(False, ["has_entity"])
    words = t.keywords(F.concat_ws(".", "namespace", "class_name", "method_name"))
    value = chunk_importance(F.lit(BASES["method"]), F.col("has_entity"), F.col("route").isNotNull(), F.col("entry_point"), F.col("n_callers"))
    return rows.select("id", F.col("label").alias("title"), F.size(words).alias("n_keywords"), value.alias("importance"))


def class_chunks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_name, namespace, class_name, n, importance, keywords, kinds, routes): classes of two members and more, and what their members have."""
    by = ["project_name", "namespace", "class_name"]
    own = nodes.filter("not is_external").join(accessing(edges), "id", "left").na.fill(False, ["has_entity"])
    rows = own.groupBy(*by).agg(F.count("*").alias("n"), F.bool_or("entry_point").alias("entry"), F.bool_or("has_entity").alias("entity"), F.array_sort(F.collect_set("route")).alias("routes"))
    kinds = edges.select(F.col("from_id").alias("id"), "kind").distinct().join(own.select("id", *by), "id").groupBy(*by).agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    score = 2 + 0.3 * F.col("n") + F.when(F.col("entry"), 3.0).otherwise(0.0) + F.when(F.col("entity"), 2.0).otherwise(0.0)
    words = t.keywords(F.concat_ws(".", "namespace", "class_name"))
    found = rows.filter("n >= 2").join(kinds, by, "left")
    return found.select(*by, "n", F.round(F.least(score, F.lit(10.0)), 4).alias("importance"), words.alias("keywords"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"), "routes")


def path_chunks(paths: DataFrame, base: float = 6.0) -> DataFrame:
    """(path_id, importance): longer paths weigh more, up to 4."""
    return paths.select("path_id", "length", (base + F.least(0.5 * F.col("length"), F.lit(4.0))).alias("importance"))


def group_chunks(paths: DataFrame, by: str, base: float, step: float, most: float) -> DataFrame:
    """(by, n_paths, n_nodes, importance): the nodes over all paths of one end."""
    rows = paths.select(by, "path_id", F.explode("node_ids").alias("node"))
    found = rows.groupBy(by).agg(F.countDistinct("path_id").alias("n_paths"), F.countDistinct("node").alias("n_nodes"))
    return found.withColumn("importance", F.round(base + F.least(step * F.col("n_paths"), F.lit(most)), 4))


def _labels(edges: DataFrame, nodes: DataFrame, by: str, other: str, most: int) -> DataFrame:
    """(id, labels): labels at the other end of edges, the first by id."""
    named = nodes.select(F.col("id").alias(other), "label")
    first = edges.select(by, other).distinct().withColumn("r", F.row_number().over(W.partitionBy(by).orderBy(other))).filter(F.col("r") <= most)
    rows = first.join(named, other, "left").select(by, "r", F.coalesce("label", other).alias("label"))
    return rows.groupBy(F.col(by).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda x: x["label"]).alias("labels"))


def content(nodes: DataFrame, edges: DataFrame, callees: int = 20, callers: int = 10) -> DataFrame:
    """(id, content): a node as Markdown: its label and names, its first callees and callers. Headings and names are fixed values."""
    none = F.array().cast("array<string>")
    rows = nodes.join(_labels(edges, nodes, "from_id", "to_id", callees).withColumnRenamed("labels", "calls"), "id", "left").join(_labels(edges, nodes, "to_id", "from_id", callers).withColumnRenamed("labels", "called"), "id", "left")
    head = [F.concat(F.lit("## "), "label"), F.lit("")]
    head += [F.concat(F.lit(f"- **{name}**: "), F.coalesce(c, F.lit(""))) for name, c in (("Namespace", "namespace"), ("Class", "class_name"), ("Method", "method_name"), ("Kind", "kind"), ("Project", "project_name"))]
    part = lambda title, mark, c: F.when(F.size(F.coalesce(c, none)) > 0, F.concat(F.array(F.lit(""), F.lit(f"### {title}")), F.transform(c, lambda x: F.concat(F.lit(f"  {mark} "), x)))).otherwise(none)
    lines = F.concat(F.array(*head), part("Calls", "→", "calls"), part("Called By", "←", "called"))
    return rows.select("id", F.array_join(lines, "\n").alias("content"))


def batches(rows: DataFrame, group: str, most_rows: int = BATCH_ROWS, most_tokens: int = BATCH_TOKENS) -> DataFrame:
    """(group, id, batch): rows in order of id, a new batch where the next would make one too large.

    A sequential fold, so each group is walked once by one task, in a stream.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, batch, n, tokens = None, 0, 0, 0
        for part in parts:
            out = []
            for g, size in zip(part[group], part["tokens"], strict=True):
                if g != key:
                    key, batch, n, tokens = g, 0, 0, 0
                elif n >= most_rows or (n and tokens + size > most_tokens):
                    batch, n, tokens = batch + 1, 0, 0
                n, tokens = n + 1, tokens + size
                out.append(batch)
            yield part[[group, "id"]].assign(batch=out)

    kinds = dict(rows.dtypes)
    sorted_ = rows.select(group, "id", "tokens").repartition(group).sortWithinPartitions(group, "id")
    return sorted_.mapInPandas(run, f"{group} {kinds[group]}, id {kinds['id']}, batch int")


def embed(rows: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """(id, content_hash, vector, cached): vectors by content; those in ``cache`` (content_hash, vector) are reused."""
    hashed = rows.select("id", "text", t.content_hash(F.col("text")).alias("content_hash"))
    if cache is None:
        return hashed.select("id", "content_hash", t.hash_embedding(F.col("text")).alias("vector"), F.lit(False).alias("cached"))
    known = cache.select("content_hash", F.col("vector").alias("known")).dropDuplicates(["content_hash"])
    joined = hashed.join(known, "content_hash", "left")
    return joined.select("id", "content_hash", F.coalesce("known", t.hash_embedding(F.col("text"))).alias("vector"), F.col("known").isNotNull().alias("cached"))


def _names(calls: DataFrame, units: DataFrame, by: str, other: str, most: int) -> DataFrame:
    """(id, names): method names at the other end of calls (from_id, to_id), the first by id, each once."""
    named = units.select(F.col("id").alias(other), F.col("method_name").alias("name")).filter("name <> ''")
    first = calls.select(by, other).distinct().join(named, other).groupBy(by, "name").agg(F.min(other).alias("o"))
    top = first.withColumn("r", F.row_number().over(W.partitionBy(by).orderBy("o", "name"))).filter(F.col("r") <= most)
    return top.groupBy(F.col(by).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]).alias("names"))


def features(units: DataFrame) -> DataFrame:
    """(id, n_literals, n_queries, n_caught, n_thrown, n_calls, transfers): what a body is made of."""
    body = F.col("content")
    texts = t.literals(body)
    code = F.regexp_replace(body, '"[^"]*"', '""')
    return units.select(
        "id", F.size(texts).alias("n_literals"), F.size(F.filter(texts, t.query_like)).alias("n_queries"), F.regexp_count(code, F.lit(r"\bcatch\b")).alias("n_caught"),
        F.regexp_count(code, F.lit(r"\bthrow\b")).alias("n_thrown"), F.size(F.filter(F.regexp_extract_all(code, F.lit(r"([A-Za-z_]\w*)\s*\("), 1), lambda w: ~w.isin("if", "for", "while", "switch", "catch"))).alias("n_calls"),
        F.array_join(t.transfers_in(body), ",").alias("transfers"),
    )


def semantic_docs(units: DataFrame, calls: DataFrame) -> DataFrame:
    """What each unit (id, namespace, class_name, method_name, content) touches: tables, urls, files, settings, exceptions, transfers, callees, callers, action."""
    body, texts = F.col("content"), F.col("texts")
    rows = units.withColumn("texts", t.literals(body)).select(
        "id", "namespace", "class_name", "method_name", t.tables_in(texts).alias("tables"), t.urls_in(texts, body).alias("urls"), t.files_in(texts).alias("files"),
        t.settings_in(body).alias("settings"), t.exceptions_in(body).alias("exceptions"), t.transfers_in(body).alias("transfers"), t.action(F.col("method_name")).alias("action"),
    )
    none = F.array().cast("array<string>")
    for name, by, other, most in (("callees", "from_id", "to_id", 10), ("callers", "to_id", "from_id", 5)):
        rows = rows.join(_names(calls, units, by, other, most).withColumnRenamed("names", name), "id", "left").withColumn(name, F.coalesce(name, none))
    return rows


def summary() -> Column:
    """What a document does, in clauses."""
    some = lambda label, c, n: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(F.slice(c, 1, n), ",")))
    caught = F.exists("exceptions", lambda e: F.lower(e).contains("catch"))
    return F.concat_ws(
        "; ", F.nullif("action", F.lit("")), some("accesses:", "tables", 3), some("endpoint:", "urls", 1), some("calls:", "callees", 3),
        F.when(caught, "handles-errors").otherwise(some("throws:", "exceptions", 2)), some("uses:", "transfers", 2), F.when(F.size("settings") > 0, "config-aware"), F.when(F.size("urls") > 0, "api-entrypoint"),
    )


def enhanced(docs: DataFrame) -> DataFrame:
    """(id, text): labelled lines of what is not empty. The labels are fixed values."""
    line = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{label}:"), F.array_join(c, ",")))
    own = [F.concat(F.lit(f"{label}:"), c) for label, c in (("Method", "method_name"), ("Class", "class_name"), ("Namespace", "namespace"))]
    more = [line(label, c) for label, c in (("Calls", "callees"), ("SQL", "tables"), ("HTTP", "urls"), ("Exceptions", "exceptions"), ("DTO", "transfers"), ("Files", "files"), ("Config", "settings"))]
    return docs.select("id", F.concat_ws("\n", *own, *more, F.when(summary() != "", F.concat(F.lit("Behavior:"), summary()))).alias("text"))


def summaries(docs: DataFrame) -> DataFrame:
    return docs.select("id", summary().alias("summary"))


def reverse_index(docs: DataFrame) -> DataFrame:
    """(category, key, id), distinct."""
    out = None
    for category, column in (("table", "tables"), ("http", "urls"), ("exception", "exceptions"), ("config", "settings")):
        part = docs.select(F.lit(category).alias("category"), F.explode(column).alias("key"), "id")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def search_index(index: DataFrame, words: DataFrame) -> DataFrame:
    """(query_id, id, score): the best category weight of keys that hold a word of a query (query_id, word) or are held by one."""
    weight = F.lit(0.0)
    for name, value in CATEGORY.items():
        weight = F.when(F.col("category") == name, value).otherwise(weight)
    keys = index.select(F.lower("key").alias("k")).distinct()
    asked = words.select(F.lower("word").alias("w")).distinct()
    within = contained(asked.withColumnRenamed("w", "s"), keys.withColumnRenamed("k", "l")).select(F.col("s").alias("w"), F.col("l").alias("k"))
    around = contained(keys.withColumnRenamed("k", "s"), asked.withColumnRenamed("w", "l")).select(F.col("l").alias("w"), F.col("s").alias("k"))
    pairs = within.union(around).distinct()
    hits = words.select("query_id", F.lower("word").alias("w")).distinct().join(pairs, "w").join(index.withColumn("k", F.lower("key")), "k")
    return hits.groupBy("query_id", "id").agg(F.max(weight).alias("score"))
