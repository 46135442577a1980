"""Vector, hybrid and keyword retrieval. The unit of work is a set of queries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fusion
from ..session import cut

#: Rows of a query set that are sent to every task; larger sets are searched in blocks. Vectors multiplied at once.
QUERY_BLOCK, ROWS = 2_000, 4_096


def unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length as rows of length 1 (or 0), and the places they stand at; those of another length than the first are left out."""
    size = len(vectors[0]) if vectors and vectors[0] is not None else 0
    at = np.array([i for i, v in enumerate(vectors) if v is not None and len(v) == size], np.int64)
    x = np.array([vectors[i] for i in at], np.float64).reshape(len(at), size)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0), at


class Best:
    """The k best (similarity, chunk) of each of some queries of one length, over batches of vectors."""

    def __init__(self, queries: list, k: int) -> None:
        self.q, _ = unit(queries)
        self.k, self.held = k, [(np.zeros(0), np.zeros(0, object)) for _ in queries]

    def add(self, ids: np.ndarray, vectors: list) -> None:
        near = np.zeros((len(ids), len(self.q)))
        alike = [i for i, v in enumerate(vectors) if v is not None and len(v) == self.q.shape[1]]
        if alike:  # others have a similarity of 0
            own, _ = unit([vectors[i] for i in alike])
            near[alike] = np.round(own @ self.q.T, 6) + 0.0
        for j in range(near.shape[1]):
            s, i = near[:, j], np.arange(len(ids))
            if len(s) > self.k:
                i = np.flatnonzero(s >= np.partition(s, -self.k)[-self.k])
            s, names = np.r_[self.held[j][0], s[i]], np.r_[self.held[j][1], ids[i]]
            first = sorted(range(len(s)), key=lambda x, s=s, names=names: (-s[x], names[x]))[: self.k]
            self.held[j] = s[first], names[first]


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, chunk_id, similarity, place): exact nearest by cosine, ties by id; 0 for vectors of another length or of zeros.

    ``queries``: (query_id, q); ``vectors``: (chunk_id, v). Queries are counted and sent to all tasks in blocks, normalised once.
    A task multiplies batches of its vectors with them and keeps its k best a query, so what is moved does not grow with its vectors.
    """
    spark, kinds = vectors.sparkSession, (queries.schema["query_id"].dataType.simpleString(), vectors.schema["chunk_id"].dataType.simpleString())
    n, out = max(1, -(-queries.count() // block)), None
    for i in range(n):
        part = queries if n == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)
        sent = spark.sparkContext.broadcast([(r[0], list(r[1]) if r[1] is not None else []) for r in part.select("query_id", "q").collect()])  # a block at most

        def run(parts, sent=sent):
            by_size: dict[int, list[int]] = {}
            for place, (_, q) in enumerate(sent.value):
                by_size.setdefault(len(q), []).append(place)
            best = [(places, Best([sent.value[p][1] for p in places], k)) for places in by_size.values()]
            for frame in parts:
                for at in range(0, len(frame), ROWS):
                    ids, own = frame["chunk_id"].to_numpy(object)[at : at + ROWS], frame["v"].tolist()[at : at + ROWS]
                    for _, b in best:
                        b.add(ids, own)
            rows = [(sent.value[p][0], c, s) for places, b in best for p, held in zip(places, b.held, strict=True) for s, c in zip(*held, strict=True)]
            yield pd.DataFrame(rows, columns=["query_id", "chunk_id", "similarity"])

        found = vectors.select("chunk_id", "v").mapInPandas(run, f"query_id {kinds[0]}, chunk_id {kinds[1]}, similarity double")
        order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
        top = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
        out = top if out is None else out.unionByName(top)
    return out


def scored(found: DataFrame, chunks: DataFrame, profile: str = "default", least: float = 0.3) -> DataFrame:
    """Candidates with their chunk's features and fused score; those of low confidence go."""
    rows = found.join(chunks, "chunk_id").filter(F.col("confidence") >= least)
    near = F.col("entry_distance").between(0, 2)
    scores = [
        F.col("similarity"),
        fusion.graph_score(F.col("entry_distance"), F.col("data_distance"), F.col("max_fan")),
        fusion.symbol_score(F.col("n_grounded"), F.col("n_nodes")),
        F.lit(0.5),
        fusion.business_score(F.col("importance") / 20, F.col("is_entry"), F.col("has_access")),
        fusion.grounding_score(F.col("is_entry"), F.col("has_access"), near),
    ]
    return rows.withColumn("score", fusion.fused(scores, profile))


def best(rows: DataFrame, k: int, score: str = "score") -> DataFrame:
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(score), "chunk_id"))
    return rows.withColumn("place", place).filter(F.col("place") <= k)


def hybrid(queries: DataFrame, vectors: DataFrame, chunks: DataFrame, k: int = 10, profile: str = "default", expand: bool = True) -> DataFrame:
    """(query_id, chunk_id, score, place): fetch 3k by vector, fuse, keep k, add chunks of the same tables, keep k."""
    top = best(scored(vector_top_k(queries, vectors, 3 * k), chunks, profile), k).select("query_id", "chunk_id", "score", "table_name")
    if expand:
        tables = top.select("query_id", "table_name").distinct()
        more = tables.join(chunks.select("chunk_id", "table_name", "importance"), "table_name").join(top.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
        # the stop rule: no more than 2k candidates in all, in order of table and chunk
        order = W.partitionBy("query_id").orderBy("table_name", "chunk_id")
        more = more.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("query_id", "chunk_id", F.round(F.col("importance") / 10 * 0.5, 4).alias("score"), "table_name")
        top = best(top.unionByName(more), k)
    return top.select("query_id", "chunk_id", "score", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")).alias("place"))


def linear(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score): the older linear fusion of vector, graph, business and importance."""
    rows = found.join(chunks, "chunk_id")
    graph = fusion.graph_score(F.col("entry_distance"), F.col("data_distance"), F.col("max_fan"))
    value = F.when(F.col("is_entry"), 0.5).otherwise(0.0) + F.when(F.col("has_access"), 0.5).otherwise(0.0)
    score = 0.35 * F.col("similarity") + 0.25 * graph + 0.20 * value + 0.20 * F.col("importance") / 10
    return rows.select("query_id", "chunk_id", F.round(F.round(score, 9), 4).alias("score"))


def running_grounded(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, place, grounded_so_far, evidence): grounded nodes counted along the candidates."""
    rows = found.join(chunks.select("chunk_id", "n_grounded", "n_nodes"), "chunk_id")
    run = W.partitionBy("query_id").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    ratio = F.sum("n_grounded").over(run) / F.greatest(F.sum("n_nodes").over(run), F.lit(1))
    kind = F.when(ratio >= 0.8, "semantic").when(ratio >= 0.5, "analyzer").otherwise("pattern")
    return rows.select("query_id", "chunk_id", "place", F.sum("n_grounded").over(run).alias("grounded_so_far"), kind.alias("evidence"))


def graph_aware(rows: DataFrame) -> DataFrame:
    """(query_id, chunk_id, composite): fused score with distance, symbol, edge, grounding and coverage."""
    near = F.when(F.col("entry_distance").between(0, 2), 1.0).when(F.col("entry_distance") <= 5, 0.5).otherwise(0.2)
    cover = F.when(F.col("max_fan") > 30, 1.0).when(F.col("max_fan") > 15, 0.7).when(F.col("max_fan") > 5, 0.4).otherwise(0.1)
    parts = (
        0.25 * F.col("score") + 0.15 * near + 0.20 * fusion.symbol_score(F.col("n_grounded"), F.col("n_nodes")) + 0.15 * F.lit(0.5)
        + 0.15 * F.when(F.col("n_grounded") > 0, 1.0).otherwise(0.3) + 0.10 * cover
    )
    return rows.select("query_id", "chunk_id", F.round(parts, 6).alias("composite"))


def contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """(s, l): strings of ``short`` (s) that stand in strings of ``long`` (l), both distinct.

    An equal join on the first three characters of the one and on all runs of up to three of the other; no other pairs are made.
    """
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length("l"), F.lit(1))), lambda i: F.array(*[F.substr(F.col("l"), i, F.lit(n)) for n in (1, 2, 3)])))
    grams = long.select("l", F.explode(F.array_distinct(runs)).alias("g"))
    keyed = short.filter("s <> ''").select("s", F.substr("s", F.lit(1), F.lit(3)).alias("g"))
    return grams.join(keyed, "g").filter(F.col("l").contains(F.col("s"))).select("s", "l")


#: Marks of a base class, and a class that is framework by its name.
BASE_MARKS, FRAMEWORK = ("BLL", "DAO", "Dao", "NHB"), "HibernateDaoSupport"


def is_base(cls: Column) -> Column:
    return cls.startswith("Base") & cls.rlike("|".join(BASE_MARKS))


def split_words(text: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) > 1))


def keyword_scores(queries: DataFrame, nodes: DataFrame, first: int = 500) -> DataFrame:
    """(query_id, id, score): words of a query in method (0.6; 1 if equal) and class (0.4) names, averaged.

    Only the ``first`` nodes by id are read, framework classes are not.
    """
    cls = F.coalesce("class_name", F.lit(""))
    pool = nodes.filter(~(is_base(cls) | (cls == FRAMEWORK))).orderBy("id").limit(first).select("id", F.lower("method_name").alias("m"), F.lower("class_name").alias("c"))
    words = queries.select("query_id", F.explode(split_words("text")).alias("w"))
    total = words.groupBy("query_id").agg(F.count("*").alias("total"))
    hit = F.when(F.col("m") == F.col("w"), 1.0).when(F.col("m").contains(F.col("w")), 0.6).when(F.col("c").contains(F.col("w")), 0.4)
    rows = words.join(F.broadcast(pool), F.col("m").contains(F.col("w")) | F.col("c").contains(F.col("w"))).select("query_id", "id", hit.alias("s"))
    return rows.groupBy("query_id", "id").agg(F.sum("s").alias("s")).join(total, "query_id").select("query_id", "id", F.round(F.least(F.col("s") / F.col("total"), F.lit(1.0)), 6).alias("score"))


def merged(vector: DataFrame, graph: DataFrame, keyword: DataFrame, profile: str = fusion.DEFAULT_PROFILE) -> DataFrame:
    """(query_id, id, score): three ranked lists of (query_id, id, s), joined fully and weighted by profile."""
    by = ["query_id", "id"]
    rows = vector.withColumnRenamed("s", "v").join(graph.withColumnRenamed("s", "g"), by, "full").join(keyword.withColumnRenamed("s", "k"), by, "full").na.fill(0.0, ["v", "g", "k"])
    a, b, c = fusion.PROFILES[profile]
    return rows.select(*by, F.round(a * F.col("v") + b * F.col("g") + c * F.col("k"), 6).alias("score"))


#: Names of generic methods.
GENERIC = ("Save", "Update", "Delete", "Remove", "Get", "Load", "LoadAll", "Flush", "Evict", "Find")


def penalties(method: Column, cls: Column, words: Column, namespace: Column | None = None, frameworks: Sequence[str] = ()) -> Column:
    """Names and values of the noise rules that a method breaks. ``frameworks``: namespaces of utilities."""
    low = F.lower(method)
    rules = [
        ("GenericCRUD", 0.3, method.isin(*GENERIC) & ~F.array_contains(words, low)),
        ("BaseClassNoise", 0.4, is_base(cls)),
        ("LowBusinessContext", 0.15, (F.length(method) <= 5) | method.rlike("^[a-z0-9]+$")),
    ]
    if namespace is not None and frameworks:
        rules.append(("FrameworkUtility", 0.25, namespace.isin(*frameworks)))
    return F.filter(F.array(*[F.when(c, F.struct(F.lit(n).alias("rule"), F.lit(v).alias("value"))) for n, v, c in rules]), lambda x: x.isNotNull())


def bonus(cls: Column, words: Column) -> Column:
    """What a class earns whose name begins with a word of the query; it is shown and does not change a score."""
    return F.when(F.exists(words, lambda w: F.lower(cls).startswith(w)), 0.15).otherwise(0.0)


def rescored(rows: DataFrame, k: int = 10, most: float = 0.7, frameworks: Sequence[str] = ()) -> DataFrame:
    """(query_id, id, adjusted, bonus, place): scores times one less the sum of penalties (at most ``most``); top k."""
    found = penalties(F.col("method_name"), F.col("class_name"), F.col("words"), F.col("namespace") if frameworks else None, frameworks)
    lost = F.least(F.aggregate(found, F.lit(0.0), lambda a, x: a + x["value"]), F.lit(most))
    out = rows.select("query_id", "id", F.round(F.col("score") * (1 - lost), 6).alias("adjusted"), bonus(F.col("class_name"), F.col("words")).alias("bonus"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("adjusted"), "id"))
    return out.withColumn("place", place).filter(F.col("place") <= k)


def noise_report(rows: DataFrame, by: str | None = None, k: int = 10) -> DataFrame:
    """(rule, n, total): how often each rule is broken and what it takes away; ``by`` method or class names, the k most frequent of each rule."""
    hits = rows.select(*([by] if by else []), F.explode(penalties(F.col("method_name"), F.col("class_name"), F.col("words"))).alias("p"))
    counts = hits.groupBy("p.rule", *([by] if by else [])).agg(F.count("*").alias("n"), F.round(F.sum("p.value"), 6).alias("total"))
    if not by:
        return counts
    place = F.row_number().over(W.partitionBy("rule").orderBy(F.desc("n"), by))
    return counts.withColumn("r", place).filter(F.col("r") <= k).drop("r")


def by_keyword(nodes: DataFrame, words: Sequence[str]) -> DataFrame:
    """(id, label, score): 5 for a method of the name, else 3 for one that holds it, 2 more for the class, 1 for the label, over all words."""
    score = F.lit(0)
    for w in {w.lower() for w in words}:
        method, cls, label = (F.lower(F.coalesce(c, F.lit(""))) for c in ("method_name", "class_name", "label"))
        score = score + F.when(method == w, 5).when(method.contains(w), 3).otherwise(0) + F.when(cls.contains(w), 2).otherwise(0) + F.when(label.contains(w), 1).otherwise(0)
    return nodes.select("id", "label", score.alias("score")).filter("score > 0")


def locate(nodes: DataFrame, method: str = "", file: str = "", question: str = "", by_vector: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """(id, tier, place): symbols of the first tier that has any.

    1: methods of the exact name, by label. 2: the first one whose file ends with ``file`` and whose name is ``method``, whatever
    the case. 3: what vector search found (id, place). 4: by keywords of the question, or of the method if it has none.
    External nodes and those without a file (``source_file``) are left out.
    """
    own = nodes.filter(~F.col("is_external") & (F.coalesce("source_file", F.lit("")) != ""))
    words = question.split() or [w for w in [method] if w]
    tiers = []
    if method:
        tiers.append((1, own.filter(F.col("method_name") == method).select("id", F.struct("label", "id").alias("o"))))
    if method and file:
        there = F.lower("source_file").endswith(file.lower()) & (F.lower("method_name") == method.lower())
        tiers.append((2, own.filter(there).select("id", F.struct("id").alias("o")).orderBy("o").limit(1)))
    if by_vector is not None:
        tiers.append((3, by_vector.join(own.select("id"), "id").groupBy("id").agg(F.struct(F.min("place"), "id").alias("o"))))
    if words:
        tiers.append((4, by_keyword(own, words).select("id", F.struct(-F.col("score"), "label", "id").alias("o"))))
    for tier, found in tiers:
        top = cut(found.orderBy("o").limit(limit))
        if not top.isEmpty():
            return top.select("id", F.lit(tier).alias("tier"), F.row_number().over(W.orderBy("o")).alias("place"))  # at most ``limit`` rows
    return nodes.limit(0).select("id", F.lit(0).alias("tier"), F.lit(0).alias("place"))
