"""Understanding a question: intent, vocabulary, aliases, expansion, rewriting, and lexical retrieval.

These operators follow descriptions, not code: the exact rules are this module's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import CAMEL
from ..plans import traverse
from .retrieval import contained

#: Words that speak of each intent, the first intent winning ties.
INTENTS = {
    "EntityLookup": ("entity", "table", "data", "repository", "dao"),
    "RouteLookup": ("route", "api", "endpoint", "controller", "action"),
    "FlowAnalysis": ("flow", "call", "chain", "path", "trace", "pipeline"),
    "ImpactAnalysis": ("impact", "affect", "change", "modify", "depend", "risk"),
    "ValidationLookup": ("validate", "verify", "check", "rule", "business"),
}
ABBREVIATIONS = {"rel": "relation", "gr": "group", "svc": "service", "repo": "repository", "mgr": "manager", "cfg": "config"}
#: Scores of the ways to expand a word.
EXACT, ALIAS, PREFIX, TEMPLATE, CONTAINS = 1.0, 0.8, 0.7, 0.6, 0.5
#: Weights of dense, lexical and graph retrieval, and of the parts of a self score.
THREE_WAY = (0.4, 0.3, 0.3)
SELF = {"grounding": 0.30, "coverage": 0.25, "calibration": 0.20, "hypotheses": 0.10, "usability": 0.15}
K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-case parts of a name or a sentence, abbreviations written out, in order of the alphabet."""
    parts = F.flatten(F.transform(F.split(text, r"[^A-Za-z0-9]+"), lambda w: F.split(w, CAMEL)))
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda w: F.coalesce(table[F.lower(w)], F.lower(w))), lambda w: F.length(w) > 0)))


def intent(words: Column) -> Column:
    """The intent most of the words speak of; the first of equals, EntityLookup without any."""
    scores = F.array(*[F.struct(F.size(F.array_intersect(words, F.array(*map(F.lit, own)))).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, own) in enumerate(INTENTS.items())])
    return F.array_max(scores)["name"]


def vocabulary(nodes: DataFrame) -> DataFrame:
    """(kind, term): names that the graph itself uses."""
    own = nodes.filter("kind = 'method'")
    parts = [
        nodes.filter("kind = 'entity'").select(F.lit("entity").alias("kind"), F.col("class_name").alias("term")),
        nodes.filter("table_name is not null").select(F.lit("table"), "table_name"),
        nodes.filter("route is not null").select(F.lit("route"), "route"),
        own.select(F.lit("class"), "class_name"), own.select(F.lit("method"), "method_name"),
        nodes.select(F.lit("normalized"), F.explode(F.split("namespace", "\\."))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.filter("term <> ''").distinct()


def aliases(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(from_id, to_id, kind): names of one thing: table and entity, entity and repository, controller and route."""
    entity = nodes.filter("kind = 'entity'").select(F.concat(F.lit("table:"), "table_name").alias("from_id"), F.concat(F.lit("entity:"), "class_name").alias("to_id"))
    names = nodes.select("id", "class_name", "kind")
    access = edges.filter("kind = 'entity-access'").select("from_id", "to_id")
    repo = access.join(names.withColumnsRenamed({"id": "from_id", "class_name": "a"}).drop("kind"), "from_id").join(names.withColumnsRenamed({"id": "to_id", "class_name": "b"}).drop("kind"), "to_id")
    repo = repo.select(F.concat(F.lit("entity:"), "b").alias("from_id"), F.concat(F.lit("class:"), "a").alias("to_id"))
    route = nodes.filter("route is not null").select(F.concat(F.lit("class:"), "class_name").alias("from_id"), F.concat(F.lit("route:"), "route").alias("to_id"))
    return entity.union(repo).union(route).distinct().withColumn("kind", F.lit("alias"))


def expand_aliases(links: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """(start, id, distance): aliases within ``depth`` steps, either way."""
    return traverse.closure(links, starts, direction="both", max_hops=depth).filter("distance > 0")


def expansions(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, word, term, score): terms for each word, by the best of the ways that find them: equal, shared-prefix and contained ones."""
    low = terms.select("term", F.lower("term").alias("t")).distinct()
    asked, names = words.select("word").distinct(), low.select("t").distinct()
    within = contained(asked.withColumnRenamed("word", "s"), names.withColumnRenamed("t", "l")).select(F.col("s").alias("word"), F.col("l").alias("t"))
    around = contained(names.withColumnRenamed("t", "s"), asked.withColumnRenamed("word", "l")).select(F.col("l").alias("word"), F.col("s").alias("t"))
    pairs = within.union(around.filter(F.col("word").startswith(F.col("t")))).distinct()
    score = F.when(F.col("t") == F.col("word"), EXACT).when(F.col("t").startswith(F.col("word")) | F.col("word").startswith(F.col("t")), PREFIX).otherwise(CONTAINS)
    found = pairs.join(low, "t").select("word", "term", score.alias("score"))
    return words.select("query_id", "word").distinct().join(found, "word").groupBy("query_id", "word", "term").agg(F.max("score").alias("score"))


def rewritten(found: DataFrame, k: int = 3, least: float = TEMPLATE) -> DataFrame:
    """(query_id, expanded): the k best terms of each word, in order of word, score and term."""
    place = F.row_number().over(W.partitionBy("query_id", "word").orderBy(F.desc("score"), "term"))
    top = found.filter(F.col("score") >= least).withColumn("r", place).filter(F.col("r") <= k)
    return top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "r", "term"))), lambda x: x["term"]), " ").alias("expanded"))


def explained(found: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, kind, n, confidence): what kinds of terms matched."""
    return found.join(terms, "term").groupBy("query_id", "kind").agg(F.countDistinct("term").alias("n"), F.round(F.avg("score"), 6).alias("confidence"))


def bm25(queries: DataFrame, documents: DataFrame, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score, place): the k best documents by BM25.

    ``queries``: (query_id, word), a few; ``documents``: (doc_id, words). Only
    the queries' words are counted, so what is shuffled is their occurrences.
    """
    asked = queries.select("word").distinct()
    side = F.broadcast(asked) if asked.count() <= 100_000 else asked
    sizes = documents.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"))
    hits = documents.select("doc_id", F.size("words").alias("length"), F.explode("words").alias("word")).join(side, "word").groupBy("doc_id", "length", "word").agg(F.count("*").alias("tf"))
    df = hits.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    rows = hits.join(df, "word").crossJoin(F.broadcast(sizes)).select("doc_id", "word", weight.alias("w"))
    scored = queries.select("query_id", "word").distinct().join(rows, "word").groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("score"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("place", place).filter(F.col("place") <= k)


def three_way(dense: DataFrame, lexical: DataFrame, graph: DataFrame) -> DataFrame:
    """(query_id, id, score) of three lists (query_id, id, s), lexical scores divided by the query's best."""
    top = lexical.withColumn("s", F.col("s") / F.max("s").over(W.partitionBy("query_id")))
    by, (a, b, c) = ["query_id", "id"], THREE_WAY
    rows = dense.withColumnRenamed("s", "x").join(top.withColumnRenamed("s", "y"), by, "full").join(graph.withColumnRenamed("s", "z"), by, "full").na.fill(0.0, ["x", "y", "z"])
    return rows.select(*by, F.round(a * F.col("x") + b * F.col("y") + c * F.col("z"), 6).alias("score"))


def verdict(grounded: Column, total: Column, conflicts: Column) -> Column:
    """Whether an answer can be trusted, by its grounded share and conflicts."""
    share = grounded / F.greatest(total, F.lit(1))
    return (
        F.when(conflicts > 0, "CompetingHypothesesPresent").when(total == 0, "RequiresFurtherInvestigation").when(share >= 0.8, "StronglyGrounded")
        .when(share >= 0.5, "PartiallyVerified").otherwise("LimitedEvidence")
    )


def self_score(rows: DataFrame) -> DataFrame:
    """Rows with score and state, from the five parts of ``SELF`` as columns."""
    total = F.round(sum((w * F.col(c) for c, w in SELF.items()), F.lit(0.0)), 6)
    state = F.when(F.col("score") >= 0.8, "Approved").when(F.col("score") >= 0.6, "Qualified").when(F.col("score") >= 0.4, "NeedsReview").otherwise("Rejected")
    return rows.withColumn("score", total).withColumn("state", state)
