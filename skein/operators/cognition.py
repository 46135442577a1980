"""Composite questions: architecture, impact, capabilities, root causes, and reading a question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans import traverse
from ..session import cut
from .retrieval import contained

#: Words of a label that speak of failure.
FAILURE_TERMS = ("fail", "retry", "timeout", "exception", "error", "reconnect", "sync", "lock")
#: Phrases of a question by intent, the first intent that matches counts.
INTENTS = {
    "architecture": (
        "architecture", "structure", "subsystem", "layer", "dependency", "how is organized", "how is structured", "explain the system", "describe the architecture",
        "架构", "结构", "子系统", "层次", "依赖", "分层", "怎么组织", "如何组织", "解释系统", "解释架构", "描述架构", "系统概述", "项目结构", "哪些模块", "模块划分",
    ),
    "impact": (
        "what breaks", "impact of", "who depends", "who calls", "what depends on", "what would break", "affected by", "consequences of changing", "what is affected",
        "影响", "改动", "修改", "变更", "破坏", "崩溃", "谁会受影响", "谁依赖", "谁调用了", "会被影响", "改动会", "修改会", "改了会", "会不会影响",
    ),
    "debug": (
        "why does", "why is", "why are", "why isn't", "why doesn't", "debug", "fail", "failing", "broken", "error", "exception", "timeout", "retry", "crash",
        "为什么", "为何", "怎么失败", "怎么出错", "怎么崩溃", "调试", "失败", "错误", "异常", "超时", "重试", "报错", "不工作", "坏了", "bug", "缺陷",
    ),
    "capability": (
        "where is", "how does", "implemented", "implementation", "how do i", "how to", "how are", "how is handled", "what handles", "who handles", "where does",
        "在哪里", "怎么实现", "如何实现", "谁处理", "谁负责", "实现方式", "怎么处理", "如何处理", "在哪处理", "哪个类", "哪个服务", "哪段代码", "在哪里处理",
    ),
}
GENERAL = "general"
ENGINES = {"architecture": "architecture", "impact": "impact", "debug": "rootcause", "capability": "capability"}


def targets(nodes: DataFrame, keywords: Sequence[str], limit: int = 5) -> DataFrame:
    """(id): nodes whose label or class holds one of the first five keywords, the first by id."""
    hit = F.lit(False)
    for k in keywords[:5]:
        hit = hit | F.lower("label").contains(k.lower()) | F.lower("class_name").contains(k.lower())
    return nodes.filter(hit).select("id").orderBy("id").limit(limit)


def risk(score: Column, hop: Column, speculative: Column, adjust: Column) -> Column:
    """1 - score, more for each hop, for speculation and for the kind of dependency, within 0 and 1."""
    raw = 1 - score + F.least(0.1 * hop, F.lit(0.4)) + F.when(speculative, 0.2).otherwise(0.0) + adjust
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def risk_level(value: Column) -> Column:
    return F.when(value <= 0.2, "low").when(value <= 0.4, "moderate").when(value <= 0.7, "high").otherwise("critical")


def downstream(edges: DataFrame, nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, id, score, hop, risk, risk_level) of what each start reaches with confidence."""
    found = traverse.propagate(edges, starts).filter("id <> start").join(nodes.select("id", "kind"), "id")
    value = F.round(risk(F.round("score", 6), F.col("hop"), F.lit(False), F.when(F.col("kind") == "entity", 0.1).otherwise(0.0)), 6)
    return found.select("start", "id", F.round("score", 6).alias("score"), "hop", value.alias("risk")).withColumn("risk_level", risk_level(F.col("risk")))


def riskiest(found: DataFrame, k: int) -> DataFrame:
    """(start, id, risk, place): the k riskiest of each start."""
    place = F.row_number().over(W.partitionBy("start").orderBy(F.desc("risk"), "id"))
    return found.withColumn("place", place).filter(F.col("place") <= k).select("start", "id", "risk", "place")


def subsystems(nodes: DataFrame) -> DataFrame:
    own = nodes.filter("not is_external")
    ids = own.withColumn("r", F.row_number().over(W.partitionBy("project_name").orderBy("id")))
    return ids.groupBy("project_name").agg(
        F.count("*").alias("n_nodes"), F.count_if("entry_point").alias("n_entry_points"),
        F.count_if(F.col("class_name").endswith("Service")).alias("n_services"), F.count_if(F.col("class_name").endswith("Controller")).alias("n_controllers"),
        F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.col("id"))))).alias("samples"),
    )


def layers(nodes: DataFrame) -> DataFrame:
    """(layer, n): four overlapping layers, counted in one pass."""
    counts = nodes.agg(
        F.count_if("entry_point").alias("entry"), F.count_if(F.col("class_name").endswith("Service")).alias("service"),
        F.count_if(F.col("class_name").endswith("Repository")).alias("data"), F.count_if(F.col("kind") == "entity").alias("entity"),
    )
    return counts.unpivot([], ["entry", "service", "data", "entity"], "layer", "n")


def integration_points(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    own = nodes.select("id", "project_name")
    pairs = edges.select("from_id", "to_id").join(own.withColumnsRenamed({"id": "from_id", "project_name": "a"}), "from_id").join(own.withColumnsRenamed({"id": "to_id", "project_name": "b"}), "to_id")
    found = pairs.filter("a <> b").select(F.least("a", "b").alias("left_project"), F.greatest("a", "b").alias("right_project")).distinct()
    return found.orderBy("left_project", "right_project").limit(limit)


def directions(nodes: DataFrame, edges: DataFrame, entries: int = 10, chains: int = 3, depth: int = 4) -> DataFrame:
    starts = nodes.filter("entry_point").orderBy("id").limit(entries)
    found = traverse.typed_paths(nodes, edges, starts, max_depth=depth)
    place = F.row_number().over(W.partitionBy("root").orderBy("path_id"))
    return found.withColumn("r", place).filter(F.col("r") <= chains).select("root", "path_id", "length")


def capabilities(nodes: DataFrame, edges: DataFrame, limit: int = 50) -> DataFrame:
    services = nodes.filter(F.col("class_name").endswith("Service")).orderBy("label", "id").limit(limit).select("id", "class_name")
    out = edges.groupBy(F.col("from_id").alias("id")).agg(F.countDistinct("to_id").alias("n_callees"))
    back = edges.groupBy(F.col("to_id").alias("id")).agg(F.countDistinct("from_id").alias("n_callers"))
    rows = services.join(out, "id", "left").join(back, "id", "left").na.fill(0, ["n_callees", "n_callers"])
    sure = F.when(F.col("n_callees") >= 5, 1).when(F.col("n_callees") > 0, 2).otherwise(3)
    return rows.select("id", F.regexp_replace("class_name", "Service$", "").alias("capability"), "n_callees", "n_callers", sure.alias("confidence"))


def capability_match(nodes: DataFrame, keywords: Sequence[str], limit: int = 10) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "class_name", "label"))
    score = sum((F.when(text.contains(k.lower()), 3).otherwise(0) for k in keywords), F.lit(0))
    rows = nodes.filter(F.col("class_name").endswith("Service")).select("id", score.alias("score"))
    return rows.filter("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def root_cause_targets(nodes: DataFrame, keywords: Sequence[str], limit: int = 5) -> DataFrame:
    text = F.lower("label")
    score = sum((F.when(text.contains(k.lower()), 2).otherwise(0) for k in keywords if len(k) > 2), F.lit(0)) + F.when(any_of(text, FAILURE_TERMS), 1).otherwise(0)
    return nodes.select("id", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def failure_paths(edges: DataFrame, of: DataFrame, callees: int = 3, sub_callees: int = 2) -> DataFrame:
    placed = edges.select("from_id", "to_id").distinct().withColumn("r", F.row_number().over(W.partitionBy("from_id").orderBy("to_id")))
    first = placed.filter(F.col("r") <= callees).join(of.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.col("from_id").alias("target"), F.col("to_id").alias("callee"))
    second = placed.filter(F.col("r") <= sub_callees).select(F.col("from_id").alias("callee"), F.col("to_id").alias("sub_callee"))
    return first.join(second, "callee").select("target", "callee", "sub_callee")


def external_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    outside = nodes.filter("is_external").select(F.col("id").alias("to_id"))
    return edges.join(outside, "to_id", "left_semi").groupBy(F.col("from_id").alias("target")).agg(F.countDistinct("to_id").alias("n"), F.min("to_id").alias("first"))


def interaction_points(edges: DataFrame, of: DataFrame, callers: int = 5) -> DataFrame:
    pairs = edges.select("from_id", "to_id").distinct()
    calling = pairs.join(of.select(F.col("id").alias("to_id")), "to_id", "left_semi").withColumn("r", F.row_number().over(W.partitionBy("to_id").orderBy("from_id"))).filter(F.col("r") <= callers)
    sides = calling.select(F.col("to_id").alias("target"), F.col("from_id").alias("caller")).join(pairs.select(F.col("from_id").alias("caller"), F.col("to_id").alias("sibling")), "caller")
    return sides.filter("sibling <> target").select("target", "caller", "sibling").distinct()


def any_of(text: Column, phrases: Sequence[str]) -> Column:
    """Whether a text holds one of some phrases, as they stand."""
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


def normalized(question: Column) -> Column:
    """A question without white space around it, double spaces, question marks, commas and quotes."""
    out = F.regexp_replace(F.coalesce(question, F.lit("")), r"^\s+|\s+$", "")
    for old, new in (("  ", " "), ("?", ""), (",", " "), ("'", ""), ('"', "")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def intent(text: Column) -> Column:
    """The intent of a normalized question."""
    low, out = F.lower(text), F.lit(GENERAL)
    for name, phrases in reversed(INTENTS.items()):
        out = F.when(any_of(low, phrases), name).otherwise(out)
    return out


def entities(text: Column, words: int = 10) -> Column:
    """Names among the first words: capitalized or dotted, once whatever their case, in order."""
    first = F.slice(F.filter(F.split(text, " "), lambda w: w != ""), 1, words)
    names = F.filter(first, lambda w: (w.rlike(r"^\p{Lu}") & (F.length(w) > 2)) | (w.contains(".") & (F.length(w) > 3)))
    lower = F.transform(names, F.lower)
    return F.array_sort(F.filter(names, lambda w, i: F.array_position(lower, F.lower(w)) == i + 1))


def interpret(questions: DataFrame) -> DataFrame:
    """(item_id, t, intent, entities, confidence): questions read; confidence 2 with an intent and names, 1 with either, else 0."""
    rows = questions.select("item_id", normalized(F.col("text")).alias("t"))
    rows = rows.withColumns({"intent": intent(F.col("t")), "entities": entities(F.col("t"))})
    return rows.withColumn("confidence", (F.col("intent") != GENERAL).cast("int") + (F.size("entities") > 0).cast("int"))


def matching_nodes(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(item_id, node): the first node by id whose label, class or method holds a whole question (item_id, t), whatever the case."""
    asked = questions.select("item_id", F.lower("t").alias("s"))
    names = nodes.select("id", F.explode(F.array_distinct(F.transform(F.array("label", "class_name", "method_name"), lambda x: F.lower(F.coalesce(x, F.lit("")))))).alias("l"))
    first = names.groupBy("l").agg(F.min("id").alias("id"))
    found = contained(asked.select("s").distinct(), first.select("l")).join(first, "l").groupBy("s").agg(F.min("id").alias("node"))
    least = nodes.agg(F.min("id").alias("node")).select(F.lit("").alias("s"), "node").filter("node is not null")  # nothing is in everything
    return asked.join(found.unionByName(least), "s").select("item_id", "node")


def route(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(item_id, engine, confidence, target): where each question goes. 2 is high, 1 medium, 0 low confidence."""
    rows = cut(interpret(questions))
    found = matching_nodes(rows.filter(F.col("intent") == GENERAL), nodes)
    named = F.size("entities") > 0
    engine = F.coalesce(*[F.when(F.col("intent") == k, v) for k, v in ENGINES.items()], F.when(F.col("node").isNotNull(), "impact"), F.lit("architecture"))
    sure = F.when(F.col("intent").isin("impact", "debug"), F.when(named, 2).otherwise(1)).when(F.col("intent") != GENERAL, F.when(F.col("confidence") >= 1, 2).otherwise(1))
    sure = sure.when(F.col("node").isNotNull(), 1).otherwise(0)
    return rows.join(found, "item_id", "left").select("item_id", engine.alias("engine"), sure.alias("confidence"), F.col("node").alias("target"))
