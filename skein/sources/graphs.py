"""Graphs on disk: JSON for exchange, Parquet as a cache, and the history of what was read."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 1
_TEXT, _MAP = T.StringType(), T.MapType(T.StringType(), T.StringType())


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


NODE = _struct(
    id=_TEXT, kind=_TEXT, label=_TEXT, projectName=_TEXT, projectPath=_TEXT, namespace=_TEXT, className=_TEXT, methodName=_TEXT,
    parameterTypes=T.ArrayType(_TEXT), isExternal=T.BooleanType(), calledBy=T.ArrayType(_TEXT), attributes=_MAP,
)
EDGE = _struct(**{"from": _TEXT, "to": _TEXT, "call": _TEXT, "kind": _TEXT, "resolved": T.BooleanType(), "attributes": _MAP})
FACT = _struct(analyzer=_TEXT, subjectId=_TEXT, subjectKind=_TEXT, factType=_TEXT, sourceFile=_TEXT, data=_MAP)
GRAPH = _struct(
    scanRoot=_TEXT, schemaVersion=T.IntegerType(), generatedAt=_TEXT, nodeCount=T.LongType(), edgeCount=T.LongType(), resolvedEdgeCount=T.LongType(),
    externalNodeCount=T.LongType(), factCount=T.LongType(), nodes=T.ArrayType(NODE), edges=T.ArrayType(EDGE), facts=T.ArrayType(FACT),
)


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and facts of graph documents; a document that is not one gives no rows."""
    docs = spark.read.schema(GRAPH).option("multiLine", True).json(path)
    return tuple(docs.select(F.explode(part).alias("x")).select("x.*") for part in ("nodes", "edges", "facts"))  # type: ignore[return-value]


def write_graph_json(nodes: DataFrame, edges: DataFrame, facts: DataFrame, path: str) -> None:
    """The three parts as lines of JSON, one folder each: a graph of any size is written by many tasks."""
    for name, part in (("nodes", nodes), ("edges", edges), ("facts", facts)):
        part.write.mode("overwrite").json(f"{path}/{name}")


def read_graph_parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.schema(s).json(f"{path}/{n}") for n, s in (("nodes", NODE), ("edges", EDGE), ("facts", FACT)))  # type: ignore[return-value]


def save_cache(parts: dict[str, DataFrame], path: str) -> None:
    """Tables as Parquet with a manifest, which is written last: without it there is no cache."""
    spark = next(iter(parts.values())).sparkSession
    for name, part in parts.items():
        part.write.mode("overwrite").parquet(f"{path}/{name}")
    manifest = json.dumps({"schemaVersion": SCHEMA_VERSION, "tables": sorted(parts)})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_cache(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The cached tables; None where there are none, the version differs or they cannot be read."""
    try:
        lines = spark.read.text(f"{path}/manifest").collect()
        manifest = json.loads(lines[0][0])
        if manifest.get("schemaVersion") != SCHEMA_VERSION:
            return None
        return {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}
    except (AnalysisException, ValueError, IndexError, KeyError):
        return None


def history(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """(path, name, last_used): the last entry of each path, the latest first."""
    rows = entries.groupBy("path").agg(F.max_by("name", "last_used").alias("name"), F.max("last_used").alias("last_used")).orderBy(F.desc("last_used"), "path")
    return rows if limit is None else rows.limit(limit)


def write_snapshots(rows: DataFrame, path: str) -> None:
    """Failure snapshots as JSON lines, a folder for each mode."""
    rows.write.mode("overwrite").partitionBy("mode").json(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, label, mode): snapshots with a fixed schema; lines that are not JSON are left out."""
    rows = spark.read.schema("case_id bigint, label string, mode string, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.filter("case_id is not null").drop("_corrupt_record")


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def write_scan(units: DataFrame, path: str) -> None:
    """Units nested by project, a line of JSON each."""
    item = F.struct("class_name", "method_name")
    units.groupBy("project_name").agg(F.array_sort(F.collect_list(item)).alias("items")).write.mode("overwrite").json(path)
