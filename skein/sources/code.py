"""Source trees: projects, files, units (methods with their bodies), calls, and XML declarations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that hold no sources.
SKIPPED = ("bin", "obj", ".git", ".vs", "node_modules")
PROJECT_LINE = r'(?m)^Project\("[^"]*"\)\s*=\s*"[^"]*",\s*"([^"]+\.csproj)"'
METHOD = r"(?:public|private|protected|internal)\s+(?:static\s+|async\s+|virtual\s+|override\s+)*[\w<>\[\],]+\s+(\w+)\s*\("


def not_skipped(path: Column) -> Column:
    return ~path.rlike("(^|[/\\\\])(" + "|".join(s.replace(".", "\\.") for s in SKIPPED) + ")[/\\\\]")


def projects(solutions: DataFrame) -> DataFrame:
    """(path): project files named in solutions (path, text), each once in any case, sorted."""
    named = solutions.select(F.explode(F.regexp_extract_all("text", F.lit(PROJECT_LINE), 1)).alias("path"))
    clean = named.select(F.translate("path", "\\", "/").alias("path")).filter(not_skipped(F.col("path")))
    return clean.groupBy(F.lower("path").alias("key")).agg(F.min("path").alias("path")).select("path").orderBy(F.lower("path"))


def files(spark: SparkSession, root: str, pattern: str = "*.cs") -> DataFrame:
    """(path, text) of all files below ``root`` that match, skipped folders left out."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    return rows.select("path", F.decode("content", "UTF-8").alias("text")).filter(not_skipped(F.col("path")))


def methods(sources: DataFrame) -> DataFrame:
    """(path, method_name): declared methods by pattern; a full parse is the task of whoever fills the unit tables."""
    return sources.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(METHOD), 1))).alias("method_name"))


_MASKED = re.compile(r"//[^\n]*|/\*.*?\*/|[$]?@\"(?:[^\"]|\"\")*\"|[$]?\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'", re.DOTALL)
_SCOPE = re.compile(r"\b(namespace|class|struct|interface|record)\s+([\w.]+)")
_DECLARED = re.compile(r"([\w.<>\[\],?]+)\s+(\w+)\s*(?:<[^()]*>)?\s*\(((?:[^()]|\([^()]*\))*)\)\s*(?:where\b[^{;=]*)?$")
_MODIFIERS = frozenset("public private protected internal static unsafe extern".split())
_WORDS = frozenset("if for foreach while switch catch using lock fixed return new else when".split())


def masked(text: str) -> str:
    """A source with comments and literals blanked out, every character in its place."""
    return _MASKED.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _parameters(listed: str) -> list[str]:
    """Types of declared parameters: what stands before the name, without modifiers and defaults."""
    out, depth, part = [], 0, ""
    for c in listed + ",":
        depth += (c in "<[") - (c in ">]")
        if c == "," and not depth:
            words = [w for w in part.split("=")[0].split() if w not in ("ref", "out", "in", "params", "this")]
            out += [" ".join(words[:-1])] if len(words) > 1 else []
            part = ""
        else:
            part += c
    return out


def declared_units(text: str) -> Iterator[tuple[str, str, str, list[str], str]]:
    """(namespace, class, method, parameter types, body) of the methods of a source, those with blocks and those with an expression."""
    code = masked(text)
    scopes: list[tuple[str, str, list[str], int]] = []  # kind, name, parameters, where the body starts
    start = 0
    file_scope = re.search(r"\bnamespace\s+([\w.]+)\s*;", code)

    def method(head: str) -> re.Match | None:
        """A declared method; a constructor has no type."""
        d = _DECLARED.search(head)
        return d if d and d[1] not in _MODIFIERS and d[2] not in _WORDS and d[1] not in _WORDS else None

    def place() -> tuple[str, str]:
        spaces = [n for k, n, _, _ in scopes if k == "namespace"] or ([file_scope[1]] if file_scope else [])
        return ".".join(spaces), ".".join(n for k, n, _, _ in scopes if k == "class")

    for m in re.finditer(r"[{};]|=>", code):
        at, mark = m.start(), m.group()
        head = code[start:at].strip()
        inside = bool(scopes) and scopes[-1][0] == "class"
        if mark == "=>":
            if inside and (d := method(head)):
                end = code.find(";", at)
                yield (*place(), d[2], _parameters(d[3]), text[at + 2 : end if end >= 0 else len(text)].strip())
            continue
        if mark == "{":
            if n := _SCOPE.search(head):
                scopes.append(("namespace" if n[1] == "namespace" else "class", n[2], [], at + 1))
            elif inside and (d := method(head)):
                scopes.append(("method", d[2], _parameters(d[3]), at + 1))
            else:
                scopes.append(("block", "", [], at + 1))
        elif mark == "}" and scopes:
            kind, name, listed, begun = scopes.pop()
            if kind == "method":
                yield (*place(), name, listed, text[begun:at].strip())
        start = at + 1


def units(sources: DataFrame) -> DataFrame:
    """(path, namespace, class_name, method_name, parameters, content): every method of sources (path, text) with its body."""

    def run(parts):
        for part in parts:
            rows = [(path, *u) for path, text in zip(part["path"], part["text"], strict=True) for u in declared_units(text or "")]
            yield pd.DataFrame(rows, columns=["path", "namespace", "class_name", "method_name", "parameters", "content"])

    return sources.select("path", "text").mapInPandas(run, "path string, namespace string, class_name string, method_name string, parameters array<string>, content string")


def invocations_of(body: str) -> Iterator[tuple[str, str, int]]:
    """(receiver, name, arguments) of the calls in a body, in order."""
    code = masked(body)
    for m in re.finditer(r"(?:([\w.]+)\s*\.\s*)?\b([A-Za-z_]\w*)\s*(?:<[\w.<>,\s]*>)?\s*\(", code):
        if m[2] in _WORDS or re.search(r"\bnew\s+$", code[: m.start()]):
            continue
        depth, n, filled = 1, 0, False
        for c in code[m.end() :]:
            depth += (c in "([{") - (c in ")]}")
            if not depth:
                break
            n += c == "," and depth == 1
            filled |= not c.isspace()
        literal = bool(body[m.end() :].lstrip()) and not body[m.end() :].lstrip().startswith(")")
        yield m[1] or "", m[2], n + 1 if filled or literal else 0


def invocations(found: DataFrame) -> DataFrame:
    """(unit_id, seq, receiver, name, arguments) of the calls in units (unit_id, content)."""

    def run(parts):
        for part in parts:
            rows = [(u, i, *c) for u, body in zip(part["unit_id"], part["content"], strict=True) for i, c in enumerate(invocations_of(body or ""))]
            yield pd.DataFrame(rows, columns=["unit_id", "seq", "receiver", "name", "arguments"])

    kind = found.schema["unit_id"].dataType.simpleString()
    return found.select("unit_id", "content").mapInPandas(run, f"unit_id {kind}, seq int, receiver string, name string, arguments int")


def resolved(calls: DataFrame, found: DataFrame) -> DataFrame:
    """Calls with ``target`` (a unit_id, or the name alone) and ``way``: symbol, candidate, delegate or external.

    A symbol is a method of the called class (its own without a receiver) with as many parameters; else the first method by id with
    the name and as many parameters is a candidate; ``Invoke`` on a name is a delegate; what is left is external.
    ``found``: (unit_id, class_name, method_name, parameters).
    """
    own = found.select("unit_id", F.col("class_name").alias("own_class"))
    methods = found.select(F.col("unit_id").alias("target"), F.substring_index("class_name", ".", -1).alias("cls"), F.col("method_name").alias("name"), F.size("parameters").alias("arguments"))
    rows = calls.join(own, "unit_id").withColumn("cls", F.substring_index(F.when(F.col("receiver").isin("", "this", "base"), F.col("own_class")).otherwise(F.col("receiver")), ".", -1))
    exact = methods.groupBy("cls", "name", "arguments").agg(F.min("target").alias("symbol"))
    first = methods.groupBy("name", "arguments").agg(F.min("target").alias("candidate"))
    rows = rows.join(exact, ["cls", "name", "arguments"], "left").join(first, ["name", "arguments"], "left")
    delegate = (F.col("name") == "Invoke") & (F.col("receiver") != "")
    way = F.when(F.col("symbol").isNotNull(), "symbol").when(F.col("candidate").isNotNull(), "candidate").when(delegate, "delegate").otherwise("external")
    target = F.coalesce("symbol", "candidate", F.when(delegate, F.substring_index("receiver", ".", -1)), "name")
    return rows.select("unit_id", "seq", "receiver", "name", "arguments", target.alias("target"), way.alias("way"))


def beans(spark: SparkSession, path: str) -> DataFrame:
    """(bean_id, type_name, ref) of ``<object id type><property ref/></object>``; a bean without references has one row."""
    whole = spark.read.text(path, wholetext=True)
    found = whole.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<object\s[^>]*?(?:/>|>.*?</object>)"), 0)).alias("x"))
    refs = found.select(F.xpath_string("x", F.lit("/object/@id")).alias("bean_id"), F.substring_index(F.xpath_string("x", F.lit("/object/@type")), ",", 1).alias("type_name"), F.xpath("x", F.lit("/object/property/@ref")).alias("refs"))
    return refs.select("bean_id", "type_name", F.explode_outer("refs").alias("ref")).na.fill("", ["ref"])


def mappings(spark: SparkSession, path: str) -> DataFrame:
    """(class_name, table_name, file) of ``<class name table/>``."""
    rows = spark.read.format("xml").option("rowTag", "class").schema("_name string, _table string").load(path)
    return rows.select(F.substring_index(F.substring_index("_name", ",", 1), ".", -1).alias("class_name"), F.coalesce("_table", F.lit("")).alias("table_name"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))
