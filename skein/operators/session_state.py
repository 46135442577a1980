"""A conversation about a graph: follow-ups, formatting, and context around a change.

The table work is done by the other operators; here are only small values of one
session, kept by the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRONOUNS = re.compile(r"\b(it|this|that|them)\b", re.IGNORECASE)
BAR = 10


@dataclass
class Session:
    """The last target and what was asked."""

    target: str = ""
    asked: list[str] = field(default_factory=list)

    def resolve(self, question: str) -> str:
        """The question with pronouns replaced by the last target; a dotted or capitalised word becomes the target."""
        out = PRONOUNS.sub(self.target, question) if self.target else question
        if named := re.findall(r"\b[A-Z]\w*(?:\.\w+)*\b", out):
            self.target = named[-1]
        self.asked.append(out)
        return out

    def summary(self) -> dict[str, int]:
        return {"questions": len(self.asked), "distinct": len(set(self.asked))}


def bar(score: float) -> str:
    """A confidence as a bar of ten characters."""
    full = max(0, min(BAR, round(score * BAR)))
    return "#" * full + "." * (BAR - full)


def confidence_bar(score: Column) -> Column:
    full = F.greatest(F.lit(0), F.least(F.lit(BAR), F.round(score * BAR).cast("int")))
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("."), BAR - full))


def citations(rows: DataFrame) -> DataFrame:
    """(source_file, n, symbols): citations grouped by file."""
    return rows.groupBy("source_file").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("symbols"))


def context_lines(text: Column, needle: Column, around: int = 2) -> Column:
    """The lines within ``around`` of the first one that holds ``needle``."""
    lines = F.split(text, "\n")
    at = F.array_position(F.transform(lines, lambda x: F.contains(x, needle)), F.lit(True))
    first = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.array_join(F.slice(lines, first.cast("int"), (at + around - first + 1).cast("int")), "\n")).otherwise("")


def signature_changed(before: Column, after: Column) -> Column:
    """Whether the first line's declaration differs, blanks aside."""
    head = lambda c: F.regexp_replace(F.substring_index(c, "{", 1), r"\s+", " ")
    return F.trim(head(before)) != F.trim(head(after))


def build_errors(log: DataFrame) -> DataFrame:
    """(file, line, code, message) of compiler lines ``file(line,col): error CODE: message``."""
    pattern = r"^(.+?)\((\d+),\d+\): error (\w+): (.*)$"
    hit = log.filter(F.col("value").rlike(pattern))
    part = lambda i: F.regexp_extract("value", pattern, i)
    return hit.select(part(1).alias("file"), part(2).cast("int").alias("line"), part(3).alias("code"), part(4).alias("message"))
