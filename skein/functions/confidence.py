"""Confidence and truth as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least score of each level, from certain (0) to speculative (4); below is unsupported (5).
LEVELS = (0.95, 0.8, 0.6, 0.4, 0.2)
SPECULATIVE_CAP = 0.55
#: Base truth of an edge's evidence.
EVIDENCE = {"semantic": 1.0, "syntax": 0.8, "analyzer-exact": 0.9, "analyzer-high": 0.75, "analyzer-medium": 0.55, "analyzer-low": 0.3, "pattern": 0.25, "inferred": 0.15}
UNKNOWN_EVIDENCE = 0.1
DECAY = 0.7


def level(score: Column, speculative: Column | None = None) -> Column:
    """0 certain, 1 strong, 2 moderate, 3 weak, 4 speculative, 5 unsupported; a speculative ancestor caps the score first."""
    if speculative is not None:
        score = F.when(speculative, F.least(score, F.lit(SPECULATIVE_CAP))).otherwise(score)
    out = F.lit(len(LEVELS))
    for i, least in reversed(list(enumerate(LEVELS))):
        out = F.when(score >= least, i).otherwise(out)
    return out


def evidence_truth(evidence: Column, grounded: Column) -> Column:
    """Base truth of an edge's evidence, half of it if neither end is grounded."""
    out = F.lit(UNKNOWN_EVIDENCE)
    for name, value in EVIDENCE.items():
        out = F.when(evidence == name, value).otherwise(out)
    return F.when(grounded, out).otherwise(out * 0.5)


def decayed(value: Column, steps: Column) -> Column:
    return value * F.pow(F.lit(DECAY), steps)


def truth_class(value: Column, grounded: Column) -> Column:
    return F.when(grounded & (value >= 0.8), "fact").when(value >= 0.4, "inferred").otherwise("uncertain")


def truth_from_level(name: Column) -> Column:
    return F.when(name == "exact", 1.0).when(name == "high", 0.85).when(name == "medium", 0.6).otherwise(0.3)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
