"""Connected components of a table of links, by alternating star contractions.

Each round replaces the links of a node by links to its smallest neighbour,
first from the larger neighbours, then from the smaller ones. The number of
rounds grows with the logarithm of the longest path. Links stay in tables; only
a sum of their hashes reaches the driver. Each round's table is written in as
many parts as its links need, which are counted anyway. Smallest neighbours are
written before they are joined, so that a node with a third of all links can be
split over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Links of one part of a round's table.
PART = 250_000


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(e: DataFrame) -> DataFrame:
    least = cut(e.groupBy("a").agg(F.min("b").alias("m")))
    moved = e.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, parts: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, for each node with a link. ``links``: (a, b), in any direction.

    ``parts``: parts in which the links are cut at first.
    """
    e = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut(e if parts is None else e.coalesce(parts))
    mark = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        e = cut(_small(_large(e)).coalesce(-(-now[0] // PART)))  # a round does not add links
    tops = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)
