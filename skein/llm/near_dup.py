"""Operator 6: near duplicates by an LSH forest.

1. Each document becomes a set of word shingles, its digest and a MinHash
   signature. Equal sets are one class; only one member of a class goes on.
2. Each of TREES sorted orders takes the signature from another place on; in a
   sorted order, rows with a longer common prefix stand closer. A region is a
   run of rows that agree on the first DEPTH values. Its depth adapts to it:
   where a run has more than SMALL rows, its parts that agree on one value more
   take its place, down to DEEPEST. All pairs of a run that is small enough are
   candidates, and in a larger one each row and the next, its neighbour by
   longest common prefix.
3. Candidates are confirmed on full sets and joined into components.
4. Going deeper can pass by a pair that agrees on DEPTH values and no more. So
   regions of more than SMALL rows, and those cut by a partition's end, are
   settled exactly: where their members are not yet one component, the members
   outside its largest one are compared with all others of the region, on full
   sets, in blocks of bounded size. So no pair of a region is lost; two documents
   of the least similarity share no region with a probability of
   (1 - similarity ** DEPTH) ** TREES, below 1e-6 at 0.85.

Scale: orders are sorted by range, so a region that holds a third of all rows
is spread over tasks; a hot group is settled by its links, not by its pairs.
What is joined by region or component is written first, so that Spark can split
hot ones. Settling takes time with the square of the members of a region that are
outside its largest component, in blocks that are dealt over all tasks.

Defined results: null and empty texts, and texts without words, have no
shingles and are linked with nothing; a very long text is read whole; rows that
share a doc_id are judged row by row, each by its own text; a row without doc_id
is linked with nothing, has a null component and is kept; an empty table gives an
empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, arrow_map, cut, parts_for, release, shingle_hashes, space_words
from .components import components

SHINGLE, PERCENT = 3, 85
TREES, DEPTH, DEEPEST = 20, 4, 8
#: Largest region of which all pairs are candidates, and rows of a block of a larger one.
SMALL, BLOCK = 8, 1024


def shingle_set(text: str | None, hashes: WordHash, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a text of fewer words is one shingle."""
    words = space_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(shingle_hashes(hashes.array(words), min(k, len(words))) + np.uint64(min(k, len(words))))


def factors(n: int) -> np.ndarray:
    """Odd multipliers of the signature's hash functions."""
    return np.array([int.from_bytes(hashlib.sha256(b"minhash %d" % i).digest()[:8], "little") | 1 for i in range(n)], np.uint64)


def signature(shingles: np.ndarray, by: np.ndarray) -> np.ndarray:
    least = np.full(len(by), ~np.uint64(0))
    for i in range(0, len(shingles), 512):
        np.minimum(least, (shingles[i : i + 512, None] * by).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(">u4")


def sketches(documents: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, digest, sig) of each row; digest and sig are null without shingles."""

    def run(batches):
        hashes, by = WordHash(), factors(TREES * DEPTH)
        for b in batches:
            out: dict[str, list] = {"doc_id": b["doc_id"], "n_shingles": [], "digest": [], "sig": []}
            for text in b["text"]:
                s = shingle_set(text, hashes, k)
                out["n_shingles"].append(len(s))
                out["digest"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                out["sig"].append(signature(s, by).tobytes() if len(s) else None)
            yield out

    kind = documents.schema["doc_id"].dataType.simpleString()
    return arrow_map(documents.select("doc_id", "text"), run, f"doc_id {kind}, n_shingles bigint, digest binary, sig binary")


def orders(classes: DataFrame) -> DataFrame:
    """(region, deeper, id, n): a row for each class and tree. ``region``: the tree and the first values of its order."""

    def run(batches):
        for b in batches:
            out: dict[str, list] = {"region": [], "deeper": [], "id": [], "n": []}
            for i, n, sig in zip(b["id"], b["n"], b["sig"], strict=True):
                twice = sig + sig
                for t in range(TREES):
                    at = 4 * DEPTH * t
                    out["region"].append(bytes([t]) + twice[at : at + 4 * DEPTH])
                    out["deeper"].append(twice[at + 4 * DEPTH : at + 4 * DEEPEST])
                    out["id"].append(i)
                    out["n"].append(n)
            yield out

    return arrow_map(classes.select("id", "n", "sig"), run, "region binary, deeper binary, id binary, n bigint")


class Descent:
    """Candidates of one region, whose rows come in sorted order.

    A level holds the run of rows that agree with the last one on so many values
    beyond the region's. Pairs of a run of at most SMALL rows wait until it is
    known whether the level above is small as well, whose pairs contain them.
    """

    LEVELS = DEEPEST - DEPTH + 1

    def __init__(self, put) -> None:
        self.put, self.deeper, self.size = put, b"", 0
        self.runs: list[list] = [[] for _ in range(self.LEVELS)]
        self.waiting: list[list] = [[] for _ in range(self.LEVELS)]

    def common(self, deeper: bytes) -> int:
        """Values that a row has in common with the one before."""
        n = 0
        while n < self.LEVELS - 1 and deeper[4 * n : 4 * n + 4] == self.deeper[4 * n : 4 * n + 4]:
            n += 1
        return n

    def add(self, row, deeper: bytes) -> None:
        if self.size:
            self.close(self.common(deeper) + 1)
            if self.size >= SMALL:
                if self.size == SMALL:
                    for pair in zip(self.runs[0], self.runs[0][1:], strict=False):
                        self.put(*pair)
                self.put(self.last, row)
        for level, run in enumerate(self.runs):
            run.append(row)
            if len(run) == SMALL + 1:  # too large: what waits below stands, and no more than that is kept
                for pair in self.waiting[level]:
                    self.put(*pair)
                self.waiting[level] = []
            elif len(run) > SMALL + 1:
                run.pop()
        self.deeper, self.last, self.size = deeper, row, self.size + 1

    def close(self, level: int = 0) -> None:
        """Ends the runs from a level on, the deepest first."""
        for at in range(self.LEVELS - 1, level - 1, -1):
            run = self.runs[at]
            if len(run) <= SMALL:
                pairs = [(run[i], run[j]) for i in range(len(run)) for j in range(i)]
                if at and len(self.runs[at - 1]) <= SMALL:
                    self.waiting[at - 1] += pairs
                else:
                    for pair in pairs:
                        self.put(*pair)
            self.runs[at], self.waiting[at] = [], []


def candidates(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, region) from rows in sorted order: pairs with a null region, and members (a) of regions left open.

    Open are regions of more than SMALL rows, and a partition's first and last one.
    """

    def run(batches):
        out: dict[str, list] = {"a": [], "b": [], "region": []}

        def put(a, b, region):
            out["a"].append(a)
            out["b"].append(b)
            out["region"].append(region)

        def pair(x, y):
            if 100 * min(x[1], y[1]) >= percent * max(x[1], y[1]) and x[0] != y[0]:
                put(max(x[0], y[0]), min(x[0], y[0]), None)

        def end(whole):
            if own.size <= SMALL and not whole:
                for x in own.runs[0]:
                    put(x[0], None, region_of)
            own.close()

        own, region_of, first = None, None, True
        for b in batches:
            for region, deeper, i, n in zip(b["region"], b["deeper"], b["id"], b["n"], strict=True):
                if region != region_of:
                    if own is not None:
                        end(not first)
                        first = False
                    own, region_of = Descent(pair), region
                if own.size == SMALL:
                    for x in own.runs[0]:
                        put(x[0], None, region)
                if own.size >= SMALL:
                    put(i, None, region)
                own.add((i, n), deeper)
            yield dict(out)
            out.update(a=[], b=[], region=[])
        if own is not None:
            end(False)
        yield dict(out)

    return arrow_map(rows, run, "a binary, b binary, region binary")


def full_sets(documents: DataFrame, named: DataFrame, k: int) -> DataFrame:
    """(id, shingles) of the classes in ``named`` (id, doc_id), from the text of the document that stands for each."""

    def run(batches):
        hashes = WordHash()
        for b in batches:
            sets = [shingle_set(t, hashes, k).tobytes() for t in b["text"]]
            yield {"id": [hashlib.blake2b(s, digest_size=16).digest() for s in sets], "shingles": sets}

    texts = documents.select("doc_id", "text").join(named.select("doc_id").distinct(), "doc_id", "left_semi")
    return arrow_map(texts, run, "id binary, shingles binary").join(named.select("id"), "id", "left_semi").dropDuplicates(["id"])


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    at = lambda end: sets.select(F.col("id").alias(end), F.col("shingles").alias(f"of_{end}"))

    def run(batches):
        for b in batches:
            read = [(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b["of_a"], b["of_b"], strict=True)]
            good = [i for i, (x, y) in enumerate(read) if similar(x, y, percent)]
            yield {"a": [b["a"][i] for i in good], "b": [b["b"][i] for i in good]}

    return arrow_map(pairs.join(at("b"), "b").join(at("a"), "a"), run, "a binary, b binary")


def settle(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components within a region. ``rows``: (region, id, label, shingles) of open regions.

    Per region, members outside its most common component are compared with all
    members in blocks of BLOCK by BLOCK rows; each gives one link per component
    that it is similar to.
    """
    sizes = rows.groupBy("region", "label").agg(F.count("*").alias("c"))
    regions = sizes.groupBy("region").agg(F.sum("c").alias("m"), F.max(F.struct("c", "label"))["label"].alias("main"), F.max("c").alias("top"))
    regions = regions.filter("m > top")
    regions = cut(regions.select("region", "main", F.ceil(F.col("m") / BLOCK).alias("mb"), F.ceil((F.col("m") - F.col("top")) / BLOCK).alias("qb")))
    held = rows.join(regions, "region").withColumn("h", F.abs(F.xxhash64("id") % 1_000_000_007))
    members = held.select("region", "id", "label", "shingles", (F.col("h") % F.col("mb")).alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("qb") - 1)).alias("y"), F.lit(0).alias("asks"))
    asking = held.filter("label <> main").select("region", "id", "label", "shingles", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mb") - 1)).alias("x"), (F.col("h") % F.col("qb")).alias("y"), F.lit(1).alias("asks"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        own, links = group[group.asks == 0], []
        sets = [np.frombuffer(s, np.uint64) for s in own.shingles]
        ids, labels, lengths = own.id.tolist(), own.label.tolist(), np.array([len(s) for s in sets])
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(sets)), lengths)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        for i, label, raw in zip(*(group[group.asks == 1][c] for c in ("id", "label", "shingles")), strict=True):
            s = np.frombuffer(raw, np.uint64)
            low, high = np.searchsorted(flat, s), np.searchsorted(flat, s, side="right")
            n = high - low
            hits = owner[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
            both = np.bincount(hits, minlength=len(sets))
            seen = {label}
            for j in np.flatnonzero(100 * both >= percent * (lengths + len(s) - both)):
                if labels[j] not in seen:
                    seen.add(labels[j])
                    links.append((i, ids[j]))
        return pd.DataFrame(links, columns=["a", "b"])

    return members.unionByName(asking).groupBy("region", "x", "y").applyInPandas(compare, "a binary, b binary")


def near_duplicates(documents: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row."""
    parts = parts_for(documents)
    base = cut(sketches(documents, k).coalesce(parts))
    linkable = base.filter("digest is not null and doc_id is not null")
    classes = cut(linkable.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")).withColumnRenamed("digest", "id").coalesce(parts))
    rows = orders(classes).repartitionByRange("region", "deeper", "id").sortWithinPartitions("region", "deeper", "id")
    found = cut(candidates(rows, percent).coalesce(parts))
    pairs = found.filter("region is null").select("a", "b").distinct()
    loose = found.filter("region is not null").select("region", F.col("a").alias("id"))
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(loose.select("id")).distinct()
    sets = cut(full_sets(documents, classes.select("id", "doc_id").join(ids, "id", "left_semi"), k).coalesce(parts))
    first = components(confirmed(pairs, sets, percent), parts)
    release(documents.sparkSession)
    labelled = loose.join(first.select(F.col("node").alias("id"), F.col("component").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = cut(labelled.groupBy("region").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("region"))
    more = cut(settle(labelled.join(mixed, "region", "left_semi").join(sets, "id"), percent).coalesce(parts))
    both = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), parts) if not more.isEmpty() else first
    tops = classes.select("id", "doc_id").join(both.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = cut(tops.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    of = tops.join(least, "component").select(F.col("id").alias("digest"), "component_id")
    own = base.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    component = F.coalesce("component_id", "doc_id")
    return own.join(of, "digest", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
