"""Operator 3: benchmark decontamination with an FM-index per training shard.

A shard is a bounded run of documents of one partition. Its words become
symbols, its documents one sequence, and an FM-index is built over it: suffix
array, Burrows-Wheeler transform in a wavelet tree, sampled suffix positions.
All test windows are searched backwards at once through wavelet-tree ranks; the
rows found walk back to sampled positions, which gives each occurrence's place.
Overlapping occurrences merge into the spans to remove.

Before that, a prefilter: words that occur in no test item cannot be inside an
occurrence. They are separators, so only the stretches between them that are at
least as long as the shortest window are put into the index; a shard made of
benchmark words is indexed whole. This loses nothing and keeps the index small.

Nothing is shuffled. The windows go to the executors in blocks of items whose
text is bounded (BLOCK_BYTES); a larger benchmark takes more passes.

Defined results: null and empty texts have no words; null or empty items have
no windows; an item without item_id hits like any other, but has no id to be
counted or named by; repeated items and documents each get their result; items
with the same words are both named; a very long text is a shard of its own; an
empty table on either side gives n_hit 0 or no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, arrow_map, cut

WINDOW = 10
#: Bytes of test items searched in one pass, and text characters indexed in one shard.
BLOCK_BYTES, SHARD_CHARS, SAMPLE = 32_000_000, 24_000_000, 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of the sorted suffixes, by doubling the length that is ordered; only unsettled ones are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    starts = np.r_[True, text[order][1:] != text[order][:-1]]
    rank[order] = np.flatnonzero(starts)[np.cumsum(starts) - 1]
    k = 1
    while True:
        ties = np.r_[starts, True]
        open_ = np.flatnonzero(~(ties[:-1] & ties[1:]))  # rows of groups of two and more
        if not len(open_):
            return order
        at = order[open_]
        second = np.where(at + k < n, rank[np.minimum(at + k, n - 1)], -1)
        by = np.lexsort((second, rank[at]))
        order[open_] = at[by]
        first, second = rank[order[open_]], second[by]
        starts[open_] = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        heads = np.where(starts[open_], open_, 0)
        rank[order[open_]] = np.maximum.accumulate(heads)
        k *= 2


class Wavelet:
    """Ranks of symbols in a sequence: one bit row a level, with counts of ones before each place."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bits = (sequence >> level) & 1
            self.ones.append(np.r_[0, np.cumsum(bits)].astype(np.int32))
            self.zeros.append(int(len(bits) - bits.sum()))
            sequence = np.concatenate([sequence[bits == 0], sequence[bits == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low = np.zeros_like(at)
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            ones, bit = self.ones[i], (symbol >> level) & 1
            a, b = ones[low], ones[at]
            low = np.where(bit == 1, self.zeros[i] + a, low - a)
            at = np.where(bit == 1, self.zeros[i] + b, at - b)
        return at - low

    def symbol(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it stands before it."""
        low, found = np.zeros_like(at), np.zeros_like(at)
        for i in range(self.levels):
            ones = self.ones[i]
            a, b = ones[low], ones[at]
            bit = ones[at + 1] - b
            found = 2 * found + bit
            low = np.where(bit == 1, self.zeros[i] + a, low - a)
            at = np.where(bit == 1, self.zeros[i] + b, at - b)
        return found, at - low


class FmIndex:
    """Backward search over a sequence of symbols from 1 on; 0 ends it."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        text = np.r_[text, 0].astype(np.int64)
        order = suffix_array(text)
        self.tree = Wavelet(text[order - 1], symbols)
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=symbols))].astype(np.int64)
        kept = order % SAMPLE == 0
        self.sampled = np.r_[0, np.cumsum(kept)]
        self.places = order[kept]
        self.size = len(text)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the patterns (one a line, filled up on the left)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        for step in range(patterns.shape[1]):
            on = np.flatnonzero((step < lengths) & (low < high))
            if not len(on):
                break
            c = patterns[on, patterns.shape[1] - 1 - step]
            low[on] = self.before[c] + self.tree.rank(c, low[on])
            high[on] = self.before[c] + self.tree.rank(c, high[on])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of rows: back through the text until a row's place is sampled."""
        out, steps, on = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.astype(np.int64)
        while len(on):
            hit = self.sampled[rows + 1] > self.sampled[rows]
            out[on[hit]] = self.places[self.sampled[rows[hit]]] + steps
            on, rows = on[~hit], rows[~hit]
            c, before = self.tree.symbol(rows)
            rows, steps = self.before[c] + before, steps + 1
        return out


class Phrases:
    """The windows of a block of test items, as symbols."""

    def __init__(self, items: list[tuple], window: int) -> None:
        self.symbol: dict[bytes, int] = {}
        windows: dict[tuple, list[int]] = {}
        self.items = [None if i is None else str(i) for i, _ in items]
        for k, (_, text) in enumerate(items):
            words = [self.symbol.setdefault(w, len(self.symbol) + 2) for w in alnum_words(text)]
            for i in range(max(0, len(words) - window) + 1 if words else 0):
                owners = windows.setdefault(tuple(words[i : i + window]), [])
                if not owners or owners[-1] != k:
                    owners.append(k)
        self.owners = list(windows.values())
        self.lengths = np.array([len(w) for w in windows] or [0], np.int64)
        self.patterns = np.zeros((len(self.lengths), window), np.int64)
        for row, w in enumerate(windows):
            self.patterns[row, window - len(w) :] = w
        self.shortest = int(self.lengths.min()) if windows else 0


def search_shard(phrases: Phrases, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[int]]]:
    """For each text: words, merged spans [start, end) of hit words, items found."""
    symbol = phrases.symbol
    n_words, parts, places = [], [], []
    offset = 0  # of the documents' words, one place between documents
    for text in texts:
        words = alnum_words(text)
        n_words.append(len(words))
        if phrases.shortest and words:
            ids = np.fromiter((symbol.get(w, 1) for w in words), np.int64, len(words))
            outside = np.flatnonzero(np.r_[True, ids == 1, True])
            for k in np.flatnonzero(np.diff(outside) > phrases.shortest):
                a, b = outside[k], outside[k + 1] - 1
                parts += [ids[a:b], [1]]
                places.append(np.arange(offset + a, offset + b + 1))
        offset += len(words) + 1
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[int]] = [set() for _ in texts]
    if parts:
        index = FmIndex(np.concatenate(parts), len(symbol) + 2)
        place = np.concatenate(places)
        low, high = index.search(phrases.patterns, phrases.lengths)
        found = high - low
        which = np.repeat(np.arange(len(found)), found)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(found) - found, found) + np.repeat(low, found)
        starts = place[index.locate(rows)]
        ends = starts + phrases.lengths[which]
        bounds = np.cumsum(np.asarray(n_words) + 1)
        doc = np.searchsorted(bounds, starts, side="right")
        base = np.r_[0, bounds]
        for i in np.lexsort((ends, starts)):
            d = doc[i]
            a, b = int(starts[i] - base[d]), int(ends[i] - base[d])
            items[d].update(phrases.owners[which[i]])
            if spans[d] and a <= spans[d][-1][1]:
                spans[d][-1] = (spans[d][-1][0], max(b, spans[d][-1][1]))
            else:
                spans[d].append((a, b))
    return list(zip(n_words, spans, items, strict=True))


def shards(batches, chars: int):
    """Joins Arrow batches into runs of documents of at most ``chars`` characters (or one document)."""
    held: dict[str, list] = {}
    size = 0
    for b in batches:
        start = 0
        for i, t in enumerate(b["text"]):
            n = len(t or "")
            if size and size + n > chars:
                for k, v in b.items():
                    held.setdefault(k, []).extend(v[start:i])
                yield held
                held, size, start = {}, 0, i
            size += n
        for k, v in b.items():
            held.setdefault(k, []).extend(v[start:])
    if held and held["text"]:
        yield held


def item_blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> list[list[tuple]]:
    """The items in blocks of about ``limit`` bytes of text, one at least; each is read when it is searched."""
    rows = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / limit))
    if n == 1:
        return [[tuple(r) for r in rows.collect()]]
    return (  # one block in the driver at a time
        [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()] for k in range(n)
    )


def find_items(documents: DataFrame, items: list[tuple], window: int = WINDOW) -> DataFrame:
    """(doc_id, row, n_words, spans, items) of each document against one block of items."""
    sent = documents.sparkSession.sparkContext.broadcast(items)  # bounded by the block

    def run(batches):
        phrases = Phrases(sent.value, window)
        for shard in shards(batches, SHARD_CHARS):
            found = search_shard(phrases, shard["text"])
            yield {
                "doc_id": shard["doc_id"],
                "row": shard["row"],
                "n_words": [n for n, _, _ in found],
                "spans": [[{"start": a, "end": b} for a, b in s] for _, s, _ in found],
                "items": [sorted({phrases.items[k] for k in i} - {None}) for _, _, i in found],
            }

    kind = documents.schema["doc_id"].dataType.simpleString()
    return arrow_map(documents.select("doc_id", "row", "text"), run, f"doc_id {kind}, row bigint, n_words bigint, spans array<struct<start:int,end:int>>, items array<string>")


def merge_spans(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items) of each document: word spans [start, end) to remove and the items they come from."""
    rows, blocks_ = documents.select("doc_id", F.lit(0).cast("long").alias("row"), "text"), item_blocks(benchmark, block_bytes)
    if isinstance(blocks_, list):
        return find_items(rows, blocks_[0], window).drop("row")
    rows = cut(documents.select("doc_id", F.monotonically_increasing_id().alias("row"), "text"))
    passes = None
    for block in blocks_:
        found = cut(find_items(rows, block, window))
        passes = found if passes is None else passes.unionByName(found)
    merged = passes.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    run = lambda it: (b | {"spans": [[{"start": a, "end": e} for a, e in merge_spans(s)] for s in b["spans"]]} for b in it)
    return arrow_map(merged.select("doc_id", "n_words", "spans", "items"), run, f"doc_id {kind}, n_words bigint, spans array<struct<start:int,end:int>>, items array<string>")


#: A word of ``alnum_words`` in the text itself.
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def without_spans(text: str, spans: list[tuple[int, int]], word: re.Pattern = WORD) -> str:
    """The text without the words of the spans and what stands between them; one space joins what is left."""
    if not spans:
        return text
    at = [m.span() for m in word.finditer(text)]
    left, start = [], 0
    for a, b in spans:
        left.append(text[start : at[a][0]])
        start = at[b - 1][1]
    left.append(text[start:])
    return " ".join(x for x in (p.strip(" \t\r\n\x0b\x0c") for p in left) if x)


def digest(found: DataFrame) -> DataFrame:
    """The figures of the contract, from spans and items."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
