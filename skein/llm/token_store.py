"""Operator 5: a content-addressed store of token ids.

Each document's ids (with an end id) form a stream. A rolling hash over a
window of ids cuts it where the hash meets a mask, so equal passages are cut
alike wherever they stand. Unique chunks are stored once under their SHA-256;
a document is a recipe, the list of its chunks, with the root of a Merkle tree
over their hashes. Everything is Parquet below one folder:

  data/kind=chunk   key (the digest), ids: little-endian unsigned 16-bit where
                    all fit, else 32-bit (the recipe's n tells which)
  data/kind=recipe  recipes as they come
  recipes/          ascending by doc_id: doc_id, row, at, n_tokens, chunks, root
  manifest/         a row a recipe file: tokens, documents, Merkle root of its roots

``read_store`` puts documents together again and checks every digest, length
and root, and each recipe file against the manifest. ``verify_store`` does so,
manifest included, without moving ids: it reads each stored chunk once where it
lies, checks its digest and takes its CRC; a document's CRC follows from those of
its chunks. A store stays until its folder is deleted.

Scale: texts are encoded once. A task sends a chunk at most once, so a passage
that a third of all documents share is sent once a task; recipes are ordered by
range; the totals that ``start`` needs are one number a file. All keys follow
from content, so a task that runs again sends the same rows.

Defined results: null and empty texts hold the end id alone; a very long text is
encoded whole, as a block of its own; null doc_ids come first; repeated rows are
documents of their own, in an order of their content; an empty table gives empty
files; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
import zlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import byte_alphabet, library, tokenizer_path
from .common import Recent, arrow_map, blocks, mix64, outlives, release, runs, shared_dir, single_spaced

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
#: Ids in the rolling window; one cut in MEAN ids on average, none before LEAST or after MOST.
WINDOW, MEAN, LEAST, MOST = 16, 256, 64, 2048
#: Runs kept encoded per worker and round, and characters of text in work at once.
KEPT_UNITS, BLOCK_CHARS = 400_000, 4_000_000


class Encoder:
    """The library's ids; texts of plain white space are encoded by the distinct runs they are made of."""

    def __init__(self, path: str) -> None:
        self.library = library(path)
        self.units = Recent(KEPT_UNITS)
        self.feed = self._library(["\n"])[0]
        # a run of letters is one piece, which the library's model encodes without the steps around it; new words come once, so nothing is cached
        self.model = pickle.loads(pickle.dumps(self.library.model))
        self.model._resize_cache(0)
        self.stand_in = dict(enumerate(byte_alphabet()))
        self.known_ids = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> None:
        """Ids of new runs. A line feed between two runs is one token."""
        words, known = self.units.recall(new), self.units.now
        letters = [w for w in words if w.isalpha() or w[:1] == " " and w[1:].isalpha()]
        tokenize, stand_in, ids = self.model.tokenize, self.stand_in, self.known_ids
        space = stand_in[32]
        for w in letters:
            coded = space + w[1:] if w[0] == " " else w
            if not w.isascii():  # of ASCII letters each is its own stand-in
                coded = w.encode().decode("latin-1").translate(stand_in)
            known[w] = b"".join([ids[t.id] for t in tokenize(coded)])
        words = list(words.difference(letters))
        for i in range(0, len(words), 50_000):
            part = [w for w in words[i : i + 50_000] if w != "\n"]
            raw = self._library(["\n".join(part)])[0]
            at = np.flatnonzero(np.frombuffer(raw, "<u4") == int.from_bytes(self.feed, "little")).tolist()
            bounds = zip([0, *(4 * x + 4 for x in at)], [*(4 * x for x in at), len(raw)], strict=True)
            known.update(zip(part, [raw[a:b] for a, b in bounds], strict=True))
        known["\n"] = self.feed

    def _joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single-spaced texts, one after the other, and the bounds of each."""
        found, first = runs(texts)
        words, which = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()
        values = list(map(self.units.now.get, words))
        if new := {w for w, v in zip(words, values, strict=True) if v is None}:
            self._learn(new)
            values = [self.units.now[w] if v is None else v for w, v in zip(words, values, strict=True)]
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        n, starts = sizes[which], (np.cumsum(sizes) - sizes)[which]
        ends = np.cumsum(n)
        at = np.repeat(starts - ends + n, n)
        at += np.arange(ends[-1])
        return np.frombuffer(b"".join(values), "<u4")[at], np.r_[0, ends][first]

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the end of each."""
        self.units.turn()
        plain = [bool(t) and "<|" not in t and single_spaced(t) for t in texts]
        whole = iter(self._library([t or "" for t, p in zip(texts, plain, strict=True) if not p]))
        joined, bounds = self._joined([t for t, p in zip(texts, plain, strict=True) if p]) if any(plain) else (np.zeros(0, "<u4"), [0])
        if all(plain):
            return joined, np.asarray(bounds[1:], np.int64)
        own = iter(np.split(joined, bounds[1:-1]))
        parts = [next(own) if p else np.frombuffer(next(whole), "<u4") for p in plain]
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        found, ends = self.ids(texts)
        return [x.tobytes() for x in np.split(found, ends[:-1])] if texts else []


@outlives
def encoder(path: str) -> Encoder:
    """One encoder a worker: its table serves all the worker's tasks."""
    return Encoder(path)


def marks(ids: np.ndarray) -> np.ndarray:
    """Where the hash of the WINDOW ids before meets the mask."""
    rolling = mix64(ids.astype(np.uint64) + np.uint64(1))
    size = 1
    while size < WINDOW:  # the sum over a window, each id shifted by its age, by windows of doubled length
        rolling[size:] += rolling[:-size] << np.uint64(size)
        size *= 2
    return np.flatnonzero(rolling >> np.uint64(64 - (MEAN.bit_length() - 1)) == 0) + 1


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of a stream, the last one its length."""
    return cuts_at(marks(ids).tolist(), 0, len(ids))


def cuts_at(places: list[int], start: int, n: int) -> list[int]:
    """Ends of the chunks of a stream that goes from ``start`` to ``n``, of its marks. Windows of LEAST ids on are its own, whatever stands before it."""
    ends = []
    for m in [*places, n]:
        while m - start > MOST:
            start += MOST
            ends.append(start)
        if m - start >= LEAST and m < n:
            ends.append(m)
            start = m
    if start < n or not ends:
        ends.append(n)
    return ends


def packed(body: bytes) -> bytes:
    """A chunk's 32-bit ids in 16 bits each, if all fit."""
    ids = np.frombuffer(body, "<u4")
    return ids.astype("<u2").tobytes() if ids.max() < 65536 else body


def unpacked(raw: bytes, n: int) -> bytes:
    """The 32-bit ids of a stored chunk of ``n`` ids."""
    return np.frombuffer(raw, "<u2").astype("<u4").tobytes() if len(raw) == 2 * n else raw


@cache
def _zeros(n: int) -> tuple[list[int], ...]:
    """What ``n`` zero bytes make of a CRC-32 register, by its four bytes."""
    if n == 1:
        bits = [_byte(1 << i) for i in range(32)]
    else:
        half = _zeros(n // 2)
        bits = [_after(half, _after(half, 1 << i)) for i in range(32)]
        if n % 2:
            one = _zeros(1)
            bits = [_after(one, b) for b in bits]
    tables = []
    for k in range(4):
        t = [0] * 256
        for v in range(1, 256):
            low = v & -v
            t[v] = t[v ^ low] ^ bits[8 * k + low.bit_length() - 1]
        tables.append(t)
    return tuple(tables)


def _byte(register: int) -> int:
    for _ in range(8):
        register = (register >> 1) ^ (0xEDB88320 if register & 1 else 0)
    return register


def _after(t: tuple[list[int], ...], x: int) -> int:
    return t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]


def crc_joined(left: int, right: int, n: int) -> int:
    """The CRC-32 of two byte strings one after the other, of their CRCs and the second one's length."""
    return _after(_zeros(n), left) ^ right if n else left


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of SHA-256; an odd node goes up as it is. No leaves: the hash of nothing."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(level[i] + level[i + 1]).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(level) - len(level) % 2 :]
    return level[0]


def rows_of(documents: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """(kind, key, doc_id, n_tokens, chunks, ids): a recipe of each document and the chunks that are new to the task."""

    def run(batches):
        import pyarrow as pa

        own, seen = encoder(tokenizer_path(tokenizer)), set()
        for b in batches:
            for part in blocks(b["text"], BLOCK_CHARS):
                found, ends = own.ids(b["text"][part])
                ids = np.insert(found, ends, end_id).astype("<u4", copy=False)
                ends += np.arange(1, len(ends) + 1)
                starts = np.r_[0, ends[:-1]]
                raw, small = ids.tobytes(), ids.astype("<u2").tobytes() if ids.max() < 65536 else None
                at = marks(ids)
                bounds = zip(starts.tolist(), ends.tolist(), np.searchsorted(at, starts, "right").tolist(), np.searchsorted(at, ends, "right").tolist(), strict=True)
                digests, sizes, counts, new, bodies, named = [], [], [], [], [], []
                at = at.tolist()
                for doc_id, (start, stop, i, j) in zip(b["doc_id"][part], bounds, strict=True):
                    leaves = []
                    for end in cuts_at(at[i:j], start, stop):
                        body = raw[4 * start : 4 * end]
                        leaves.append(digest := hashlib.sha256(body).digest())
                        sizes.append(end - start)
                        if digest not in seen:
                            seen.add(digest)
                            new.append(digest)
                            bodies.append(packed(body) if small is None else small[2 * start : 2 * end])
                        start = end
                    digests += leaves
                    counts.append(len(leaves))
                    named.append(hashlib.sha256(repr(doc_id).encode() + merkle(leaves)).digest())
                    if len(seen) > 500_000:
                        seen.clear()
                each = pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int32())], ["digest", "n"])
                recipes = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), each)
                none = [None] * len(new)
                yield {
                    "kind": ["chunk"] * len(new) + ["recipe"] * len(named),
                    "key": new + named,
                    "doc_id": none + b["doc_id"][part],
                    "n_tokens": none + (ends - starts).tolist(),
                    "chunks": pa.concat_arrays([pa.nulls(len(new), recipes.type), recipes]),
                    "ids": bodies + [None] * len(named),
                }

    kind = documents.schema["doc_id"].dataType.simpleString()
    return arrow_map(documents.select("doc_id", "text"), run, f"kind string, key binary, doc_id {kind}, n_tokens bigint, chunks array<struct<digest:binary,n:int>>, ids binary")


def _put(out: dict[str, list], *values) -> None:
    for column, value in zip(out.values(), values, strict=True):
        column.append(value)


def _objects(column) -> list:
    """An Arrow column's values; of strings and bytes this is faster than ``to_pylist``."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _once(batches):
    """Sorted rows, Arrow batches, without repeated chunks."""
    import pyarrow as pa
    import pyarrow.compute as pc

    last = None
    for b in batches:
        key, chunk = b.column("key"), pc.equal(b.column("kind"), "chunk")
        first = np.ones(b.num_rows, bool)
        first[1:] = pc.not_equal(key.slice(1), key.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        first[0] = key[0].as_py() != last
        b = b.filter(pc.or_(pc.invert(chunk), pa.array(first)))
        # chunks come before recipes
        if (n := pc.sum(chunk).as_py()) and n == len(key):
            last = key[-1].as_py()
        yield {c: b.column(c) for c in b.schema.names}


def write_store(documents: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Writes chunks, recipes and manifest below ``path``."""
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    leaf = "array<struct<digest:binary,n:int>>"
    rows = rows_of(documents, tokenizer, end_id)
    # chunks first, as one binary value: its first bytes, by which Spark sorts, tell rows apart
    chunk_first = F.concat(F.when(F.col("kind") == "chunk", F.lit(b"\0")).otherwise(F.lit(b"\1")), "key")
    sent = rows.repartition("key").sortWithinPartitions(chunk_first)
    unique = arrow_map(sent, _once, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), lists=False)
    unique.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/data")
    release(spark)
    # recipes in order of doc_id; those of a repeated id in order of content
    found = _data(spark, path, kind).filter("kind = 'recipe'").select("doc_id", "key", "n_tokens", "chunks")
    ordered = found.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key")

    def number(batches):
        row = at = 0
        for b in batches:
            n, chunks = b.column("n_tokens").to_numpy(), b.column("chunks")
            leaves, ends = _objects(chunks.flatten().field("digest")), np.cumsum(chunks.value_lengths().to_numpy()).tolist()
            out = {c: b.column(c) for c in b.schema.names} | {"row": np.arange(row, row + len(n)), "at": at + np.cumsum(n) - n}
            yield out | {"root": [merkle(leaves[i:j]) for i, j in zip([0, *ends[:-1]], ends, strict=True)]}
            row, at = row + len(n), at + int(n.sum())

    numbered = arrow_map(ordered, number, f"doc_id {kind}, key binary, n_tokens bigint, chunks {leaf}, row bigint, at bigint, root binary", lists=False)
    numbered.drop("key").withColumn("file", F.spark_partition_id()).write.parquet(f"{path}/recipes")
    # a total a file
    manifest = totals(spark.read.parquet(f"{path}/recipes"))
    manifest.write.parquet(f"{path}/manifest")
    release(spark)


def _data(spark: SparkSession, path: str, doc_id: str) -> DataFrame:
    schema = f"key binary, doc_id {doc_id}, n_tokens bigint, chunks array<struct<digest:binary,n:int>>, ids binary, kind string"
    return spark.read.schema(schema).parquet(f"{path}/data")


class Tree:
    """The root that ``merkle`` gives, of leaves that come one by one; it holds one hash a level."""

    def __init__(self) -> None:
        self.tops: list[tuple[int, bytes]] = []  # leaves below, and hash, of whole subtrees from left to right

    def add(self, leaf: bytes) -> None:
        size = 1
        while self.tops and self.tops[-1][0] == size:
            leaf, size = hashlib.sha256(self.tops.pop()[1] + leaf).digest(), 2 * size
        self.tops.append((size, leaf))

    def root(self) -> bytes:
        if not self.tops:
            return merkle([])
        root = self.tops[-1][1]
        for _, left in self.tops[-2::-1]:
            root = hashlib.sha256(left + root).digest()
        return root


def totals(recipes: DataFrame) -> DataFrame:
    """(file, n_tokens, documents, root) of each recipe file, whose rows are read in order and not held."""

    def run(batches):
        file, tokens, documents, tree = None, 0, 0, Tree()
        out: dict[str, list] = {c: [] for c in ("file", "n_tokens", "documents", "root")}

        def done():
            if file is not None:
                _put(out, file, tokens, documents, tree.root())

        for b in batches:
            for f, n, root in zip(b["file"], b["n_tokens"], b["root"], strict=True):
                if f != file:
                    done()
                    file, tokens, documents, tree = f, 0, 0, Tree()
                tokens, documents = tokens + n, documents + 1
                tree.add(root)
        done()
        yield out

    rows = recipes.select("file", "row", "n_tokens", "root").repartition("file").sortWithinPartitions("file", "row").drop("row")
    return arrow_map(rows, run, "file int, n_tokens bigint, documents bigint, root binary")


def check_manifest(spark: SparkSession, path: str) -> None:
    """Fails where recipe files and manifest do not agree; at once, as rows that are lost have no later step that could fail."""
    m, found = spark.read.parquet(f"{path}/manifest").alias("m"), totals(spark.read.parquet(f"{path}/recipes")).alias("r")
    same = F.lit(True)
    for c in ("n_tokens", "documents", "root"):
        same = same & F.col(f"m.{c}").eqNullSafe(F.col(f"r.{c}"))
    bad = m.join(found, F.col("m.file") == F.col("r.file"), "full").filter(~same).select(F.coalesce("m.file", "r.file").alias("file")).take(1)
    if bad:
        raise ValueError(f"recipe file {bad[0].file} does not match the manifest")


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """(file, first): the ids before each recipe file. There are as many rows as files."""
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    return spark.read.parquet(f"{path}/manifest").select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"))


def _stored(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Recipes, and stored chunks (digest, ids), once the manifest holds."""
    check_manifest(spark, path)
    recipes = spark.read.parquet(f"{path}/recipes")
    kind = recipes.schema["doc_id"].dataType.simpleString()
    return recipes, _data(spark, path, kind).filter("kind = 'chunk'").select(F.col("key").alias("digest"), "ids")


def _assemble(recipes: DataFrame, chunks: DataFrame, value: str, kind: str, build) -> DataFrame:
    """A row a document, from its recipe and the values of its chunks in order."""
    doc_id = recipes.schema["doc_id"].dataType.simpleString()
    parts = recipes.select("file", "row", F.posexplode("chunks").alias("seq", "c")).select("file", "row", "seq", F.col("c.digest").alias("digest"), F.col("c.n").alias("n"))
    bodies = parts.join(chunks, "digest", "left").select("file", "row", "seq", "digest", "n", value)
    heads = recipes.select("file", "row", F.lit(-1).alias("seq"), F.col("root").alias("digest"), F.lit(0).alias("n"), F.lit(None).cast(kind).alias(value), "doc_id", "n_tokens", "at")
    rows = heads.unionByName(bodies, allowMissingColumns=True).repartition("file", "row").sortWithinPartitions("file", "row", "seq")
    names = ("doc_id", "n_tokens", "at", "file", "ids_crc32", "ids")

    def run(batches):
        import pyarrow as pa

        head, leaves, values = None, [], []

        def done(out):
            if head is None:
                return
            if sum(n for n, _, _ in values) != head["n_tokens"] or merkle(leaves) != head["digest"]:
                raise ValueError(f"document {head['doc_id']} does not match its recipe")
            crc, body = build(values)
            for k, v in zip(names, (head["doc_id"], head["n_tokens"], head["at"], head["file"], crc, body), strict=True):
                out[k].append(v)

        out: dict[str, list] = {k: [] for k in names}
        for b in batches:
            seq, found = b.column("seq").to_numpy(), b.column(value)
            lost = found.is_null().to_numpy(zero_copy_only=False)
            n, digests, found = (_objects(c) for c in (b.column("n"), b.column("digest"), found if kind == "binary" else found.fill_null(0)))
            own = np.flatnonzero(seq < 0)
            heads_ = b.take(pa.array(own)).select(["doc_id", "n_tokens", "at", "file", "digest"]).to_pylist()
            for i, j, new in zip([0, *(own + 1).tolist()], [*own.tolist(), len(seq)], [None, *heads_], strict=True):
                if new:
                    done(out)
                    head, leaves, values = new, [], []
                if lost[i:j].any():
                    raise ValueError(f"a chunk of document {head and head['doc_id']} is missing or altered")
                leaves += digests[i:j]
                values += zip(n[i:j], found[i:j], digests[i:j], strict=True)
            yield out
            out = {k: [] for k in names}
        done(out)
        yield out

    built = arrow_map(rows, run, f"doc_id {doc_id}, n_tokens bigint, at bigint, file int, ids_crc32 bigint, ids binary", lists=False)
    return built.select("doc_id", "n_tokens", "at", "file", "ids_crc32", "ids")


def verify_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files, without moving ids; fails where they do not agree."""
    recipes, stored = _stored(spark, path)

    def check(batches):
        for b in batches:
            digests, raws = _objects(b.column("digest")), _objects(b.column("ids"))
            even = [raw if len(raw) % 2 == 0 else b"" for raw in raws]
            wide, start = np.frombuffer(b"".join(even), "<u2").astype("<u4").tobytes(), 0
            out: dict[str, list] = {"digest": [], "crc": []}
            for digest, raw, half in zip(digests, raws, even, strict=True):
                body = wide[start : (start := start + 2 * len(half))]
                if hashlib.sha256(body).digest() != digest:
                    body = raw
                    if hashlib.sha256(body).digest() != digest:
                        continue
                out["digest"].append(digest)
                out["crc"].append(zlib.crc32(body))
            yield out

    def build(values):
        crc = 0
        for n, c, _ in values:
            crc = crc_joined(crc, c, 4 * n)
        return crc, None

    built = _assemble(recipes, arrow_map(stored, check, "digest binary, crc bigint", lists=False), "crc", "bigint", build)
    found = built.join(offsets(spark, path), "file")
    return found.select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids): the documents put together again; fails where the files do not agree."""
    recipes, stored = _stored(spark, path)

    def build(values):
        parts = [unpacked(raw, n) for n, raw, _ in values]
        if any(hashlib.sha256(p).digest() != digest for p, (_, _, digest) in zip(parts, values, strict=True)):
            raise ValueError("a chunk is missing or altered")
        body = b"".join(parts)
        return zlib.crc32(body), body

    found = _assemble(recipes, stored, "ids", "binary", build).join(offsets(spark, path), "file")
    return found.select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")


def store_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/token-store-{uuid.uuid4().hex}"
