"""Shared helpers of the training-data operators: table access, lineage cuts, Arrow maps.

Every operator takes DataFrames, names the columns it needs and ignores all
others, so extra or clashing columns in an input never reach its result.
"""

from __future__ import annotations

import contextlib
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, wraps
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import cut, shared_dir, table

__all__ = ["cut", "shared_dir", "table"]

#: Odd factors of a shingle's words.
PLACES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


#: Rows of documents behind one part of a cut table.
PART_ROWS = 20_000


def parts_for(documents: DataFrame) -> int:
    """Parts in which tables made of ``documents`` are cut: by their number, two for each core at least."""
    return max(2 * documents.sparkSession.sparkContext.defaultParallelism, -(-documents.count() // PART_ROWS))


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle and checkpoint files of steps that nothing refers to any more.

    It does so when the driver's JVM collects their owners, which a driver with
    free memory may put off until disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Tables:
    """Tables of one run as Parquet below the shared folder.

    They are compressed, which checkpoints are not, and go as soon as a step has no more use for them.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.name = f"{name}_{uuid.uuid4().hex}"
        self.spark, self.path, self.named = spark, f"{shared_dir(spark).rstrip('/')}/{self.name}", []

    def keep(self, name: str, df: DataFrame, parts: int | None = None) -> DataFrame:
        """``df`` computed once and written, in at most ``parts`` files."""
        (df if parts is None else df.coalesce(parts)).write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        release(self.spark)
        return self.spark.read.parquet(f"{self.path}/{name}")

    def bucketed(self, name: str, df: DataFrame, column: str) -> DataFrame:
        """``df`` written in buckets of ``column``, as many as shuffles have parts: joins by it move the other side alone."""
        self.named.append(f"{self.name}_{name}")
        buckets = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 100_000)  # Spark takes no more
        df.repartition(buckets, column).write.bucketBy(buckets, column).option("compression", "zstd").option("path", f"{self.path}/{name}").format("parquet").saveAsTable(self.named[-1])
        release(self.spark)
        return self.spark.table(self.named[-1])

    def drop(self, *names: str) -> None:
        """Deletes tables, without names all."""
        while self.named and not names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.named.pop()}")
        for place in [f"{self.path}/{n}" for n in names] or [self.path]:
            found = self.spark._jvm.org.apache.hadoop.fs.Path(place)
            found.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(found, True)


#: What outlives the tasks of this worker, and of that what the task at work has asked for.
_HELD: list = []
_ASKED: set = set()


def outlives(make: Callable) -> Callable:
    """``make``, whose last result stays in a worker from task to task: until a task of another step, which does not ask for it."""
    held = lru_cache(maxsize=1)(make)
    _HELD.append(held)

    @wraps(make)
    def ask(*args):
        _ASKED.add(held)
        return held(*args)

    return ask


def begin_task() -> None:
    _ASKED.clear()


def let_go() -> None:
    """Drops what the task at work has not asked for: other steps' tables take memory beside its own."""
    for held in _HELD:
        if held not in _ASKED:
            held.cache_clear()


def give_back() -> None:
    """Returns a worker's free memory to the machine: workers outlive their tasks, beside others of the same executor."""
    import ctypes

    let_go()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, fn: Callable[[Iterator], Iterable[dict]], schema: str, lists: bool = True) -> DataFrame:
    """``fn`` over dicts of column lists (or Arrow batches, without ``lists``); each dict it yields becomes one Arrow batch of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for i, out in enumerate(fn(b.to_pydict() if lists else b for b in batches if b.num_rows)):
            if not i:
                let_go()
            columns = [out[f.name] for f in target]
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, target, strict=True)],
                schema=target,
            )
        give_back()

    return df.mapInArrow(run, schema)


#: Upper-case ASCII to lower case; every byte that ends a word to a space.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ALNUM = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in _LOWER)


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return [] if text is None else text.encode("utf-8", "replace").translate(_ALNUM).split()


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8."""
    return [] if text is None else text.encode("utf-8", "replace").translate(_LOWER).split()


class WordHash(dict):
    """64-bit hashes of words, remembered; it empties itself before it outgrows a worker."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words (shift, multiply, shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: A random number for each byte at each place of a word up to this length.
_LONG = 32
_BYTES = mix64(np.arange(1, 256 * _LONG + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)


def alnum_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """32-bit hashes of the words that ``alnum_words`` gives, of each text: a sum of random numbers, one for each byte at its place."""
    raws = [b"" if t is None else t.encode("utf-8", "replace").translate(_ALNUM) for t in texts]
    whole = np.frombuffer(b" ".join([*raws, b""]), np.uint8)
    kept = whole != 32
    change = np.flatnonzero(kept[1:] != kept[:-1]) + 1
    if len(kept) and kept[0]:
        change = np.r_[0, change]
    starts, ends = change[::2], change[1::2]
    if not len(starts):
        return [np.zeros(0, np.uint32) for _ in raws]
    sizes = ends - starts
    at = np.flatnonzero(kept)
    first = np.cumsum(sizes) - sizes
    place = (np.arange(len(at), dtype=np.int32) - np.repeat(first.astype(np.int32), sizes)) & (_LONG - 1)
    out = np.add.reduceat(_BYTES[(place << 8) | whole[at]], first)
    for i in np.flatnonzero(sizes > _LONG).tolist():
        import xxhash

        out[i] = xxhash.xxh3_64_intdigest(whole[starts[i] : ends[i]].tobytes())
    out = (mix64(out) >> np.uint64(32)).astype(np.uint32)
    bounds = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raws])[:-1])
    return np.split(out, bounds)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, in text order (empty if there are fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * np.uint64(PLACES[0])
    for j in range(1, k):
        out += words[j : j + n] * np.uint64(PLACES[j % len(PLACES)] + 2 * j)
    return mix64(out)


def plain(text: str, without: bytes) -> bool:
    """Whether a text is of Latin-1 characters, none of them in ``without``."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return len(raw.translate(None, without)) == len(raw)


#: White space other than space and line feed, and what only some take for white space.
ODD_SPACE = b"\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"


def single_spaced(text: str) -> bool:
    """Whether a Latin-1 text has only single spaces and line feeds, each before a character of another kind."""
    return plain(text, ODD_SPACE) and text[-1:] not in (" ", "\n") and not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text)


def units(text: str) -> list[str]:
    """Runs of non-space with the space before them, and line feeds, of a single-spaced text.

    A piece of the byte-level pattern never spans two of them.
    """
    return [u for u in text.replace(" ", "\x1f ").replace("\n", "\x1f\n\x1f").split("\x1f") if u]


#: Letters by their last byte in UTF-8: of ASCII, and of those that begin with the byte C3.
_ASCII_LETTERS, _C3_LETTERS = (np.isin(np.arange(256), list(x)) for x in (bytes(range(65, 91)) + bytes(range(97, 123)), {*range(128, 192)} - {0x97, 0xB7}))


def runs(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The units of single-spaced texts, all in one column, and the first of each text, then their number.

    A point or comma after a letter at a unit's end is one of its own, as it is in the byte-level pattern.
    """
    raws = [t.encode() for t in texts]
    first = np.cumsum([0, *map(len, raws)])
    raw = np.frombuffer(b"".join(raws), np.uint8)
    begun = np.zeros(len(raw) + 1, bool)
    begun[:-1] = raw == 32
    feeds = np.flatnonzero(raw == 10)
    begun[feeds] = begun[feeds + 1] = begun[first] = True
    marks = np.flatnonzero((raw == 44) | (raw == 46))
    marks = marks[begun[marks + 1]]
    last = raw[marks - 1]
    begun[marks[_ASCII_LETTERS[last] | _C3_LETTERS[last] & (raw[np.maximum(marks - 2, 0)] == 0xC3)]] = True
    ends = np.flatnonzero(begun)
    units_ = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)])
    return units_.dictionary_encode(), np.searchsorted(ends, first)


def blocks(texts: list[str | None], chars: int) -> Iterator[slice]:
    """Slices of at most ``chars`` characters each, or of one text."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and size + n > chars:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if len(texts) > start:
        yield slice(start, len(texts))


class Recent:
    """A bounded table that outlives a task: entries of the last rounds, of which those in use move on.

    Look up in ``now``; for what is not there, ``recall`` brings back what ``before`` holds and names the rest.
    """

    def __init__(self, limit: int) -> None:
        self.limit, self.now, self.before = limit, {}, {}

    def turn(self) -> None:
        """Between blocks: a full table becomes the old one."""
        if len(self.now) > self.limit:
            self.now, self.before = {}, self.now

    def recall(self, keys: set) -> set:
        if not self.before:
            return keys
        held = keys & self.before.keys()
        self.now.update((k, self.before[k]) for k in held)
        return keys - held


def looked_up(known: dict, lists: list[list[str]], learn: Callable[[set[str]], None]) -> list[list]:
    """The values of words in ``known``; ``learn`` is called once with those it does not have."""
    new = set(chain.from_iterable(lists)).difference(known)
    if new:
        learn(new)
    return [list(map(known.get, x)) for x in lists]
