"""Operators 2, 5 and 9 against the tokenizers library."""

import hashlib
import random
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pytest

from skein.llm import bpe_codec, common, token_counts, token_store
from skein.llm.bpe import library, load, tokenizer_path
from skein.llm.common import arrow_map, outlives, runs, single_spaced, units

WORDS, BYTES = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
PARTS = [
    "a", "b", "th", "e", " ", " ", "\n", "  ", "'s", "'re", "'", "!", "1", "23", "é", "É", "ß", "İ", "日本", "́", "\t", "\xa0", "\x85", "\x1c", "<|endoftext|>", "<|", "|>",
    "<|startoftext|>", ".", ",", "...", "====", "Σ", "ς", "​", "🙂", "the", "ing", " \n", " ", "ﬁ", "Ǆ", "AB",
]
EDGES = ["", None, "日" * 300, "=" * 500, " " * 300 + "x", "a" * 700, "Hello, world.\nThis is, a. test", "a\nb. c, d", " lead", "x "]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 25))) for _ in range(800)] + EDGES


def test_every_token_is_usable():
    for path in (WORDS, BYTES):
        assert load(path).usable == set(load(path).vocab)


def test_encodings_and_decodings(texts):
    lib, codec, rng = library(WORDS), bpe_codec.TrieCodec(WORDS), random.Random(8)
    every = [chr(i) for i in range(0x180)]  # control characters among them
    odd = [*every, *(f"x{c}y{c}" for c in every), *("".join(rng.choices(every, k=rng.randint(2, 30))) for _ in range(1500))]
    for text, ids in zip(texts + odd, codec.encode(texts + odd), strict=True):
        want = lib.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert codec.decode(ids) == lib.decode(want, skip_special_tokens=False)


def test_tables_that_turn_over(texts, monkeypatch):
    """Small tables give the same results as large ones."""
    for module in (bpe_codec, token_counts, token_store):
        monkeypatch.setattr(module, "KEPT_UNITS", 5)
    monkeypatch.setattr(token_counts, "KEPT_PIECES", 3)
    for make, run in ((bpe_codec.TrieCodec, "encode"), (token_counts.PrefixCounter, "counts"), (token_store.Encoder, "encode")):
        path = WORDS if make is bpe_codec.TrieCodec else BYTES
        little, whole = make(path), list(getattr(make(path), run)(texts))
        parts = [x for i in range(0, len(texts), 40) for x in getattr(little, run)(texts[i : i + 40])]
        assert all(bytes(a) == bytes(b) for a, b in zip(parts, whole, strict=True))


def test_stored_steps(texts):
    for counts in [*token_counts.PrefixCounter(BYTES).counts(texts), np.array([300, 1, 2]), np.zeros(0, np.int32)]:
        assert token_counts.read_steps(token_counts.steps(counts), len(counts)).tolist() == counts.tolist()


def test_counts_at_every_prefix(texts):
    lib, counter = library(BYTES), token_counts.PrefixCounter(BYTES)
    some = texts[:300] + EDGES
    for text, got in zip(some, counter.counts(some), strict=True):
        want = [len(lib.encode(text[: i + 1], add_special_tokens=False)) for i in range(len(text or ""))]
        assert got.tolist() == want, text


def test_truncation():
    counts = np.array([1, 2, 3, 2, 3, 4])
    assert [token_counts.truncate(counts, n) for n in (0, 1, 2, 3, 9)] == [0, 1, 4, 5, 6]


def test_units_join_to_the_text():
    for t in ("a b\nc, d", "x", "a\nb"):
        assert single_spaced(t) and "".join(units(t)) == t
    for t in ("a  b", "a \nb", "a\n b", "a ", "\ta", "日"):
        assert not single_spaced(t)


def test_store_encoder(texts):
    lib, encoder = library(BYTES), token_store.Encoder(BYTES)
    for text, raw in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == lib.encode(text or "", add_special_tokens=False).ids, text


def test_cuts_follow_content():
    ids = np.random.default_rng(1).integers(0, 50000, 20000).astype("<u4")
    ends = token_store.cuts(ids)
    assert ends[-1] == len(ids) and all(a < b for a, b in zip(ends, ends[1:], strict=False))
    assert max(np.diff([0, *ends])) <= token_store.MOST
    moved = token_store.cuts(np.r_[ids[:777], ids].astype("<u4"))
    assert len({e - 777 for e in moved} & set(ends)) > len(ends) * 0.9


def test_merkle():
    a, b, c = (hashlib.sha256(x).digest() for x in (b"a", b"b", b"c"))
    both = hashlib.sha256(a + b).digest()
    assert token_store.merkle([a]) == a and token_store.merkle([a, b]) == both
    assert token_store.merkle([a, b, c]) == hashlib.sha256(both + c).digest()
    assert token_store.merkle([]) == hashlib.sha256(b"").digest()
    leaves = [bytes([i]) * 32 for i in range(70)]
    for n in range(len(leaves) + 1):
        tree = token_store.Tree()
        for x in leaves[:n]:
            tree.add(x)
        assert tree.root() == token_store.merkle(leaves[:n])


def table(spark):
    rows = [(5, "the cat sat", 9), (3, None, 9), (4, "", 9), (2, "the cat sat " * 4000, 9), (9, "same", 1), (9, "same", 2), (None, "no id", 3), (7, "日本 <|endoftext|> x", 9)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens bigint")


def test_operators_on_odd_rows(spark):
    lib = library(WORDS)
    rows = {(r.doc_id, r.n_tokens): r for r in bpe_codec.encode_decode(table(spark), ids=True).collect()}
    assert len([r for r in rows]) == 7  # the repeated row gives the same result twice
    for _, r in rows.items():
        assert hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 and len(r.ids) == 4 * r.n_tokens
        assert hashlib.sha256(r.decoded.encode()).hexdigest() == r.decoded_sha256
    assert rows[5, 3].decoded == lib.decode(lib.encode("the cat sat", add_special_tokens=False).ids, skip_special_tokens=False)
    assert rows[3, 0].decoded == rows[4, 0].decoded == ""
    counts = {(r.doc_id, r.n_bytes): r for r in token_counts.prefix_counts(table(spark)).collect()}
    assert counts[3, 0].n_tokens == 0 and counts[2, 48000].n_tokens == len(library(BYTES).encode("the cat sat " * 4000, add_special_tokens=False))
    long, stored = counts[2, 48000], token_counts.prefix_counts(table(spark))
    vector = token_counts.read_steps(long.counts, long.n_chars)
    assert vector[-1] == long.n_tokens and vector[long.fit_chars - 1] <= token_counts.LIMIT < vector[long.fit_chars]
    for budget in (0, 2, 100):
        fits = {r.doc_id: r.fit_chars for r in token_counts.truncated(stored, budget).collect()}
        assert fits[3] == fits[4] == 0 and fits[2] == token_counts.truncate(vector, budget)


def test_store_round_trip(spark, tmp_path):
    lib = library(BYTES)
    token_store.write_store(table(spark), str(tmp_path / "s"))
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in token_store.read_store(spark, str(tmp_path / "s")).collect())
    at = 0
    for start, _, n, crc, ids in got:
        assert start == at and len(ids) == 4 * n and zlib.crc32(ids) == crc
        at += n
    order = [r[1] for r in got]
    assert order[0] is None and order[1:] == sorted(order[1:])
    want = np.array([*lib.encode("the cat sat", add_special_tokens=False).ids, 2], "<u4").tobytes()
    assert {r[1]: r[4] for r in got}[5] == want


def test_crc_of_joined_strings():
    rng = random.Random(2)
    for _ in range(50):
        a, b = (rng.randbytes(rng.randint(0, 9000)) for _ in range(2))
        assert token_store.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_verified_as_read(spark, tmp_path):
    token_store.write_store(table(spark), str(tmp_path / "s"))
    columns = ["doc_id", "start", "n_tokens", "ids_crc32"]
    read, verified = (sorted(map(str, x.select(*columns).collect())) for x in (token_store.read_store(spark, str(tmp_path / "s")), token_store.verify_store(spark, str(tmp_path / "s"))))
    assert read == verified and len(read) == 8
    chunks = [r.key for r in spark.read.parquet(str(tmp_path / "s" / "data")).filter("kind = 'chunk'").collect()]
    assert len(chunks) == len(set(chunks))


def test_altered_chunk_is_found(spark, tmp_path):
    token_store.write_store(table(spark), str(tmp_path / "s"))
    chunks = spark.read.parquet(str(tmp_path / "s" / "data" / "kind=chunk")).toPandas()
    other = np.arange(3, dtype="<u2").tobytes()
    altered = spark.createDataFrame([(bytes(k), other) for k in chunks["key"]], "key binary, ids binary")
    altered.selectExpr("key", "cast(null as bigint) doc_id", "cast(null as bigint) n_tokens", "cast(null as array<struct<digest:binary,n:int>>) chunks", "ids").write.mode("overwrite").parquet(str(tmp_path / "s" / "data" / "kind=chunk"))
    for read in (token_store.read_store, token_store.verify_store):
        with pytest.raises(Exception, match="missing or altered|does not match"):
            read(spark, str(tmp_path / "s")).collect()


def test_empty_tables(spark, tmp_path):
    none = table(spark).limit(0)
    assert bpe_codec.encode_decode(none).count() == 0 and token_counts.prefix_counts(none).count() == 0
    token_store.write_store(none, str(tmp_path / "s"))
    assert token_store.read_store(spark, str(tmp_path / "s")).count() == 0


@pytest.mark.parametrize("lost", ["rows", "file", "manifest"])
def test_store_fails_where_recipes_are_lost(spark, tmp_path, lost):
    rows = [(i, f"the cat sat on {i} mats") for i in range(40)]
    token_store.write_store(spark.createDataFrame(rows, "doc_id bigint, text string"), str(tmp_path / "s"))
    part = "manifest" if lost == "manifest" else "recipes"
    whole = spark.read.parquet(str(tmp_path / "s" / part))
    one = whole.agg({"file": "max"}).first()[0]
    kept = whole.filter("doc_id <> 39" if lost == "rows" else f"file <> {one}").collect()
    spark.createDataFrame(kept, whole.schema).write.mode("overwrite").parquet(str(tmp_path / "s" / part))
    for read in (token_store.read_store, token_store.verify_store):
        with pytest.raises(Exception, match="does not match the manifest"):
            read(spark, str(tmp_path / "s")).collect()


def test_a_workers_tables_go_with_their_step():
    """A task of another step lets the tables of an encoder go, before its second batch."""

    class Rows:
        def mapInArrow(self, run, schema):
            return run

    class Table:
        pass

    made = outlives(lambda name: Table())

    def task(ask):
        def run(batches):
            seen.append(weakref.ref(made("a")) if ask else None)
            for _ in batches:
                yield {"x": [1]}

        seen = []
        outs = arrow_map(Rows(), run, "x int")(iter([pa.record_batch({"x": [1]})] * 2))
        next(outs)
        still = bool(table_) and table_() is not None
        list(outs)
        return seen[0], still

    table_ = None
    table_, _ = task(True)
    again, still = task(True)
    assert again() is table_() is not None and still
    _, still = task(False)
    assert not still and table_() is None
    for kept in (load, library, bpe_codec.codec, token_counts.counter, token_store.encoder):
        assert any(c.cell_contents in common._HELD for c in kept.__closure__)


def test_repeated_chunks_across_batches():
    """Arrow batches in, each chunk once, every recipe kept."""
    rows = [("chunk", b"a"), ("chunk", b"a"), ("chunk", b"b"), ("chunk", b"c"), ("recipe", b"c"), ("recipe", b"r"), ("recipe", b"r"), ("recipe", b"r")]
    want = [("chunk", b"a"), ("chunk", b"b"), ("chunk", b"c"), *rows[4:]]
    for size in range(1, len(rows) + 1):
        batches = [pa.record_batch({"kind": [k for k, _ in part], "key": pa.array([x for _, x in part], pa.binary())}) for part in (rows[i : i + size] for i in range(0, len(rows), size))]
        got = [(k, x) for out in token_store._once(iter(batches)) for k, x in zip(out["kind"].to_pylist(), out["key"].to_pylist(), strict=True)]
        assert got == want, size


def test_runs_of_a_block():
    """All texts' units by columns, a mark after a letter apart; the store's encoder keeps a word once, with and without its mark."""
    some = ["Hello, world.\nThis is, a. test", ",", "a", "x.", "é, ×, ÷. ª. 1. a.. a'.", "\n,\n.", " lead é."]
    found, first = runs(some)
    every = found.to_pylist()
    assert len(first) == len(some) + 1
    for t, i, j in zip(some, first[:-1], first[1:], strict=True):
        apart = [x for u in units(t) for x in ([u[:-1], u[-1]] if u[-1] in ".," and u[-2:-1].isalpha() and u[-2:-1] != "ª" else [u])]
        assert every[i:j] == apart and "".join(every[i:j]) == t
    encoder, lib = token_store.Encoder(BYTES), library(BYTES)
    encoder.encode(["word, word. word"])
    assert {" word", "word", ",", "."} <= encoder.units.now.keys() and not {"word,", " word."} & encoder.units.now.keys()
    rng = random.Random(3)
    parts = [*(chr(i) for i in range(33, 256) if chr(i) not in "\x85\xa0"), *" ,.\n" * 30]
    odd = [t for t in ("".join(rng.choices(parts, k=rng.randint(1, 40))).strip() for _ in range(3000)) if single_spaced(t)]
    assert len(odd) > 500
    for t, raw in zip(odd, encoder.encode(odd), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_cuts_of_streams_end_to_end():
    """Streams cut in one go are cut as each alone."""
    rng = np.random.default_rng(4)
    streams = [rng.integers(0, 50000, n).astype("<u4") for n in (1, 5, 63, 64, 65, 700, 9000, 2, 4000)] + [np.full(6000, 7, "<u4")]
    ends = np.cumsum([len(x) for x in streams])
    at = token_store.marks(np.concatenate(streams))
    for x, start, end in zip(streams, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        own = at[(at > start) & (at <= end)].tolist()
        assert [e - start for e in token_store.cuts_at(own, start, end)] == token_store.cuts(x)
