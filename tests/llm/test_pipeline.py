"""The corpus pipeline: each stage against a brute-force version or its own contract."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from skein.llm import decontam, near_dup
from skein.llm.bpe import library, tokenizer_path
from skein.llm.common import WordHash, alnum_words
from skein.session import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """Documents and what each stage kept, by name."""
    docs, base, out = table(spark, small, "documents"), tmp_path_factory.mktemp("stages"), {}
    out["documents"] = docs
    for i, (name, run) in enumerate(pipeline.STAGES):
        run(spark, docs, small).write.parquet(f"{base}/{i}")
        docs = out[name] = spark.read.parquet(f"{base}/{i}")
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_names_and_columns(stages):
    names = list(stages)
    assert len(pipeline.STAGES) == 5 and all(stages[n].columns == COLUMNS for n in names[:-1])


def test_quality_keeps_good_documents(spark):
    d = "/root/testdata/sf0.01"
    kept = set(rows(pipeline.quality(spark, table(spark, d, "documents"), d)))
    labels = {r.doc_id: r.quality for r in table(spark, d, "labels").collect()}
    good, bad = [i for i, q in labels.items() if q == 1], [i for i, q in labels.items() if q == 0]
    assert np.mean([i in kept for i in good]) > 0.95 and np.mean([i in kept for i in bad]) < 0.6


def test_one_of_each_near_group_stays(stages):
    before, kept = rows(stages["quality classifier"]), set(rows(stages["near duplicates"]))
    hashes = WordHash()
    sets = {i: set(near_dup.shingle_set(r.text, hashes, 5).tolist()) for i, r in before.items()}
    ids, parent = sorted(i for i in sets if sets[i]), {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    assert kept == {i for i in sets if top(i) == i}


def test_texts_only_lose_repeated_words(stages):
    before, after = rows(stages["near duplicates"]), rows(stages["substring dedup"])
    for i, r in after.items():
        assert r.n_chars == len(r.text) if r.text != before[i].text else r == before[i]
        assert len(alnum_words(r.text)) <= len(alnum_words(before[i].text))


def test_no_window_of_the_benchmark_is_left(spark, small, stages):
    windows = set()
    for r in table(spark, small, "benchmark").collect():
        w = alnum_words(r.text)
        windows.update(tuple(w[i : i + 10]) for i in range(max(0, len(w) - 10) + 1 if w else 0))
    before, after = rows(stages["substring dedup"]), rows(stages["decontamination"])
    dirty = 0
    for i, r in before.items():
        w = alnum_words(r.text)
        hit = any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9))
        dirty += hit
        if not hit:
            assert after[i] == r
        elif i in after:
            w = alnum_words(after[i].text)
            assert not any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9))
    assert dirty


def test_encoding(stages):
    lib, texts = library(tokenizer_path("word_bpe_49k.json")), rows(stages["decontamination"])
    got = rows(stages["BPE encoding"])
    assert set(got) == set(texts)
    for i, r in got.items():
        ids = np.array(lib.encode(texts[i].text, add_special_tokens=False).ids, "<u4")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest() and bytes(r.ids) == ids.tobytes()


def test_run(spark, small, stages):
    assert sorted(r.doc_id for r in pipeline.run(spark, small).select("doc_id").collect()) == sorted(rows(stages["BPE encoding"]))


def test_stages_on_odd_rows(spark, small):
    good = "The whole of this text is plain and says a thing or two about nothing at all, again. " * 2
    odd = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, good, None, None, len(good)), (3, good, None, None, len(good)), (None, good, "en", "s", 5), (4, "x", "en", "s", 1)]
    docs = spark.createDataFrame(odd, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for part in (docs, docs.limit(0)):
        for _, run in pipeline.STAGES:
            part = run(spark, part, small)
            assert part.filter(F.col("doc_id") == 3).count() <= 2
            part.collect()


def test_rows_that_share_an_id(spark, small):
    """Near copies of one id are one row, unlike texts of it stay; without n_chars and with odd columns."""
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(f"q{x}" for x in rng.integers(0, 10**6, n))
    a, b = word(100), word(100)
    rows = [(1, a), (1, f"{a} x"), (1, b), (2, f"{b} y"), (3, word(40)), (None, a)]
    docs = spark.createDataFrame([(i, t, {"k": i}) for i, t in rows], "doc_id bigint, text string, m map<string,bigint>").withColumns({c: F.lit(1) for c in ("kept", "spans", "key", "row", "digest")})
    got = pipeline.near_duplicates(spark, docs, small)
    assert got.columns == docs.columns and sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(1, min(a, f"{a} x")), (1, b), (3, rows[4][1]), (0, a)])
    for _, run in pipeline.STAGES[2:4]:
        got = run(spark, got, small)
        assert got.columns == docs.columns and got.count() == 4


def test_decontamination_in_blocks_as_in_one(spark, tmp_path):
    a, b = [f"a{i}" for i in range(10)], [f"b{i}" for i in range(10)]
    spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = [["x", *a[:5], *b, *a[5:], "y"], ["x", *b[:5], *a, *b[5:], "y"], ["x", *a[:9], "y"]]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    bench = table(spark, str(tmp_path), "benchmark")
    assert sum(map(bool, decontam.item_blocks(bench, 8))) == 2
    for size in (8, 10**6):
        got = rows(pipeline.decontamination(spark, docs, str(tmp_path), size))
        assert {i: r.text for i, r in got.items()} == {0: "x y", 1: "x y", 2: " ".join(texts[2])}


def test_edited_passage_whose_seeds_many_documents_have(spark, small):
    """The passage is cut, though the first and the nearest holders of each of its seeds are other documents."""
    rng = np.random.default_rng(12)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 10**6, n)]
    p = word(55)
    q = [w if y % 9 else f"e{y}" for y, w in enumerate(p)]
    alone = lambda: [p[y : y + 10] + word(60) for y in range(0, 55, 9)]
    before, after = word(40), word(20)
    texts = [*alone(), *alone(), word(20) + p + word(30), *alone(), *alone(), *alone(), before + q + after]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = {r.doc_id: r.text.split() for r in pipeline.substrings(spark, docs, small).collect()}
    assert len(left) == len(texts) and all(left[i] == t for i, t in enumerate(texts[:-1]))
    last = left[len(texts) - 1]
    assert len(set(last) & set(q)) <= 5 and set(before) <= set(last) and set(after) <= set(last)
