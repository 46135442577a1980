"""Operators 4, 6 and 8."""

import collections
import random
import re
import zlib
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import near_dup, quality_pu, quality_rules
from skein.llm.common import WordHash
from skein.llm.components import components
from skein.session import table

BLANK = "[\x20\x09-\x0d]"


def brute_figures(text):
    t = text or ""
    w = [q for q in re.split(f"{BLANK}+", t) if q]
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    again = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def test_figures(spark, small):
    docs = table(spark, small, "documents")
    odd = [(-1, None, None), (-2, "", "en"), (-3, "a b c d e f g h a b c d e f g h", "en"), (-4, " x \n x \n\n x\ty\x0bz\n", "en"), (-5, "a " * 30, "en"), (-6, "é\xa0ü x" * 9, "fr"), (-5, "a " * 30, "en"), (None, "q " * 3000, "en")]
    rows = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(odd, "doc_id bigint, text string, lang string"))
    got = quality_rules.judge(rows.withColumn("n_words", F.lit("clash")), table(spark, small, "labels")).collect()
    want = collections.Counter((r.doc_id, *brute_figures(r.text)) for r in rows.collect())
    assert collections.Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)


def test_binomial(spark):
    rows = spark.createDataFrame([(k, n) for n in (5, 50, 400) for k in range(12)], "k bigint, n bigint")
    for r in rows.select("k", "n", quality_rules.binomial_cdf(F.col("k"), F.col("n"), 0.03).alias("c")).collect():
        want = sum(comb(r.n, i) * 0.03**i * 0.97 ** (r.n - i) for i in range(r.k + 1)) if r.k < 0.03 * r.n else 1.0
        assert abs(r.c - want) < 1e-12
    big = spark.createDataFrame([(100, 20000)], "k bigint, n bigint").select(quality_rules.binomial_cdf(F.col("k"), F.col("n"), 0.05)).first()[0]
    assert 0 < big < 1e-100


def test_cutoffs_hold_the_risk(spark):
    rng = random.Random(1)
    rows = [(i, "en", 100, 500, rng.randrange(3) if i % 8 else 200, 0, 0, 5) for i in range(8000)]
    counted = spark.createDataFrame(rows, "doc_id bigint, stratum string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_capitals bigint")
    labels = spark.createDataFrame([(i, 1 if i % 8 else 0) for i in range(8000)], "doc_id bigint, quality int")
    got = quality_rules.cutoffs(counted, labels).first()
    assert got.n == 7000 and got.cut_symbols == 0.01 and got.cut_capitals == 0.1
    noisy = spark.createDataFrame([(i, 1) for i in range(8000)], "doc_id bigint, quality int")
    assert quality_rules.cutoffs(counted, noisy).first().cut_symbols == 0.5  # an eighth of the good would go: only a cutoff above them is certified
    assert quality_rules.cutoffs(counted, labels.limit(0)).count() == 0


def brute_components(sets, percent):
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if len(sets[i])]
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: top(i) for i in sets}


def star_rows():
    """Groups of copies, a star whose arms are like its centre and not like each other, chains, and odd texts."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    rows, base = [], [word() for _ in range(150)]
    rows.append(" ".join(base))
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(150)] = word()
        rows.append(" ".join(copy))
    for _ in range(40):
        rows.append(" ".join(word() for _ in range(rng.randint(3, 80))))
    rows += [rows[70], rows[70].upper(), "a b", "A  B", "a", "", None, "  \n"]
    return list(enumerate(rows))


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, percent, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL", 4)
    rows = star_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("sig", F.lit("clash"))
    hashes = WordHash()
    sets = {i: set(near_dup.shingle_set(t, hashes, k).tolist()) for i, t in rows}
    want = brute_components(sets, percent)
    got = {r.doc_id: r for r in near_dup.near_duplicates(df, k, percent).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "x y z"), (1, "x y z"), (None, "x y z"), (2, "X Y Z")], "doc_id bigint, text string")
    got = collections.Counter(tuple(r) for r in near_dup.near_duplicates(df).collect())
    assert got == {(1, 1, 1, True): 2, (None, 1, None, True): 1, (2, 1, 1, False): 1}
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (102, 101), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


def test_classifier_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    got = {r.doc_id: r for r in quality_pu.classify(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    scored = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = [s for s, q in scored if q == 1], [s for s, q in scored if q == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert np.mean([s >= 0.3 for s in good]) > 0.97


def test_classifier_ignores_labels_of_held_out_rows(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    flipped = labels.withColumn("quality", F.when(quality_pu.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda x: sorted((r.doc_id, r.score) for r in quality_pu.classify(docs, x).collect())
    assert score(labels) == score(flipped)


def test_classifier_on_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (None, "x"), (3, "")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = quality_pu.classify(docs, none).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {1}
    some = spark.createDataFrame([(1, 1), (2, None), (None, 1), (3, 0), (3, 1)], "doc_id bigint, quality int")
    assert quality_pu.classify(docs, some).count() == 5
    assert quality_pu.classify(docs.limit(0), some).count() == 0


def test_class_prior():
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(2, 1, 6000), rng.normal(-2, 1, 2000)
    assert abs(quality_pu.class_prior(pos[:3000], np.r_[pos[3000:], neg[:1000]]) - 0.75) < 0.08


def test_descent_by_common_prefix():
    """Candidates of a region against a reading of it as a tree of prefixes."""
    rng, small, levels = random.Random(3), near_dup.SMALL, near_dup.Descent.LEVELS

    def want(rows, level, out):
        if len(rows) <= small:
            out.update((max(x, y), min(x, y)) for x, _ in rows for y, _ in rows if x != y)
        elif level < levels - 1:
            groups = collections.defaultdict(list)
            for row in rows:
                groups[row[1][4 * level : 4 * level + 4]].append(row)
            for group in groups.values():
                want(group, level + 1, out)
        return out

    for n in (1, 2, small, small + 1, 30, 200):
        for values in (1, 2, 5, 40):
            rows = sorted((b"".join(rng.randrange(values).to_bytes(4, "big") for _ in range(levels - 1)), i) for i in range(n))
            rows = [(i, deeper) for deeper, i in rows]
            got = []
            own = near_dup.Descent(lambda x, y, got=got: got.append((max(x, y), min(x, y))))
            for i, deeper in rows:
                own.add(i, deeper)
            own.close()
            near = {(max(x, y), min(x, y)) for (x, _), (y, _) in zip(rows, rows[1:], strict=False)} if n > small else set()
            assert set(got) == want(rows, 0, set()) | near


def test_classifier_bound_holds_where_ids_repeat(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality_pu, "fit", lambda pos, unl: seen.update(pos=len(pos), unl=len(unl)))
    rows = [(i % 7 + 1, f"text {i} " * (i % 5 + 1)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("kind", "score", "held_out", "q", "x")})
    labels = spark.createDataFrame([(i, 1) for i in range(1, 8)] * 3, "doc_id bigint, quality int").withColumn("kind", F.lit(1))
    quality_pu.learn(docs, labels, sample=3)
    assert seen == {"pos": 3, "unl": 3}
    assert quality_pu.classify(docs, labels).count() == 900
