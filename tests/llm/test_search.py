"""Operators 1, 3, 7 and 10."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from skein.llm import decontam, html_extract, license_scan, substring_dedup
from skein.llm.common import alnum_hashes, alnum_words

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1><nav><ul><li><a href=x>Menu</a></ul></nav></header><div class="cookie-notice">We use cookies</div>
<div id="wrap"><div class="content post-123"><article><header><h1>My &eacute;Title</h1><p>By me</p></header>
<p>First <b>par</b>agraph   one&nbsp;two.<br>next<p>Second 1 < 2 para &lt;x&gt;.<div class="ad">Buy!</div><form><input><label>x</label></form>
<ul><li>a<li>b</ul><script>var x="</p>"</script><table><tr><td>c1<td>c2</table></article><section class="comments"><p>Nice!</p></section></div>
<aside>side</aside></div><footer>&copy; 2020</footer></body></html>"""
TEXT = "My éTitle First paragraph one two. next Second 1 < 2 para <x>. a b c1 c2"


def test_page():
    page = html_extract.Page(PAGE)
    assert page.text(None) == TEXT
    assert page.candidate().path == "/html/body.has-sidebar/div/div.content.post-#/article"


@pytest.mark.parametrize("html", ["", "<", "<p", "<!-- x", "<script>x", "plain", "</div></p>", "<a href='", "&amp", "<p>" * 500 + "deep"])
def test_broken_pages(html):
    assert isinstance(html_extract.Page(html).text(None), str)


def test_host_path_wins(spark):
    body = "long text of an article that goes on and on and on. " * 3
    normal = f"<html><body><div class='main'><div class='text'><p>{body}</p></div><div class='tail'><p>Read on elsewhere</p></div></div></body></html>"
    odd = "<html><body><div class='main'><div class='text'><p>Short one</p></div><div class='tail'><p>Read on elsewhere, there is more of it than of the article itself</p></div></div></body></html>"
    rows = [(i, "http://h.org/a", normal, "x") for i in range(4)] + [(9, "HTTP://user@H.org:80/b", odd, "x"), (10, None, normal, "x"), (11, "http://h.org", None, "x"), (12, "http://h.org", "", "x")]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()}
    assert len(got) == 8 and got[9].text == "Short one" and got[10].text.startswith("long text")
    assert got[11].text == got[12].text == "" and got[11].n_chars == 0
    plain = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string"), broadcast_hosts=0).collect()}
    assert plain == {k: r.text for k, r in got.items()}
    assert html_extract.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_nothing_but_furniture_is_dropped(spark):
    """Titles, leads and sibling articles stay; a scrap on the host's path does not replace a page's article."""
    body = "long text of an article that goes on and on and on. " * 9
    page = lambda i: f"<body><h1>Title {i}</h1><p>Lead {i}</p><div><div><p>{i} {body}</p></div></div><div class='tail'><p>Read on</p></div></body>"
    other = f"<body><div><div>Scrap</div></div><section><p>Other {body}</p></section></body>"
    twins = f"<body><div class='a'><article><p>One {body}</p></article></div><div class='b'><article><p>Two {body[:200]}</p></article></div></body>"
    rows = [(i, "http://h.org/a", page(i)) for i in range(4)] + [(8, "http://h.org/b", other), (9, "http://g.org/", twins), (10, "http://g.org/", twins)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == f"Title {i} Lead {i} {i} {body.strip()}" for i in range(4))
    assert got[8] == f"Scrap Other {body.strip()}"
    assert got[9] == got[10] == f"One {body.strip()} Two {body[:200].strip()}"


def test_windows_against_brute_force():
    rng = random.Random(2)
    for _ in range(120):
        v, width = rng.choice([2, 3, 6]), rng.choice([2, 3, 4])
        make = lambda m, n: " ".join(f"w{rng.randrange(n)}" for _ in range(rng.randint(0, m)))
        items = [(i, make(12, v)) for i in range(rng.randint(0, 4))]
        docs = [make(40, v + 2) for _ in range(rng.randint(1, 6))] + [None, ""]
        for doc, (n, spans, found) in zip(docs, decontam.search_shard(decontam.Phrases(items, width), docs), strict=True):
            words = (doc or "").split()
            hit, named = set(), set()
            for k, (_, text) in enumerate(items):
                own = text.split()
                for a in range(max(0, len(own) - width) + 1 if own else 0):
                    window = own[a : a + width]
                    for p in range(len(words) - len(window) + 1):
                        if words[p : p + len(window)] == window:
                            hit.update(range(p, p + len(window)))
                            named.add(k)
            assert (n, found) == (len(words), named)
            assert {y for a, b in spans for y in range(a, b)} == hit


def test_suffix_array():
    rng = np.random.default_rng(3)
    for n in (1, 2, 30, 200):
        x = np.r_[rng.integers(1, 4, n), 0]
        assert decontam.suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


def test_decontamination_rows(spark):
    item = " ".join(f"word{i}" for i in range(12))
    docs = [(1, f"Before. {item.upper()}! After"), (2, "clean"), (3, None), (4, ""), (5, "short notice"), (5, "short notice"), (None, item)]
    bench = [(10, item), (2, item), (7, "Short, notice"), (8, None), (9, "...")]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string")
    got = decontam.digest(decontam.decontaminate(d, b)).collect()
    assert {(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got} == {(1, 14, 12, 2), (2, 1, 0, 0), (3, 0, 0, 0), (4, 0, 0, 0), (5, 2, 2, 1), (None, 12, 12, 2)}
    assert len(got) == 7
    blocks = sorted((str(r.doc_id), r.n_hit, r.items_sha256) for r in decontam.digest(decontam.decontaminate(d, b, block_bytes=40)).collect())
    assert blocks == sorted((str(r.doc_id), r.n_hit, r.items_sha256) for r in got)  # in blocks as in one
    assert decontam.decontaminate(d, b.limit(0)).filter("size(items) > 0").count() == 0
    assert decontam.decontaminate(d.limit(0), b).count() == 0


def test_removal_keeps_the_rest():
    text = "One, two THREE four. Five"
    assert decontam.without_spans(text, [(1, 3)]) == "One, four. Five"
    assert decontam.without_spans(text, [(0, 5)]) == ""
    assert decontam.without_spans(text, []) == text


def test_notices():
    scan = license_scan.Scanner()
    found = lambda t: [(f.label, f.errors) for f in scan.fuzzy(b" ".join(alnum_words(t)))]
    assert found("Released under the MIT License.") == [("mit", 0)]
    assert found("is licenced under the GNU General Public License, version 3") == [("gpl-3.0", 1)]
    assert found("x licensed undr teh apache license version 2.0 y") == [("apache-2.0", 3)]
    assert found("All rights reserved. All rigts reserved") == [("all-rights-reserved", 0), ("all-rights-reserved", 1)]
    assert found("nothing of the kind") == found("") == []


def test_notices_against_plain_search():
    """Every notice that bounded-error matching alone finds in a text is found from its seeds."""
    rng, scan = random.Random(4), license_scan.Scanner()
    for _ in range(60):
        notice, label = rng.choice(license_scan.NOTICES)
        k = int(len(notice) * license_scan.ERRORS)
        chars = list(notice)
        for _ in range(rng.randint(0, k)):
            chars[rng.randrange(len(chars))] = rng.choice("abcxyz")
        text = "zq " * rng.randint(0, 5) + "".join(chars) + " qz" * rng.randint(0, 5)
        assert regex.search(f"(?:{regex.escape(notice)}){{e<={k}}}", text)
        assert scan.fuzzy(" ".join(text.split()).encode()), text


def test_places(spark):
    rows = [(1, "MIT License and mit license; CC-BY, cc by"), (2, None), (3, ""), (4, "smit license"), (5, "GNU General Public License gnu general public license")]
    got = {r.doc_id: r for r in license_scan.digest(license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (4, 0, 7, "cc-by,mit")
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].labels, got[2].score) == (0, 0, None, "", 0.0)
    assert got[4].n_base == 0 and (got[5].n_base, got[5].last_word) == (2, 4)
    assert got[1].score >= license_scan.PHRASE_SCORE


def test_inline_furniture_and_unlucky_names():
    read = lambda body: html_extract.Page(f"<html><body>{body}</body></html>").text(None)
    long = "The article says this and that at some length, so that it holds most of the text. " * 3
    for inline in ('<span class="advert">Buy</span>', '<ins class="adsbygoogle">Buy</ins>', '<a class="share-button" href=x>Share</a>', "<span hidden>x</span>", '<span style="display: none">x <b>y</b></span>', '<b class="ad"><i>x</i></b>'):
        assert read(f"<article><p>One{inline} two.</p><p>{long}</p></article>") == f"One two. {long.strip()}", inline
    assert read(f'<div>One<b class="ad"><i>x</i><div>y</div></b> two.<p>{long}</div>') == f"One two. {long.strip()}"
    for block in ('<p class="related-work">Kept.</p>', '<section id="search-methods">Kept.</section>', '<div class="comment-free">Kept.</div>', '<div class="dialog">Kept.</div>', '<p><math><mi>Kept.</mi></math></p>', '<p><span class="comment">Kept.</span></p>', '<div class="with-sidebar">Kept.</div>'):
        assert read(f"<article>{block}<p>{long}</p></article>") == f"Kept. {long.strip()}", block
    for block in ('<div class="related-posts">Gone.</div>', '<div id="cookie-notice">Gone.</div>', '<div class="comments"><p>Gone.</p></div>', '<div class="user-comments">Gone.</div>', '<div class="dialog" hidden>Gone.</div>', '<ul class="social"><li><a href=x>Gone</a></ul>', '<div role="search">Gone.</div>', '<label>Gone.</label>'):
        assert read(f"<article><p>{long}</p>{block}</article>") == long.strip(), block
    assert read(f'<div class="sidebar-content"><p>{long}</p></div><div class="sidebar">Gone.</div>') == long.strip()
    assert read(f'<article><p>{long}</p></article><section class="comments">{"<p>I say so. " * 90}</section>') == long.strip()
    assert read('<p title="foo>bar</p><p>next</p>') == "bar next"
    assert read("<article><p>a<p>b") == "a b" and read("") == ""


def test_pages_against_their_making(spark):
    """Pages made of known blocks with furniture between them; rows of several hosts, repeats and odd ones."""
    rng, rows, want = random.Random(6), [], []
    words = "alpha beta gamma delta eta theta iota kappa lambda omega".split()
    say = lambda n: " ".join(rng.choices(words, k=n))
    junk = ['<nav><ul><li><a href=x>Home</a></ul></nav>', '<div class="ad">Buy now</div>', '<aside>Aside</aside>', '<footer>Foot</footer>', '<div class="cookie-notice">Cookies</div>', '<form>Find <input></form>', '<script>var a = "<p>x</p>";</script>', '<section id="comments"><p>Nice!</p></section>', '<!-- <p>c</p> -->', '<div hidden>h</div>']
    for i in range(150):
        host, parts, texts = i % 7, [], []
        for _ in range(rng.randint(1, 8)):
            t = say(rng.randint(3, 40))
            kind = rng.randrange(5)
            half = len(t.split()) // 2
            a, b = " ".join(t.split()[:half]), " ".join(t.split()[half:])
            parts.append([f"<p>{t}</p>", f"<p>{t}", f"<h2>{t}</h2>", f"<ul><li>{a}<li>{b}</ul>", f"<p>{a} <b>{b}</b><br>&eacute;&#33;"][kind])
            texts.append(t + " é!" if kind == 4 else t)
            if rng.random() < 0.5:
                parts.append(rng.choice(junk))
        html = f"<html><head><title>T</title></head><body>{rng.choice(junk)}<div class='post-{i}'><article>{' '.join(parts)}</article></div>{rng.choice(junk)}</body></html>"
        rows.append((i, f"http://h{host}.example/{i}", html))
        want.append((i, " ".join(" ".join(texts).split())))
    rows += [rows[0], (None, "u", "<p>no id</p>"), (900, None, "<p>no url</p>"), (901, "", None), (902, "http://h1.example/", ""), (903, "x://y/", "<div>" * 3000 + "deep")]
    want += [want[0], (None, "no id"), (900, "no url"), (901, ""), (902, ""), (903, "deep")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "path", "text", "n_chars", "repeated")})
    for broadcast_hosts in (100, 0):
        got = html_extract.extract(df, broadcast_hosts).collect()
        assert sorted(((r.page_id or -1, r.text) for r in got)) == sorted((i or -1, t) for i, t in want)
        assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_scan_against_plain_reading(spark, small):
    """Base figures and labels of whole documents, odd rows among them, against a plain reading of the words."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rng = random.Random(12)
    parts = ["mit license", "MIT", "license", "apache license", "Apache", "gnu general public license", "cc by", "CC-BY", "released under the mit license", "é", "x1", "all rights reserved"]
    odd = [(-i, " ".join(rng.choices(parts, k=rng.randint(1, 30)))) for i in range(1, 60)] + [(-70, "apache license " * 20_000), (-71, None), (-72, ""), (-1, "again"), (None, "mit license")]
    rows = docs.unionByName(spark.createDataFrame(odd, "doc_id bigint, text string"))
    got = license_scan.digest(license_scan.scan(rows.withColumns({c: F.lit("clash") for c in ("label", "places", "notices", "n_words")})))
    read = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got.collect()}
    phrases, want = [(p.encode().split(), label) for p, label in license_scan.PHRASES], set()
    for r in rows.collect():
        words = alnum_words(r.text)
        places = [(i, label) for p, label in phrases for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        at = [i for i, _ in places]
        want.add((r.doc_id, len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    assert read == want
    for r in got.collect():
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert license_scan.digest(license_scan.scan(rows.limit(0))).count() == 0


def test_decontamination_of_odd_items(spark):
    """Items without an id hit without being named; clashing columns and repeats change nothing."""
    a, b = " ".join(f"a{i}" for i in range(12)), " ".join(f"b{i}" for i in range(10))
    items = spark.createDataFrame([(None, a), ("x", b), ("y", b), ("z", None), ("w", ""), ("v", "solo")], "item_id string, text string").withColumn("doc_id", F.lit(1))
    rows = [(1, f"q {a} {b}"), (2, a), (2, a), (3, None), (4, ""), (5, "a0 a1"), (None, b), (6, "the solo one"), (7, "q " * 300_000 + b)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(0) for c in ("row", "items", "spans", "n_words", "item_id")})
    for size in (10**6, 8):
        found = decontam.digest(decontam.decontaminate(docs, items, block_bytes=size)).collect()
        got = sorted(((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in found))
        assert got == [(0, 10, 10, 2, True), (1, 23, 22, 2, True), (2, 12, 12, 0, True), (2, 12, 12, 0, True), (3, 0, 0, 0, False), (4, 0, 0, 0, False), (5, 2, 0, 0, False), (6, 3, 1, 1, True), (7, 300_010, 10, 2, True)]


def passage_rows(rng):
    word = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    docs, want = [word(rng.randint(60, 300)) for _ in range(40)], set()
    for _ in range(15):
        a, b = sorted(rng.sample(range(40), 2))
        p = word(rng.randint(60, 110))
        q = list(p)
        for _ in range(int(len(p) * 0.08)):
            q[rng.randrange(len(q))] = "zz"
        docs[a][5:5] = p
        docs[b][9:9] = q
        want.add(b)
    return [(i, " ".join(d), "en", "s", 0) for i, d in enumerate(docs)], want


def test_passages(spark):
    rows, want = passage_rows(random.Random(3))
    odd = [(100, None, "en", "s", 0), (101, "", "en", "s", 0), (102, "a b", "en", "s", 0), (None, rows[0][1], "en", "s", 0)]
    df = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = substring_dedup.passages(df)
    got = found.collect()
    assert {r.doc_id for r in got} == want and all(r.source_id < r.doc_id and r.n_words >= 50 and r.similarity >= 0.8 for r in got)
    left = substring_dedup.remove(df, found)
    assert left.columns == df.columns and left.count() == len(rows) + len(odd)
    again = substring_dedup.passages(left.filter("doc_id is not null")).collect()
    assert not again
    assert substring_dedup.passages(df.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    """Equal rows are one; other texts of the same id are searched and cut each by its own text, with clashing columns beside."""
    rng = random.Random(9)
    word = lambda n: " ".join(f"x{rng.randrange(10**6)}" for _ in range(n))
    long, other, short = word(80), word(70), word(5)
    rows = [(1, long, "p"), (1, long, "q"), (2, long, "r"), (2, short, "s"), (3, f"{short} {other}", "t"), (3, f"{other} {short}", "u"), (4, f"{other} z", "v")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans string").withColumns({c: F.lit(7) for c in ("digest", "source_id", "start", "key", "lead")})
    found = substring_dedup.passages(df)
    assert {(r.doc_id, r.source_id, r.n_words) for r in found.collect()} == {(2, 1, 80), (4, 3, 70)}
    left = substring_dedup.remove(df, found)
    assert left.columns == df.columns
    assert sorted((r.doc_id, r.text, r.spans) for r in left.collect()) == sorted([*(r for r in rows if r[0] in (1, 3)), (2, short, "s"), (4, "z", "v")])


def test_removal_from_a_long_text(spark):
    rng = random.Random(10)
    words = [f"y{rng.randrange(10**6)}" for _ in range(200_000)]
    df = spark.createDataFrame([("a", " ".join(words[1000:1100])), ("b", " ".join(words))], "doc_id string, text string")
    found = substring_dedup.passages(df)
    assert [(r.doc_id, r.source_id, r.start, r.end) for r in found.collect()] == [("b", "a", 1000, 1100)]
    assert {r.doc_id: r.text for r in substring_dedup.remove(df, found).collect()}["b"] == " ".join(words[:1000] + words[1100:])


def test_whole_passages_whose_parts_are_in_smaller_documents(spark):
    """Every stretch of 50 equal words is found, whatever fragments other documents hold."""
    rng = random.Random(7)
    word = lambda n: [f"v{rng.randrange(9000)}" for _ in range(n)]
    docs = []
    for _ in range(6):
        p = word(60)
        docs += [p[:30] + word(40), p[30:] + word(40), word(20) + p + word(9), p[:30] + word(33), word(8) + p[30:], p[5:35] + word(8), word(9) + p + word(30), p[:20], p[18:45]]
    p = word(50)
    docs += [word(9) + p, p[:28] + word(9), p[22:] + word(9), p[10:40], word(30) + p]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id bigint, text string")
    places: dict[tuple, int] = {}
    want = set()
    for i, d in enumerate(docs):
        for x in range(len(d) - 49):
            if places.setdefault(tuple(d[x : x + 50]), i) < i:
                want.update((i, y) for y in range(x, x + 50))
    got = {(r.doc_id, y) for r in substring_dedup.passages(df).collect() for y in range(r.start, r.end)}
    assert want and want <= got


def test_passages_of_documents_against_brute_force(spark, small):
    """Every word of every repeated stretch of 50 words is found, and what is found is alike."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    words = {r.doc_id: alnum_words(r.text) for r in docs.orderBy("doc_id").collect()}
    first, want = {}, set()
    for i, w in words.items():
        for x in range(len(w) - 49):
            if first.setdefault(tuple(w[x : x + 50]), i) != i:
                want.update((i, y) for y in range(x, x + 50))
    found = substring_dedup.passages(docs).collect()
    assert want and want <= {(r.doc_id, y) for r in found for y in range(r.start, r.end)}
    for r in found:
        a, b = words[r.doc_id][r.start : r.end], words[r.source_id][r.source_start : r.source_end]
        known = {w: i for i, w in enumerate({*a, *b})}
        equal = len(substring_dedup.common([known[w] for w in a], [known[w] for w in b]))
        assert len(a) == r.n_words >= 50 and equal >= 0.8 * max(len(a), len(b)) and equal >= r.similarity * max(len(a), len(b)) - 1e-6


@pytest.mark.parametrize("edits", [0.1, 0.15, 0.2])
def test_edited_passages(spark, edits):
    """Passages of 50 to 110 words with a fifth of them edited at most; each pair is similar enough by construction."""
    rng = random.Random(8)
    word = lambda n: [f"v{rng.randrange(9000)}" for _ in range(n)]
    rows, want = [], {}
    for i in range(120):
        p = word(50 + 20 * (i % 4))
        q = list(p)
        for y in rng.sample(range(len(p)), int(len(p) * edits)):
            q[y] = f"e{rng.randrange(10**6)}"
        rows += [(2 * i, " ".join(word(70) + p + word(70))), (2 * i + 1, " ".join(word(20) + q + word(90)))]
        want[2 * i + 1] = 2 * i
    got = {r.doc_id: r for r in substring_dedup.passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(want[d] == r.source_id and r.n_words >= 50 and r.similarity >= 0.8 for d, r in got.items())
    assert len(got) >= 0.97 * len(want)


def test_edited_passages_whose_seeds_many_documents_have(spark):
    """An edited passage is found where the first and the nearest holders of each of its seeds are others than the document that has it."""
    rng = random.Random(12)
    word = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], {}
    for i in range(12):
        p = word(55)
        q = [w if y % 9 else f"e{rng.randrange(10**6)}" for y, w in enumerate(p)]  # no LEAST equal words
        # every run of eight and nine words of it stands alone in other documents, before and after the one that has it
        alone = lambda: [p[y : y + 10] + word(60) for y in range(0, 55, 9)]
        texts = [*alone(), *alone(), word(20) + p + word(30), *alone(), *alone(), *alone(), word(40) + q + word(20)]
        rows += [(100 * i + j, " ".join(t)) for j, t in enumerate(texts)]
        want[100 * i + len(texts) - 1] = 100 * i + 14
    got = {r.doc_id: r for r in substring_dedup.passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {d: r.source_id for d, r in got.items()} == want
    assert all(r.n_words >= 50 and r.similarity >= 0.8 for r in got.values())


def test_edited_passage_beside_many_places_of_its_seeds(spark):
    """A passage is found whatever the number of places that its seeds have in both documents."""
    rng = random.Random(13)
    word = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    p = word(55)
    q = [w if y % 9 else f"e{rng.randrange(10**6)}" for y, w in enumerate(p)]
    alone = lambda n: [w for _ in range(n) for y in range(0, 55, 9) for w in p[y : y + 10] + word(60)]
    first, second = alone(7) + p + alone(4), alone(2) + q + alone(9)
    found = substring_dedup.passages(spark.createDataFrame([(1, " ".join(first)), (2, " ".join(second))], "doc_id bigint, text string")).collect()
    at = len(alone(2))
    assert any(r.doc_id == 2 and r.start <= at + 5 and r.end >= at + 50 for r in found)


def test_pairs_left_out_have_too_few_words_in_common():
    """The bound is never below the number of words that two stretches have in common."""
    rng = np.random.default_rng(6)
    for _ in range(300):
        x, a = (rng.integers(0, rng.choice([5, 60, 10**6]), rng.integers(1, 120)).astype(np.uint64) for _ in range(2))
        x[: len(a) // 2] = a[: len(x[: len(a) // 2])]
        equal = sum((Counter(x.tolist()) & Counter(a.tolist())).values())
        (p, n), (q, m) = substring_dedup.bag(x), substring_dedup.bag(a)
        row = lambda raw: np.frombuffer(raw, np.uint64)[None]
        assert substring_dedup.enough_common(row(p), np.array([n]), row(q), np.array([m]), equal).all()
        assert not substring_dedup.enough_common(row(p), np.array([n]), row(q), np.array([m]), len(x) + 1).any()


def _rest(spark, texts, places):
    """``rest`` over texts of words, with given seeds, all of them capped, and no passages."""
    number: dict[str, int] = {}
    rows = [(i, len(t), np.array([number.setdefault(w, len(number)) for w in t], np.uint32).tobytes()) for i, t in enumerate(texts)]
    shared = spark.createDataFrame([(i, seed, at, True) for i, found in enumerate(places) for seed, at in found], "doc_id bigint, seed bigint, at int, capped boolean")
    found = spark.createDataFrame([], "doc_id bigint, start int, end int")
    tables = substring_dedup.Tables(spark, "rest-test")
    out = substring_dedup.rest(shared, found, spark.createDataFrame(rows, "doc_id bigint, n_words int, words binary"), tables).collect()
    tables.drop()
    return out


def test_rest_grows_with_the_documents(spark):
    """Of n documents that all share an edited passage each comes with the smallest one, not with all before it; one alike in other words is compared on."""
    word = lambda i, n: [f"w{i}_{y}" for y in range(n)]
    p = [f"p{y}" for y in range(60)]
    texts = [[*p[20:24], *word(0, 60), *p[30:34]], [*word(1, 30), *p[20:34], *word(-1, 30)]]  # both seeds, and no passage
    texts += [[*word(i, 9), *p[: i % 20], f"e{i}", *p[i % 20 + 1 :]] for i in range(2, 42)]
    got = _rest(spark, texts, [[(1, t.index("p20")), (2, t.index("p30"))] for t in texts])
    assert {r.doc_id: r.source for r in got} == dict.fromkeys(range(3, 42), 2) and len(got) == 2 * 39


def test_two_seeds_further_apart_in_the_source(spark):
    """A passage's source may be longer than the passage, and so may be the way between two seeds."""
    p = [f"p{y}" for y in range(50)]
    own = [f"e{y}" if y in (10, 20, 30) else w for y, w in enumerate(p)]
    source = [x for y, w in enumerate(p) for x in ([w, f"i{y}"] if y in (5, 8, 13, 17, 25, 28, 35, 40) else [w])]
    got = _rest(spark, [source, own], [[(1, 0), (2, 54)], [(1, 0), (2, 46)]])
    assert {(r.doc_id, r.source, r.at, r.source_at) for r in got} == {(1, 0, 0, 0), (1, 0, 46, 54)}


def test_bound_on_the_words_of_a_passage():
    """Where alignment finds a passage that holds two matches, the bound lets the pair through."""
    rng = np.random.default_rng(1)
    held = out = 0
    for _ in range(800):
        u = rng.integers(0, rng.choice([40, 400, 10**6]), rng.integers(45, 117)).astype(np.uint32)
        x = int(rng.integers(0, len(u) - 20))
        y, rate, v, ways = x + int(rng.integers(4, 16)), rng.choice([0.05, 0.1, 0.2, 0.3]), [], {}
        for i, w in enumerate(u.tolist()):
            ways[i] = len(v)
            edit = 3 if x <= i < x + 4 or y <= i < y + 4 or rng.random() > rate else rng.integers(0, 3)
            v += [[int(rng.integers(10**7))], [], [w, int(rng.integers(10**7))], [w]][edit]
        v, a, c = np.array(v, np.uint32), ways[x], ways[y]
        found = [p for p in substring_dedup.align(u, v, [(x, a), (y, c)]) if p[0] <= x and y + 4 <= p[1] and p[2] <= a and c + 4 <= p[3]]
        can = substring_dedup.can_hold(u, v, x, y + 4, a, 50, 0.8)
        assert can or not found
        held, out = held + bool(found), out + (not can)
    assert held > 500 and out > 20


def test_groups_stay_together():
    """Batches by the first column come in order of all columns, no value of the first one in two of them."""
    rng = np.random.default_rng(3)
    seed = np.sort(rng.integers(-40, 40, 400_000))
    rows = {"seed": seed, "doc_id": rng.integers(0, 90, len(seed)), "at": rng.integers(0, 9, len(seed))}
    whole = pa.RecordBatch.from_pydict(rows)
    out = list(substring_dedup.in_order((whole.slice(i, 9_000) for i in range(0, len(seed), 9_000)), "seed", "doc_id", "at"))
    got = [np.concatenate([b.column(c).to_numpy() for b in out]) for c in rows]
    order = np.lexsort((rows["at"], rows["doc_id"], rows["seed"]))
    assert len(out) > 1 and all((x == v[order]).all() for x, v in zip(got, rows.values(), strict=True))
    assert all(a.column(0)[-1] != b.column(0)[0] for a, b in zip(out, out[1:], strict=False))


def test_hashes_are_those_of_the_words():
    """Equal words have equal hashes, others not, whatever stands around them."""
    texts = [None, "", "  ", "Ab ab,AB", "x" * 40 + " " + "x" * 41 + " " + "x" * 40, "é日本 a-b é", "start ab"]
    got, want = alnum_hashes(texts), [alnum_words(t) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    pairs = {(w, int(h)) for ws, hs in zip(want, got, strict=True) for w, h in zip(ws, hs, strict=True)}
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})


def test_links_of_hot_seeds():
    """A hot seed is linked in each part, and its first documents over all parts."""
    row = lambda part: pa.RecordBatch.from_pydict({c: list(v) for c, v in zip(("seed", "doc_id", "at"), zip(*part, strict=True), strict=True)})
    flat = lambda found: [dict(zip(o, r, strict=True)) for o in found for r in zip(*o.values(), strict=True)]
    parts = [[(1, 1, 0), (2, 1, 5), (2, 3, 6), (2, 3, 9)], [(2, 4, 1), (2, 5, 2), (2, 6, 2), (2, 7, 2), (3, 1, 1)]]
    rows = [r for part in parts for r in flat(substring_dedup.near_links([row(part)], 2, frozenset([2])))]
    edges = sorted((r["seed"], r["doc_id"], r["at"]) for r in rows if r["source"] is None)
    rows += flat(substring_dedup.near_links([row(edges)], 2))
    links = {(r["doc_id"], r["source"], r["at"], r["source_at"]) for r in rows if r["source"] is not None}
    assert {(3, 1, 6, 5), (3, 1, 9, 5), (4, 3, 1, 6), (4, 3, 1, 9), (4, 1, 1, 5), (5, 4, 2, 1), (7, 6, 2, 2), (7, 5, 2, 2), (7, 4, 2, 1)} <= links
    assert all(d > s for d, s, _, _ in links)


def test_seed_places():
    rng = np.random.default_rng(1)
    for w in (3, 5, 8, 10, 16):
        for n in (1, 2, 8, 9, 100):
            h = rng.integers(0, 2**63, n).astype(np.uint64)
            assert substring_dedup.seed_places(h, w).tolist() == sorted({int(np.argmin(h[i : i + w])) + i for i in range(max(1, n - w + 1))})


def test_pairs_with_chains():
    rng = np.random.default_rng(4)
    for _ in range(200):
        sizes = rng.integers(1, 6, rng.integers(1, 8))
        runs = [np.sort(rng.integers(0, 120, n)) for n in sizes]
        x, starts, sure = np.concatenate(runs), np.r_[0, np.cumsum(sizes)[:-1]], rng.random(sizes.sum()) < 0.1
        got = substring_dedup.pairs_with_chains(x, sure, starts, 50, 4)
        want = [bool(sure[i : i + len(r)].any()) or any(4 <= q - p <= 46 for p in r for q in r) for i, r in zip(starts, runs, strict=True)]
        assert got.tolist() == want == [bool(sure[i : i + len(r)].any()) or substring_dedup._close(r, 50, 4) for i, r in zip(starts, runs, strict=True)]


def test_chains_against_brute_force():
    rng = random.Random(5)

    def best(points):
        points, score = sorted(set(points)), []
        for j, (x, a) in enumerate(points):
            before = [score[i] - 0.1 * (x - points[i][0] + a - points[i][1]) for i in range(j) if x > points[i][0] and a > points[i][1]]
            score.append(4 + max([0, *before]))
        return max(score)

    for _ in range(200):
        points = [(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randint(1, 25))]
        found = substring_dedup.chains(points)
        assert sorted(p for c in found for p in c) == sorted(set(points))
        for c in found:
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(c, c[1:], strict=False))
        top = found[0]
        value = 4 * len(top) - sum(0.1 * (q[0] - p[0] + q[1] - p[1]) for p, q in zip(top, top[1:], strict=False))
        assert value == pytest.approx(best(points))


def test_seeds_go_in_bundles(spark):
    """Occurrences of seeds go as a few rows of bytes and come out as they were, a seed in one bucket, a hot one dealt out by documents."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(0, 50, 400).astype(np.uint32).tobytes(), [3] if i % 3 else None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, words binary, inside array<int>").repartition(3)
    want = sorted(map(tuple, substring_dedup.seeds(docs).select("seed", "doc_id", "at").collect()))
    for hot in ((), (want[0][0], want[-1][0])):
        sent = spark.sparkContext.broadcast(frozenset(hot))
        found = substring_dedup.bundled(docs, 7, sent).toArrow().sort_by("bucket").to_batches()
        assert sum(b.num_rows for b in found) <= 7 * 3 < len(want)
        got = [list(zip(*(b.column(c).to_pylist() for c in ("seed", "doc_id", "at")), strict=True)) for b in substring_dedup.unbundled(found)]
        assert all(part == sorted(part) for part in got) and sorted(r for part in got for r in part) == want
        held = [{s for s, _, _ in part} for part in got]
        assert all(sum(s in h for h in held) == 1 for s in set().union(*held) if s not in hot)
