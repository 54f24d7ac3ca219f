"""Joins, searches, page extraction and the pipeline against brute force."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from sieveline.llm import common, graph, html_text, jaccard, topk, url_filter  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_join(rows, percent=75):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if any(100 * len(p & q) >= percent * len(p | q) > 0 for p in sets[a] for q in sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def families(seed, n=14, words=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    out = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(6, 200))]
        for _ in range(rng.randint(1, 12)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 30))):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                t = t[: int(len(t) * rng.uniform(0.7, 1))]
            out.append(" ".join(t) + (f" {passage}" if rng.random() < 0.4 else ""))
    return out


def test_jaccard(spark):
    texts = [*families(1), *families(2), None, "", " \n", "a b", "A  b\n", "a b c d e", "a b c d E f", "x " * 3000, "x " * 2900]
    rows = [(i, t, "u") for i, t in enumerate(texts)] + [(5, texts[5], "v"), (7, texts[30], "v"), (None, "a b", "v")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string")
    want = plain_join([(i, t) for i, t, _ in rows if i is not None])
    got = jaccard.join(docs).collect()
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(shingles(t))) for i, t, _ in rows)
    assert all(r.component_id == want.get(r.doc_id) for r in got)
    assert jaccard.join(docs.limit(0)).count() == 0


def test_jaccard_blocks(spark, monkeypatch):
    """Tiles of several blocks and units, and no star, give the same components."""
    monkeypatch.setattr(jaccard, "TILE", 4)
    monkeypatch.setattr(jaccard, "UNIT", 3)
    monkeypatch.setattr(jaccard, "STAR", 0)  # no pair shares that much
    texts = families(3, 6) + families(4, 6)
    got = jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == plain_join(list(enumerate(texts)))


@pytest.mark.parametrize("percent", [1, 30, 50, 90, 100])
def test_jaccard_percents(spark, monkeypatch, percent):
    """Without the star every link must come from tiles, between bitmaps of all widths that sizes allow."""
    monkeypatch.setattr(jaccard, "STAR", 0)
    texts = [" ".join(f"s{i}" for i in range(k)) for k in (104, 304, 34, 3004, 120, 1000)] + families(5, 4) + ["a b c d e f", "a b c d e f g h i j"]
    got = jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), percent=percent).collect()
    assert {r.doc_id: r.component_id for r in got} == plain_join(list(enumerate(texts)), percent)


def test_bitmap_bound():
    rng = np.random.default_rng(1)
    pool = common.splitmix(np.arange(5000, dtype=np.uint64))
    for k in range(200):
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 900))) for _ in range(2))
        x, y = (jaccard.bitmap(s, (75, 30, 90)[k % 3], k % 2 > 0) for s in (a, b))
        w = min(len(x), len(y))
        apart = int(np.bitwise_count(jaccard._fold(x, w) ^ jaccard._fold(y, w)).sum())
        assert jaccard.overlap(a, b) == len(np.intersect1d(a, b)) <= (len(a) + len(b) - apart) // 2


def test_runs_over_batches():
    rng = np.random.default_rng(2)
    key = np.sort(rng.integers(0, 40, 300))
    rows = list(zip(key.tolist(), range(300), [9] * 300, strict=True))
    for size in (1, 2, 7, 300):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + size]], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], ["key", "doc", "n"]) for i in range(0, 300, size)]
        got = [tuple(r.values()) for b in jaccard._runs(iter(batches)) for r in b.to_pylist()]
        first = {}
        for k, d, _ in rows:
            first.setdefault(k, d)
        many = Counter(key.tolist())
        assert [g for g in got if g[2] >= 0] == [(k, d, n, first[k], 9) for k, d, n in rows if many[k] > 1]
        ends = [g for g in got if g[2] < 0]
        assert [g[0] for g in ends] == sorted(k for k in many if many[k] > 1)
        for k, a, _, b, _ in ends:
            assert (a, b) == jaccard._digest(np.array([d for x, d, _ in rows if x == k], np.uint64))


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7), (None, 3)]
    got = {r.id: r.label for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint"), common.Scratch(spark, "test")).collect()}
    parent = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a in parent and b in parent and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in parent}


# ---------------------------------------------------------------- search

def test_topk(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 0.2, (700, 12)) + rng.normal(0, 0.3, (7, 12)).repeat(100, 0)
    base[200:400] = base[0]  # a common vector, so ties
    vectors = [(i, v.tolist()) for i, v in enumerate(base.astype(np.float32))]
    vectors += [(1000, None), (1050, [1.0] * 11 + [None]), (1100, [float("nan")] * 12), (1150, [float("inf")] * 12), (1200, [0.5, 0.5]), (1201, [0.25, 0.5]), (None, [0.1] * 12), (3, [0.9] * 12), (1250, []), (1300, [1e30] * 12), (1301, [-1e30] * 12), (1302, [3e7] * 12)]
    got = topk.search(spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>"), F.col("vec_id") % 50 == 0, rows=64, pivots=8, queries=3).collect()
    live = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in vectors if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for q, x in live:
        if q % 50 == 0:
            exact = lambda x, y: max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * int(b) for a, b in zip(x, y, strict=True))))
            score = sorted(((-exact(x, y), i) for i, y in live if i != q and len(y) == len(x)))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(score)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.search(none, F.col("vec_id") % 50 == 0).count() == 0


# ---------------------------------------------------------------- urls

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "bad.org", "")]


def test_rules(spark):
    urls = ["http://A.Example.com/en/71?x", "https://x.com/en/1#y", "http://com/en/", "ftp://w.net/de/a?b", "http://xcom/en/", "http://x.com", "nonsense", None, "http://x.com:80/en/1", "a://b.org/c://d", "http://bad.org?q", "http://É.com/en/"]
    pages = spark.createDataFrame([(i, u, None, "z") for i, u in enumerate(urls)], "page_id bigint, url string, html string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, RULES).collect()}
    assert got[0] == ("a.example.com", "/en/71", "example.com/en/7", "allow")
    assert got[1] == ("x.com", "/en/1", "com/en/", "block") and got[2][2] == "com/en/"
    assert got[3] == ("w.net", "/de/a", "net/de/", "allow")
    assert got[4] == ("xcom", "/en/", None, "allow")
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8][0] == "x.com:80" and got[8][2] is None
    assert got[9][:2] == ("b.org", "/c://d") and got[10] == ("bad.org", "", "bad.org", "block") and got[11][0] == "É.com"
    assert url_filter.judge(pages.limit(0), RULES).count() == 0


def test_propagation(spark):
    link = lambda *hs: "".join(f'<A class=x HREF="{h}">t</a>' for h in hs)
    pages = spark.createDataFrame([
        (1, "http://good.net/de/1", link("http://friend.io/a", "//friend.io/b", "/local")), (2, "http://friend.io/x", link("https://pal.io/")), (3, "http://pal.io/x", ""),
        (4, "http://spam.io/x", link("http://bad.org/1")), (5, "http://bad.org/x", ""), (6, "http://mixed.io/y", link("http://bad.org/2", "http://pal.io/z")), (7, "http://lone.io/y", None),
    ], "page_id bigint, url string, html string")
    edges = {(r.src, r.dst): r.w for r in url_filter.host_edges(pages).collect()}
    assert edges == {("good.net", "friend.io"): 2, ("friend.io", "pal.io"): 1, ("spam.io", "bad.org"): 1, ("mixed.io", "bad.org"): 1, ("mixed.io", "pal.io"): 1}
    seeds = {"good.net": (1.0, 0.0), "bad.org": (0.0, 1.0)}
    trust, distrust = {h: s[0] for h, s in seeds.items()}, {h: s[1] for h, s in seeds.items()}
    for _ in range(20):  # plain power iteration
        t2, d2 = {h: s[0] for h, s in seeds.items()}, {h: s[1] for h, s in seeds.items()}
        for (a, b), w in edges.items():
            t2[b] = t2.get(b, 0) + 0.85 * trust.get(a, 0) * w / sum(x for (c, _), x in edges.items() if c == a)
            d2[a] = d2.get(a, 0) + 0.85 * distrust.get(b, 0) * w / sum(x for (_, c), x in edges.items() if c == b)
        trust, distrust = t2, d2
    frame = spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, good double, bad double")
    state = {r.host: (r.trust, r.distrust) for r in url_filter.propagate(url_filter.host_edges(pages), frame, common.Scratch(spark, "t")).collect()}
    for h in {*trust, *distrust}:
        assert state[h] == pytest.approx((trust.get(h, 0), distrust.get(h, 0)), abs=1e-3)
    verdict = {r.page_id: r.verdict for r in url_filter.judge(pages.unionByName(pages.filter("page_id = 7")), RULES, threshold=0.4, kinship=0).collect()}
    assert verdict == {1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "allow" if trust["pal.io"] and distrust["mixed.io"] < 0.4 else "block", 7: "allow"}


def test_kinship(spark):
    """Hosts of a domain share trust and distrust, where their own pages alone would say something else."""
    hosts = spark.createDataFrame([("www.a.example.com",), ("a.example.com",), ("10.0.0.1",), ("x.org",), ("b.example.com:80",)], "host string")
    assert {(r.src, r.dst) for r in url_filter.kin_edges(hosts).collect() if len(r.src) > len(r.dst)} == {("www.a.example.com", "a.example.com"), ("a.example.com", "example.com"), ("b.example.com:80", "example.com:80")}
    rows = [(i, f"http://{h}/{p}", "") for i, (h, p) in enumerate([("m.farm.bad.com", "en/1"), ("w.farm.bad.com", "en/1"), ("farm.bad.com", "en/2"), ("new.farm.bad.com", "x"), ("fine.net", "de/1"), ("www.fine.net", "x"), ("lone.io", "x")])]
    rules = [("block", "com", "/en/"), ("allow", "net", "/de/")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for name in ("_m", "_h", "_v", "_host", "_match", "_verdict", "a.b"):
        pages = pages.withColumn(name, F.lit(name))
    verdict = lambda k: {r.page_id: r.verdict for r in url_filter.judge(pages, rules, kinship=k).collect()}
    assert {k for k, v in verdict(0).items() if v == "block"} == {0, 1, 2}
    assert {k for k, v in verdict(1.0).items() if v == "block"} == {0, 1, 2, 3}
    assert all(r[c] == c for r in url_filter.judge(pages, rules).collect() for c in ("_m", "_h", "_v", "_host", "_match", "_verdict", "a.b"))


# ---------------------------------------------------------------- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header class="site-header"><a href=/>Home</a></header><nav><ul><li><a href=/a>One</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, please accept all of them now.</p></div><div id="content"><h1>Title &amp; more</h1><p>First   paragraph of the <b>story</b>,<br>long enough.</p><p>Short.
<div class="ad-box">Buy now! Cheap things for all of you, today only.</div><blockquote>A quote, too.</blockquote><ul><li>point one.<li>point two.</ul><p>Last &lt;b&gt; one.</p></div>
<form><label>Email</label><input><button>Go</button></form><section id="comments"><h3>Comments</h3><p>Great article, I liked it very much indeed, thanks for all.</p></section>
<aside><p>Another long story about things that happened elsewhere.</p></aside><footer>&copy; us</footer><script>var x="<p>no</p>"</script><!-- <p>no</p> --></body></html>"""
TEXT = "Title & more\nFirst paragraph of the story, long enough.\nShort.\nA quote, too.\npoint one.\npoint two.\nLast <b> one."


PLAIN = html_text.Model(html_text.fit([]))


def test_page():
    assert html_text.main_text(PAGE, PLAIN) == TEXT
    for bad in (None, "", "   ", "<p>", "<script>x", "<!-- x", "<"):
        assert html_text.main_text(bad, PLAIN) in ("", "<")
    long = "<article>" + "<p>Some words of a paragraph.</p>" * 3000 + "</article>"
    assert html_text.main_text(long, PLAIN).count("\n") == 2999
    assert html_text.main_text("<article><p>cut off &am", PLAIN) == "cut off &am"
    assert html_text.main_text("<article><p>cut off</p", PLAIN) == "cut off"


def test_markup():
    text = lambda x: html_text.main_text(x, PLAIN)
    assert text("<article><p title=it's>Hello there, I don't know.</p><p>And so it goes on, as ever.</p></article>") == "Hello there, I don't know.\nAnd so it goes on, as ever."
    assert text('<p title="x>Hello there to all of you.') == "Hello there to all of you."
    assert text('<p title="a>b" data-x=\'<p>\'>Hello there to all of you.') == "Hello there to all of you."
    assert text('<article class="alert-news"><p>Real story of the day.</p></article>') == "Real story of the day."
    assert text('<article><div class="related-work">Others did this before.</div><div class="share-price">It rose to 5.</div></article>') == "Others did this before.\nIt rose to 5."
    assert text("<article>so <math>x=1</math> and <svg/>on <button>z<p>kept<script/>too</article><nav>w</nav>") == "so x=1 and on\nkepttoo"
    assert text("<article><pre>a  b\n c</pre><p>one<br>two &lt;p&gt;</article>") == "a b c\none two <p>"
    import time

    began = time.perf_counter()
    assert html_text.parse("<div>x" * 20_000)[-1].text == "x" and len(html_text.parse("<b>" * 20_000 + "<p>y" * 5000 + "</i>" * 20_000)) == 5000
    html_text.main_text("<article>" + "<p>Some words of a paragraph.</p><p>no</p>" * 5000, PLAIN)
    assert time.perf_counter() - began < 20  # in time linear in the page


SEMANTIC = "article|main|nav|aside|footer|form|header"


def plain_pages(n, rng):
    """(page, text of its article)."""
    words = [a + b for a in ("ta", "ro", "mi", "sel", "vun") for b in ("", "ne", "lo", "kir", "dath")]
    some = lambda k: " ".join(rng.choice(words) for _ in range(k))
    out = []
    for _ in range(n):
        paragraphs = [f"{some(rng.randint(2, 60))}." for _ in range(rng.randint(2, 9))]
        links = "".join(f"<li><a href=/{some(1)}>{some(1)}</a></li>" for _ in range(6))
        out.append((
            f"<html><body><header><a href=/>{some(2)}</a></header><nav><ul>{links}</ul></nav><div class=ad>{some(5)}</div><article><h1>{some(6)}</h1>"
            + "".join(f"<p>{p}</p>" for p in paragraphs[:1]) + f"<h2>{some(2)}</h2>" + "".join(f"<p>{p}</p>" for p in paragraphs[1:]) + f"</article><footer>&copy; {some(3)}</footer></body></html>",
            paragraphs,
        ))
    return out


def test_learned_from_tags_and_used_without():
    """A model that learned from telling tags finds articles where these and all names are gone."""
    rng = random.Random(4)
    pages = plain_pages(120, rng)
    model = html_text.learn([p for p, _ in pages[:80]])
    right = same = changed = 0
    for page, paragraphs in pages[80:]:
        want = [b.text for b in html_text.parse(page) if b.label == 1]
        assert [x for x in want if x in paragraphs] == paragraphs
        right += html_text.main_text(page, model) == "\n".join(want)
        stripped = re.sub(r"(?i)\s(?:class|id|role)=\S+?(?=[\s>])", "", re.sub(rf"<(/?)(?:{SEMANTIC})\b", r"<\1div", page))
        same += html_text.main_text(stripped, model) == "\n".join(want)
        blocks = html_text.parse(stripped)
        changed += sum(x != (u > 0) for x, u in zip(html_text.labels(blocks, model, 2), model.logits(blocks, 2), strict=True))
    assert right == 40 and same >= 36 and changed > 0  # with shape alone the cut decides some


def test_min_cut():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 9)
        unary = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 1.5)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        cost = lambda ls: sum(u for u, x in zip(unary, ls, strict=True) if not x) + sum(w for i, j, w in edges if ls[i] != ls[j])  # noqa: B023, E731
        best = min(cost(ls) for ls in itertools.product((False, True), repeat=n))
        assert cost(html_text.min_cut(unary, edges)) == pytest.approx(best)


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "q"), (1, "u", PAGE, "q"), (2, None, None, "q"), (3, "v", "", "q")], "page_id bigint, url string, html string, text string")
    got = html_text.extract(pages.withColumn("_html", F.lit(1)).drop("_html"), model=PLAIN)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert Counter((r.page_id, r.text, r.n_chars) for r in got.collect()) == {(1, TEXT, len(TEXT)): 2, (2, "", 0): 1, (3, "", 0): 1}
    assert html_text.extract(pages.limit(0)).count() == 0
    clash = html_text.extract(pages.withColumn("_html", F.lit(1)).withColumn("a.b", F.lit(2)), model=PLAIN).first()
    assert clash["_html"] == 1 and clash["a.b"] == 2
    decided = pages.filter("page_id = 1").withColumn("html", F.replace("html", F.lit('<div id="content">'), F.lit("<article>")))
    assert (html_text.train(decided).w != PLAIN.w).any() and (html_text.train(pages.limit(0)).w == PLAIN.w).all()
    got = html_text.extract(decided)
    assert got.first().text == TEXT


# ---------------------------------------------------------------- pipeline

def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    vocabulary = [a + b + c for a in ("ba", "ko", "mi", "tu", "re") for b in ("lan", "ver", "sto", "qui") for c in ("", "d", "na", "ros")]
    line = lambda: " ".join(rng.choice(vocabulary) for _ in range(25))
    passage = "\n".join(line() for _ in range(3))
    rows, marks = [], []
    for i in range(400):
        text = "\n".join(line() for _ in range(4))
        if i % 10 == 3:
            text = text.replace(" ", " idiot ", 6)
        elif i % 10 == 5:
            text = f"{text}\n{passage}"
        elif i % 50 == 7:
            text = rows[i - 1][1].replace("\n", " ") + " extra"  # a near copy, on one line
        elif i % 50 == 8:
            text = "too short"
        rows.append((i, text, "en", "s", len(text)))
        marks.append((i, 1, int("idiot" in text)))
    rows += [(400, None, None, None, None), (401, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in out}
    toxic = {i for i, _, t in marks if t}
    short = {i for i, t, *_ in rows if len((t or "").split()) < 50}
    copies = {i for i in range(400) if i % 50 == 7 and i % 10 != 3}
    assert kept == set(range(402)) - toxic - short - copies
    # what is packed are the texts after line dedup, id by id
    from test_text_ops import plain_dedup, tokens

    left = plain_dedup([(i, t) for i, t, *_ in rows if i not in toxic | short])
    texts = {i: t for (i, _), t in left.items() if i in kept}
    assert any("\n" in t and passage not in t and rows[i][1] != t for i, t in texts.items())
    for r in out:
        ids = np.array([*tokens(texts[r.doc_id]), 2], "<u4")
        assert (r.doc_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids[r.start : r.start + r.length].tobytes()))
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 4096 for v in by.values())
    assert all(len(s) == 2 and callable(s[1]) for s in corpus_pipeline.STAGES)


def test_pipeline_empty_and_repeated(spark, tmp_path):
    import corpus_pipeline

    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, a), (1, b), (2, a), (None, a), (None, a), (None, b), (3, None), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], kind).withColumn("row", F.lit(1)).withColumn("_gone", F.lit(2))
    got = corpus_pipeline.near_copies_go(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, a), (1, b), (None, a), (None, b), (3, None), (3, None), (4, "")])
    assert {r.doc_id for r in corpus_pipeline.poor_go(spark, docs, str(tmp_path)).collect()} == {1, 2, None}
