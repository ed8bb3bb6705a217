"""Exact top-k search and page text."""

import math

import numpy as np
from pyspark.sql import functions as F

from tillroll.llm.html_template import extract_main_text, main_text
from tillroll.llm.topk import exact_top_k

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


def plain_top_k(data: list[tuple], k: int) -> list[tuple]:
    rows = [(i, key, [math.floor(256 * float(np.float32(x))) for x in v]) for key, (i, v) in enumerate(data)
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, key, v in rows:
        if i is None or i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j, other) for j, other, w in rows if other != key)
        out += [(i, rank, j, -s) for rank, (s, _, j, _) in enumerate(scored[:k], 1)]
    return out


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(0, 0.3, 8).tolist()) for i in range(600)]
    data += [(600 + i, data[0][1]) for i in range(300)]  # one very common vector
    data += [(i, [1.0] * 8) for i in (50, 50, 1001)]  # repeated ids
    data += [(2000, None), (2050, [None] * 8), (2100, [float("nan")] + [0.0] * 7), (2101, [float("inf")] * 8),
             (2150, []), (2151, [0.5, 0.5]), (None, [0.9] * 8)]
    df = spark.createDataFrame([(i, v, 0, 0.0) for i, v in data], SCHEMA)
    for sizes in ({}, {"pivots": 3, "rings": 2, "block_rows": 64, "block_queries": 5}):
        got = exact_top_k(df, F.col("vec_id") % 50 == 0, 5, **sizes).collect()
        assert sorted((r.query_id, r["rank"], r.score) for r in got) == sorted((q, n, s) for q, n, _, s in plain_top_k(data, 5))
        assert sorted(map(str, got)) and {(r.query_id, r["rank"], r.vec_id) for r in got} == {
            (q, n, j) for q, n, j, _ in plain_top_k(data, 5)}


def test_top_k_of_few_rows(spark):
    df = spark.createDataFrame([(0, [0.1, 0.2], 0, 0.0), (1, [0.3, -0.2], 0, 0.0)], SCHEMA)
    got = exact_top_k(df, F.col("vec_id") % 50 == 0, 5).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 25 * 76 + 51 * -52)]
    assert exact_top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).collect() == []
    assert exact_top_k(df.where("vec_id = 1"), F.col("vec_id") % 50 == 0, 5).collect() == []


PAGE = """<html><head><title>t {n}</title></head><body>
<div class="x1"><span>Home</span><span>News</span><p>Read all about it every day</p></div>
<div class="x2"><h2>Story {n}</h2><p>Body of story {n}, with &lt;tags&gt; &amp; more{more}.</p><p>Second part {n}</p></div>
<div class="x3"><p>All rights kept</p></div></body></html>"""


def test_template_is_left_out_without_landmarks(spark):
    pages = [(n, f"http://h.example/{n}", PAGE.format(n=n, more=" words" * n)) for n in range(20)]
    pages += [(100, "http://h.example/odd", None), (101, None, PAGE.format(n=101, more="")), (None, "x", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in extract_main_text(df).collect()}
    for n in range(20):
        assert got[n] == f"Story {n} Body of story {n}, with <tags> & more{' words' * n}. Second part {n}"
    assert got[100] == "" and got[None] == "" and "Body of story 101" in got[101]
    assert extract_main_text(df.limit(0)).collect() == []


def test_parts_of_a_page():
    cases = {
        "<nav>menu</nav><article><h1>Title</h1><p>a<b>b</b> c<br>d</p><aside>x</aside></article><footer>f</footer>":
            "Title ab c d",
        "<article>x &amp; y&nbsp;z &lt;q<p>1<p>2</article> tail": "x & y z <q 1 2",
        '<div class="comments"><p>no</p></div><div>yes</div>': "yes",
        '<div id="cookie-notice">no</div><form><input>no</form><main>yes<form>no</form></main>': "yes",
        '<script>var a="</p><article>no";</script><article>ok</article>': "ok",
        "<!-- <article>no</article> --><p>a\n\t b</p><p></p>": "a b",
        "a < b and c": "a < b and c", "<p": "", "": "", "<article><p>open <b>ends": "open ends",
        "<ul><li>1<li>2</ul>": "1 2", "x" * 100_000: "x" * 100_000,
    }
    for page, text in cases.items():
        assert main_text(page, frozenset(), None) == text


def test_layout_wrappers_are_no_furniture():
    cases = {
        '<div class="content-sidebar-wrap"><main><p>all of it</p></main></div>': "all of it",
        '<div class="site has-sidebar"><div class="sidebar">no</div><p>all of it</p></div>': "all of it",
        '<div class="layout no-ads"><article><p>all of it</p></article></div>': "all of it",
        '<form id="aspnetForm"><nav>menu</nav><div><p>all of it</p></div><div class="comments"><p>no, no</p></div></form>':
            "all of it",
        '<div class="sidebar"><main role="main"><p>all of it</p></main></div><p>no</p>': "all of it",
        '<form><article><p>all of it</p></article><div class="comments"><article>no</article></div></form>': "all of it",
        '<article><div class="post-header"><h1>Title</h1></div><p>text</p></article>': "Title text",
        '<article><div class="header"><h1>Title</h1></div><p>text</p><div class="share">no</div></article>': "Title text",
        "<article><figure><img><figcaption>caption</figcaption></figure><p>text <math><mi>x</mi><mo>=</mo><mn>1</mn>"
        "<annotation>x=1</annotation></math></p></article>": "caption text x=1",
        '<div class="modal"><p>Sign up</p></div><div><p>the longer text of the page</p></div>': "the longer text of the page",
    }
    for page, text in cases.items():
        assert main_text(page, frozenset(), None) == text, page


SPLIT = """<body><div class="x1"><span>Home</span><span>News</span></div><div class="x2"><h1>Story {n}</h1>
<div class="lead">Lead of {n}{lead}.</div><div class="body"><p>Body of {n}{body}.</p></div></div></body>"""


def test_text_of_pages_without_an_article_stays_whole(spark):
    fill = {"lead": " and more of it" * 6, "body": " and still more of it" * 9}
    pages = [(n, f"http://a.example/{n}", SPLIT.format(n=n, **fill)) for n in range(12)]
    pages.append((50, "http://a.example/50", f"<body><div class='y'>Other {'layout ' * 20}</div><div class='x2'>scrap</div>"))
    # more than half of a host's pages copy one article, and all pages of another are copies
    pages += [(100 + n, f"http://b.example/{n}", PAGE.format(n=max(n, 11), more="")) for n in range(20)]
    pages += [(200 + n, f"http://c.example/{n}", PAGE.format(n=7, more="")) for n in range(20)]
    got = {r.page_id: r.text for r in extract_main_text(
        spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for n in range(12):
        assert got[n] == f"Story {n} Lead of {n}{fill['lead']}. Body of {n}{fill['body']}."
    assert got[50] == f"Other {'layout ' * 20}scrap"
    for n in range(20):
        k = max(n, 11)
        assert got[100 + n] == f"Story {k} Body of story {k}, with <tags> & more. Second part {k}"
        assert "Story 7 Body of story 7, with <tags> & more. Second part 7" in got[200 + n]
