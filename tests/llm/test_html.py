import math
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import html, queries
from millrace.llm.common import WordHashes

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head>
<body class="home"><header>Head</header><nav><ul><li>One<li>Two</ul></nav><div class='cookie-notice'>We use cookies</div><!-- <p>no</p> -->
<div id=wrap><main><article><h1>A &amp; B</h1><p>First   <b>bo</b>ld&nbsp;text<br>next <p>Second<div class="ad">Buy</div><form><p>Name</p></form>
<aside>Side</aside><blockquote>Said &lt;b&gt; &#233;</blockquote><section class="reader-comments"><div><p>nice post</p></div></section><p>Last</article></main></div>
<footer>&copy; x"""


def texts_of(pages):
    return [" ".join(html.blocks(p)) for p in pages]


def test_article_without_the_rest():
    assert texts_of([PAGE, None, "", "<p", "a < b", "<div>x</div><div hidden>y</div>z"]) == ["A & B First bold text next Second Said <b> é Last", "", "", "", "a < b", "x z"]


def test_names_inside_and_around_an_article():
    inside = lambda name: f"<article><p>one</p><div class=\"{name}\"><p>two</p></div><p>three</p></article>"
    for name in ("post-comments", "article-comments", "content-ad", "article-related", "post-share", "adbox", "entry_comments", "post-sidebar", "x comments-area", "Ad"):
        assert texts_of([inside(name)]) == ["one three"], name
    for name in ("article-header", "post-header", "has-header", "no-sidebar", "with_comments", "entry-content", "loading", "admire", "no-comments post-body", "shared"):
        assert texts_of([inside(name)]) == ["one two three"], name
    comment = "<article><p>one</p></article><div><article class='comment depth-1'>no</article><article class=\"post-comment\">no</article></div><article class='no-comments'>yes</article>"
    assert texts_of([comment]) == ["one yes"]
    around = lambda name, body: f"<body><div class='{name}'><nav>menu</nav>{body}</div></body>"
    assert texts_of([around(n, "<p>text</p>") for n in ("has-header", "no-sidebar", "page")]) == ["text"] * 3
    assert texts_of([around(n, "<main><p>text</p></main>") for n in ("sidebar-left", "header-fixed", "page-with-banner")]) == ["text"] * 3
    assert texts_of([around("comments", "<article>no</article>"), around("sidebar", "<p>no</p>"), "<nav><article>no</article></nav><p>text</p>"]) == ["", "", "text"]


def test_unclosed_markup_is_linear():
    start = time.time()
    texts_of(["<a " + " \t" * 200_000, "<" * 300_000, '<div class="' + "x " * 200_000, "<div>" * 20_000 + "t", "<b " + '"' * 100_001])
    assert time.time() - start < 20


def brute_boilerplate(pages, least):
    different = {tuple(p) for p in pages}
    held = {}
    for p in different:
        for run in {p[i : i + html.RUN] for i in range(len(p) - html.RUN + 1)}:
            held[run] = held.get(run, 0) + 1
    out = []
    for p in pages:
        gone = [False] * len(p)
        for i in range(len(p) - html.RUN + 1):
            if held[tuple(p[i : i + html.RUN])] >= least:
                gone[i : i + html.RUN] = [True] * html.RUN
        out.append(gone)
    return out


def random_pages(n=30, seed=4):
    rng = random.Random(seed)
    common = [["c%d" % i for i in range(12)], ["d"] * 9]
    pages = []
    for _ in range(n):
        parts = [[rng.choice("abcxyz") for _ in range(rng.randrange(12))] for _ in range(3)] + [c for c in common if rng.random() < 0.6]
        rng.shuffle(parts)
        pages.append(sum(parts, []))
    return pages + [pages[0]] * 20 + [[]]


def test_runs_equal_brute_force():
    pages = random_pages()
    different = [np.array(html._stream(" ".join(p), WordHashes())) for p in map(list, {tuple(p) for p in pages})]
    runs, held = html.repeated_runs(different)
    for least in (1, 2, 10, 25):
        gone = np.sort(runs[held >= least])
        assert [html.covered(html._stream(" ".join(p), WordHashes()), gone).tolist() for p in pages] == brute_boilerplate(pages, least)


def test_texts_equal_brute_force_for_any_shard_size(spark, monkeypatch):
    rows, want = [], {}
    for h, (n, seed) in enumerate([(30, 4), (5, 8), (1, 9), (2, 10), (300, 11)]):
        pages = random_pages(n, seed)
        least = max(html.LEAST_PAGES, math.ceil(html.LEAST_SHARE * len({tuple(p) for p in pages})))
        for p, gone in zip(pages, brute_boilerplate(pages, least), strict=True):
            want[len(rows)] = " ".join(t for t, g in zip(p, gone, strict=True) if not g)
            rows.append((len(rows), f"http://h{h}.org/{len(rows)}", " ".join(p)))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("x"), "host": F.lit(2)})
    for chars, runs in ((html.SHARD_CHARS, html.BROADCAST_RUNS), (300, 1)):
        monkeypatch.setattr(html, "BROADCAST_RUNS", runs)
        assert {r.page_id: r.text for r in html.main_texts(frame, chars).collect()} == want
    assert sum(t != r[2] for r, t in zip(rows, want.values(), strict=True)) > 100


def test_site_wide_runs_go_and_shared_passages_stay(spark):
    rng = random.Random(6)
    note = " ".join("note%d" % i for i in range(20))
    passage = " ".join("shared%d" % i for i in range(30))
    own = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(25)) for _ in range(40)]
    # names that say nothing; one host of 40 pages, one of 4
    body = lambda i: f"<div class=c1>{note}</div><div class=c2>{own[i]}</div><div class=c3>{passage if i % 3 == 0 else f'y{i}'}</div><div class=c4>{note} end</div>"
    rows = [(i, f"http://h{i >= 36}.org/{i}", body(i), "z") for i in range(40)] + [(99, None, None, "z"), (None, "http://h0.org/3", "<p>only", "z")]
    got = {r.page_id: r.text for r in html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert all(got[i] == f"{own[i]} {passage if i % 3 == 0 else f'y{i}'}" for i in range(40))
    assert got[99] == "" and got[None] == "only"
    assert html.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_unclosed_items_and_names_inside_the_article():
    assert texts_of(['<ul><li class="share">Share<li>Real one<li>Real two</ul>']) == ["Real one Real two"]
    assert texts_of(['<article><div class="article-header"><p>Lead</div><p class="notice">Cookies<p>Text</article>']) == ["Lead Text"]


def test_query_gives_whole_articles(spark, sf_dir):
    import html as entities

    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").join(queries.op10_html_text(spark, sf_dir).drop("url"), "page_id").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = " ".join(entities.unescape(re.sub(r"<(?:p|/p|br|h1|/h1)>", " ", article).replace("<b>", "").replace("</b>", "")).split())
        assert r.text == want and r.n_chars == len(want)
