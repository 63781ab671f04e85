"""Main text: cuts against all labellings, the query against the articles read by plain patterns, many layouts, odd markup and rows."""

from __future__ import annotations

import html
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import maintext
from sparkloom.llm.queries import QUERIES

LONG = "The river rose slowly over the fields, and nobody in the village, old or young, could say when it had last done so. "
NONE = np.zeros(sum(maintext.FEATURES) + 1)


def article_of(page):
    """What stands in the one article of a page of the given tables: headings and paragraphs."""
    inside = re.search("<article>(.*?)</article>", page or "", re.S)[1]
    parts = [" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
    return "\n\n".join(x for x in parts if x)


@pytest.fixture(scope="module")
def weights(spark):
    return maintext.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_the_articles(spark, folder):
    pages = {r.page_id: r for r in spark.read.parquet(f"/root/testdata/{folder}/pages.parquet").collect()}
    rows = QUERIES["op13_minimum_cut_main_text"](spark, f"/root/testdata/{folder}").collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, article_of(pages[r.page_id].html), len(r.text))


def loss(gain, edges, label):
    return sum(max(0, -g) if k else max(0, g) for g, k in zip(gain, label)) + sum(c for a, b, c in edges if label[a] != label[b])


def test_cut_is_least_of_all_labellings():
    rng = random.Random(7)
    for _ in range(1500):
        n = rng.randint(1, 8)
        gain = [rng.randint(-6, 6) for _ in range(n)]
        edges = [(a, b, rng.randint(0, 5)) for a in range(n) for b in range(a + 1, n) if b == a + 1 or rng.random() < 0.3]
        every = [[bool(m >> k & 1) for k in range(n)] for m in range(1 << n)]
        least = min(loss(gain, edges, x) for x in every)
        found = maintext.cut(gain, edges)
        assert loss(gain, edges, found) == least
        assert sum(found) == max(sum(x) for x in every if loss(gain, edges, x) == least)


def test_cut_turns_a_weak_block_with_its_neighbours():
    assert maintext.cut([5, -1, 5], [(0, 1, 1), (1, 2, 1)]) == [True, True, True]
    assert maintext.cut([5, -3, 5], [(0, 1, 1), (1, 2, 1)]) == [True, False, True]
    assert maintext.cut([0, 0], [(0, 1, 4)]) == [True, True] and maintext.cut([], []) == []


def test_long_runs_of_undecided_blocks_end():
    rng = random.Random(2)
    blocks = [maintext.Block("x", "p", 0, rng.randint(0, 2000), rng.randint(0, 6)) for _ in range(20_000)]
    began = time.time()
    gain = [rng.randint(-900, 900) for _ in blocks]
    found = maintext.cut(gain, maintext.ties(blocks))
    assert len(found) == len(blocks) and time.time() - began < 60
    assert loss(gain, maintext.ties(blocks), found) <= min(loss(gain, maintext.ties(blocks), [k] * len(blocks)) for k in (True, False))


BODY = f"<h1>A flood</h1><p>{LONG}</p><p>Short.</p><p>{LONG * 2}</p>"
TEXT = f"A flood\n\n{LONG.strip()}\n\nShort.\n\n{(LONG * 2).strip()}"
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/news>News</a></li><li><a href=/about>About us</a></li></ul>"
LAYOUTS = {
    "semantic": f"<header><a href=/>The Site</a></header><nav>{MENU}</nav><main><article>{BODY}</article></main><aside><p>{LONG}</p></aside><footer><p>{LONG}</p></footer>",
    "named divs": f'<div id="top-header">The Site</div><div class="navMenu">{MENU}</div><div class="post-content">{BODY}</div><div id="sidebar"><h3>Latest</h3><p>{LONG}</p></div><div class="site-footer">{LONG}</div>',
    "article header": f'<article><header class="entry-header"><h1>A flood</h1></header>{BODY[16:]}<footer>{LONG}</footer></article>',
    "comments": f'<article>{BODY}<section id="comments"><h2>3 comments</h2><article class="comment"><p>{LONG}</p></article></section></article><ol class="commentlist"><li><p>{LONG}</p></li></ol>',
    "notices and forms": f'<div class="cookie-notice"><p>{LONG}</p></div><div role="alert">{LONG}</div><main>{BODY}<form><label>Mail</label><input><p>{LONG}</p><button>Send it. Now.</button></form><div class="newsletter-signup"><p>{LONG}</p></div></main>',
    "adverts inside": f'<article><h1>A flood</h1><p>{LONG}</p><div class="ad"><p>{LONG}</p></div><p class="advert">{LONG}</p><p>Short.</p><p>{LONG * 2}</p></article>',
    "scripts and styles": f'<script>document.write("<p>{LONG}</p>")</script><style>p > a {{}}</style><article><h1>A flood</h1><p>{LONG}<script>if (a < b) x("</p>")</script></p><!-- <p>{LONG}</p> --><p>Short.<noscript>Turn it on</noscript></p><template><p>no</p></template><p>{LONG * 2}<svg><title>x</title><path/></svg></p></article>',
    "hidden": f'<article><div style="display: none">{LONG}</div><h1>A flood</h1><p>{LONG}<span hidden>secret</span></p><p aria-hidden=true>{LONG}</p><p>Short.</p><p>{LONG * 2}</p></article>',
    "whole page form": f"<form id=aspnet><nav>{MENU}</nav><main>{BODY}</main></form>",
    "states": f'<body class="has-sidebar no-comments"><div class="content has-sidebar"><div>{BODY}</div></div>',
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(weights, layout):
    page = f"<!doctype html><html><head><title>No</title></head><body>{LAYOUTS[layout]}</body></html>"
    for found in (weights, NONE):
        assert maintext.main_text(page, found) == TEXT


def test_pages_without_any_mark_are_judged_by_their_text(weights):
    page = f"<div>{MENU}</div><div>{BODY}</div><div><a href=/x>Imprint</a> | <a href=/y>Contact</a></div>"
    assert maintext.main_text(page, weights) == TEXT


def test_markup_and_references():
    read = lambda page: [b.text for b in maintext.blocks_of(page)]
    assert read("<p>a &lt;b&gt; &amp;amp; &eacute;&#33; &am &copy\n\tx&nbsp;y<p>c") == ["a <b> &amp; é! &am © x y", "c"]
    assert read('<p title="a > b" data-x=\'</p>\'>one<b>two</b> three<br>four</p>five') == ["onetwo three four", "five"]
    assert read("<ul><li>a<li>b<ul><li>c</ul>d</ul><table><tr><td>1<td>2<tr><th>3</table>") == ["a", "b", "c", "d", "1", "2", "3"]
    assert read("x < y <3 a<p>z") == ["x < y <3 a", "z"] and read("a<!-- b") == ["a"] and read("<p>a</p><p class='x") == ["a"]
    assert read("a<!x>b</ >c<?y?>d") == ["abcd"] and read("<script>a</SCRIPT >b<style>never closed") == ["b"] and read("") == []
    assert read("<p>a <button>no<button>nor</button></button> b</p><div><button>never closed</div><p>c<article><button>nor<main>d") == ["a b", "c", "d"]
    deep = maintext.blocks_of("<div>" * 5000 + "<p>inside" + "</div>" * 5000 + "<p>after")
    assert [b.text for b in deep] == ["inside", "after"]


def test_one_read_of_long_pages():
    began = time.time()
    for page in ("<a<b" * 200_000, "<p " * 200_000, '<p x="' * 200_000, "<b>x" * 100_000 + "</i>" * 100_000, "&" * 400_000, "<!-" * 200_000, "</p>" * 200_000):
        maintext.blocks_of(page)
    assert time.time() - began < 60
    page = f"<nav>{MENU}</nav><article>" + f"<p>{LONG}</p>" * 20_000 + "<p>The last one.</p></article>"
    assert maintext.main_text(page, NONE).endswith("\n\nThe last one.") and maintext.main_text(page, NONE).count("\n\n") == 20_000


def test_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", ""), (2, None, "<article>a</article>"), (2, None, "<article>a</article>"), (None, "v", "<nav>x</nav>"), (3, "w", "plain words, no markup at all")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit("v").alias(n) for n in ("text", "n_chars", "h", "key", "n")])
    found = maintext.extract(df, maintext.fit(df))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [(1, "u", "", 0), (1, "u", "", 0), (2, None, "a", 1), (2, None, "a", 1), (None, "v", "", 0), (3, "w", "plain words, no markup at all", 29)]))
    assert maintext.extract(df.limit(0), maintext.fit(df.limit(0))).count() == 0
