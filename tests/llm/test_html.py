"""Hand-labelled pages: `+` before a text that belongs to the article, `-` before furniture; and whole labellings against brute force."""

import itertools
import random
import re

import pytest

from kilowave.llm import html_extraction as h

LONG = "the old bridge was closed for the winter because the river had risen above its piers and nobody could say when it would open again"
PAGES = {
    "an article with all furniture around and inside it": f"""
<header class="site"><h1>-The Daily Page</h1><p>-{LONG}, says our motto.</p></header><nav class="menu"><ul><li><a href="/">-Home</a><li><a href="/w">-World news</a></ul></nav>
<div class="cookie-consent"><p>-We use cookies to make the site better, and by staying here you agree to all of them, now and later.</p></div>
<main><article><header><h2 class="post-header">+Bridge closed</h2><p class="byline">+By Ann Smith</p></header><p>+{LONG}.</p><p>+Why?</p><p>+{LONG}, they said.</p>
<div class="advert"><p>-Buy new boots now, they are warm, they are cheap, and they are sent to you the day after, whatever the weather may be where you live.</p></div>
<ul><li>+Two lanes<li>+One pier<li>+No ferry</ul><table><tr><td>+1950</td><td>+built</td></tr></table><math><mi>+x + y</mi></math><blockquote><p>+No.</p></blockquote>
<p class="tags">+bridges, rivers</p><p>+See <a href="/r">+the whole report of the commission</a></p><p class="legal">+{LONG}.</p>
<form action="/s"><p>-Get our news by mail every morning, it costs nothing and you can leave at any time.</p><input value="no"><button>Send</button></form>
<footer><p>-Filed under rivers, bridges and the winter of the year.</p></footer></article>
<section id="comments"><article class="comment"><p>-{LONG}. I liked it.</p></article><article class="comment"><p>-Me too.</p></article></section></main>
<aside><p>-{LONG}.</p><ul><li><a href="/1">-Most read</a></ul></aside><footer><p>-© 2024 The Daily Page. All rights reserved.</p></footer><script>var x = "<p>no</p>";</script><style>p {{}}</style>""",
    "no article element, plain names": f"""
<div id="top"><a href="/">-Home</a> <a href="/a">-About us</a></div><div id="navigation"><a href="/1">-One</a><a href="/2">-Two</a></div>
<div id="wrap"><h1>+On bridges</h1><p>+{LONG}.</p><p>+So it goes.</p><p>+{LONG}, and then some more of it came.</p><p>+Ah.</p><p>+{LONG}.</p></div>
<div id="sidebar"><p>-{LONG}.</p><p>-Vote now!</p></div><div id="footer"><p>-Contact</p><p>-Copyright by nobody, all rights reserved.</p></div>""",
    "names that mislead": f"""
<body class="has-sidebar menu-open"><div class="ad-free-layout-comments-off"></div><article class="post"><div class="post-header"><h1>+Head</h1></div><p class="menu">+{LONG}.</p>
<p class="ad">+The ad was five years old.</p><p class="search-result">+{LONG}.</p><div class="form-of-government"><p>+{LONG}.</p></div><h3 class="sidebar-title">+Sidebars in history</h3><p>+{LONG}.</p></article>
<div class="post-comments"><p>-{LONG}.</p></div>""",
    "furniture without names": f"""
<ul><li><a href="/a">-Start</a></li><li><a href="/b">-Shop</a></li><li><a href="/c">-Help</a></li></ul><p>+{LONG}.</p><p>+{LONG}.</p><p>+{LONG}.</p>
<div><div><div><a href="/t">-Terms</a></div></div></div><div><div><p>-© 2020</p></div></div>""",
    "roles": f"""
<div role="banner"><p>-{LONG}.</p></div><div role="main"><p>+{LONG}.</p><p>+End.</p></div><div role="complementary"><p>-{LONG}.</p></div><div role="contentinfo"><p>-Mail us.</p></div>""",
    "one word": "<nav><a>-Menu</a></nav><article><p>+A</p></article><footer>-b</footer>",
    "an article of teasers beside it": f"""
<article><h1>+Head</h1><p>+{LONG}.</p></article><aside><article><h2>-Other</h2><p>-{LONG}.</p></article></aside><div class="newsletter"><h3>-Mail</h3><p>-{LONG}.</p></div>""",
    "notices in the way": f"""
<div class="popup"><p>-{LONG}!</p></div><dialog><p>-Are you sure that you want to leave this page now?</p></dialog><div role="alert"><p>-{LONG}.</p></div>
<section class="content"><h1>+Head</h1><p>+{LONG}.</p><noscript>+A picture of the bridge</noscript><p>+Short one</p><p>+{LONG}.</p></section>""",
}


def judged(page):
    """(right, blocks): blocks whose label the cut gives as marked, texts that are marked within as well."""
    found = [(b.text, content) for b, content in h.labelled(page) if re.search(r"[+-]", b.text)]
    return [(content == (text[0] == "+"), text) for text, content in found]


@pytest.mark.parametrize("name", PAGES)
def test_labelled_pages(name):
    wrong = [text for ok, text in judged(PAGES[name]) if not ok]
    assert not wrong


def test_the_cut_decides():
    """A share of blocks gets a label that its own text does not ask for."""
    turned = total = 0
    for page in PAGES.values():
        blocks, boxes = h.blocks_of(page)
        labels = h.minimum_cut(*h.page_graph(blocks, boxes))
        total += len(blocks)
        turned += sum((h.text_odds(b) >= 0) != label for b, label in zip(blocks, labels, strict=False))
    assert turned >= 0.2 * total


def cost(unary, edges, labels):
    return sum(abs(u) for u, x in zip(unary, labels, strict=True) if (u > 0) != x and u) + sum(w for i, j, w in edges if labels[i] != labels[j])


def test_whole_pages_match_brute_force():
    r = random.Random(5)
    tags = ["p", "p", "div", "li", "h2", "nav", "aside", "article", 'div class="ad"', 'div class="post-header"', "footer", "section"]

    def grown(depth):
        out = []
        for _ in range(r.randint(1, 3)):
            tag = r.choice(tags)
            inside = grown(depth - 1) if depth and r.random() < 0.5 else " ".join(["word"] * r.choice([1, 3, 20, 40])) + r.choice(["", "."])
            out.append(f"<{tag}>{inside}</{tag.split()[0]}>")
        return "".join(out)

    seen = 0
    for _ in range(120):
        blocks, boxes = h.blocks_of(grown(2))
        unary, edges = h.page_graph(blocks, boxes)
        if len(unary) > 13:
            continue
        seen += 1
        best = min(cost(unary, edges, x) for x in itertools.product([False, True], repeat=len(unary)))
        assert cost(unary, edges, h.minimum_cut(unary, edges)) == pytest.approx(best, abs=1e-4)
        assert cost(unary, edges, h.max_flow_sides(unary, edges)) == pytest.approx(best, abs=1e-4)
    assert seen > 60


def test_long_pages_and_clashing_columns(spark):
    page = "<article>" + "".join(f"<p>{LONG} {k}.</p>" for k in range(3000)) + "</article>"
    pages = spark.createDataFrame([(1, "u", page, "x", 1), (1, "u", page, "x", 1)], "page_id int, url string, html string, text string, n_chars int")
    want = "\n\n".join(f"{LONG} {k}." for k in range(3000))
    got = h.extract(pages).collect()
    assert [tuple(r) for r in got] == [(1, "u", want, len(want))] * 2
