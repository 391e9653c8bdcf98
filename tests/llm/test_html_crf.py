import html
import itertools
import re
import time
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import html_crf

TABLE = "/root/testdata/sf0.001/pages.parquet"


def by_article(page):
    """What stands inside <article>, by plain patterns."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    body = re.sub(r"<(script|style).*?</\1>|<!--.*?-->", "", body, flags=re.S)
    text = html.unescape(re.sub(r"</?b>", "", body).replace("<", "\0 <"))
    return " ".join(re.sub(r"\0 <[^>]*>", " ", text).split(" ")).split()


@pytest.fixture(scope="module")
def model(spark):
    return html_crf.train(spark.read.parquet(TABLE))


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(TABLE)
    got = {r.page_id: r._tm_text for r in html_crf.extracted(pages, ["page_id"]).collect()}
    for r in pages.collect():
        assert got[r.page_id].split() == by_article(r.html), r.page_id


P1, P2, P3 = "It flows down from the hills, past the town, and on to the sea.", "Nobody knows how old it is, and nobody has asked for a long time; the maps are silent.", "In spring the water rises, and the lower meadows lie under it for weeks."
H, ALL = "The river and the sea", f"The river and the sea {P1} {P2} {P3}"
BODY = f"<h1>{H}</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p>"
NAV = "<ul><li><a href=/1>Start</a></li><li><a href=/2>Places</a></li><li><a href=/3>People</a></li></ul>"
SAID = "<p>I like this river, and I went there last year with my family.</p><p>Thanks for the text, it was a pleasure to read it.</p>"

LAYOUTS = {
    "class words on the article": f"<nav>{NAV}</nav><article class='post tags-news'>{BODY}</article><footer>Imprint</footer>",
    "class words on the wrapper": f"<div class=site-menu>{NAV}</div><div class=elementor-widget-container>{BODY}</div><div class=site-footer>&copy; 2020</div>",
    "wrapper around each part": f"<div class=widget-container>{NAV}</div><div class=widget-container><h1>{H}</h1></div><div class=widget-container><p>{P1}</p></div><div class=widget-container><p>{P2}</p><p>{P3}</p></div>",
    "all in a form": f"<form action=/><div class=toolbar>{NAV}</div><div>{BODY}</div></form>",
    "main": f"<header><a href=/>Logo</a></header><main>{BODY}</main><aside><p>More rivers, more lakes and more seas are in our archive, which is free.</p></aside>",
    "comments longer than the article": f"<article>{BODY}</article><div id=comments>{SAID * 12}</div>",
    "comments inside the article": f"<nav>{NAV}</nav><article>{BODY}<section class='comments-area'><h3>Comments</h3>{SAID}</section></article>",
    "comments as articles": f"<article class=post>{BODY}</article><article id=comment-7 class=comment-body>{SAID}</article>",
    "cookie notice": f"<div class=cookie-banner><p>We use cookies to make this site better, and to count who comes here. Read our privacy policy.</p></div><nav>{NAV}</nav><article>{BODY}</article>",
    "advert in the text": f"<article><h1>{H}</h1><p>{P1}</p><div class=advertisement>Buy a new boat today, and pay for it next year!</div><p>{P2}</p><p>{P3}</p></article>",
    "no marks at all": f"<div>{NAV}</div><div>{BODY}</div><div>&copy; 2020 All rights reserved.</div>",
    "table layout": f"<table><tr><td>{NAV}</td><td>{BODY}</td></tr></table>",
    "sidebar of headlines": f"<div id=content>{BODY}</div><div id=sidebar><h3>Popular</h3><ul><li><a href=/a>Seven lakes to see</a></li><li><a href=/b>The last ferry</a></li></ul></div>",
    "header inside the article": f"<nav>{NAV}</nav><article><header><h1>{H}</h1></header><p>{P1}</p><p>{P2}</p><p>{P3}</p></article><footer>Contact</footer>",
    "scripts and forms": f"<script>document.write('<p>no</p>')</script><style>p {{}}</style><div class=article-body>{BODY}</div><form><label>Your name</label></form><noscript>Turn on scripts, please.</noscript>",
    "newsletter and share": f"<div role=banner>The Paper</div><div role=main>{BODY}</div><div class=newsletter>Sign up for our letter, and get it every week.</div><div class=share>Share this</div>",
    "nested divs": "<div>" * 30 + f"<div class=menu>{NAV}</div>" + BODY + "</div>" * 30,
    "breadcrumbs": f"<div class=breadcrumbs><a href=/>Start</a> &gt; <a href=/r>Rivers</a></div><section class=entry-content>{BODY}</section><div class=pagination><a href=/2>2</a> <a href=/3>3</a></div>",
    "sponsored box": f"<div class='main-content'>{BODY}</div><div class='box sponsored'><p>Sponsored: a hotel by the river, with breakfast and a view of the town.</p></div>",
    "footer prose": f"<main>{BODY}</main><footer><p>The Paper has been written by people who live here, since 1920.</p><p>All rights reserved.</p></footer>",
    "stray quotes": f"<nav>{NAV}</nav><article><h1>{H}</h1><p don't class=\"a>{P1}</p><p>{P2}</p><p title='x>{P3}</p></article>",
    "upper case and no ends": f"<NAV>{NAV}</NAV><ARTICLE><H1>{H}<P>{P1}<P>{P2}<P>{P3}</ARTICLE><FOOTER>Imprint</FOOTER>",
    "id article": f"<div id=nav>{NAV}</div><div id=article>{BODY}</div><div id=legal>Legal notice</div>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_unseen_layouts(model, name):
    assert html_crf.main_text(f"<html><head><title>T</title></head><body>{LAYOUTS[name]}</body></html>", *model) == ALL


def with_body(page, kind):
    """The page with its paragraphs as other elements."""
    if kind == "br" and BODY in page:
        return page.replace(BODY, f"<table><tr><td>{H}<br><br>{P1}<br><br>{P2}<br>{P3}</td></tr></table>")
    for p in (P1, P2, P3):
        page = page.replace(f"<p>{p}</p>", f"<{kind}>{p}</{kind}>" if kind != "br" else f"<div>{p}<br></div>")
    return page


@pytest.mark.parametrize("kind", ["div", "section", "br"])
@pytest.mark.parametrize("name", LAYOUTS)
def test_unseen_layouts_with_other_paragraphs(model, name, kind):
    assert html_crf.main_text(f"<html><body>{with_body(LAYOUTS[name], kind)}</body></html>", *model) == ALL


DIVS = f"<h1>{H}</h1><div>{P1}</div><div>{P2}</div><div>{P3}</div>"
KEPT = {
    "has a sidebar": f"<div id=main class=has-sidebar>{BODY}</div><aside><p>More rivers and more lakes are in our archive, which is free.</p></aside>",
    "has none": f"<div class='site no-sidebar'>{BODY}</div><div class=footer><p>The Paper has been written by people who live here, since 1920.</p></div>",
    "layout name": f"<div class=layout-right-sidebar>{BODY}</div><div class=footer><p>The Paper has been written by people who live here, since 1920.</p></div>",
    "divs beside a menu": f"<div>{NAV}</div>{DIVS}<div>&copy; 2020 The Paper</div>",
    "cell with breaks": f"<table><tr><td>{NAV}</td><td>{H}<br><br>{P1}<br><br>{P2}<br><br>{P3}</td></tr></table>",
    "widget of text": f"<div class=menu>{NAV}</div><div class='widget widget-text'>{BODY}</div>",
    "template name": f"<body class='page-with-sidebar hide-footer'><nav>{NAV}</nav><div class=with-comments>{BODY}</div></body>",
    "comments without marks": f"<article>{BODY}</article><h3>Reader comments</h3>{SAID}{SAID}",
    "comments counted": f"<nav>{NAV}</nav><main>{BODY}<h3>3 Comments</h3>{SAID}</main>",
    "newsletter sentence": f"<article><h1>{H}</h1><p>{P1}</p><p>{P2}</p><p>Sign up for our newsletter, and get it every week.</p><p>{P3}</p></article>",
    "read also": f"<article><h1>{H}</h1><p>{P1}</p><p>Read also: <a href=/x>The last ferry of the year</a></p><p>{P2}</p><p>{P3}</p></article>",
}


@pytest.mark.parametrize("name", KEPT)
def test_articles_are_kept_whole(model, name):
    assert html_crf.main_text(f"<html>{KEPT[name]}</html>", *model) == ALL


def test_tables_and_addresses_of_articles(model):
    table = "<table><tr><th>Place</th><th>Depth</th></tr><tr><td>The mill</td><td>2 m</td></tr><tr><td>The bridge</td><td>5 m</td></tr></table>"
    page = f"<nav>{NAV}</nav><article><h1>{H}</h1><p>{P1}</p>{table}<p>{P2}</p><address>The river museum, 4 Mill Lane</address><p>{P3}</p></article><footer>Imprint</footer>"
    assert html_crf.main_text(page, *model) == f"{H} {P1} Place Depth The mill 2 m The bridge 5 m {P2} The river museum, 4 Mill Lane {P3}"


def test_edges(spark):
    unseen = f"<div class=main-menu><a href=/1>One</a></div><div class=article-body><h1>A   &lt;b&gt;</h1><p>{P1}<br>{P2}</p><p hidden>{P1}</p></div></html"
    rows = [(1, unseen, "a"), (2, None, "b"), (3, "", None), (None, "<p>", "c"), (1, unseen, "a"), (4, f"<div><p>{P2}</p></div><scr", "d"), (5, "<article>" + "<p>A line of prose, as it should be.</p>" * 5000 + "</article>", "e")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string").union(spark.read.parquet(TABLE).selectExpr("page_id + 100", "html", "url"))
    out = Counter((r.page_id, r._tm_text) for r in html_crf.extracted(df, ["page_id", "text"]).where("page_id is null or page_id < 100").collect())
    want = f"A <b> {P1} {P2}"
    assert out == Counter([(1, want), (1, want), (2, ""), (3, ""), (None, ""), (4, P2), (5, " ".join(["A line of prose, as it should be."] * 5000))])


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_crf.extracted(df, ["page_id"]).count() == 0


HARD = ["<div>x" * 50_000, "it's <b don't " * 50_000, "<b a='" * 50_000, "<p><div>" + "<b>" * 25_000 + "<li></li>" * 25_000, "<svg>" * 50_000, "</div>" * 50_000, "<div class=ad>x y" * 50_000, "<" * 100_000, "&#" + "9" * 100_000, "<!--" * 50_000, "<a x=\"'" * 50_000]


@pytest.mark.parametrize("k", range(len(HARD)))
def test_time_grows_with_the_length(model, k):
    began = time.process_time()
    html_crf.main_text(HARD[k], *model)
    assert time.process_time() - began < 4


def chains(rng, n):
    return [(rng.random((m, len(html_crf.NAMES))) < 0.2).astype(float) for m in rng.integers(1, 7, n)]


def score(x, y, w, t):
    return sum(x[i] @ w[:, y[i]] for i in range(len(x))) + sum(t[a, b] for a, b in zip(y, y[1:]))


def test_viterbi_finds_the_best_of_all_labellings():
    rng = np.random.default_rng(3)
    for x in chains(rng, 40):
        w, t = rng.normal(size=(x.shape[1], 2)), rng.normal(size=(2, 2))
        best = max(itertools.product((0, 1), repeat=len(x)), key=lambda y: score(x, y, w, t))
        assert html_crf.viterbi([np.flatnonzero(v).tolist() for v in x], w.tolist(), t.tolist()) == list(best)


def test_gradient_against_all_labellings():
    rng = np.random.default_rng(4)
    for x in chains(rng, 20):
        w, t, y = rng.normal(size=(x.shape[1], 2)), rng.normal(size=(2, 2)), rng.integers(0, 2, len(x))
        padded = np.concatenate([x, np.zeros((7 - len(x), x.shape[1]))])[None]
        labels, live = np.append(y, [0] * (7 - len(x)))[None], (np.arange(7) < len(x))[None]
        value, gw, gt = html_crf.gradient(padded, labels, live, np.array([2.0]), w, t)

        def likelihood(w, t):
            return 2 * (score(x, y, w, t) - np.log(sum(np.exp(score(x, z, w, t)) for z in itertools.product((0, 1), repeat=len(x)))))

        assert abs(value - likelihood(w, t)) < 1e-8
        for a, g in ((w, gw), (t, gt)):
            for at in [tuple(rng.integers(0, n) for n in a.shape) for _ in range(4)]:
                up, down = a.copy(), a.copy()
                up[at] += 1e-5
                down[at] -= 1e-5
                got = (likelihood(up, t) - likelihood(down, t) if a is w else likelihood(w, up) - likelihood(w, down)) / 2e-5
                assert abs(got - g[at]) < 1e-5
