import html
import itertools
import re
import time

import numpy as np
import pytest

from tests.conftest import SF
from tideflow.llm import html_text as ht


@pytest.fixture(scope="module")
def model():
    return ht.fit()


def test_marginals_equal_enumeration(model):
    """Two passes of messages against the sum over all labellings."""
    for source in ("<div><p>some words here</p><nav><a href=x>link</a></nav></div>", "<ul><li><a>x</a><li>plain</ul><article><h1>t</h1><p>b <i>c</i></p></article>", ""):
        page = ht.parse(source)
        n = len(page.nodes)
        p = [1 / (1 + np.exp(-s)) for s in ht.logits(page, model.bias, model.weights)]
        total = np.zeros(n)
        norm = 0.0
        for labels in itertools.product((0, 1), repeat=n):
            weight = np.prod([p[i] if labels[i] else 1 - p[i] for i in range(n)])
            weight *= np.prod([model.edge[labels[page.nodes[i].parent]][labels[i]] for i in range(1, n)])
            total += weight * np.array(labels)
            norm += weight
        assert np.allclose(model.marginals(page), total / norm)


def test_held_out_labels(model):
    right = total = 0
    for plain, marked in ht.labelled_pages(240, seed=101):
        page = ht.parse(plain)
        labels = [1, *map(int, ht.LABEL.findall(marked))]
        right += sum((m >= 0.5) == bool(y) for m, y in zip(model.marginals(page), labels))
        total += len(labels)
    assert right / total > 0.97


def test_given_pages(spark, model):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in ht.extract(pages, model).collect()}
    for row in pages.collect():
        body = row.html[row.html.index("<article>") + 9 :]
        body = body[: body.index("</article>")]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", body))
        assert got[row.page_id] == "\n\n".join(b for b in blocks if b)


PAGE = """<html><head><title>T</title></head><body><header class="top"><a href=/>Home</a></header><nav class=menu><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article class="post"><h1>A &amp; B</h1><p>First&nbsp; para
graph &#233;&lt;b&gt;.</p><script>var x = "<p>no</p>";</script><!-- <p>no</p> --><p>Second <em>one</em>, with <a href=x>a link</a> inside it.</p><ul><li>item one of the list</li><li>item two</li></ul></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I disagree with this a lot.</p></div></section>
<aside class="sidebar"><h4>Related</h4><ul><li><a href=y>Other</a></li></ul></aside><form class="newsletter"><label>Mail</label><input><button>Go</button></form><footer>&copy; us</footer></body></html>"""


def test_a_full_page(model):
    assert ht.main_text(PAGE, model) == "A & B\n\nFirst para graph é<b>.\n\nSecond one, with a link inside it.\n\nitem one of the list\n\nitem two"


def test_edges(spark, model):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "plain words"), (4, "u", "<p>unclosed <b>bold"), (5, "u", "</p></div>"), (6, "u", PAGE), (6, "u", PAGE), (None, "u", "<!-- x"), (8, "u", "<article>" + "<p>w</p>" * 3000 + "</article>"), (9, "u", "<div>" * 500 + "x"), (10, "u", "<" * 2000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = ht.extract(df, model).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == "" and by[8].count("\n\n") == 2999
    assert ht.extract(df.limit(0), model).count() == 0


def test_layouts_without_articles_or_telling_names(model):
    """Divisions with line breaks, anonymous paragraphs, a layout table: none of the names is one of the training pages'."""
    long = "The river rose in the night and took the bridge with it. By noon the road was gone. "
    more = "Nobody could say when it would be rebuilt. "
    links = "".join(f'<a href="/{k}">Page {k}</a> ' for k in range(5))
    for source, want in (
        (f'<div id="q1">{links}</div><div class="zz9"><div class="yy">{long}<br><br>{more}</div></div><div id="q2">Copyright</div>', [(long + more).strip()]),
        (f'<div>{links}</div><div><p>{long}</p><p>{more * 3}</p></div><p>&copy; 2020 Some One</p>', [long.strip(), (more * 3).strip()]),
        (f"<table><tr><td>{links}</td><td>{long * 3}</td></tr></table>", [(long * 3).strip()]),
        (f'<ul class="qq"><li>{links}</li></ul><div class="ww">{long * 2}</div>', [(long * 2).strip()]),
    ):
        assert ht.main_text(source, model) == "\n\n".join(want)
    assert ht.main_text('<div id="top">links</div><div class="c1"><div class="c2">long text<br><br>more</div></div><div id="bot">Copyright</div>', model).endswith("long text more")


def test_hostile_pages_take_linear_time(model):
    def seconds(page):
        start = time.perf_counter()
        ht.main_text(page, model)
        return time.perf_counter() - start

    for unit in ("<div>", '<a href="', '<a ">" ', "</section><x>", "<!--", "<p><li>"):
        few, many = min(seconds(unit * 2000) for _ in range(3)), min(seconds(unit * 8000) for _ in range(3))
        assert many < 0.1 + 8 * few, unit


def test_an_overlong_tag_ends_at_its_first_bracket(model):
    source = f'<article><p>Some words that count here.</p><p title="{"x" * 70000}">And these words too.</p></article>'
    assert ht.main_text(source, model) == "Some words that count here.\n\nAnd these words too."
