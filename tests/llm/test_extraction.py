import html
import re

import numpy as np

from cloakwork.llm.extraction import Potentials, extract_main_text, labels_of, main_texts, marginals, train
from cloakwork.llm.html_labelled import labelled_pages
from cloakwork.llm.html_tree import N_FEATURES, N_GROUPS, Forest
from cloakwork.llm.queries import op6_html_extraction

from .conftest import SF

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><article><h1>Tea &amp;  time</h1><p><b>First&nbsp;part<br>goes on.<p>Second &lt;part&gt;, a &#233; b.</p><div class="ad">Buy now.</div></article>
<div id="comments"><p>I liked it, thanks.</p><p>So did I.</p></div><footer>&copy; example.com</footer></body></html>"""


def test_marginals_against_all_labelings():
    rng = np.random.default_rng(5)
    parent, depth = np.array([-1, 0, 0, 1, 1, 3]), np.array([0, 1, 1, 2, 2, 3])
    group, features = rng.integers(0, N_GROUPS, 6), rng.normal(size=(6, N_FEATURES))
    potentials = Potentials(rng.normal(size=N_FEATURES) / 8, rng.normal(size=(N_GROUPS, 2, 2)))
    own, weights = features @ potentials.own, np.zeros(6)
    total = 0.0
    for code in range(64):
        y = [(code >> i) & 1 for i in range(6)]
        w = np.exp(sum(own[i] * y[i] for i in range(6)) + sum(potentials.pair[group[i], y[parent[i]], y[i]] for i in range(1, 6)))
        total += w
        weights += w * np.array(y)
    assert np.allclose(marginals(parent, depth, group, features, potentials)[0], weights / total)


def test_a_page_with_everything():
    assert main_texts([PAGE], train()) == ["Tea & time First part goes on. Second <part>, a é b."]


def test_drawn_pages_of_another_seed():
    forest = Forest(labelled=True)
    for page in labelled_pages(150, 77):
        forest.add_page(page)
    parent, depth, group, features = forest.arrays()
    right = (marginals(parent, depth, group, features, train())[0] >= 0.5) == labels_of(forest, parent)
    assert right[np.array([bool(t) for t in forest.text])].mean() > 0.97


def test_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "no markup at all"), (4, "<p"), (5, "<div>" * 3000 + "deep"), (6, PAGE[:300]), (6, PAGE[:300]), (None, PAGE), (7, "<<>></></p><!-- never closed"), (8, "<article><p>" + "word. " * 50_000)]
    source = spark.createDataFrame([(i, "u", h, 1, "x") for i, h in rows], "page_id long, url string, html string, n_chars int, text string")
    found = extract_main_text(source).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    by_id = {r.page_id: r.text for r in found}
    assert by_id[1] == by_id[2] == "" and by_id[8] == ("word. " * 50_000).strip()
    assert extract_main_text(source.where("page_id = -1")).count() == 0


def test_attributes_and_inline_elements_of_everyday_pages():
    around = "<html><body><nav class=menu><a href=/>Home</a></nav><article class=post>{}<p>" + "More words follow here, as they do. " * 6 + "</p></article><footer>All rights</footer></body></html>"
    page = around.format("<table><tr><td data-label='Name'>First cell of the table.</td><td DATA-LABEL=2>Second cell.</td></tr></table><p>The mass is <math><mi>m</mi></math> as <object>shown</object>, so <button>press</button> on.</p>")
    text = main_texts([page], train())[0]
    assert "First cell of the table. Second cell. The mass is m as shown, so press on." in text


def test_all_pages_give_their_articles(spark):
    """The text between <article> tags, stripped of what the pages' generator puts there but is no article, equals the result."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = {r.page_id: r.text for r in op6_html_extraction(spark, SF).collect()}
    assert found.keys() == pages.keys()
    whole = 0
    for i, source in pages.items():
        inner = re.search(r"<article[^>]*>(.*)</article>", source, re.S)
        if inner:
            words = html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", " ", inner[1], flags=re.S))).split()
            whole += " ".join(words).replace(" ", "") == found[i].replace(" ", "")
    assert whole >= 0.98 * sum("<article" in x for x in pages.values())
