import re
from html import unescape

import numpy as np
import pytest

from tallyhouse.llm import html_text as H
from tallyhouse.llm.html_pages import _Writer
from tallyhouse.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model():
    return H.default_model()


def runs(html):
    return [words for _, words in H.parse(html).runs]


def test_parsing_follows_the_rules_of_html():
    assert runs("<p>a<b>b</b> c\n\t d<p>e<br>f<ul><li>g<li>h</ul>") == ["ab c d", "e", "f", "g", "h"]
    assert runs("x<!-- <p>no --> y<script>var a='<p>';</script><STYLE>p{}</Style>z") == ["x yz"]
    assert runs("&lt;p&gt; &amp;&copy;&#233;&#xE9; &am &nbsp;x") == ["<p> &©éé &am x"]
    assert runs('<p title="a>b" class=\'x>y\'>t</p>') == ["t"]
    assert runs("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert runs("a < b <3 c") == ["a < b <3 c"]
    assert runs("<p>a<!-- never closed") == ["a"] and runs("<p>a<script>never") == ["a"] and runs("<p>a<div class='") == ["a"]
    assert runs("</p></div>a</b>") == ["a"] and runs("") == [] and runs("<title>no</title>") == []
    assert runs("<a/>x<br/>y<img/>z") == ["x", "yz"]


def test_quotes_count_after_equals_signs_only():
    assert runs("<p title=it's>A</p><p>it isn't B</p>") == ["A", "it isn't B"]
    assert runs("<p a'b c\">A</p><p>\"B'</p>") == ["A", "\"B'"]
    assert runs("<p title = 'a>b' x=\"c>d\">A</p>") == ["A"]
    assert runs("<p title='a>A</p><p>B</p>") == ["A", "B"]  # never closed, so the tag ends at the first >


def test_raw_elements_are_not_closed_by_a_slash():
    for tag in ("<script src=/a.js/>", "<script />", "<style/>", "<TextArea />", "<title/>"):
        name = re.match(r"<(\w+)", tag)[1]
        assert runs(f"<p>a</p>{tag}code </{name}x>more</{name.upper()} ><p>b</p>") == ["a", "b"]
    assert runs("<p>a<svg/>b<button/>c</p>") == ["abc"]


def test_time_is_in_proportion_to_the_page():
    import time

    def seconds(n):
        pages = ["<div>" * n + "</p>" * n, "<p><td>" + "<div>" * n, "<li><ul>" + "<b><div><span>" * n + "<li>" * n]
        pages += ["<a x=\"1\" y='" + "=\"z\" " * n, "<table>" + "<tr><td>" * n, "<p>" + "<dd><dt>" * n]
        start = time.perf_counter()
        for page in pages:
            H.parse(page)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(40_000) < 30 * seconds(4_000) and seconds(40_000) < 20


def test_messages_give_exact_marginals(model):
    page = H.parse('<body><nav><a href=x>l</a></nav><div class="post"><p>One two.</p><p>Three</p></div></body>')
    forest = H.Forest([page], model.features, model.kinds)
    chance, joint = forest.marginals(model.weights, model.pair)
    n = len(page.parent)
    own = np.bincount(forest.owner, model.weights[forest.found], n)
    total, content, pairs = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for state in range(1 << n):
        y = [(state >> k) & 1 for k in range(n)]
        weight = np.exp(sum(own[k] * y[k] for k in range(n)) + sum(model.pair[forest.edge[k], y[page.parent[k]], y[k]] for k in range(1, n)))
        total += weight
        content += weight * np.array(y)
        for k in range(1, n):
            pairs[k, y[page.parent[k]], y[k]] += weight
    assert np.allclose(chance, content / total) and np.allclose(joint[1:], pairs[1:] / total)


def test_pages_never_seen(model):
    right = 0
    for number in range(5000, 5200):
        marked = _Writer(number).page()
        page = H.parse(marked)
        wanted = " ".join(words for node, words in page.runs if page.label[node])
        right += H.main_text([re.sub(r' data-y="\d"', "", marked)], model)[0] == wanted
    assert right >= 180


def test_common_layouts(model):
    body = "<h1>Head line</h1><p>First &amp; <a href=x>second</a> words.</p><ul><li>One item.</li></ul><blockquote>Quoted.</blockquote>"
    wanted = "Head line First & second words. One item. Quoted."
    around = '<header><nav><ul><li><a href=/>Home</a></li></ul></nav></header>{}<aside><h3>See also</h3><p>Other words here.</p></aside><footer>&copy; Us</footer>'
    for box in ("<article>{}</article>", "<main>{}</main>", '<div class="entry-content">{}</div>', '<div id="main-content"><article>{}</article></div>'):
        assert H.main_text([around.format(box.format(body))], model) == [wanted]
    extra = '<div class="comments"><div class="comment"><p>I liked reading this very much, thanks.</p></div></div><form><label>Mail</label><p>Sign up.</p></form><div class="cookie-notice">We use cookies.</div><div class="ad">Buy this now.</div>'
    assert H.main_text([around.format(f"<article>{body}</article>{extra}")], model) == [wanted]
    assert H.main_text([around.format(f"<article>{body}{extra}</article>")], model) == [wanted]


def test_odd_rows(spark, model):
    deep = "<div>" * 3000 + "<p>Deep words.</p>"
    rows = [(1, None), (2, ""), (2, ""), (None, "<article><p>Some words here.</p></article>"), (3, deep), (4, "<article><p>" + "word " * 100000 + "</p></article>"), (5, "<" * 3000 + "'\"" * 3000)]
    pages = spark.createDataFrame([(*r, "u", 5) for r in rows], "page_id long, html string, text string, n_chars int")
    found = H.extract(pages, ["page_id"]).collect()
    assert [r["page_id"] for r in found] == [r[0] for r in rows]
    assert [r["text"] for r in found[:4]] == ["", "", "", "Some words here."]
    assert found[5]["n_chars"] == 499999
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert H.extract(pages.limit(0), ["page_id"]).count() == 0


def test_query_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = QUERIES["op3_html_text"](spark, sf).collect()
    assert len(found) == len(pages)
    for r in found:
        article = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        article = re.sub("<[^>]*>", "", re.sub("<br>|</?p>|</?h1>", " ", article))
        assert r["text"] == " ".join(unescape(article).split())
