import random
import time
from itertools import product

import numpy as np

from siftlode.llm import htmltree as H


def test_marginals_equal_enumeration():
    r = np.random.default_rng(2)
    page = H.Page("<div>a<p>b<ul><li>c<li>d</ul></div><p>e")
    f = H.Forest([page, H.Page("<p>z")])
    w, pair = r.normal(size=H.WIDTH), r.normal(size=(len(H.KINDS), 2, 2))
    p, both = f.marginals(w, pair)
    n = len(page.parent)
    unary = [sum(w[c] for c in fs) for fs in page.features]
    total, yes, joint = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for y in product((0, 1), repeat=n):
        e = np.exp(sum(u for u, s in zip(unary, y) if s) + sum(pair[page.kind[i], y[page.parent[i]], y[i]] for i in range(1, n)))
        total += e
        yes += e * np.array(y)
        for i in range(1, n):
            joint[i, y[page.parent[i]], y[i]] += e
    assert np.allclose(p[:n], yes / total) and np.allclose(both[1:n], joint[1:] / total)


def test_tree_building():
    p = H.Page("<ul><li>a<li>b <b>c</b></ul><p>d<div>e &amp;\n\t f</div>g<!-- no --><script>var x='<p>no</p>'</script><br>h</p><table><tr><td>1<td>2</table><title>t&lt;")
    assert p.text == ["a", "b c", "d", "e & f", "g", "h", "1", "2", "t<"]
    tags = [H.KINDS[p.kind[p.parent[i]]] for i in p.node]
    assert tags == ["li", "li", "p", "div", "html", "html", "td", "td", "title"]
    assert all(q < i for i, q in enumerate(p.parent))
    deep = H.Page("<div>" * 5000 + "x" + "</div>" * 5000)
    assert deep.text == ["x"] and len(deep.parent) == 5002


def test_long_pages_take_linear_time():
    t = time.process_time()
    for html in ("<a " * 40000, '<p "' * 40001, "<div>" * 40000 + "x", "<p><table>" + "<div>" * 40000, "<script>" + "</script " * 40000, "<!" * 40000, "<ul><li>" * 20000, "'<b class=\"" * 30000):
        H.Page(html)
    assert time.process_time() - t < 20
    deep = H.extract(["<article>" + "<div>" * 3000 + "Some words of an article here.", "a <b"], *H.model())
    assert deep[1] in ("", "a")


def test_held_out_accuracy():
    w, pair = H.model()
    r = random.Random(12345)
    pages, marks = H.labelled([H.labelled_page(r) for _ in range(250)])
    f = H.Forest(pages)
    p, _ = f.marginals(w, pair)
    right = total = 0
    for x, m, o in zip(pages, marks, f.offset):
        right += sum((p[i + o] > 0.5) == y for i, y in zip(x.node, m))
        total += len(m)
    assert right / total > 0.98


def test_query(spark):
    article = "<article><h1>A &eacute;</h1><p><b>One\n two.<br><p>Three   four.</p><div class='comments'><p>Nice post, thank you.</p></div></article>"
    html = f"<html><head><title>A</title></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='ad'>Buy now.</div>{article}<footer>&copy; x</footer></body>"
    rows = [(1, "u", html, 5), (2, None, None, 5), (3, "u", "", 5), (None, "v", "<p", 5), (1, "u", html, 5)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(H.op9_html(docs).collect(), key=str)
    by = {r.page_id: r for r in got}
    assert len(got) == 5 and by[1].text == "A é\nOne two.\nThree four." and by[1].n_chars == len(by[1].text)
    assert by[2].text == by[3].text == "" and by[2].n_chars == 0
    assert H.op9_html(docs.limit(0)).collect() == []
    long = "<article><h1>T</h1>" + "".join(f"<p>{'word ' * 50}{i}.</p>" for i in range(3000)) + "</article><footer>x</footer>"
    assert len(H.extract([long], *H.model())[0].split("\n")) == 3001
