"""Pages: main text on labelled and hand-written pages, and URL rules against brute force."""

import re

from pyspark.sql import functions as F

from pixelframe.llm.html_extract import ARTICLE, html_extract, labelled_pages, trained
from pixelframe.llm.html_tree import tree

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><div class="cookie-notice">We use
cookies.</div><nav><a href=/>Home</a></nav><main><article><h1>My &amp; title</h1><p>First para <a href=x>link</a>&nbsp;text
 here.<p>Second<br>line.<ul><li>one<li>two</ul><!-- <p>no</p> --><div class="advert">Buy now!</div><aside>Related stuff</aside><form><label>Mail</label>
<input><button>Go</button></form><blockquote>Quote</blockquote><script>var t="</p>";</script></article><section id="comments"><h3>Comments</h3>
<article class="comment"><p>I disagree with this.</p></article></section></main><aside class="sidebar"><p>Popular posts.</p></aside><footer>&copy; x</footer></body></html>"""


def test_hand_written_page():
    assert trained().text(PAGE) == "My & title\nFirst para link text here.\nSecond line.\none\ntwo\nQuote"


def test_held_out_accuracy():
    wrong = total = 0
    for nodes, states in labelled_pages(150, 99):
        for v, s, m in zip(nodes, states, trained().marginals(nodes), strict=True):
            if v.tag == "#text":
                total += 1
                wrong += (m[ARTICLE] >= 0.5) != (s == ARTICLE)
    assert wrong < 0.02 * total


def test_marginals_are_exact():
    """Against sums over all states of a small tree."""
    import itertools

    import numpy as np

    model, nodes = trained(), tree("<div class=ad><p>Some words here.</p><p>x</p></div><p>More words.</p>")
    local = np.array([model._local(v) for v in nodes])
    sums = np.zeros((len(nodes), 3))
    for states in itertools.product(range(3), repeat=len(nodes)):
        p = model.root[states[0]]
        for i, s in enumerate(states):
            p *= local[i, s] * (model.step[states[nodes[i].parent], s] if i else 1)
        for i, s in enumerate(states):
            sums[i, s] += p
    assert np.allclose(sums / sums.sum(1, keepdims=True), model.marginals(nodes))


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "<p>" + "deep words. " * 2000 + "</p>"
    odd = [None, "", "   ", "<", "<!--", "<p", "a < b and c > d.", "<script>x", '<p title="never closed>text. </p>', "&lt;p&gt; &#233; &eacute &bogus; text here.", deep, "</p></p><p>Text of a paragraph.</p>"]
    df = spark.createDataFrame([(i, "u", h) for i, h in enumerate(odd)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = {r.page_id: r.text for r in html_extract(df).collect()}
    assert out[0] == out[1] == out[2] == ""
    assert out[9] == "<p> é é &bogus; text here."
    assert out[10] == ("deep words. " * 2000).strip()
    assert html_extract(df.filter("false")).count() == 0


def test_url_filter(spark):
    from pixelframe.llm.queries import URL_RULES
    from pixelframe.llm.url_filter import url_filter

    hosts = ["example.com", "www.example.com", "a.www.EXAMPLE.com", "xexample.com", "com", "example.net", "net", "org", "", ".com", "a.b.c.net", "com."]
    paths = ["", "/", "/en/", "/en", "/en/x?y=/fr/", "/fr/", "/es/1#t", "?x", "#y", "/EN/"]
    urls = [f"{s}{h}{p}" for s in ("http://", "https://", "") for h in hosts for p in paths] + [None, "", "http://", "a://b://example.com/en/", "//example.com/en/"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(0, urls[0])]

    def judge(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")

    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("clash"))
    assert sorted([tuple(r) for r in url_filter(df, URL_RULES).collect()], key=str) == sorted([(i, *judge(u)) for i, u in rows], key=str)
    assert url_filter(df.filter("false"), URL_RULES).count() == 0
    assert {r.verdict for r in url_filter(df, []).collect()} == {"allow"}


def test_url_filter_with_a_long_list(spark, monkeypatch):
    """More rules than are broadcast, given as a table, with many numbers of labels and lengths of paths."""
    from pixelframe.llm import url_filter as module

    monkeypatch.setattr(module, "BROADCAST_RULES", 10)
    rules = [("block" if i % 3 else "allow", ".".join(f"h{i % k}" for k in range(2, 3 + i % 5)), "/" + "p" * (i % 7)) for i in range(200)]
    rules += [("allow", rules[0][1], rules[0][2]), (None, None, None)]
    urls = [(i, f"https://{'x.' * (i % 2)}{h}{p}/{i}?q") for i, (_, h, p) in enumerate(rules[:200])] + [(1000, "https://other.org/"), (1001, "http://" + "a." * 3000 + "h0.h0/" + "p" * 9000)]
    kinds = {}
    for v, h, p in rules[:-1]:
        kinds[h, p] = "block" if "block" in (v, kinds.get((h, p))) else v

    def judge(u):
        host, _, rest = u.split("://")[1].partition("/")
        path = "/" + rest.split("?")[0]
        fits = [(len(h + p), h + p, v) for (h, p), v in kinds.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")

    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    out = module.url_filter(spark.createDataFrame(urls, "page_id long, url string"), table).collect()
    assert sorted(tuple(r) for r in out) == sorted((i, *judge(u)) for i, u in urls)
