"""Main text of pages written by hand, in layouts that the module's own labelled pages do not come from, and of all given pages."""

import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from pixelframe.llm.html_extract import html_extract, trained

LONG = "The old mill by the river was rebuilt in three summers, and the village paid for most of it."
MORE = "Its wheel turns again from May to October; visitors may watch the stones from a small gallery."
LAST = "A third paragraph tells of the miller, who had kept every bill since the first flood of 1931."

#: Pages, and the blocks that are their main text.
PAGES = {
    "blog": (
        f"""<html><body class="home blog"><div id="page"><header id="masthead" class="site-header"><p class="site-title"><a href="/">Mill notes</a></p>
<nav id="site-navigation" class="main-navigation"><ul><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></nav></header>
<div id="content" class="site-content"><main id="main"><article id="post-7" class="post"><h1 class="entry-title">The mill</h1>
<div class="entry-content"><p>{LONG}</p><p>{MORE}</p><blockquote><p>{LAST}</p></blockquote></div></article>
<div id="comments" class="comments-area"><h2>Two thoughts</h2><ol class="comment-list"><li class="comment"><div class="comment-body"><p>I went there as a child and loved it very much.</p></div></li></ol>
<div id="respond" class="comment-respond"><form class="comment-form"><p><label>Name</label><input></p><button>Post comment</button></form></div></div></main>
<aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href="/a">Old bridges of the county</a></li></ul></section></aside></div>
<footer id="colophon" class="site-footer"><div class="site-info">Proudly made by hand</div></footer></div></body></html>""",
        ["The mill", LONG, MORE, LAST],
    ),
    "news": (
        f"""<body><div class="cookie-banner" role="dialog"><p>We use cookies to make this site better. By going on you accept them.</p><button>Accept</button></div>
<div class="top-nav"><a href=/w>World</a> <a href=/b>Business</a></div><div class="container"><div class="article-body"><h1>Mill reopens</h1><p>{LONG}</p>
<div class="ad-slot"><p>Buy one pair of shoes, get the second pair free today.</p></div><p>{MORE}</p><figure><img src=m.jpg><figcaption>The wheel in June.</figcaption></figure><p>{LAST}</p>
<div class="newsletter-signup"><h3>Stay informed</h3><p>Sign up for our weekly letter.</p><form><input><button>Go</button></form></div></div>
<div class="sidebar"><h4>Most read</h4><ul><li><a href=/1>Storm closes harbour for two days</a></li><li><a href=/2>Council votes on the new school</a></li></ul></div></div>
<div class="footer"><p>Contact us. Terms. All rights reserved.</p></div></body>""",
        ["Mill reopens", LONG, MORE, "The wheel in June.", LAST],
    ),
    "plain": (f"<body><h2>A mill</h2><p>{LONG}<p>{MORE}<ul><li>Open in May<li>Closed in winter</ul><p>{LAST}</body>", ["A mill", LONG, MORE, "Open in May", "Closed in winter", LAST]),
    "docs": (
        f"""<body><div class="toc sidebar-left"><ul><li><a href=#a>Start</a></li><li><a href=#b>Build</a></li></ul></div><div role="main" class="document"><h1>Building the wheel</h1>
<p>{LONG}</p><pre>turn --slow wheel</pre><table><tr><th>Part</th><th>Count</th></tr><tr><td>Paddle</td><td>24</td></tr></table><p>{MORE}</p></div>
<div class="prev-next pagination"><a href=/p>Previous page</a><a href=/n>Next page</a></div><footer role="contentinfo">Built with care</footer></body>""",
        ["Building the wheel", LONG, "turn --slow wheel", "Part", "Count", "Paddle", "24", MORE],
    ),
    "notices": (
        f"""<body><div id="gdpr-consent"><p>Your privacy matters to us and to our 312 partners.</p></div><div class="alert alert-info"><p>This site will be down on Sunday night.</p></div>
<nav><ul><li><a href=/>Start</a></li></ul></nav><article><h1>Water</h1><p>{LONG}</p><p>{LAST}</p></article><section class="reader-comments"><p>Great piece, thank you for writing it up!</p><p>My uncle was the miller there for years.</p></section>
<form class="login"><p>Please log in to leave a reply.</p></form><div class="share-bar"><a href=/s>Share this</a></div></body>""",
        ["Water", LONG, LAST],
    ),
    "aside inside": (
        f"""<body><main><article><header><h1>River</h1></header><p>{LONG}</p><aside class="related-articles"><h3>Read also</h3><ul><li><a href=/x>Ten walks along the water</a></li></ul></aside><p>{MORE}</p>
<section><h2>History</h2><p>{LAST}</p></section></article></main><div class="sponsored-content"><p>Paid: the finest garden chairs in the country.</p></div></body>""",
        ["River", LONG, MORE, "History", LAST],
    ),
    "forum": (
        f"""<body><div id=menu><a href=/f>Forum</a></div><div class="content"><h1>Question about mills</h1><div class="post-text"><p>{LONG}</p><p>{MORE}</p></div></div>
<div class="replies"><div class="reply"><p>You should ask at the town hall about this one.</p></div><div class="reply"><p>They open every Tuesday, I believe.</p></div></div><div id=footer>Imprint</div></body>""",
        ["Question about mills", LONG, MORE],
    ),
}


def counts(text, want):
    got = text.split("\n") if text else []
    right = sum(min(got.count(w), want.count(w)) for w in set(want))
    return right, len(want), len(got)


def test_blocks_of_hand_labelled_pages():
    right = asked = given = 0
    for page, want in PAGES.values():
        r, a, g = counts(trained().text(page), want)
        right, asked, given = right + r, asked + a, given + g
    assert right / asked >= 0.9 and right / given >= 0.9


@pytest.mark.parametrize("name", PAGES)
def test_comments_menus_notices_and_forms_stay_out(name):
    page, want = PAGES[name]
    text = trained().text(page)
    for words in ("cookies", "privacy", "Sign up", "log in", "Home", "Most read", "Recent posts", "shoes", "rights reserved", "garden chairs", "thank you for writing"):
        assert words not in text
    assert LONG in text


def test_all_given_pages_against_a_plain_reading(spark):
    """The given pages mark their parts by element: what stands inside the article, less what is marked as an advert."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_extract(pages).collect()}
    for r in pages.collect():
        body = re.sub(r"(?s)<(script|style|nav|footer|header|aside|form)\b.*?</\1>|<!--.*?-->|<div class=\"ad\">.*?</div>", " ", r.html or "")
        m = re.search(r"(?s)<article\b[^>]*>(.*)</article>", body)
        blocks = re.split(r"</?(?:p|h1|article|div|ul|li|br)\b[^>]*>", m[1]) if m else []
        plain = (" ".join(unescape(re.sub(r"(?s)<[^>]+>", "", b)).split()) for b in blocks)
        assert got[r.page_id] == "\n".join(b for b in plain if b), r.page_id
    twice = html_extract(pages.limit(3).union(pages.limit(3)).withColumns({c: F.lit("clash") for c in ("text", "n_chars")})).collect()
    assert len(twice) == 6 and len({(r.page_id, r.text) for r in twice}) == 3
