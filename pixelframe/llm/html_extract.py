"""Main text of web pages by a graphical model on the DOM tree.

Every block element and every text block of a page is a variable with three states: frame (holds both kinds),
article, and rest. Potentials: of a node's observed features given its state, and of parent and child states.
Sum-product messages pass upward from the leaves and downward from the page, which gives each node's exact
marginals. The text blocks whose marginal for article is at least one half are the main text.

The potentials are relative frequencies in labelled pages, with ``PRIOR`` added to each count. No labelled pages
come with the tables, so ``labelled_pages`` writes them: sites of many layouts, from a seed, each block marked with its state.

Defined results: a null or empty page, or one without article text, has an empty text; white space of any kind inside
a block becomes one space, a line break element too; blocks are joined by one line feed; a block whose marginal is exactly
one half stays; repeated rows each get a row; pages of any length and depth are read whole; an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, small_batches, tidy
from .html_tree import Node, attributes, tree

FRAME, ARTICLE, REST = range(3)
PRIOR, TRAIN_PAGES, SEED = 0.2, 600, 11

# Words in class, id and role attributes that tell what an element is for.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs tabs toc pagination pager toolbar skip",
    "header": "header masthead banner topbar branding logo",
    "footer": "footer bottom copyright legal colophon contentinfo",
    "sidebar": "sidebar aside rail related recommended recommendations widget complementary trending popular more tags",
    "notice": "notice cookie cookies consent gdpr popup modal overlay alert alertdialog dialog paywall toast disclaimer",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted affiliate adsense dfp banner",
    "form": "form login signin signup search subscribe subscription newsletter register contact feedback poll survey",
    "comments": "comment comments commentlist reply replies respond disqus discussion reviews",
    "share": "share sharing social follow",
    "hidden": "hidden invisible",
    "article": "article content main post entry story body text prose page blog",
}
_HINT_OF = {w: k for k in reversed(HINTS) for w in HINTS[k].split()}
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Elements with a feature value of their own; others share one.
TAGS = frozenset(
    "#page #text html head body main article section div header footer nav aside form p ul ol li dl dt dd table tr td th tbody thead blockquote pre"
    " figure figcaption h1 h2 h3 h4 h5 h6 button label select fieldset noscript svg details dialog address menu template".split()
)


def features(node: Node) -> tuple:
    """Tag; hint; for a text block instead its length, its share of link text, and whether it ends a sentence."""
    if node.tag == "#text":
        n = len(node.text)
        size = 0 if n < 20 else 1 if n < 80 else 2 if n < 250 else 3
        links = 0 if not node.linked else 1 if 3 * node.linked < n else 2
        return "#text", size, links, node.text[-1] in ".!?…\"'»”:"
    hint = "none"
    if node.attrs:
        a = attributes(node.attrs)
        if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
            hint = "hidden"
        else:
            words = [w.lower() for k in ("role", "class", "id") for w in _PIECES.findall(a.get(k, ""))]
            kinds = [_HINT_OF[w] for w in words if w in _HINT_OF]
            hint = next((k for k in kinds if k != "article"), kinds[0] if kinds else "none")
    return (node.tag if node.tag in TAGS else "other", hint)


def compact(nodes: list[Node]) -> list[Node]:
    """The nodes without wrappers: elements that tell nothing and have one child, which takes their place."""
    children = [0] * len(nodes)
    for v in nodes[1:]:
        children[v.parent] += 1
    out: list[Node] = []
    place = [0] * len(nodes)
    for i, v in enumerate(nodes):
        parent = place[v.parent] if i else -1
        if i and children[i] == 1 and v.tag in ("div", "section", "other") and features(v)[1] == "none":
            place[i] = parent
            continue
        place[i] = len(out)
        v.parent = parent
        out.append(v)
    return out


class DomModel:
    """Log potentials: of states at the page, of a child's state by its parent's, of feature values by state."""

    def __init__(self, root: np.ndarray, step: np.ndarray, seen: dict, unseen: dict):
        self.root, self.step, self.seen, self.unseen = root, step, seen, unseen
        self.known: dict = {}

    @classmethod
    def fit(cls, pages: list[tuple[list[Node], list[int]]]) -> DomModel:
        root, step = np.full(3, PRIOR), np.full((3, 3), PRIOR)
        counts: dict = {}
        for nodes, states in pages:
            root[states[0]] += 1
            for node, s in zip(nodes, states, strict=True):
                if node.parent >= 0:
                    step[states[node.parent], s] += 1
                for key in cls._values(features(node)):
                    counts.setdefault(key, np.zeros(3))[s] += 1
        totals: dict = {}
        kinds: dict = {}
        for (place, _), c in counts.items():
            totals[place] = totals.get(place, 0) + c
            kinds[place] = kinds.get(place, 0) + 1
        seen = {k: (c + PRIOR) / (totals[k[0]] + PRIOR * (kinds[k[0]] + 1)) for k, c in counts.items()}
        unseen = {p: PRIOR / (t + PRIOR * (kinds[p] + 1)) for p, t in totals.items()}
        return cls(root / root.sum(), step / step.sum(1, keepdims=True), seen, unseen)

    @staticmethod
    def _values(f: tuple):
        if f[0] == "#text":
            return [("leaf", True), ("size", f[1]), ("links", f[2]), ("ends", f[3])]
        return [("leaf", False), ("tag", f[0]), ("hint", f[1])]

    def _local(self, node: Node) -> list[float]:
        f = features(node)
        got = self.known.get(f)
        if got is None:
            p = np.ones(3)
            for k in self._values(f):
                p = p * self.seen.get(k, self.unseen.get(k[0], 1.0))
            got = self.known[f] = (p / p.sum()).tolist()
        return got

    def marginals(self, nodes: list[Node]) -> list[list[float]]:
        """Each node's probabilities of the three states, by one upward and one downward pass."""
        s0, s1, s2 = self.step.tolist()
        n = len(nodes)
        belief = [list(self._local(v)) for v in nodes]  # local potential times the messages of the children so far
        up: list = [None] * n
        for i in range(n - 1, 0, -1):
            a, b, c = belief[i]
            m0 = s0[0] * a + s0[1] * b + s0[2] * c
            m1 = s1[0] * a + s1[1] * b + s1[2] * c
            m2 = s2[0] * a + s2[1] * b + s2[2] * c
            up[i] = (m0, m1, m2)
            p = belief[nodes[i].parent]
            x, y, z = p[0] * m0, p[1] * m1, p[2] * m2
            total = x + y + z
            p[0], p[1], p[2] = x / total, y / total, z / total
        out: list = [None] * n
        r = [q * b for q, b in zip(self.root.tolist(), belief[0], strict=True)]
        out[0] = [v / sum(r) for v in r]
        for i in range(1, n):
            q, m = out[nodes[i].parent], up[i]
            w0, w1, w2 = (q[k] / m[k] if m[k] > 0 else 0.0 for k in range(3))
            a = (w0 * s0[0] + w1 * s1[0] + w2 * s2[0]) * belief[i][0]
            b = (w0 * s0[1] + w1 * s1[1] + w2 * s2[1]) * belief[i][1]
            c = (w0 * s0[2] + w1 * s1[2] + w2 * s2[2]) * belief[i][2]
            total = a + b + c or 1.0
            out[i] = [a / total, b / total, c / total]
        return out

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        nodes = compact(tree(page))
        marginals = self.marginals(nodes)
        return "\n".join(v.text for v, m in zip(nodes, marginals, strict=True) if v.tag == "#text" and m[ARTICLE] >= 0.5)


def labelled_pages(count: int = TRAIN_PAGES, seed: int = SEED) -> list[tuple[list[Node], list[int]]]:
    """Pages of many layouts and the states of their nodes."""
    rng = random.Random(seed)
    words = [a + b for a in ("ka", "lo", "mi", "ru", "te", "so") for b in ("n", "ra", "st", "l", "ve", "do")]
    pick, chance = rng.choice, lambda p: rng.random() < p

    def prose(low, high):
        return " ".join(pick(words) for _ in range(rng.randint(low, high))).capitalize()

    def el(tag, state, inner, attrs=""):
        return f'<{tag}{" " + attrs if attrs else ""} data-y={state}>{inner}</{tag}>'

    def named(kind):
        return "" if chance(0.25) else f'{pick(("class", "id", "class"))}="{pick(("", "", "site-", "main-", "page-"))}{pick(HINTS[kind].split())}"'

    def sentence():
        return "".join(f"{prose(4, 16)}{pick('.....!?')} " for _ in range(rng.randint(1, 6))).strip()

    def links(state, k):
        return el(pick(("ul", "ol", "div")), state, "".join(el("li", state, f'<a href="/x">{prose(1, 3)}</a>') for _ in range(k)))

    def short(state):
        return pick((prose(1, 4), sentence(), f"<a href=/x>{prose(1, 4)}</a>", f"&copy; {prose(1, 4)}", f"{prose(2, 8)} <a href=/x>{prose(1, 3)}</a>"))

    def rest(kind):
        tags = {"menu": ("nav", "nav", "div"), "header": ("header", "header", "div"), "footer": ("footer", "footer", "div"), "sidebar": ("aside", "aside", "div", "section"), "form": ("form", "form", "div")}
        tag = pick(tags.get(kind, ("div", "div", "section", "aside")))
        attrs = named(kind) if tag not in ("div", "section") else named(kind) or f'class="{pick(HINTS[kind].split())}"'
        if kind == "menu" or kind == "sidebar" and chance(0.5):
            return el(tag, REST, (el("h3", REST, prose(1, 3)) if chance(0.3) else "") + links(REST, rng.randint(2, 8)), attrs)
        if kind == "form":
            return el(tag, REST, el("label", REST, prose(1, 3)) + "<input>" + el("button", REST, prose(1, 2)), attrs)
        if kind == "comments":
            each = lambda: el(pick(("div", "article", "li")), REST, el("p", REST, sentence()), f'class="{pick(HINTS["comments"].split())}"' if chance(0.9) else "")
            return el(tag, REST, el("h3", REST, prose(1, 2)) + "".join(each() for _ in range(rng.randint(1, 5))), attrs)
        inner = short(REST) if chance(0.6) else "".join(el(pick(("p", "div", "h1", "h2")), REST, short(REST)) for _ in range(rng.randint(1, 3)))
        return el(tag, REST, inner, attrs)

    def block():
        kind = rng.random()
        if kind < 0.72:
            text = sentence() if chance(0.85) else prose(1, 5)
            if chance(0.2):
                text = f"<a href=/y>{prose(1, 3)}</a> {text}"
            return el(pick(("p",) * 9 + ("div",)), ARTICLE, text)
        if kind < 0.8:
            return el(pick(("h2", "h3", "h4")), ARTICLE, prose(1, 6))
        if kind < 0.87:
            return el(pick(("ul", "ol")), ARTICLE, "".join(el("li", ARTICLE, prose(2, 12)) for _ in range(rng.randint(2, 5))))
        if kind < 0.91:
            return el("blockquote", ARTICLE, el("p", ARTICLE, sentence()))
        if kind < 0.94:
            return el("table", ARTICLE, "".join(el("tr", ARTICLE, "".join(el("td", ARTICLE, prose(1, 3)) for _ in range(3))) for _ in range(2)))
        if kind < 0.97:
            return el("figure", ARTICLE, "<img>" + el("figcaption", ARTICLE, prose(2, 9)))
        return el(pick(("pre", "section")), ARTICLE, sentence())

    def page():
        body = el("h1", ARTICLE, prose(2, 10)) if chance(0.8) else ""
        if body and chance(0.15):
            body = el("header", ARTICLE, body, pick(("", 'class="entry-header"', 'class="article-header"')))
        for _ in range(rng.randint(1, 12)):
            body += block()
            if chance(0.2):
                body += rest(pick(("advert", "sidebar", "share", "form", "notice")))
        if chance(0.1):
            pass  # an article without an element of its own
        elif chance(0.6):
            body = el("article", ARTICLE, body, named("article") if chance(0.4) else "")
        else:
            body = el(pick(("div", "section", "main")), ARTICLE, body, f'{pick(("class", "id"))}="{pick(HINTS["article"].split())}"' if chance(0.8) else "")
        after = "".join(rest(pick(("comments", "sidebar", "share", "advert", "form"))) for _ in range(rng.randint(0, 3)))
        if chance(0.4):
            body, after = el(pick(("main", "div")), FRAME, body + after, pick(("", 'id="wrapper"', 'class="row"', 'class="main"'))), ""
        before = "".join(rest(pick(("header", "menu", "notice", "advert", "menu", "form"))) for _ in range(rng.randint(1, 4)))
        tail = rest("footer") if chance(0.9) else ""
        if chance(0.2):
            tail += rest(pick(("notice", "hidden", "advert")))
        inner = before + body + after + tail
        return el("html", FRAME, el("head", REST, "<title>x</title>") + el("body", FRAME, inner))

    out = []
    for _ in range(count):
        nodes = tree(page())
        states = [FRAME] * len(nodes)
        for i, v in enumerate(nodes[1:], 1):
            states[i] = states[v.parent] if v.tag == "#text" else int(attributes(v.attrs)["data-y"])
        state_of = dict(zip(map(id, nodes), states, strict=True))
        nodes = compact(nodes)
        out.append((nodes, [state_of[id(v)] for v in nodes]))
    return out


@cache
def trained() -> DomModel:
    """The model of ``labelled_pages``; the same in every process."""
    return DomModel.fit(labelled_pages())


def html_extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row."""
    sent = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        for b in batches:
            texts = [sent.value.text(h) for h in column(b, "html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    small_batches(pages.sparkSession)
    return rows.mapInArrow(tidy(run), "page_id long, url string, text string")
