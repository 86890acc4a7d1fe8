"""A tolerant HTML reader: the tree of block elements of a page, its text blocks as leaves."""

from __future__ import annotations

import html
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, up to their end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
#: Elements that an open one of the same set ends, up to the nearest of the others.
_SAME = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
_NO_P_END = INLINE | VOID - {"hr"} | {"html", "head", "body", "label", "button", "select", "option", "noscript", "svg", "math", "picture", "video", "audio", "object", "canvas"}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_REST = re.compile(r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>")
_ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/>\"']+)")


class Node:
    """An element, or a text block (tag ``#text``)."""

    __slots__ = ("attrs", "linked", "parent", "tag", "text")

    def __init__(self, tag: str, parent: int, attrs: str = "", text: str = "", linked: int = 0):
        self.tag, self.parent, self.attrs, self.text, self.linked = tag, parent, attrs, text, linked


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        name = (m[1] or m[5]).lower()
        out.setdefault(name, html.unescape(next((v for v in m.groups()[1:4] if v is not None), "")))
    return out


def tree(page: str) -> list[Node]:
    """Nodes in page order, each after its parent; node 0 is the page. A block's text has single spaces, and
    ``linked`` of its characters stand in links. Comments, scripts and styles leave no node."""
    nodes = [Node("#page", -1)]
    open_: list[tuple[str, int]] = [("#page", 0)]  # block elements
    inline: list[str] = []
    parts: list[tuple[str, bool]] = []
    quotes = True

    def flush() -> None:
        if not parts:
            return
        text = " ".join("".join([p for p, _ in parts]).split())
        if text:
            linked = sum(len("".join(p.split())) for p, link in parts if link)
            nodes.append(Node("#text", open_[-1][1], text=text, linked=linked))
        parts.clear()

    def close_to(depth: int) -> None:
        flush()
        del open_[depth:]
        inline.clear()

    i, n = 0, len(page)
    while i < n:
        lt = page.find("<", i)
        if lt < 0:
            lt = n
        if lt > i:
            parts.append((html.unescape(page[i:lt]), "a" in inline))
        if lt == n:
            break
        nxt = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            if page.startswith(("<!-->", "<!--->"), lt):
                i = page.index(">", lt) + 1
            else:
                end = page.find("-->", lt + 4)
                i = n if end < 0 else end + 3
            continue
        if nxt and nxt in "!?":
            end = page.find(">", lt)
            i = n if end < 0 else end + 1
            continue
        closing = nxt == "/"
        name = _NAME.match(page, lt + 1 + closing)
        if not name:
            if closing:  # </ and no name: a comment up to >
                end = page.find(">", lt)
                i = n if end < 0 else end + 1
            else:
                parts.append(("<", "a" in inline))
                i = lt + 1
            continue
        rest = _TAG_REST.match(page, name.end()) if quotes else None
        if rest:
            end = rest.end()
        else:
            quotes = False  # a quote stays open up to the end: from here on, a tag ends at the next >
            end = page.find(">", name.end()) + 1
            if not end:
                break
        tag, raw = name[0].lower(), page[name.end() : end - 1]
        i = end
        if tag in INLINE:
            if closing:
                if tag in inline:
                    del inline[len(inline) - 1 - inline[::-1].index(tag) :]
            elif not raw.endswith("/"):
                inline.append(tag)
            continue
        if tag in ("br", "wbr", "img"):
            if tag == "br":
                parts.append((" ", False))
            continue
        if closing:
            for depth in range(len(open_) - 1, 0, -1):
                if open_[depth][0] == tag:
                    close_to(depth)
                    break
            else:
                flush()
            continue
        flush()
        inline_link = "a" in inline
        inline.clear()
        if inline_link:
            inline.append("a")
        if tag not in _NO_P_END:
            for depth in range(len(open_) - 1, 0, -1):
                if open_[depth][0] == "p":
                    close_to(depth)
                    break
                if open_[depth][0] in ("button", "object", "td", "th", "table", "div", "article", "section", "li"):
                    break
        if tag in _SAME:
            ends, bound = _SAME[tag]
            for depth in range(len(open_) - 1, 0, -1):
                if open_[depth][0] in bound:
                    break
                if open_[depth][0] in ends:
                    close_to(depth)
                    if tag not in ("tr",):
                        break
        if tag in RAW:
            stop = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.IGNORECASE).search(page, i)
            if not stop:
                break
            end = page.find(">", stop.end())
            i = n if end < 0 else end + 1
            continue
        if tag in VOID:
            continue
        nodes.append(Node(tag, open_[-1][1], raw))
        if not raw.endswith("/") or tag not in ("path", "use", "circle", "rect"):
            open_.append((tag, len(nodes) - 1))
    flush()
    return nodes
