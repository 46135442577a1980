"""Operator 1: HTML extraction by consensus host paths.

1. Each page is read into blocks of text and the containers around them. A
   container's score is the text in it, without links and furniture. From the
   body down, the page's candidate is the innermost container that still holds
   almost all of it; its generalised path (tags and classes, digits as #) gets
   the page's vote, as heavy as its text.
2. Votes are summed per host and path; each host has one winning path. Containers
   beside it whose text is the same on two pages of the host are furniture too.
3. Each page is read again. On pages with the winning path, its text is all but
   that furniture; elsewhere, all that is not furniture.

Furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments
and what is hidden) is left out wherever it stands, inline elements included;
headings in an article's own header stay. Tags, roles and hidden ones are
furniture at once. A class or id is, if it has a word that marks nothing else, or
all its words are words of furniture and its parts ("related-posts", but not
"related-work"); unless the element holds
most of the page's text, and for names that articles use as well (_SOFT, alone)
only outside an article or where links make up most of it. Scripts, styles and markup
are never text.

Scale: votes combine before their shuffle, so a host that holds a third of all
pages sends one row a path and task. Winners, one row a host, are broadcast up
to BROADCAST_HOSTS hosts, which is counted first; beyond it they are joined by
host, and Spark splits hot hosts.

Defined results: a null or empty html has the text ""; a page without a host has
no winning path; a null page_id is carried along; a very long page is read
whole; a tag whose quote is never closed ends at the next ">"; of paths with as
many votes the smaller one wins; repeated rows vote again and give repeated
results; an empty table gives an empty one; columns other than page_id, url and
html are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut

BROADCAST_HOSTS, HOLDS, HOLDS_ARTICLE = 50_000, 0.8, 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|title|annotation|annotation-xml)\b[^>]*?(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|</?(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)"
    r"|</?(?P<cut>[a-zA-Z][^\s/>]*)(?P<open>[^>]*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTAINERS = frozenset("html body div section article main td th tr tbody table center blockquote ul ol dl figure details xmp".split())
_BLOCKS = _CONTAINERS | _HEADINGS | frozenset("p li dt dd pre address hr nav header footer aside form fieldset menu dialog caption figcaption summary thead tfoot option select button hgroup search legend label".split())
#: What may not stand inside the tag that it closes.
_CLOSES = {
    **dict.fromkeys([*_BLOCKS - {"button", "label", "option", "select", "legend", "summary"}], frozenset({"p"})),
    "li": frozenset({"p", "li"}), "dt": frozenset({"p", "dt", "dd"}), "dd": frozenset({"p", "dt", "dd"}),
    "tr": frozenset({"p", "tr", "td", "th"}), "td": frozenset({"p", "td", "th"}), "th": frozenset({"p", "td", "th"}), "option": frozenset({"option"}),
}
_WALLS = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "dt": {"dl"}, "dd": {"dl"}}
_FURNITURE = frozenset("nav footer aside form menu dialog select button search fieldset header label".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form tooltip".split())
#: Words of a class or id that mark furniture, those that mark inline elements as well, and those that are also found in articles.
_INLINE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo promotion share sharing social cookie cookies consent gdpr newsletter subscribe "
    "subscription signup signin login popup breadcrumb breadcrumbs pagination pager paywall disqus".split()
)
_COMMENTS = frozenset("comment comments commentlist reply replies respond disqus".split())
_SOFT = frozenset("dialog alert search menu menus modal overlay toast header skip related social promotion banner widget widgets".split())
_WORDS = _INLINE | _COMMENTS | _SOFT | frozenset("nav navbar navigation sidebar footer masthead topbar toolbar notice notices recommended recommendations".split())
#: Words that no article's own part is named by, whatever stands beside them.
_SURE = frozenset(
    "advert adverts advertisement advertising adsense adsbygoogle sponsored cookie cookies consent gdpr newsletter breadcrumb breadcrumbs navbar sidebar footer masthead pagination "
    "paywall disqus commentlist".split()
)
#: What stands beside them in a name.
_PARTS = frozenset(
    "site page global top bottom left right main primary secondary post posts article articles story stories link links list lists item items box form container wrapper wrap "
    "block area section content inner outer bar button buttons btn icon icons panel message text title image unit slot module group row col column float floating sticky fixed "
    "footer header nav menu body holder zone region widget widgets count author thread by to us more read also news policy google banner user users reader readers "
    "visitor visitors new latest recent all add leave submit id js fb facebook wp x".split()
)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


class Node:
    """A block element. ``why``: 0 for text, HARD for furniture at once, else by the words of its class and id."""

    __slots__ = ("tag", "parent", "path", "why", "out", "heading_only", "weight", "links", "kids")

    def __init__(self, tag: str, parent: Node | None, path: str, why: int, heading_only: bool) -> None:
        self.tag, self.parent, self.path, self.why, self.heading_only = tag, parent, path, why, heading_only
        self.out, self.weight, self.links, self.kids = False, 0, 0, []
        if parent is not None:
            parent.kids.append(self)


HARD, NAMED, SOFT = 1, 2, 3


def _marks(rest: str) -> tuple[str, str, bool]:
    """Class, all words of class and id, and whether the attributes hide the element or make it furniture."""
    if "=" not in rest and "hidden" not in rest.lower():
        return "", "", False
    a = {}
    for name, x, y, z in _ATTRIBUTE.findall(rest):
        a.setdefault(name.lower(), unescape(x or y or z))
    style = a.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
    return a.get("class", ""), f"{a.get('class', '')} {a.get('id', '')}", hidden or a.get("role", "").lower() in _ROLES


def _furniture(names: str, marks: frozenset[str] = _WORDS) -> int:
    """Whether a class or an id names furniture, and how; "with-sidebar" names what stands beside it."""
    found = 0
    for name in names.split():
        words = set(_SPLIT.sub(" ", name).lower().split())
        own = words & marks
        if not own or words & {"with", "has", "no", "without"} or own == {"header"} and not words <= {"header", "site", "page", "global", "top", "main"}:
            continue
        if own & _SURE or words <= _WORDS | _PARTS:
            if own & _COMMENTS:
                return HARD
            found = NAMED if words - _SOFT or found == NAMED else SOFT
    return found


def general(tag: str, classes: str) -> str:
    """A step of a path: the tag and its classes in order of the alphabet, runs of digits as #."""
    names = sorted({re.sub(r"\d+", "#", c) for c in classes.split()})
    return ".".join([tag, *names])


class Page:
    """Blocks of text in page order with their nodes, and the tree of containers."""

    def __init__(self, html: str) -> None:
        self.root = self.body = Node("", None, "", 0, False)
        self.blocks: list[tuple[Node, str, int]] = []
        stack = [self.root]
        held: list[str] = []
        linked = link = 0
        gone: list[tuple[str, int]] = []  # open inline elements from a furnished one on, and the blocks around each

        def flush():
            nonlocal held, linked
            if held:
                text = " ".join("".join(held).split())
                if text:
                    self.blocks.append((stack[-1], text, linked))
            held, linked = [], 0

        for m in _TOKEN.finditer(html):
            text = m["text"]
            if text is not None:
                if not gone:
                    text = unescape(text)
                    held.append(text)
                    if link:
                        linked += len(text)
                continue
            tag, rest = (m["tag"] or m["cut"] or "").lower(), m["rest"] or m["open"] or ""
            if not tag:
                continue
            if tag == "br":
                held.append(" ")
            elif m.group().startswith("</"):
                if tag == "a":
                    link = 0
                if tag in _BLOCKS or tag == "head":
                    at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
                    flush()
                    if at:
                        del stack[at:]
                        gone = [g for g in gone if g[1] <= at]
                elif (at := next((i for i in range(len(gone) - 1, -1, -1) if gone[i][0] == tag), -1)) >= 0:
                    del gone[at:]
            elif tag in _BLOCKS or tag == "head":
                flush()
                closes, walls = _CLOSES.get(tag, ()), _WALLS.get(tag, ())
                while len(stack) > 1 and stack[-1].tag in closes and stack[-1].tag not in walls:
                    stack.pop()
                gone = [g for g in gone if g[1] <= len(stack)]
                if tag == "hr":
                    continue
                parent = stack[-1]
                classes, names, hidden = _marks(rest)
                own_header = tag == "header" and any(n.tag in ("article", "main") for n in stack)
                why = HARD if gone or hidden or (tag in _FURNITURE and not own_header) or tag == "head" else 0
                if not why and names.strip() and tag not in ("article", "main", "body", "html") and tag not in _HEADINGS:
                    why = _furniture(names)
                node = Node(tag, parent, f"{parent.path}/{general(tag, classes)}", why, parent.heading_only or own_header)
                if tag == "body" and self.body is self.root:
                    self.body = node
                stack.append(node)
            else:
                if tag == "a":
                    link = 1
                if tag not in _VOID and not rest.endswith("/"):
                    _, names, hidden = _marks(rest)
                    if gone or hidden or (names.strip() and _furniture(names, _INLINE)):
                        gone.append((tag, len(stack)))
        flush()
        self._judge()
        self.blocks = [b for b in self.blocks if not b[0].out and (not b[0].heading_only or b[0].tag in _HEADINGS)]
        for node in self._nodes():
            node.weight = 0
        self._weigh()

    def _nodes(self) -> list[Node]:
        """All nodes, parents first."""
        out = [self.root]
        for node in out:
            out += node.kids
        return out

    def _weigh(self) -> None:
        for node, text, links in self.blocks:
            weight = max(0, len(text) - links)
            while node is not None:
                node.weight += weight
                node.links += min(links, len(text))
                node = node.parent

    def _judge(self) -> None:
        """What is out: by tags at once, by names where neither the share of text nor, for soft ones, the place speaks against it."""
        self._weigh()
        nodes = self._nodes()
        for node in nodes[1:]:
            node.out = node.parent.out or node.why == HARD
        total = sum(max(0, len(text) - links) for node, text, links in self.blocks if not node.out)
        inside = {self.root: False}
        for node in nodes[1:]:
            up = node.parent
            inside[node] = inside[up] or node.tag in ("article", "main")
            most = 2 * node.weight > total
            soft = inside[node] and node.links <= node.weight
            node.out = up.out or node.why == HARD or (node.why == NAMED and not most) or (node.why == SOFT and not most and not soft)

    def candidate(self) -> Node:
        """The innermost container with almost all of the text; an article or main part with half of it comes first."""
        total = self.root.weight
        named, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if node.out:
                continue
            if node.tag in ("article", "main") and total and node.weight >= HOLDS_ARTICLE * total:
                named.append(node)
            todo.extend(node.kids)
        node = max(named, key=lambda n: (n.weight, len(n.path))) if named else self.root
        while True:
            inner = [k for k in node.kids if not k.out and k.tag in _CONTAINERS and k.weight >= HOLDS * node.weight > 0]
            if not inner or node.tag == "article":
                return node
            node = max(inner, key=lambda k: k.weight)

    def beside(self, own: Node) -> dict[str, str]:
        """Texts of the outermost containers that stand beside ``own``, by path; articles are never beside."""
        around, found = set(), {}
        node: Node | None = own
        while node is not None:
            around.add(node)
            node = node.parent
        for n, text, _ in self.blocks:
            top, whole = None, False
            while n is not None and n not in around:
                whole |= n.tag in ("article", "main")
                if n.tag in _CONTAINERS:
                    top = n
                n = n.parent
            if top is not None and n is not own and not whole:
                found[top.path] = f"{found.get(top.path, '')} {text}"
        return found

    def text(self, path: str | None, repeated: list[str] | None = None) -> str:
        """All text but that of containers which the host repeats beside its winning ``path``, where the page has that path."""
        own = path is not None and any(_on(n, path) for n, _, _ in self.blocks)
        drop = frozenset(repeated or ()) if own else frozenset()
        return " ".join(t for n, t, _ in self.blocks if not drop or _on(n, path) or not _under(n, drop))


def _on(node: Node | None, path: str) -> bool:
    while node is not None:
        if node.path == path:
            return True
        node = node.parent
    return False


def _under(node: Node | None, paths: frozenset[str]) -> bool:
    while node is not None:
        if node.path in paths:
            return True
        node = node.parent
    return False


def host():
    return F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, score, text): each page's vote, and without a score the hashes of what stands beside it."""

    def run(batches):
        for b in batches:
            out: dict[str, list] = {"host": [], "path": [], "score": [], "text": []}
            for name, html in zip(b["host"], b["html"], strict=True):
                page = Page(html)
                best = page.candidate()
                if best.weight:
                    rows = [(best.path, best.weight, None), *((p, None, hashlib.md5(t.encode("utf-8", "replace")).digest()) for p, t in page.beside(best).items())]
                    for row in rows:
                        for c, v in zip(out, (name, *row), strict=True):
                            out[c].append(v)
            yield out

    rows = pages.select(host().alias("host"), "html").filter("host <> '' and html is not null")
    return arrow_map(rows, run, "host string, path string, score bigint, text binary")


def winners(pages: DataFrame) -> DataFrame:
    """(host, path, repeated): each host's path with the most votes, the smaller one of equals, and paths with the same text beside it on two pages."""
    summed = cut(votes(pages).groupBy("host", "path", "text").agg(F.sum("score").alias("score"), F.count("*").alias("n")))
    best = summed.filter("text is null").groupBy("host").agg(F.min(F.struct((-F.col("score")).alias("s"), "path"))["path"].alias("path"))
    same = summed.filter("text is not null and n > 1").groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("repeated"))
    return best.join(same, "host", "left")


def extract(pages: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """(page_id, url, text, n_chars, path) of each row; ``path`` is the host's winning one."""
    best = cut(winners(pages))
    side = F.broadcast(best) if best.count() <= broadcast_hosts else best
    rows = pages.select("page_id", "url", "html", host().alias("host")).join(side, "host", "left").select("page_id", "url", "html", "path", "repeated")

    def run(batches):
        for b in batches:
            texts = [Page(h).text(p, r) if h else "" for h, p, r in zip(b["html"], b["path"], b["repeated"], strict=True)]
            yield {"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts], "path": b["path"]}

    kind = pages.schema["page_id"].dataType.simpleString()
    return arrow_map(rows, run, f"page_id {kind}, url string, text string, n_chars bigint, path string")
