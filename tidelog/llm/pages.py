"""Main text of web pages by composite text density.

The page becomes a tree of elements (void and unclosed elements as HTML5 has them). Parts that are no article - scripts,
styles, forms, page headers and footers, navigation, asides, hidden parts, and blocks named as adverts, notices, menus,
sidebars or comments - are left out. So are blocks that are links for the most part, unless they are inside the seed, its
nearest article or main, or other content that is not around the seed: there they are sources, not menus. (If the body is
the seed, one outside article and main stays out.) For each other element the
composite text density weighs characters per tag by its links:

    ctd = c / t * log(c / lc * t / lt) / log(ln(c / (c - lc) * lc + LC / C * c + e))

(c characters, t tags, lc and lt those in links, C and LC the body's; a zero divisor counts as one). The element with
the greatest sum of its children's densities is the seed. The lowest density on its path to the body is the threshold;
the content is all that reaches it, in page order: whole elements where one does, else what of their parts does, where
text with the inline elements around it is one part. If the body is the seed, it is the content. Tags such as article
decide nothing.

Nulls and edge cases: null or empty html gives empty text; repeated rows give repeated results; broken markup is read as
far as it goes; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
DROPPED = set("script style noscript template nav footer aside form button select textarea input iframe object embed svg canvas audio video head title dialog menu".split())
CLOSES_P = set("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
# Words in class or id that name parts which are no article.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|adverts?|advertisements?|adsense|adslot|sponsor(?:ed|s)?|promos?|promotions?|banners?|notices?|cookies?|consent|gdpr|popups?|modals?|overlays?|newsletters?|subscribe|"
    r"subscription|signup|menus?|nav|navbar|navigation|breadcrumbs?|toolbars?|pagination|pager|sidebars?|widgets?|related|recommended|sharing|social|comments?|commentlist|disqus|respond|"
    r"replies|footers?|masthead|topbar|skip|login|search)(?:$|[\s_-]|\d)",
    re.I,
)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "up", "parts", "keep", "c", "t", "lc", "lt", "density", "total", "links")

    def __init__(self, tag: str, up: Node | None, keep: bool):
        self.tag, self.up, self.keep, self.parts = tag, up, keep, []
        self.c = self.t = self.lc = self.lt = 0
        self.density = self.total = 0.0
        self.links = False  # left out as it is links for the most part


class Tree(HTMLParser):
    """Elements and texts of a page; what is no article is marked as not to keep."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None, True)
        self.open = [self.root]
        self.depths: dict[str, list[int]] = {"html": [0]}  # of the open elements of each name
        self.blocks = [0]  # depths of the open elements that an inline end tag does not close

    def kept(self, tag: str, attrs: dict) -> bool:
        if tag in DROPPED or "hidden" in attrs or (attrs.get("role") or "").lower() in ROLES or (attrs.get("aria-hidden") or "").lower() == "true":
            return False
        if tag == "header" and not self.depths.get("article"):
            return False
        if tag not in ("body", "html", "article", "main") and NAMES.search(f"{attrs.get('class') or ''} {attrs.get('id') or ''}"):
            return False
        return not HIDDEN.search(attrs.get("style") or "")

    def depth(self, tags) -> int:
        """Of the innermost open element of these names, 0 if there is none: no walk up the tree, however deep."""
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)

    def enter(self, n: Node) -> None:
        if n.tag not in INLINE and n.tag != "p":
            self.blocks.append(len(self.open))
        self.depths.setdefault(n.tag, []).append(len(self.open))
        self.open.append(n)
        self.at = n

    def close_to(self, depth: int) -> None:
        """Closes the element at the depth and all within."""
        while len(self.open) > depth:
            n = self.open.pop()
            self.depths[n.tag].pop()
            if self.blocks[-1] == len(self.open):
                self.blocks.pop()
        self.at = self.open[-1]

    def leave(self, tags: set[str], stops: set[str]) -> None:
        """Leaves the nearest open element of tags, unless one of stops comes first."""
        at = self.depth(tags)
        if at and at > self.depth(stops - tags):
            self.close_to(at)

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag in CLOSES_P:
            self.leave({"p"}, {"button", "table", "td", "th", "article", "section", "div", "li", "body"})
        if tag == "body":
            self.leave({"head"}, set())
        elif tag in SAME:
            self.leave(SAME[tag], STOPS[tag])
        n = Node(tag, self.at, self.at.keep and self.kept(tag, dict(attrs)))
        self.at.parts.append(n)
        if tag not in VOID:
            self.enter(n)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and tag in ("svg", "path"):
            self.close_to(len(self.open) - 1)

    def handle_endtag(self, tag):
        at = self.depth((tag,))
        # a stray end tag of an inline element ends no block
        if at and (tag not in INLINE or at > self.blocks[-1]):
            self.close_to(at)

    def handle_data(self, data):
        self.at.parts.append(data)


def nodes_below(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += [x for x in n.parts if isinstance(x, Node) and x.keep]
    return out


def measure(root: Node) -> list[Node]:
    """The kept nodes, parents first, with their counts summed over what they hold."""
    order = nodes_below(root)
    for n in reversed(order):
        n.c = n.t = n.lc = n.lt = 0
        for x in n.parts:
            if isinstance(x, str):
                n.c += len("".join(x.split()))
            elif x.keep:
                n.c, n.t, n.lc, n.lt = n.c + x.c, n.t + x.t + 1, n.lc + x.lc, n.lt + x.lt + (x.tag == "a")
        if n.tag == "a":
            n.lc = n.c
    return order


def drop_links(order: list[Node]) -> bool:
    """Leaves out blocks of two links or more that are links for the most part."""
    found = False
    for n in order[1:]:
        if n.tag not in INLINE and n.tag not in ("body", "p", "article", "main") and n.lt >= 2 and 2 * n.lc > n.c:
            n.keep, n.links, found = False, True, True
    return found


def density_of(c: int, t: int, lc: int, lt: int, share: float) -> float:
    if not c:
        return 0.0
    t = max(1, t)
    base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
    return c / t * math.log(max(math.e, c / max(1, lc) * t / max(1, lt))) / max(1.0, math.log(max(math.e, base)))


def densities(order: list[Node], body: Node) -> None:
    share = body.lc / max(1, body.c)
    for n in order:
        n.density = density_of(n.c, n.t, n.lc, n.lt, share)
    for n in order:
        n.total = sum(x.density for x in n.parts if isinstance(x, Node) and x.keep)


def pieces(n: Node, share: float) -> list[tuple[Node, float]]:
    """The kept blocks of n and the runs of text and inline elements between them, with their densities."""
    out: list[tuple[Node, float]] = []
    for inline, xs in groupby((x for x in n.parts if isinstance(x, str) or x.keep), lambda x: isinstance(x, str) or x.tag in INLINE):
        if inline:
            run = Node("", n, True)
            run.parts = list(xs)
            measure(run)
            out.append((run, density_of(run.c, run.t, run.lc, run.lt, share)))
        else:
            out += [(x, x.density) for x in xs]
    return out


def restore_links(root: Node) -> None:
    """Takes in again what drop_links() left out inside root."""
    stack = [root]
    while stack:
        for x in stack.pop().parts:
            if isinstance(x, Node) and (x.keep or x.links):
                x.keep = True
                stack.append(x)


def content(body: Node) -> list[Node]:
    """The nodes in page order whose text is the main text."""
    order = measure(body)
    if drop_links(order):
        order = measure(body)
    if not body.c:
        return []
    densities(order, body)
    seed = max(order, key=lambda n: (n.total, -n.t))  # the first of equals
    path = [seed]
    while path[-1] is not body:
        path.append(path[-1].up)
    on_path = set(map(id, path))
    if seed is body:
        for n in order:
            if n.tag in ("article", "main"):
                restore_links(n)
        return [body]
    least = min(n.density for n in path)
    share = body.lc / max(1, body.c)
    out, stack = [], pieces(body, share)[::-1]
    while stack:
        n, density = stack.pop()
        if n.c and density >= least:
            out.append(n)
            if id(n) not in on_path:
                restore_links(n)
        elif n.c and n.tag:
            stack += pieces(n, share)[::-1]
    restore_links(next((n for n in path if n.tag in ("article", "main")), seed))
    return out


def text_of(roots: list[Node]) -> str:
    """Blocks in order, white space inside each turned to one space, joined by one space."""
    out: list[str] = []

    def walk(root: Node) -> None:
        stack: list = [root]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.keep:
                if x.tag not in INLINE:
                    out.append(" ")
                    stack.append(" ")
                stack += reversed(x.parts)

    for r in roots:
        walk(r)
    return " ".join("".join(out).split())


def main_text(html: str | None) -> str:
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    body = tree.root
    for n in nodes_below(tree.root):
        if n.tag == "body":
            body = n
            break
    return text_of(content(body))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return pd.Series([main_text(h) for h in html], dtype=object)

    return pages.select("page_id", "url", text("html").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
