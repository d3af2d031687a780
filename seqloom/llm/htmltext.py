"""Main text of one page by composite text density; plain Python without recursion."""

from __future__ import annotations

import functools
import html
import math
import re

# Fixed values of HTML: elements whose content is raw, that have no content, and that run along within a block.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
#: Opening one of the first closes an open one of the second, up to the enclosing container.
CLOSES = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"},
}
CONTAINERS = frozenset("html body article main section div table ul ol dl nav aside header footer form blockquote figure td th".split())
#: Elements that never hold a part of an article's text.
NEVER = frozenset("script style noscript template textarea title head iframe object svg canvas video audio select button xmp noembed noframes".split())
#: Elements that stand beside an article by their meaning, and words of class, id and role names that say the same of any other.
BESIDE = frozenset("form nav footer aside menu dialog".split())
BESIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsbygoogle banner promo promos promoted promotion sponsor sponsored sponsors sidebar sidebars"
    " menu menus nav navbar navigation breadcrumb breadcrumbs footer footers masthead topbar cookie cookies consent gdpr notice notices alert alerts popup modal overlay"
    " newsletter subscribe subscription signup login register share sharing social related recommended recommendations widget widgets toolbar pagination pager"
    " copyright complementary contentinfo search searchbox form dialog".split()
)
COMMENT_WORDS = frozenset("comment comments reply replies disqus".split())
HEADER_NAMES = frozenset("header site-header page-header main-header top-header global-header".split())
#: Words that leave the sense of a name as it is: "cookie-bar" is a notice, "share-price" is not.
PLAIN_WORDS = frozenset(
    "area bar block bottom box btn button col column container desktop global group inner item items left link links list main mobile outer page panel policy"
    " primary region right row secondary section site slot text top unit wrap wrapper zone thread user reader post entry".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an element's name costs the densities in it.
CLEAR, BESIDE_COST, COMMENT_COST = 1.0, 0.05, 0.01
#: Paragraphs of so many characters each that an element beside the article must have to compete with it, where it has no article, main or h1.
PARAGRAPHS, PARAGRAPH = 3, 80

_TAG = re.compile(
    r"<(?:!--(?:.*?-->|.*)|[!?][^>]*+(?:>|$)|/[^>]*+(?:>|$)"
    r"|([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|$)))",
    re.S,
)
_END_NAME = re.compile(r"</([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])(?!\s*=\s*[\"']?until)")


class Node:
    __slots__ = ("name", "parent", "parts", "kind", "never", "inside", "own", "own_links", "own_tags", "own_link_tags", "chars", "links", "tags", "link_tags", "evidence", "cost", "density", "own_density", "sum", "at")

    def __init__(self, name, parent, kind, never, inside, at=0):
        self.name, self.parent, self.kind, self.never, self.inside, self.at = name, parent, kind, never, inside, at
        self.own = self.own_links = self.own_tags = self.own_link_tags = 0
        self.chars = self.links = self.link_tags = self.evidence = 0
        self.tags, self.cost = 1, CLEAR
        self.density = self.own_density = self.sum = 0.0


@functools.lru_cache(maxsize=1 << 16)
def name_kind(name: str) -> int:
    """What a whole class, id or role name says: nothing (0), beside the article (1), reader comments (2) or a header (3).

    All its parts must be words of the lists, so a name that merely contains such a word says nothing.
    """
    if name.lower() in HEADER_NAMES:
        return 3
    words = _WORD.findall(_CAMEL.sub(" ", name).lower())
    telling = [w for w in words if w not in PLAIN_WORDS]
    if not telling or not all(w in BESIDE_WORDS or w in COMMENT_WORDS for w in telling):
        return 0
    return 2 if any(w in COMMENT_WORDS for w in telling) else 1


def _kind(name: str, attributes: str, inside: bool) -> int:
    """0: an ordinary element, 1: beside the article by its name, 2: reader comments, 3: without article text."""
    if name in NEVER:
        return 3
    if name in ("html", "body", "main", "#root"):
        return 0
    kind = 1 if name in BESIDE or (name == "header" and not inside) else 0
    if attributes and not attributes.isspace():
        if "hidden" in attributes and _HIDDEN.search(_QUOTED.sub("", attributes)):
            return 3
        if "=" in attributes:
            for m in _NAMES.finditer(attributes):
                for one in (m[1] or m[2] or m[3] or "").split():
                    k = name_kind(one)
                    kind = max(kind, 0 if k == 3 and inside else 1 if k == 3 else k)
    return kind


def parse(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree of block elements, and the text runs in page order with the node that holds each.

    Inline elements are tags of their block, not nodes, so one left open spoils nothing. Unclosed
    elements end with their container or with the page.
    """
    root = Node("#root", None, 0, False, False)
    node, runs, pos, link = root, [], 0, False
    nodes = [root]
    size = len(page)

    def text(run: str):
        if run:
            runs.append((node, run, link))

    while pos < size:
        at = page.find("<", pos)
        if at < 0:
            text(page[pos:])
            break
        m = _TAG.match(page, at)
        if not m:
            text(page[pos : at + 1])
            pos = at + 1
            continue
        text(page[pos:at])
        pos = m.end()
        if m[1]:
            name, attributes = m[1].lower(), m[2]
            if name == "br" or name == "hr":
                node.own_tags += 1
                runs.append((node, "\n", False))
            elif name in INLINE and (name in ("a", "time", "img", "wbr") or not _kind(name, attributes, node.inside)):
                node.own_tags += 1
                if name == "a":
                    link = True
                    node.own_link_tags += 1
            elif name in VOID:
                node.own_tags += 1
            else:
                link = False
                while node.parent and (node.name in CLOSES.get(name, ()) or (node.name == "p" and name not in INLINE)):
                    node = node.parent
                if name in RAW:
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, pos)
                    pos = end.start() if end else size
                kind = _kind(name, attributes, node.inside)
                child = Node(name, node, kind, node.never or kind == 3, node.inside or name in ("article", "main"), len(nodes))
                nodes.append(child)
                runs.append((node, "\n", False))
                if not attributes.rstrip(">").endswith("/") or name in CONTAINERS or name == "p":
                    node = child
        elif e := _END_NAME.match(page, at):
            name = e[1].lower()
            if name == "a":
                link = False
            scan = node
            while scan.parent and scan.name != name and (scan.name not in ("html", "body") or name in ("html", "body")):
                if scan.name in CONTAINERS and name not in CONTAINERS:
                    break
                scan = scan.parent
            if scan.name == name and scan.parent:
                link = False
                node = scan.parent
                runs.append((node, "\n", False))
    root.parts = nodes
    return root, runs


def composite_density(chars: int, links: int, tags: int, link_tags: int, share: float) -> float:
    """Characters for each tag, the more the fewer of both are links; share is the page's part of linked characters."""
    if chars <= links:
        return 0.0
    spread = chars / max(links, 1) * tags / max(link_tags, 1)
    base = math.log(chars * links / (chars - links + 1) + share * chars + math.e)
    return chars / tags * math.log(1 + spread) / math.log(1 + base)


def _measure(root: Node, runs) -> None:
    """Characters, linked ones and tags of every subtree, and what each has that an article would have."""
    for node, run, link in runs:
        if not node.never:
            n = len("".join(run.split()))
            node.own += n
            node.own_links += n * link
    for node in reversed(root.parts):  # children come before their parents
        if not node.never:
            node.chars += node.own
            node.links += node.own_links
            node.tags += node.own_tags
            node.link_tags += node.own_link_tags
            if node.chars and node.kind < 2 and node.name in ("article", "main", "h1"):
                node.evidence += PARAGRAPHS
            elif node.name == "p" and node.own - node.own_links >= PARAGRAPH:
                node.evidence += 1
            if p := node.parent:
                p.chars += node.chars
                p.links += node.links
                p.tags += node.tags
                p.link_tags += node.link_tags
                if node.kind < 2 or node.evidence >= 2 * PARAGRAPHS:
                    p.evidence += node.evidence


def _costs(root: Node) -> None:
    """What names cost. An element beside the article that lacks all that an article has goes; one that holds most of the page has its name forgiven."""
    plain = {0: True}  # nodes that no name costs anything
    comments, outside = 0, []
    for n in root.parts[1:]:
        plain[n.at] = plain[n.parent.at] and not n.kind
        if n.kind == 2 and plain[n.parent.at]:
            comments += n.chars - n.links
        if n.name in ("article", "main") and plain[n.at] and n.chars > n.links:
            outside.append(n)
    most = (root.chars - root.links - comments) / 2
    for n in root.parts[1:]:
        if n.kind == 2:
            n.cost = n.parent.cost * (COMMENT_COST if n.evidence >= 2 * PARAGRAPHS else 0)
        elif n.kind == 1 and n.evidence < PARAGRAPHS:
            n.cost = 0.0
        elif n.kind == 1:
            n.cost = n.parent.cost * (CLEAR if n.chars - n.links > most and not outside else BESIDE_COST)
        else:
            n.cost = 0.0 if n.never else n.parent.cost


def _score(root: Node) -> None:
    """Density of every node and of the text that stands in it directly, and the sum of its children's, that text included."""
    share = (root.links + 1) / (root.chars + 1)
    for n in root.parts:
        if n.cost and n.chars:
            n.density = n.cost * composite_density(n.chars, n.links, n.tags, n.link_tags, share)
            n.own_density = n.cost * composite_density(n.own, n.own_links, n.own_tags + 1, n.own_link_tags, share)
            n.sum += n.own_density
            if n.parent:
                n.parent.sum += n.density


def _content(root: Node) -> tuple[set[int], set[int]]:
    """Places of the nodes that are content with all they hold, less what stands beside it, and of those whose direct text is."""
    _costs(root)
    live = [n for n in root.parts if n.cost and n.chars]
    if not live:
        return set(), set()
    _score(root)
    best = max(live, key=lambda n: n.sum)
    body = next((n for n in live if n.name == "body"), root)
    if not best.sum:  # nothing but links
        best = body
    path, n = [], best
    while n is not None:
        path.append(n)
        n = n.parent
    on_path = {n.at for n in path}
    cost = min(n.cost for n in path)
    # The threshold is the least density on the way from the body to the subtree of the greatest sum, names on that way forgiven.
    way = path[: path.index(body) + 1] if body in path else path
    threshold = min(n.density / n.cost for n in way)
    gone = set()
    for n in root.parts[1:]:
        if n.parent.at in gone or n.never or not n.cost or (n.kind and n.at not in on_path and n.cost < n.parent.cost):
            gone.add(n.at)
    live = [n for n in live if n.at not in gone]
    # In every subtree that is dense enough, the descendant of the greatest sum is content.
    peak: dict[int, Node] = {}
    for n in reversed(live):
        mine = peak.get(n.at)
        mine = peak[n.at] = n if mine is None or n.sum >= mine.sum else mine
        if n.parent and (n.parent.at not in peak or mine.sum >= peak[n.parent.at].sum):
            peak[n.parent.at] = mine
    whole = {peak[n.at].at for n in live if n.density >= threshold * min(cost, n.cost)} | {best.at}
    whole.discard(0) if best is not root else None
    whole -= on_path - {best.at}
    own = {n.at for n in live if n.own_density and n.own_density >= threshold * min(cost, n.cost)}
    # An article is whole; so is a main, but for its lists of links; and headings before the content on its way are its own.
    scope = next((n for n in reversed(path) if n.name == "article" and n.kind < 2), None)
    main = next((n for n in path if n.name == "main"), None)
    if scope:
        whole.add(scope.at)
    elif main:
        own.update(n.at for n in live if n.inside and (n.density >= threshold * min(cost, n.cost) or 2 * n.own_links < n.own))
    own.update(n.at for n in live if n.name in HEADINGS and n.at < best.at and n.parent.at in on_path and 2 * n.links < n.chars)
    for n in root.parts:  # parents come first
        if n.at in gone:
            whole.discard(n.at)
        elif n.parent is not None and n.parent.at in whole:
            whole.add(n.at)
    return whole, own


def extract(page: str) -> str:
    """The article's text: blocks in page order, white space runs as one space; the empty text if there is none."""
    root, runs = parse(page)
    _measure(root, runs)
    whole, own = _content(root)
    out = [run if not node.never and (node.at in whole or node.at in own) else "\n" for node, run, _ in runs]
    return " ".join(html.unescape("".join(out)).split())
