"""Main text of web pages by composite text density.

Each page is read into a tree of elements in the task that holds it. Every element gets its
composite text density: characters per tag below it, cut down by the share of characters that stand
in links. Per element the densities of its children and of its own text are summed, and the element
with the greatest sum is the centre of the page; ``article`` and ``main`` weigh more, the page as a
whole less. The least density on the path from there to the body is the threshold: from the body
down, every element that reaches a share of it gives the subtree with the greatest sum below it, and
the text is what the smallest element around all these subtrees holds, without boxes of links. So an
article cut into sections is taken whole. Boxes that announce by tag, role or their whole name that
they are not the article (menus, footers, adverts, forms, comments) take no part.

Null and empty html gives an empty text, repeated rows are done each on its own, and a page
without any element is plain text. Markup that is never closed ends with its parent.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What HTML says about elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote body details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
    "p": {"p"},
}
#: A box that stays though its name sets it aside holds this share of the article's paragraph text.
STAY = 0.15
SCOPES = frozenset("ul ol dl table tbody thead tfoot select body html article section div main aside td th".split())
_LIST_SCOPES = SCOPES - {"div", "td", "th"}

#: Elements that never hold the article, and words in class, id or role that say so.
ASIDE = frozenset(
    "nav header footer aside form button select menu dialog template svg object canvas audio video head".split()
) | RAW
_NAMES = (
    "ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments commentform commentlist consent "
    "cookie cookies disqus footer gdpr menu modal nav navbar navigation newsletter pager pagination popup promo promoted "
    "related reply replies responses share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets"
)
ASIDE_NAMES = frozenset(_NAMES.split())
#: Those of them that speak of readers' comments.
TALK = frozenset("comment comments commentform commentlist disqus reply replies responses".split())
#: Words that may stand beside them in the name of a box; any other word makes it a name of something else.
_PARTS = (
    "area articles bar block bottom box button buttons center col column container content form global google group header icons inner "
    "item items left links list main media notice outer page panel post posts primary right row secondary section site slot stories "
    "thread top unit wrap wrapper"
)
NAME_PARTS = frozenset(_PARTS.split())
#: Names that say so outside an article only, and those of boxes that announce articles on a page that has one.
OUTSIDE_NAMES = frozenset("header masthead topbar".split())
TEASERS = frozenset("teaser teasers".split())
#: Elements whose names say nothing about the page: running text, and what holds the article.
UNNAMED = INLINE | frozenset("html body article main p h1 h2 h3 h4 h5 h6 hgroup blockquote pre li dt dd tr td th caption figcaption".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"  # comment
    # an unquoted value may hold quotes, and a quote after a value starts a name
    r"|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*+)"
    r"(?P<rest>(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)?+)*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>\"'][^\s>]*+)))?+")
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are never the centre, and how much the sums of others weigh.
_RUNNING = INLINE | _HEADING | {"p"}
_PAGE = frozenset(("#page", "html", "body"))
WEIGHTS = {"article": 4.0, "main": 4.0} | dict.fromkeys(_PAGE, 0.5)


class Node:
    __slots__ = ("tag", "parent", "depth", "parts", "aside", "doubt", "teaser", "chars", "links", "tags", "link_tags", "density", "total", "peak")

    def __init__(self, tag: str, parent: Node | None, aside: bool):
        self.tag, self.parent, self.aside, self.doubt, self.teaser = tag, parent, aside, False, False
        self.depth = parent.depth + 1 if parent else 0
        self.parts: list[Node | str] = []


def _attributes(rest: str) -> dict[str, str]:
    """Names and values as they stand in a tag; the first of a name counts."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        out.setdefault(name.lower(), unescape(a or b or c).lower())
    return out


def _names_aside(name: str) -> bool:
    """Whether all words of a box's name speak of a box beside the article."""
    words = [w for w in re.split(r"[-_]+", name) if w and not w.isdigit()]
    return any(w in ASIDE_NAMES for w in words) and all(w in ASIDE_NAMES or w in NAME_PARTS for w in words)


def _is_aside(tag: str, own: dict[str, str], in_article: bool) -> tuple[bool, bool]:
    """Whether an element announces that it is not the article, and whether its text may prove otherwise."""
    if tag in ASIDE:
        return not (tag == "header" and in_article), tag == "form"
    if not own:
        return False, False
    if "hidden" in own or own.get("aria-hidden") == "true" or own.get("role") in ASIDE_ROLES:
        return True, False
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", "")):
        return True, False
    if tag in UNNAMED:
        return False, False
    names = [*own.get("class", "").split(), *own.get("id", "").split()]
    found = [n for n in names if _names_aside(n) or not in_article and n in OUTSIDE_NAMES]
    talk = any(w in TALK for n in found for w in re.split(r"[-_]+", n))
    return bool(found), in_article and not talk


class _Open:
    """The open elements, with how many there are of each tag."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.count: dict[str, int] = {}

    def push(self, node: Node) -> None:
        self.nodes.append(node)
        self.count[node.tag] = self.count.get(node.tag, 0) + 1

    def close(self, until: int) -> None:
        for node in self.nodes[until:]:
            self.count[node.tag] -= 1
        del self.nodes[until:]

    def any(self, tags) -> bool:
        return any(self.count.get(t) for t in tags)

    def last(self, tags, scopes=frozenset()) -> int:
        """Place of the innermost open element of ``tags`` that none of ``scopes`` hides; 0 if there is none."""
        if self.any(tags):
            for k in range(len(self.nodes) - 1, 0, -1):
                if self.nodes[k].tag in tags:
                    return k
                if self.nodes[k].tag in scopes:
                    break
        return 0


def tree(html: str) -> Node:
    """Read markup into a tree; what is never closed ends with its parent."""
    root = Node("#page", None, False)
    open_, at, end = _Open(root), 0, len(html)
    doubtful: list[Node] = []
    while at < end:
        found = _TOKEN.search(html, at)
        if found is None:
            open_.nodes[-1].parts.append(html[at:])
            break
        if found.start() > at:
            open_.nodes[-1].parts.append(html[at : found.start()])
        at = found.end()
        tag = found["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if found["end"]:
            if tag == "br" or tag == "p" and not open_.any(("p",)):
                open_.nodes[-1].parts.append(Node("br", open_.nodes[-1], False))
                continue
            # a stray inline end inside another box closes nothing
            if k := open_.last((tag,), SCOPES if tag in INLINE else frozenset()):
                open_.close(k)
            continue
        rest = found["rest"]
        if tag in CLOSES_P and (k := open_.last(("p",), SCOPES)):
            open_.close(k)
        if tag in SIBLINGS and tag != "p" and (k := open_.last(SIBLINGS[tag], _LIST_SCOPES)):
            open_.close(k)
        own, in_article = _attributes(rest), open_.any(("article", "main"))
        aside, doubt = _is_aside(tag, own, in_article)
        parent = open_.nodes[-1]
        node = Node(tag, parent, aside)
        node.teaser = not in_article and tag not in UNNAMED and not TEASERS.isdisjoint(own.get("class", "").split())
        if aside and doubt:
            node.doubt = True
            doubtful.append(node)
        parent.parts.append(node)
        if tag in VOID or rest.endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
            node.parts.append(html[at : stop.start() if stop else end])
            at = stop.end() if stop else end
            continue
        open_.push(node)
    if doubtful:
        _acquit(root, doubtful)
    return root


def _acquit(root: Node, doubtful: list[Node]) -> None:
    """A box that its name alone, or being a form, sets aside stays if it holds much of the text in paragraphs.

    Much is ``STAY`` of the paragraph text of the article around it, and half of the page's for a form.
    """
    prose: dict[int, int] = {}
    order, rest = [], [root]
    while rest:
        node = rest.pop()
        order.append(node)
        rest.extend(c for c in node.parts if isinstance(c, Node) and (c.doubt or not c.aside))
    for node in reversed(order):
        if node.tag == "p":
            # words of links are no prose
            prose[id(node)] = _prose(node)
        else:
            prose[id(node)] = sum(prose.get(id(c), 0) for c in node.parts if isinstance(c, Node))
    article = {}
    for node in order:
        article[id(node)] = node if node.tag in ("article", "main") else article.get(id(node.parent))
    for node in doubtful:
        if id(node) not in prose:
            continue
        whole = root if node.tag == "form" else article.get(id(node)) or root
        if prose[id(node)] and prose[id(node)] >= (0.5 if node.tag == "form" else STAY) * prose[id(whole)]:
            node.aside = False


def _prose(paragraph: Node) -> int:
    """Characters of a paragraph outside links."""
    chars, rest = 0, [paragraph]
    while rest:
        for part in rest.pop().parts:
            if isinstance(part, str):
                chars += len(part) - part.count(" ")
            elif part.tag != "a" and not part.aside:
                rest.append(part)
    return chars


def _walk(root: Node) -> list[Node]:
    """Elements that may hold the article, parents first."""
    out, rest = [], [root]
    while rest:
        node = rest.pop()
        out.append(node)
        rest.extend(c for c in node.parts if isinstance(c, Node) and not c.aside)
    return out


def measure(root: Node) -> list[Node]:
    """Fill in characters, tags, links, composite density, its sum, and the element below with the greatest sum."""
    nodes = _walk(root)
    for node in reversed(nodes):
        own = sum(len(c) - c.count(" ") for c in node.parts if isinstance(c, str))
        below = [c for c in node.parts if isinstance(c, Node) and not c.aside]
        node.chars = own + sum(c.chars for c in below)
        node.tags = sum(c.tags + 1 for c in below)
        node.links = node.chars if node.tag == "a" else sum(c.links for c in below)
        node.link_tags = sum(c.link_tags + (c.tag == "a") for c in below)
    page = max(root.chars, 1)
    ratio = root.links / page
    for node in nodes:
        tags, plain = max(node.tags, 1), max(node.chars - node.links, 1)
        links, link_tags = max(node.links, 1), max(node.link_tags, 1)
        # a high base flattens the logarithm: boxes full of links lose, the page's own share is the norm
        base = math.log(node.chars / plain * node.links + ratio * node.chars + math.e)
        rated = max(node.chars / links * tags / link_tags, 1.0)
        node.density = node.chars / tags * math.log(rated + math.e - 1) / base if node.chars else 0.0
    for node in reversed(nodes):
        below = [c for c in node.parts if isinstance(c, Node) and not c.aside]
        node.total, node.peak = sum(c.density for c in below), node
        if node.tag in _RUNNING:
            node.total = 0.0
        else:
            own = sum(len(c) - c.count(" ") for c in node.parts if isinstance(c, str) and not c.isspace())
            node.total += own * math.log(own + math.e - 1) / math.log(1 + ratio * own + math.e) if own else 0.0
            node.total *= WEIGHTS.get(node.tag, 1.0)
        for c in below:
            if c.peak.total > node.peak.total:
                node.peak = c.peak
    return nodes


def _without_teasers(nodes: list[Node]) -> bool:
    """Where a page marks its article, rows of boxes that announce others are none of it."""
    if not any(n.tag in ("article", "main") and n.chars for n in nodes):
        return False
    rows = [[c for c in n.parts if isinstance(c, Node) and c.teaser and not c.aside] for n in nodes]
    found = [c for row in rows if len(row) > 1 for c in row]
    for c in found:
        c.aside = True
    return bool(found)


def _around(a: Node, b: Node) -> Node:
    """The smallest element that holds both."""
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return a


def centre(root: Node, path_share: float = 0.5) -> Node:
    """The smallest element around all subtrees that qualify; link boxes between them are set aside.

    The threshold is the least density on the path from the greatest sum to the body; an element
    qualifies that reaches ``path_share`` of it. A marked article that holds them all is taken whole.
    """
    nodes = measure(root)
    if _without_teasers(nodes):
        nodes = measure(root)
    best = root.peak
    if best.total <= 0:
        return root
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    start = next((n for n in path if n.tag in ("body", "html")), root)
    least = path_share * min(n.density for n in path[: path.index(start) + 1])
    taken, rest = {id(best): best}, [start]
    while rest:
        node = rest.pop()
        if id(node) not in taken and node.density >= least and node.chars:
            peak = node.peak if node.peak.total > 0 else node
            taken[id(peak)] = peak
            if peak is not node:
                rest.extend(c for c in node.parts if isinstance(c, Node) and not c.aside)
    top = best
    for node in taken.values():
        top = _around(top, node)
    named = top
    while named is not None and named.tag not in ("article", "main"):
        named = named.parent
    top = named or top
    if top.tag != "article":
        _trim(top, taken)
    return top


def _trim(top: Node, taken: dict[int, Node]) -> None:
    """Set aside what is no part of the article below ``top``, outside the subtrees taken."""
    if id(top) in taken:
        return
    held: dict[int, Node] = {}
    for node in taken.values():
        while node is not top and id(node) not in held:
            held[id(node)] = node
            node = node.parent
    within = [top, *(n for n in held.values() if id(n) not in taken)]
    for node in within:
        boxes = [c for c in node.parts if isinstance(c, Node) and not c.aside]
        inside = [i for i, c in enumerate(boxes) if id(c) in held]
        for i, c in enumerate(boxes):
            if id(c) in held or c.tag in _RUNNING:
                continue
            beside = node is top and top.tag in _PAGE and not inside[0] < i < inside[-1]
            c.aside = beside or 2 * c.links > c.chars


def _texts(node: Node) -> Iterator[str]:
    """Text below ``node`` in page order; a space stands where a block begins or ends."""
    stack: list[Node | str] = [node]
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            yield part
        elif part.tag == "br" or part.tag == "hr":
            yield " "
        elif part is node or not part.aside:
            if part.tag not in INLINE:
                stack.append(" ")
            stack.extend(reversed(part.parts))
            if part.tag not in INLINE:
                stack.append(" ")


def main_text(html: str | None, path_share: float = 0.5) -> str:
    if not html:
        return ""
    # references are decoded after markup is read, so that they never make a tag
    return " ".join(unescape("".join(_texts(centre(tree(html), path_share)))).split())


def extract(pages: DataFrame, path_share: float = 0.5) -> DataFrame:
    """page_id, url, text and n_chars for every page; no shuffle."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(h, path_share) for h in part.column(2).to_pylist()]
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    given = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = given.schema["page_id"].dataType.simpleString()
    return given.mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")
