"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Each paragraph-like block passes points, for its length and its commas, to its parent
and half of them to its grandparent; containers' own tags and names add or take points; the sum is discounted by link
density. The best container is kept, with siblings that score like it. Elements that are never part of an article
(menus, headers, footers, side bars, notices, adverts, forms, scripts, comments) are taken out of the tree first; where
only a name tells so, or a form, an element that holds much of the page's text stays and loses points instead.
Parsing takes time in proportion to the page, whatever is left open or closed in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from rankspark.llm.common import require, with_fields

#: Element names by how the parser and the scorer treat them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
GONE = frozenset("head nav header footer aside form button select dialog menu object canvas audio video".split()) | RAW
CLOSED_BY_BLOCK = BLOCKS - frozenset("html body option".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd div section article main body figcaption h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
BAD_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations widget widgets pagination pager skip toolbar".split())
GOOD_NAMES = frozenset("article content main body post entry text story page blog".split())
#: Words that make a compound name say how a page looks or what is switched on, not what an element is for.
STATES = frozenset("with without no not has have is are open opened opens closed enabled disabled allowed on off active inactive visible shown show fixed sticky layout collapsed expanded ready count js".split())
#: Words that leave a compound name's role as it is.
NEUTRAL = frozenset("list item items box block section area wrapper wrap container inner outer bar left right top bottom main primary secondary site global page links link button buttons form panel row group thread".split())
TAG_POINTS = {"article": 25.0, "main": 20.0, "section": 3.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "table": -2.0, "body": 0.0, "html": -5.0}
BAD_POINTS = 25.0
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

#: A tag whose quoted values are closed; a tag that ends at the next `>`, for pages on which a quote is left open.
STRICT = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)>")
LENIENT = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
HIDDEN = re.compile(r"\shidden(?=[\s/=]|\Z)|style\s*=\s*[\"'][^\"']*display\s*:\s*none", re.I)
LEAST_PARAGRAPH = 25
#: An element with a doubtful name stays if it holds more than this share of the page's text outside links; one whose
#: name leaves no doubt stays only with more than the second share.
DOUBTFUL, CERTAIN = 0.5, 0.9


class Node:
    """An element: its name, what its class and id say, and what it holds; `near`: open elements that a tag may end."""

    __slots__ = ("bad", "children", "good", "links", "near", "parent", "points", "role", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent = tag, parent
        self.good, self.bad, self.role = _roles(attributes) if "=" in attributes or "hidden" in attributes else (False, 0, "")
        self.children: list[Node | str] = []
        self.points, self.size, self.links = 0.0, 0, 0
        self.near: dict[str, Node | None] = _near(parent.near if parent else {}, tag, self)


def _words(name: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower()) if w]


def _roles(attributes: str) -> tuple[bool, int, str]:
    """(a name of an article's parts, 2 for a name that is no part of an article, 1 for one that may be none, role)."""
    good, bad, role = False, 1 if HIDDEN.search(attributes) else 0, ""
    for m in NAMES.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            role = value.strip().lower()
            continue
        for name in value.split():
            words = _words(name)
            good |= any(w in GOOD_NAMES for w in words)
            if not words or any(w in STATES for w in words):
                continue
            rest = [w for w in words if w not in NEUTRAL and not w.isdigit()]
            if rest and all(w in BAD_NAMES for w in rest):
                bad = 2
            elif words[0] in BAD_NAMES or words[-1] in BAD_NAMES:
                bad = max(bad, 1)
    return good, bad, role


#: Which open element a tag ends, and the elements that bound the look for it.
_ENDS = {"p": "p", "a": "a", "li": "li", "dd": "dd", "dt": "dd", "option": "option", "td": "cell", "th": "cell", "tr": "row", "tbody": "rows", "thead": "rows", "tfoot": "rows"}
_LISTS = frozenset("ul ol dl select menu".split())


def _near(near: dict, tag: str, node: Node) -> dict:
    """Open elements by kind, as seen from inside a new element."""
    kind = _ENDS.get(tag)
    if kind is None and tag not in BLOCKS and tag != "select":
        return near
    now = dict(near)
    if tag in BLOCKS:
        now["p"] = now["a"] = None
    if tag in _LISTS:
        now["li"] = now["dd"] = now["option"] = None
    if tag == "table":
        now["cell"] = now["row"] = now["rows"] = None
    if kind == "rows":
        now["row"] = now["cell"] = None
    elif kind == "row":
        now["cell"] = None
    if kind:
        now[kind] = node
    return now


class _Open:
    """The open elements: the innermost one, and how many there are of each name since the innermost article."""

    BARRIERS = frozenset("article main body".split())

    def __init__(self, root: Node):
        self.root = self.node = root
        self.counts: list[dict[str, int]] = [{}]
        self.barriers = 0

    def enter(self, child: Node) -> None:
        self.node = child
        if child.tag in self.BARRIERS:
            self.counts.append({})
        self.counts[-1][child.tag] = self.counts[-1].get(child.tag, 0) + 1

    def leave(self, upto: Node) -> None:
        """Close everything up to an open element, which is closed too."""
        while True:
            x = self.node
            if x is self.root:
                return
            self.counts[-1][x.tag] -= 1
            if x.tag in self.BARRIERS:
                self.counts.pop()
            self.node = x.parent
            if x is upto:
                return

    def end(self, *kinds: str) -> None:
        """Leave the outermost of these open elements, if there is one."""
        for kind in kinds:
            found = self.node.near.get(kind)
            if found is not None:
                self.leave(found)
                return

    def close(self, tag: str) -> None:
        """An end tag closes the innermost open element of its name; none inside the innermost article: nothing."""
        if tag in self.BARRIERS or tag == "html":
            if not any(c.get(tag) for c in self.counts):
                return
        elif not self.counts[-1].get(tag):
            return
        x = self.node
        while x.tag != tag:
            x = x.parent
        self.leave(x)


def parse(html: str) -> Node:
    """The tree of a page; tags that don't match are mended as browsers do: a block ends an open paragraph."""
    root = Node("html", None)
    open_ = _Open(root)
    text, pattern, has_body = [], STRICT, False
    at, n, last = 0, len(html), html.rfind(">")

    def flush() -> None:
        if text:
            open_.node.children.append(unescape("".join(text)))
            text.clear()

    while at < n:
        begin = html.find("<", at)
        if begin < 0 or (begin > last and not html.startswith("<!--", begin)):  # what follows has no tag that ends
            text.append(html[at:])
            break
        text.append(html[at:begin])
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 4)
            at = end + 3 if end >= 0 else n
            continue
        if html.startswith("<![CDATA[", begin):
            end = html.find("]]>", begin)
            text.append(html[begin + 9 : end if end >= 0 else n])
            at = end + 3 if end >= 0 else n
            continue
        if html[begin + 1] in "!?":
            at = html.find(">", begin) + 1
            continue
        m = pattern.match(html, begin)
        if m is None and pattern is STRICT and LENIENT.match(html, begin):
            pattern = LENIENT  # a quote is left open: from here on it ends nowhere
            m = pattern.match(html, begin)
        if m is None:
            text.append("<")
            at = begin + 1
            continue
        flush()
        at = m.end()
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            open_.close(tag)
            continue
        if tag == "html":
            continue
        closed = attributes.rstrip().endswith("/")
        if tag in RAW:
            if not closed:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = end.end() if end else n
            continue
        if tag in CLOSED_BY_BLOCK:
            open_.end("p")
        if tag in ("li", "dd", "dt", "option", "a"):
            open_.end(_ENDS[tag])
        elif tag in _ENDS and tag != "p":
            open_.end(*{"cell": ("cell",), "row": ("row", "cell"), "rows": ("rows", "row", "cell")}[_ENDS[tag]])
        elif tag == "body":
            if has_body:
                continue
            has_body = True
            open_ = _Open(root)
        child = Node(tag, open_.node, attributes)
        open_.node.children.append(child)
        if tag not in VOID and not closed:
            open_.enter(child)
    flush()
    return root


def _weigh(nodes: list[Node]) -> None:
    """Characters of text, and of text in links, of each element; nodes: parents first."""
    for x in reversed(nodes):
        x.size = x.links = 0
        for c in x.children:
            if isinstance(c, str):
                x.size += len(c)
            else:
                x.size += c.size
                x.links += c.size if c.tag == "a" else c.links


def _prune(root: Node) -> None:
    """Take out what is no part of an article. Of a header inside an article its headings stay."""
    stack = [root]
    while stack:  # by their tags alone, so that the text that is weighed next is that of the rest
        x = stack.pop()
        x.children = [c for c in x.children if isinstance(c, str) or c.tag not in GONE or c.tag in ("form", "header")]
        stack += [c for c in x.children if isinstance(c, Node)]
    _weigh(_nodes(root))
    total = max(root.size - root.links, 1)
    walk = [(root, False)]
    while walk:
        x, inside = walk.pop()
        inside = inside or x.tag in ("article", "main")
        kept: list[Node | str] = []
        for c in x.children:
            if isinstance(c, Node):
                share = (c.size - c.links) / total
                if c.tag == "header" and not inside and share <= CERTAIN:
                    continue
                if c.tag == "header" and share <= DOUBTFUL:
                    kept += _headings(c)
                    continue
                bad = 2 if c.role in ROLES else 1 if c.tag == "form" else c.bad if c.tag not in ("html", "body", "main") else 0
                if c.tag == "article" and bad and not re.search(r"comment|reply|\bad|promo|related|sponsor", c.role) and c.bad < 2:
                    bad = 0
                if bad and share <= (CERTAIN if bad == 2 else DOUBTFUL):
                    continue
                c.points -= BAD_POINTS * bool(bad)
                walk.append((c, inside))
            kept.append(c)
        x.children = kept


def _headings(node: Node) -> list[Node]:
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if x.tag in HEADINGS:
            out.append(x)
        else:
            stack += [c for c in reversed(x.children) if isinstance(c, Node)]
    return out


def _nodes(root: Node) -> list[Node]:
    """Parents before children, in page order."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack += [c for c in reversed(x.children) if isinstance(c, Node)]
    return out


def _own(node: Node) -> str:
    """Text of a block without the blocks inside it."""
    parts, stack = [], list(reversed(node.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            parts.append(c)
        elif c.tag not in BLOCKS:
            stack += reversed(c.children)
    return " ".join("".join(parts).split())


def _score(nodes: list[Node]) -> None:
    _weigh(nodes)
    for x in nodes:
        x.points += TAG_POINTS.get(x.tag, 0.0) if x.size else 0.0
        x.points += 10.0 * x.good if x.size and x.tag in TAG_POINTS else 0.0
        if x.tag in PARAGRAPHS and len(own := _own(x)) >= LEAST_PARAGRAPH:
            points = (1 + own.count(",") + min(len(own) / 100, 3)) * (1 - min(x.links / max(x.size, 1), 1))
            up = x if x.tag in ("div", "section", "article", "main", "body") else x.parent
            if up is not None:
                up.points += points
                if up.parent is not None:
                    up.parent.points += points / 2


def _value(node: Node) -> float:
    return node.points * (1 - min(node.links / max(node.size, 1), 1))


def blocks(kept: list[Node]) -> Iterator[str]:
    """Texts of blocks in page order, white space folded, empty ones left out."""
    for top in kept:
        held: list[str] = []
        stack: list[tuple[Node | str, bool]] = [(top, False)]
        while stack:
            x, leaving = stack.pop()
            if isinstance(x, str):
                held.append(x)
                continue
            if x.tag == "br":
                held.append(" ")
            if x.tag in BLOCKS and (text := " ".join("".join(held).split())):
                yield text
            if x.tag in BLOCKS:
                held = []
            if not leaving:
                stack.append((x, True))
                stack += [(c, False) for c in reversed(x.children)]
        if text := " ".join("".join(held).split()):
            yield text


def main_text(html: str | None) -> str:
    """The article of a page, blocks joined by a line feed; empty if there is none."""
    if not html:
        return ""
    root = parse(html)
    _prune(root)
    nodes = _nodes(root)
    _score(nodes)
    containers = [x for x in nodes if x.tag in TAG_POINTS and x.size]
    if not containers:
        return "\n".join(blocks([root]))
    best = max(containers, key=_value)
    kept = [best]
    if best.parent is not None:
        least = max(10.0, 0.2 * _value(best))
        kept = []
        for s in best.parent.children:
            if s is best:
                kept.append(s)
            elif isinstance(s, Node) and s.tag in TAG_POINTS and _value(s) - TAG_POINTS[s.tag] >= least:
                kept.append(s)
            elif isinstance(s, Node) and s.tag == "p" and best.tag not in ("article", "main") and (own := _own(s)) and (len(own) > 80 or own[-1] in ".!?") and s.links < 0.25 * s.size:
                kept.append(s)
            elif isinstance(s, Node) and s.tag in ("h1", "h2") and best.tag not in ("article", "main"):
                kept.append(s)
    return "\n".join(blocks(kept))


def extract(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """df with the main text of its pages. Null and empty html, and pages with no article, give an empty text.

    An empty table gives no rows; rows that repeat a page repeat its text; of containers with equal points the first one
    on the page is kept; pages are read whole, in time in proportion to their length. A column named like `out` is replaced, unless it is the html itself.
    """
    require(df, html)
    base = df.select([f"`{c}`" for c in df.columns if c.lower() != out.lower() or c == html])
    schema = with_fields(base.schema, f"`{out}` string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return base.mapInArrow(run, schema)
