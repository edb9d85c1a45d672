"""HTML main-text extraction by composite text density.

Every DOM node gets a density: characters per tag, adjusted for links. A page's main text is where
children's densities add up: the node with the largest sum of its children's densities is sought, and the
smallest density on the path from body to that node is the threshold. Of every node at or above it the
subtree with the largest sum is kept, all else is cut. Parts that are never article text (menus, form controls, scripts, comments and the like) are taken
out first by element name or by whole names of class, id and role, the latter not if they hold the page's text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements without end tag, with raw content, that break a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that an opening block ends inside a paragraph, and siblings that end each other.
CLOSES_P = BLOCK - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: Elements, and whole names of class, id or role, that mark what is not article text.
DROP = frozenset(
    "script style noscript template head title nav footer aside button input select textarea option iframe object embed "
    "svg canvas audio video map menu dialog".split()
)
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices popup modal newsletter subscribe "
    "comment comments disqus replies reply respond share sharing social related recommended pagination pager login signup search toolbar widget "
    "complementary contentinfo search".split()
)
_KEEP = frozenset("html body main article".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>\x00]*)", re.S)
#: In a tag, its end, or a value: the quote that opens it, or all of it if it has none.
_PART = re.compile(r">|=\s*+(?:([\"'])|[^\s>]++)")
_ATTRIBUTE = re.compile(r"([^\s/=]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s]++))?")
#: Reasons to leave out a node: its element or hiddenness, or only its name.
BY_TAG, BY_NAME = 1, 2


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "chars", "tags", "link_chars", "link_tags", "density", "total", "blocks", "best")

    def __init__(self, tag: str, parent: Node | None, dropped: int):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.children: list[Node | str] = []


def _unwanted(tag: str, attributes: str, in_article: bool) -> int:
    if tag in DROP or (tag == "header" and not in_article):
        return BY_TAG
    if not attributes or tag in _KEEP:
        return 0
    found = 0
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name not in ("class", "id", "role", "hidden", "aria-hidden"):
            continue
        if name in ("hidden", "aria-hidden"):
            if value != "false" and (name == "hidden" or value == "true"):
                return BY_TAG
        elif not DROP_WORDS.isdisjoint(value.split()):
            found = BY_NAME
    return found


def _tag_end(page: str, at: int, failed: set[int]) -> int:
    """Where the tag's `>` is, outside of quoted values of any length; where there is none, the first `>`.

    failed: opening quotes after which no end comes. What follows a quote depends on its place alone, so
    each is tried once and a page of broken quotes costs linear time.
    """
    tried, i = [], at
    while m := _PART.search(page, i):
        if m.group() == ">":
            return m.start()
        i = m.end()
        if m.group(1):
            if i in failed:
                break
            tried.append(i)
            i = page.find(m.group(1), i) + 1
            if not i:
                break
    failed.update(tried)
    return page.find(">", at)


def parse(page: str) -> Node:
    """A tree from a page however broken: implied ends, missing ends and stray ends are mended."""
    root = Node("html", None, 0)
    body = Node("body", root, 0)
    root.children.append(body)
    node, at, opened, names = body, 0, [body], Counter()
    last = page.rfind(">")  # no tag ends after it
    inside = 0  # open article and main elements
    failed: set[int] = set()

    def close(depth: int) -> Node:
        nonlocal inside
        for n in opened[depth:]:
            names[n.tag] -= 1
            inside -= n.tag in ("article", "main")
        del opened[depth:]
        return opened[-1]

    while at <= last and (m := _TOKEN.search(page, at)) and m.start() <= last:
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at, tag = m.end(), m.group(2)
        if tag is None:
            continue
        stop = _tag_end(page, at, failed)
        attributes, at = page[at:stop], stop + 1
        tag = tag.lower()
        if m.group(1):  # an end tag: closes the nearest open element of that name
            if names[tag] > 0:
                depth = next(d for d in range(len(opened) - 1, 0, -1) if opened[d].tag == tag)
                node = close(depth)
            continue
        if tag in ("html", "body"):
            continue
        ends, scope = SIBLINGS.get(tag, ()), _SCOPE.get(tag, ())
        if (tag in CLOSES_P and names["p"] > 0) or any(names[x] > 0 for x in ends):
            for depth in range(len(opened) - 1, 0, -1):
                name = opened[depth].tag
                if name in scope:
                    break
                if name in ends or (tag in CLOSES_P and name == "p"):
                    node = close(depth)
                    if name not in ends:
                        break
                elif name in BLOCK:
                    break
        child = Node(tag, node, _unwanted(tag, attributes, inside > 0))
        node.children.append(child)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            stop = end.start() if end else len(page)
            child.children.append(page[at:stop])
            at = len(page) if not end else page.find(">", stop) + 1 or len(page)
        elif tag not in VOID and not attributes.endswith("/"):
            opened.append(child)
            names[tag] += 1
            inside += tag in ("article", "main")
            node = child
    if at < len(page):
        node.children.append(page[at:])
    return root


def _walk(node: Node, most: int = 0):
    """Children before parents, without recursion; most: the reason that is not heeded."""
    stack = [(node, False)]
    while stack:
        n, seen = stack.pop()
        if seen:
            yield n
        else:
            stack.append((n, True))
            stack += [(c, False) for c in n.children if not isinstance(c, str) and (not c.dropped or c.dropped == most)]


def _restore(body: Node) -> None:
    """A node left out by its name alone comes back if less than a fifth of the page's text is outside of it."""
    named = []
    for n in _walk(body, BY_NAME):
        n.chars = sum(len(c.strip()) if isinstance(c, str) else c.chars for c in n.children if isinstance(c, str) or c.dropped != BY_TAG)
        if n.dropped:
            named.append(n)
    for n in named:
        if 5 * n.chars > 4 * body.chars:
            n.dropped = 0


def measure(root: Node) -> Node:
    """Fills in densities; returns body."""
    body = root.children[0]
    _restore(body)
    for n in _walk(body):
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        for c in n.children:
            if isinstance(c, str):
                n.chars += len(c.strip())
            elif not c.dropped:
                n.chars += c.chars
                n.tags += c.tags + 1
                n.link_chars += c.link_chars
                n.link_tags += c.link_tags
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1
    for n in _walk(body):
        n.density = _density(n.chars, n.tags, n.link_chars, n.link_tags, body)
        kids = [k for k in n.children if not isinstance(k, str) and not k.dropped]
        n.total = sum(k.density for k in kids)
        n.blocks = any(k.blocks or k.tag in BLOCK for k in kids)
        n.best = n
        for k in kids:  # a block of text is neither divided nor, for its words in bold, preferred to its neighbours
            if k.best.blocks and k.best.total > n.best.total:
                n.best = k.best
    return body


def _density(c: int, t: int, lc: int, lt: int, body: Node) -> float:
    """Composite text density of c characters and t tags, lc and lt of them in links."""
    if not c:
        return 0.0
    ratio, t, lc, lt = body.link_chars / max(body.chars, 1), max(t, 1), max(lc, 1), max(lt, 1)
    base = math.log(c * lc / max(c - lc, 1) + ratio * c + math.e)  # 1 where the page has no link text: then the plain logarithm
    x = math.log(c / lc * t / lt)
    return c / t * (x / math.log(base) if base > 1 + 1e-9 else x)


def main_node(body: Node) -> tuple[Node, float]:
    """The node with the largest density sum (the outermost, then the first), and the threshold on its path."""
    best = body.best
    threshold, n = best.density, best
    while n is not None and n is not body.parent:
        threshold, n = min(threshold, n.density), n.parent
    return best, threshold


def _blocks(node: Node | str) -> list[str]:
    """The texts of the blocks under node in page order, white space collapsed."""
    out, now = [], []

    def end() -> None:
        if now:
            text = " ".join(html.unescape("".join(now)).split())
            if text:
                out.append(text)
            now.clear()

    stack: list = [node]
    while stack:
        n = stack.pop()
        if n is None:
            end()
        elif isinstance(n, str):
            now.append(n)
        elif not n.dropped:
            if n.tag == "br":
                now.append("\n")
            if n.tag in BLOCK:
                end()
                stack.append(None)
            stack.extend(reversed(n.children))
    end()
    return out


def _marked(body: Node, threshold: float) -> list[Node | str]:
    """In page order: of each node at or above the threshold the subtree with the largest density sum, and
    text at or above it that lies beside blocks."""
    chosen, stack = set(), [body]
    while stack:
        n = stack.pop()
        if n.density >= threshold and n.density > 0:
            chosen.add(id(n.best))
        if n.blocks:
            stack += [c for c in n.children if not isinstance(c, str) and not c.dropped]
    found: list[Node | str] = []
    todo: list[Node | str] = [body]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            if n.strip() and _density(len(n.strip()), 0, 0, 0, body) >= threshold:
                found.append(n)
        elif id(n) in chosen:
            found.append(n)
        elif n.blocks:
            todo += [c for c in reversed(n.children) if isinstance(c, str) or not c.dropped]
    return found


def main_text(page: str | None) -> str:
    """The article's blocks joined by an empty line; empty for null, empty and text-free pages.

    The densities decide on every page, whatever its tags are called.
    """
    if not page:
        return ""
    body = measure(parse(page))
    own = [b for p in _marked(body, main_node(body)[1]) for b in _blocks(p)]
    return "\n\n".join(own or _blocks(body))


def main_text_column(page: Column) -> Column:
    """main_text of each page, in Arrow batches."""

    @F.arrow_udf("string")
    def run(pages):
        import pyarrow as pa

        return pa.array([main_text(p) for p in pages.to_pylist()], pa.string())

    return run(page)


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """pages with column `out`; rows, order and other columns as they were, `out` must not exist.

    Null and empty pages give an empty text; pages of any length and nesting are read whole.
    """
    if out in pages.columns:
        raise ValueError(f"column {out} exists")
    return pages.withColumn(out, main_text_column(F.col(html_col)))
