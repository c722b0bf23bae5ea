"""Main text of web pages by scoring the tree of their blocks.

A page is read into a tree of block elements; inline elements only add to the
text of the block they stand in. Elements that never hold the article
(scripts, menus, ...) are left out; so are forms and elements whose class or
id is a name of furniture (adverts, sidebars, comments, ...), unless most of
the page's paragraph points stand in them. Furniture is read by the same rules
for tags left open as the rest. Every paragraph
passes points for its length and commas to its ancestors, halved and then
thinned with distance; an ancestor's points are discounted by the share of
its text inside links. The best container is kept with its siblings that
score enough or are plain paragraphs.

As in browsers, an element nested deeper than ``DEEPEST`` becomes its parent's
sibling, so the work per page stays in proportion to its length.

Per-row work on whole pages in one narrow pass; nothing is shuffled.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import batch, table

# Names of HTML elements and of usual class names.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
LEFT_OUT = {"head", "nav", "footer", "aside", "button", "select", "dialog", "menu", "svg", "math", "object", "canvas",
            "audio", "video", "datalist"}
UNLESS_MAIN = {"form", "fieldset"}  # left out, as furniture by class is, unless most of the page stands in it
BLOCK = {"html", "body", "address", "article", "blockquote", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure",
         "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "li", "main", "ol", "p", "pre", "section", "summary", "table",
         "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption"} | LEFT_OUT | UNLESS_MAIN
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"},
         "tbody": {"table"}, "tfoot": {"table"}}
_WORDS = (r"(?:ads?|adverts?|advertisement|banner|sponsor(?:ed)?|promo|popup|modal|overlay|cookies?|consent|gdpr|notice|alert|"
          r"newsletter|subscribe|signup|login|paywall|sidebar|menu|nav(?:bar|igation)?|breadcrumbs?|pagination|pager|footer|masthead|"
          r"topbar|toolbar|share|sharing|social|related|recommend(?:ed|ations)?|comments?|disqus|replies|respond|widget|tags?|"
          r"skip|search|hidden|sr-only|site-header|page-header)")
# Words that stand beside them in names of furniture: its place, its kind, whose it is.
_BESIDE = (r"(?:area|articles|bar|block|bottom|box|buttons?|container|desktop|field|fixed|form|global|icons|inner|items|left|links|list|main|"
           r"mobile|outer|page|panel|posts|primary|reader|right|row|secondary|section|site|slot|sticky|stories|thread|top|unit|user|wrap|wrapper|zone)")
# A whole class name or id of such words, at least one of them of furniture.
FURNITURE = re.compile(rf"(?<!\S)(?:{_BESIDE}[_-])*{_WORDS}(?:[_-](?:{_WORDS}|{_BESIDE}))*(?!\S)", re.I)
ROLE_OUT = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu"}
LIKELY = re.compile(r"article|content|main|post|entry|story|text|body", re.I)
TAG_POINTS = {"article": 25, "main": 15, "section": 3, "div": 5, "td": 3, "blockquote": 3, "pre": 3, "ol": -3, "ul": -3, "dl": -3}
TEXT_BLOCK = {"p", "pre", "blockquote", "li", "dd", "dt", "td", "th", "figcaption", "address", "caption",
              "h1", "h2", "h3", "h4", "h5", "h6", "summary"}

DEEPEST = 512
SENTENCE = 60  # characters from which a run of text is no menu entry

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<(?=[^a-zA-Z/!?])|<$|</[^>]*>?|[^<]+|<",
                   re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "parts", "depth", "points", "scored", "chars", "linked", "out", "open")

    def __init__(self, tag: str, parent: Node | None, points: float = 0.0):
        self.tag, self.parent, self.points = tag, parent, points
        self.depth = parent.depth + 1 if parent else 0
        self.parts: list = []  # child nodes, and [text, linked text] runs between them
        self.scored = False
        self.out = 0  # 1: left out unless most of the page stands in it, 2: left out
        self.open = 1  # of an inline element that is left out: elements of its name open in it
        self.chars = self.linked = 0


def _left_out(tag: str, attributes: str, node: Node) -> tuple[int, float]:
    """(how it is left out, as ``Node.out``; extra points) of an opened element."""
    if tag in LEFT_OUT:
        return 2, 0
    if tag == "header":  # the page's, unless it stands in an article-like container
        inside = node
        while inside is not None and inside.points < 10:
            inside = inside.parent
        if inside is None:
            return 2, 0
    out, extra = int(tag in UNLESS_MAIN), 0.0
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return 2, 0
            if name == "role" and value.lower() in ROLE_OUT:
                return 2, 0
            if name == "role" and value.lower() == "form":
                out = 1
            if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
                if FURNITURE.search(value):
                    out = 1
                if LIKELY.search(value):
                    extra = 10.0
    return out, extra


def parse(html: str) -> Node:
    """The tree of blocks, furniture marked. Unclosed and stray tags are mended as browsers do."""
    root = node = Node("html", None)
    link = False
    at, end = 0, len(html)
    match = TOKEN.match
    while at < end:
        m = match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[0] != "<" or len(text) == 1:
                if "&" in text:
                    text = unescape(text)
                if not node.parts or type(node.parts[-1]) is Node:
                    node.parts.append([[], 0])
                run = node.parts[-1]
                run[0].append(text)
                if link:
                    run[1] += len(text.strip())
            continue
        tag = tag.lower()
        closing = m[1]
        if not closing and tag in RAW:
            found = re.compile(rf"</{tag}(?=[\s/>]|$)[^>]*>?", re.I).search(html, at)
            at = found.end() if found else end
            continue
        if tag == "a":
            link = not closing
            continue
        if closing:
            if tag in ("body", "html"):  # ends all furniture left open
                up = node
                while up is not None:
                    if up.out:
                        node, link = up.parent, False
                    up = up.parent
            elif tag in BLOCK:
                up = node
                while up is not None and up.tag != tag:
                    up = up.parent
                if up is not None and up.parent is not None:
                    node = up.parent
                    link = False
            elif tag == node.tag:
                node.open -= 1
                if not node.open:
                    node, link = node.parent, False
            continue
        if tag in VOID:
            if tag in ("br", "hr") and node.parts and type(node.parts[-1]) is list:
                node.parts[-1][0].append(" ")
            continue
        block = tag in BLOCK and tag not in ("html", "body")
        if node.tag == "head" and (block or tag == "body"):
            node = node.parent
        out, extra = _left_out(tag, m[3], node)
        if tag in ("html", "body") or not block and not out:
            if tag == node.tag and not m[3].endswith("/"):
                node.open += 1
            continue
        if block:
            link = False
            up = node
            while up is not None and up.tag not in BLOCK:
                up = up.parent
            if up is not None and up.tag == "p":  # a block ends an open paragraph
                while up is not None and up.tag == "p":
                    up = up.parent
                node = up or root
        if tag in CLOSED_BY:
            up = node
            while up is not None and up.tag not in HOLDS[tag]:
                if up.tag in CLOSED_BY[tag]:
                    node = up.parent
                up = up.parent
        if node.depth >= DEEPEST:
            node = node.parent
        new = Node(tag, node, TAG_POINTS.get(tag, 0) + extra)
        new.out = out
        node.parts.append(new)
        if not m[3].endswith("/"):
            node = new
    return root


def _points(own: str) -> float:
    return min(1.0, len(own) / 25) + own.count(",") + min(len(own) / 100, 3)


def _clean(root: Node) -> None:
    """Take furniture out of the tree; of ``out`` 1 what holds most of the paragraph points left stays."""
    order, stack, doubt = [], [root], False
    while stack:
        n = stack.pop()
        order.append(n)
        doubt = doubt or n.out == 1
        stack += [c for c in n.parts if type(c) is Node and c.out < 2]
    if doubt:
        held, total = {}, 0.0
        for n in order:
            held[n] = 0.0
            for run in n.parts:
                if type(run) is list and (own := _text(run[0])):
                    held[n] += _points(own) * (1 - min(run[1], len(own)) / len(own))
            total += held[n]
        for n in reversed(order):  # children before parents
            if n.out == 1:
                n.out = 0 if held[n] > total / 2 else 1
            if n.out:
                total -= held[n]
            elif n.parent is not None:
                held[n.parent] += held[n]
    for n in order:
        parts: list = []
        for x in n.parts:
            if type(x) is Node:
                if not x.out:
                    parts.append(x)
            elif parts and type(parts[-1]) is list:  # text on both sides of furniture
                parts[-1][0] += x[0]
                parts[-1][1] += x[1]
            else:
                parts.append(x)
        n.parts = parts


def _text(parts: list) -> str:
    return SPACE.sub(" ", "".join(parts)).strip()


def _score(root: Node) -> list[Node]:
    """Pass paragraph points up; the nodes that got any, in page order of their first paragraph."""
    scored: list[Node] = []
    order: list[Node] = []
    stack = [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [c for c in n.parts if type(c) is Node]
    for n in reversed(order):  # children before parents
        for run in n.parts:
            if type(run) is Node:
                n.chars += run.chars
                n.linked += run.linked
            else:
                run[0] = _text(run[0])
                n.chars += len(run[0])
                n.linked += min(run[1], len(run[0]))
    for n in order:
        for run in n.parts:
            if type(run) is Node or not run[0]:
                continue
            own = run[0]
            points = _points(own)
            up, level = (n.parent or n, 0) if n.tag in TEXT_BLOCK else (n, 0)
            while up is not None:
                if not up.scored:
                    up.scored = True
                    scored.append(up)
                up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                up, level = up.parent, level + 1
    return scored


def _value(n: Node) -> float:
    return n.points * (1 - n.linked / n.chars) if n.chars else 0.0


def _blocks(n: Node, out: list[str]) -> None:
    stack = [n]
    while stack:
        x = stack.pop()
        if type(x) is Node:
            stack += reversed(x.parts)
        elif x[0]:
            out.append(x[0])


def _without_menus(n: Node) -> Node:
    """``n`` without lists of links that stand before its first sentence.

    Such a list has two items or more, nearly all of its text in links, and
    no item as long as a line of text; a list further on belongs to the article.
    """
    stack = [n]
    while stack:
        x = stack.pop()
        if type(x) is not Node:
            if len(x[0]) >= SENTENCE and x[1] < len(x[0]) / 2:
                break
            continue
        if x.tag in ("ul", "ol") and x.chars and x.linked >= 0.9 * x.chars:
            items = [c for c in x.parts if type(c) is Node and c.tag == "li"]
            if len(items) > 1 and max(c.chars for c in items) < SENTENCE:
                x.parts = []
                continue
        stack += reversed(x.parts)
    return n


def main_text(html: str | None) -> str:
    """The article's blocks in page order, joined by an empty line; empty if there is none."""
    root = parse(html or "")
    _clean(root)
    scored = _score(root)
    if not scored:
        return ""
    top = max(scored, key=_value)
    keep = [top]
    if top.parent is not None:
        keep = []
        for s in top.parent.parts:
            if s is top:
                keep.append(s)
            elif type(s) is Node and s.chars:
                density = s.linked / s.chars
                if s.scored and _value(s) >= max(10.0, 0.2 * _value(top)) or s.tag in ("p", "h1", "h2", "h3", "pre", "blockquote") and density < 0.25:
                    keep.append(s)
    out: list[str] = []
    for n in keep:
        _blocks(_without_menus(n), out)
    return "\n\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row.

    Null html is empty; pages without text give an empty text; pages of any
    length are read whole. Of containers with equal points the first in page
    order is the article. Repeated rows come out alike, null ids pass through.
    An empty table gives an empty result. Columns but page_id, url and html
    are not read.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = [main_text(x.as_py()) for x in part.column("html")]
                yield batch(schema, [part.column("page_id"), part.column("url"), texts, [len(t) for t in texts]])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
