"""Main text of web pages by scoring the element tree.

Each paragraph (p, pre, td, and div without block elements inside) with enough text has
1 point, 1 for each comma, and 1 for each 100 characters up to 3.  Its parent gets all of
them, its grandparent half, the ancestor n levels above the parent a 3n-th.  A container's
points are multiplied by 1 - link density (the share of its text that lies in links).  The
best container is kept, with those of its siblings that have a fifth of its points, or are
long paragraphs with few links.  Scripts, styles and markup comments never count.

Navigation, headers, footers, asides and elements of which a whole class, id or role is a word
of ``UNLIKELY`` are left out, unless such an element holds two paragraphs at least and
most of the text of the page's paragraphs, and less than half of its own text lies in links: then it is scored like any
other.  Readers' comments and related pages often outgrow the article; they come back only
if no other paragraph is left.

The parser makes one pass with a regular expression over the tags: unclosed and crossing
elements are repaired as browsers do for the common cases (an open paragraph ends where a
block begins; an end tag without its start is dropped; beyond ``DEPTH`` open elements a new one
takes the place of the innermost).  Texts are pieces of one list, of which an element is an
interval, so that time is linear in the page's length however deep it is nested.

Defined cases: null, empty and unparseable pages have an empty text and score 0; a page
without any scored paragraph keeps the text of its body; ties go to the first container;
every row has one result row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_PARAGRAPH, SIBLING_SHARE, LONG_PARAGRAPH, FEW_LINKS = 25, 0.2, 80, 0.25
ATTRIBUTES = r"((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg)\b" + ATTRIBUTES + r".*?(?:</\1\s*+>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)" + ATTRIBUTES + r"|<[!?][^<>]*+>", re.S | re.I)
TITLE, TITLE_END = re.compile(r"<title\b[^<>]*+>", re.I), re.compile(r"</title\s*+>", re.I)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
UNLIKELY = re.compile(r"(?<!\S)(?:ad|ads|advert|banner|breadcrumbs?|comments?|cookie|footer|header|menu|nav|navigation|promo|related|share|sidebar|social|sponsor)(?!\S)", re.I)
BESIDE = re.compile(r"(?<!\S)(?:comments?|related|share|social)(?!\S)", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
SKIP = frozenset("nav footer aside button select head title header menu".split())
BASE = {"div": 5, "article": 10, "main": 10, "section": 3, "blockquote": 3, "pre": 3, "td": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "li": -3, "th": -5, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5}
CLOSES = {"li": ("li", ("ul", "ol")), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table")), "dt": ("dd", ("dl",)), "dd": ("dt", ("dl",)), "option": ("option", ("select",))}
NEVER = frozenset("button select head title".split())
DEPTH = 512
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("begin", "beside", "blocks", "end", "items", "links", "parent", "points", "skip", "tag")

    def __init__(self, tag: str, parent: "Node | None", skip: bool):
        self.tag, self.parent, self.skip = tag, parent, skip
        self.items: list = []
        self.points: float | None = None
        self.blocks = self.beside = False


def plain(text: str) -> str:
    """Character references resolved; those with a number of thousands of digits stay as they are."""
    if "&" not in text:
        return text
    try:
        return unescape(text)
    except ValueError:
        return text


def parse(html: str) -> Node:
    root = Node("#root", None, False)
    at, open_ = 0, [root]
    there: dict[str, int] = {}  # open elements by tag

    def close(k: int) -> None:
        for n in open_[k:]:
            there[n.tag] -= 1
        del open_[k:]

    for m in TAG.finditer(html):
        if m.start() > at:
            open_[-1].items.append(html[at : m.start()])
        at = m.end()
        name = m.group(4)
        if not name:
            continue
        name = name.lower()
        if m.group(3):
            if there.get(name):
                close(next(k for k in range(len(open_) - 1, 0, -1) if open_[k].tag == name))
            continue
        if name in BLOCK and there.get("p"):
            for k in range(len(open_) - 1, 0, -1):  # a block ends an open paragraph
                if open_[k].tag == "p":
                    close(k)
                    break
                if open_[k].tag in ("td", "th", "div", "article", "section", "li", "body"):
                    break
        if name in CLOSES:
            ends, stop = CLOSES[name]
            if there.get(ends) or there.get(name):
                for k in range(len(open_) - 1, 0, -1):
                    if open_[k].tag in (ends, name):
                        close(k)
                        break
                    if open_[k].tag in stop:
                        break
        if len(open_) > DEPTH:
            close(DEPTH)
        top, said = open_[-1], m.group(5)
        words = "" if not said else " ".join(a or b or c or "" for a, b, c in ATTRIBUTE.findall(said))
        node = Node(name, top, name in SKIP or (name not in ("body", "html", "article", "main") and bool(UNLIKELY.search(words))))
        node.beside = node.skip and bool(BESIDE.search(words))
        top.items.append(node)
        if name in BLOCK:
            top.blocks = True
        if name not in VOID and not (said or "").endswith("/"):
            open_.append(node)
            there[name] = there.get(name, 0) + 1
    if at < len(html):
        open_[-1].items.append(html[at:])
    return root


class Text:
    """The text of a page as pieces, of which every element is an interval, with running sums over the pieces."""

    def __init__(self, root: Node):
        self.pieces: list[str] = []
        self.order: list[Node] = []  # children first
        todo: list = [(root, iter(root.items))]
        root.begin, pieces = 0, self.pieces
        while todo:
            node, items = todo[-1]
            for x in items:
                if isinstance(x, str):
                    pieces.append(plain(x))
                elif not x.skip:
                    if x.tag in BLOCK or x.tag == "br":
                        pieces.append("\n")
                    x.begin = len(pieces)
                    todo.append((x, iter(x.items)))
                    break
            else:
                todo.pop()
                node.end = len(pieces)
                self.order.append(node)
                if node.tag in BLOCK or node.tag == "br":
                    pieces.append("\n")
        # characters that aren't spaces, words that begin, commas before each piece; the next piece that isn't empty
        n = len(pieces)
        self.solid, self.words, self.commas, self.joins = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        open_word = False
        for i, p in enumerate(pieces):
            parts = p.split()
            joins = open_word and bool(p) and not p[0].isspace()
            self.solid[i + 1] = self.solid[i] + sum(map(len, parts))
            self.words[i + 1] = self.words[i] + len(parts) - joins
            self.commas[i + 1] = self.commas[i] + p.count(",")
            self.joins[i] = joins
            if p:
                open_word = not p[-1].isspace()
        for i in range(n - 1, -1, -1):  # an empty piece hands on to the next
            if not pieces[i]:
                self.joins[i] = self.joins[i + 1]
        for node in self.order:
            node.links = self.size(node) if node.tag == "a" else sum([x.links for x in node.items if x.__class__ is Node and not x.skip])

    def size(self, node: Node) -> int:
        """Length of the text with runs of space as one and none at its ends."""
        a, b = node.begin, node.end
        solid = self.solid[b] - self.solid[a]
        return solid + self.words[b] - self.words[a] + (self.joins[a] and b > a) - 1 if solid else 0

    def count(self, node: Node) -> int:
        a, b = node.begin, node.end
        return self.commas[b] - self.commas[a]

    def of(self, node: Node) -> str:
        a, b = node.begin, node.end
        return "".join(self.pieces[a:b])

    def density(self, node: Node) -> float:
        size = self.size(node)
        return min(1.0, node.links / size) if size else 0.0


def restore(root: Node) -> None:
    """Elements that would be left out, but hold most of the page's paragraphs, are scored after all."""
    order = [root]
    for n in order:
        order.extend(x for x in n.items if isinstance(x, Node) and x.tag not in NEVER)
    if not any(n.skip for n in order):
        return
    # text, text in links, text in paragraphs, paragraphs of each element
    sizes: dict[int, tuple[int, int, int, int]] = {}
    for n in reversed(order):
        size = links = inner = count = 0
        for x in n.items:
            if isinstance(x, str):
                size += len(SPACE.sub(" ", x).strip())
            elif id(x) in sizes:
                a, b, c, d = sizes[id(x)]
                size, links, inner, count = size + a, links + b, inner + c, count + d
        own = (n.tag in ("p", "pre", "td") or (n.tag == "div" and not n.blocks)) and size >= MIN_PARAGRAPH
        sizes[id(n)] = size, size if n.tag == "a" else links, size if own else inner, 1 if own else count
    whole, stack = sizes[id(root)][2], [root]
    while stack:
        n = stack.pop()
        size, links, inner, count = sizes[id(n)]
        if n.skip and count > 1 and 2 * inner > whole and 2 * links < size and (not n.beside or inner == whole):
            n.skip = False
        if not n.skip:
            stack.extend(x for x in n.items if isinstance(x, Node) and id(x) in sizes)


def tidy(text: str) -> str:
    return "\n".join(x for x in (SPACE.sub(" ", line).strip() for line in text.split("\n")) if x)


def extract(html: str | None) -> tuple[str, str, float, int]:
    """(title, text, score, paragraphs) of a page."""
    if not html:
        return "", "", 0.0, 0
    found = TITLE.search(html)
    end = found and TITLE_END.search(html, found.end())
    title = SPACE.sub(" ", plain(html[found.end() : end.start()])).strip() if end else ""
    root = parse(html)
    restore(root)
    text = Text(root)
    touched: list[Node] = []
    paragraphs = 0
    for n in text.order:
        if n.tag not in ("p", "pre", "td") and not (n.tag == "div" and not n.blocks):
            continue
        size = text.size(n)
        if size < MIN_PARAGRAPH:
            continue
        paragraphs += 1
        points = 1 + text.count(n) + min(size / 100, 3)
        up, level = n.parent, 0
        while up is not None and up.tag not in ("#root", "html"):
            if up.points is None:
                up.points = BASE.get(up.tag, 0)
                touched.append(up)
            up.points += points if level == 0 else points / 2 if level == 1 else points / (3 * level)
            up, level = up.parent, level + 1
    best, top = None, 0.0
    for n in touched:
        n.points = n.points * (1 - text.density(n))
        if n.points > top:
            best, top = n, n.points
    if best is None:
        body = next((n for n in text.order if n.tag == "body"), root)
        return title, tidy(text.of(body)), 0.0, paragraphs
    kept = []
    for x in best.parent.items if best.parent is not None else [best]:
        if not isinstance(x, Node) or x.skip:
            continue
        if x is best or (x.points is not None and x.points >= max(10.0, SIBLING_SHARE * top)) or (x.tag == "p" and text.size(x) > LONG_PARAGRAPH and text.density(x) < FEW_LINKS):
            kept.append(text.of(x))
    return title, tidy("\n".join(kept)), top, paragraphs


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, title, text, score, n_paragraphs), a row for each page."""
    common.prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [extract(x.as_py()) for x in b.column(2)]
            title, text, score, n = (list(x) for x in zip(*rows)) if rows else ([], [], [], [])
            yield common.batch(page_id=b.column(0), url=b.column(1), title=pa.array(title, pa.string()), text=pa.array(text, pa.string()), score=pa.array(score, pa.float64()), n_paragraphs=pa.array(n, pa.int32()))

    slim = pages.select(F.col(f"`{page_id}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    return slim.mapInArrow(common.lean(run), "page_id bigint, url string, title string, text string, score double, n_paragraphs int")
