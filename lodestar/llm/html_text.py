"""HTML extraction (operator 6) by composite text density (Sun, Song and Liao, 2011).

For each node of a page's tree: C characters of text, T tags, LC characters and LT tags of links below it;
its density is C / T, scaled by a logarithm that falls with the share of links in the node and
in the body. A node's sum is that of its children's densities. The threshold is the least
density on the path from the node of the largest sum to the body; below every node that reaches it, the
subtree of the largest sum is content. Pages are parsed whole, by one pass over their tags, in time in proportion
to their length; end tags that are missing are implied as browsers do for paragraphs, list items and cells: a block
closes an open paragraph, however many inline tags are open in it.

Defined results
- A null page or one without text gives an empty text. Text outside of any tag belongs to the body.
- Script, style, comments and the head are no text. Characters count without runs of white space.
- Of equal sums the first node in the page wins. Rows with a null page_id are left out. An empty table gives an empty result.
- Very long pages and deep ones are read whole, as are broken ones: see `tags` for quotes that don't close.
- Repeated rows give one result; if their pages differ, the longest text (then the last by order) counts.
- Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import common

SCHEMA = pa.schema([("page_id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64())])
NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea".split())
BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BREAKS = BLOCKS | frozenset("br li dt dd tr body".split())
LINKS = frozenset("a button select".split())
LISTS = ("ul", "ol", "dl", "table", "select")
CELLS = ("td", "th", "table")  # a paragraph isn't closed from inside of a cell in it


class Node:
    __slots__ = ("tag", "parent", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total", "best")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.parts = tag, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.best = self


def tags(page: str) -> Iterator[tuple[int, int, str, bool, bool]]:
    """(start, end, name, whether it ends an element, whether it is closed by itself) of each tag; name "" for comments and the like.

    Every step goes on from where the last one ended, so that the time is in proportion to the page however it is
    written: a quote that never closes is a character like others, and a page in which a tag runs to the
    end, as its > are all in quotes, has quotes that don't count from there on.
    """
    at, quotes = 0, {'"', "'"}
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, "", False, False
            continue
        m = NAME.match(page, start)
        if m is None:
            if page.startswith(("<!", "<?"), start):
                end = page.find(">", at)
                if end < 0:
                    return
                at = end + 1
                yield start, at, "", False, False
            continue
        k = m.end()
        while (stop := STOP.search(page, k)) is not None and stop.group() != ">":
            k = stop.end()
            if stop.group() in quotes:
                close = page.find(stop.group(), k)
                if close < 0:
                    quotes.discard(stop.group())
                else:
                    k = close + 1
        if stop is None:
            quotes.clear()
            end = page.find(">", m.end())
            if end < 0:
                return
        else:
            end = stop.start()
        at = end + 1
        moved = yield start, at, m.group(2).lower(), m.group(1) == "/", page[m.end() : end].endswith("/")
        if moved is not None:
            at = moved
            yield at, at, "", False, False


class Stack:
    """The open elements, and for each tag the places where it is open, so that no search goes through the stack."""

    def __init__(self, body: Node):
        self.nodes, self.places = [body], {}

    def last(self, *names: str) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCKS:
            self.places.setdefault("", []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        while len(self.nodes) > at:
            tag = self.nodes.pop().tag
            self.places[tag].pop()
            if tag in BLOCKS:
                self.places[""].pop()


def parse(page: str) -> tuple[Node, list[Node]]:
    """(body, all nodes in the order of the page)"""
    body = Node("body", None)
    order, stack, at = [body], Stack(body), 0

    def text(piece: str) -> None:
        piece = re.sub(r"\s+", " ", html.unescape(piece))
        parts = stack.nodes[-1].parts
        if piece and (piece != " " or parts):
            parts.append(piece)

    found = tags(page)
    for start, end, tag, ends, single in found:
        if start > at:
            text(page[at:start])
        at = end
        if not tag or tag in ("html", "body"):
            continue
        if ends:
            k = stack.last(tag)
            # An inline end tag doesn't close blocks.
            if k and (tag in BLOCKS or tag in CLOSES or k > stack.last("")):
                stack.cut(k)
            continue
        if tag in RAW or tag == "head":
            if not single:  # what it holds is no text
                close = re.compile(f"</{re.escape(tag)}[^>]*>?", re.I).search(page, at)
                at = close.end() if close else len(page)
                found.send(at)
            continue
        if tag in BLOCKS and stack.last("p") > stack.last(*CELLS):
            stack.cut(stack.last("p"))
        elif tag in CLOSES:
            floor = stack.last(*LISTS)
            if open_ := [k for name in CLOSES[tag] if (k := stack.last(name)) > floor]:
                stack.cut(min(open_))
        node = Node(tag, stack.nodes[-1])
        stack.nodes[-1].parts.append(node)
        order.append(node)
        if tag not in VOID and not single:
            stack.push(node)
    if at < len(page):
        text(page[at:])
    return body, order


def measure(body: Node, order: list[Node]) -> None:
    for n in reversed(order):  # children come after their parents
        for p in n.parts:
            if isinstance(p, str):
                n.chars += len(p.strip())
            else:
                n.chars += p.chars
                n.tags += p.tags + 1
                n.link_chars += p.chars if p.tag in LINKS else p.link_chars
                n.link_tags += p.link_tags + (p.tag in LINKS)
        if n.tag in LINKS:
            n.link_chars = n.chars
    share = body.link_chars / max(body.chars, 1)
    for n in reversed(order):
        if n.chars:
            c, t, lc, lt = n.chars, max(n.tags, 1), max(n.link_chars, 1), max(n.link_tags, 1)
            base = math.log(c / max(c - n.link_chars, 1) * n.link_chars + share * c + math.e)
            # The base is 1 without any link; the logarithm then is taken as natural.
            n.density = c / t * (math.log(max(c / lc * t / lt, 1)) / math.log(base) if base > 1.0000001 else math.log(max(c / lc * t / lt, 1)))
        n.total = sum(p.density for p in n.parts if not isinstance(p, str))
        n.best = n
        for p in n.parts:
            if not isinstance(p, str) and p.best.total > n.best.total:
                n.best = p.best


def content(page: str) -> str:
    body, order = parse(page)
    measure(body, order)
    node, threshold = body.best, math.inf
    while node is not None:
        threshold = min(threshold, node.density)
        node = node.parent
    marked = {id(n.best) for n in order if n.chars and n.density >= threshold}
    out: list[str] = []
    stack: list[tuple] = [(body, False)]
    while stack:
        n, inside = stack.pop()
        if isinstance(n, str):
            if inside:
                out.append(n)
            continue
        inside = inside or id(n) in marked
        if inside and n.tag in BREAKS:
            out.append("\n")
            stack.append(("\n", True))
        stack.extend((p, inside) for p in reversed(n.parts))
    text = re.sub(r" *\n[ \n]*", "\n", re.sub(r" +", " ", "".join(out)))
    return text.strip()


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_chars) of each page."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [content(x) if x else "" for x in batch.column(1).to_pylist()]
        return common.rows([common.longs(batch.column(0)), texts, [len(t) for t in texts]], SCHEMA)

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).where("page_id is not null")
    out = common.map_arrow(source, kernel, SCHEMA)
    return out.groupBy("page_id").agg(F.max(F.struct("n_chars", "text")).alias("x")).select("page_id", F.col("x.text").alias("text"), F.col("x.n_chars").alias("n_chars"))
