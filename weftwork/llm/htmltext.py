"""Visible text of HTML pages, laid out: a tree builder with implied tags, visibility rules, and a
renderer that keeps block spacing, lists and aligned table cells.

The builder reads tags with one pattern, closes elements that a start tag ends by itself (a
paragraph by a block, a cell by the next cell), ignores end tags without a start, and leaves the
text of scripts and styles alone. The renderer walks the tree with a stack of its own, so nesting
may be as deep as the page likes. Nothing is scored or cut: all visible text comes out.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and those of them (and others) that show nothing.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes datalist object audio video canvas svg math".split())
#: Blocks with a blank line around them, and blocks that only start a line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol pre blockquote dl table figure hr listing xmp menu".split())
PLAIN = frozenset("html body div section article header footer nav main aside li dt dd form fieldset address details summary figcaption legend option optgroup caption center hgroup search dialog tr thead tbody tfoot td th textarea select".split())
BLOCKS = SPACED | PLAIN
#: A start tag ends these open elements, up to the nearest of the scope.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
#: A block does not end a paragraph outside of these; end tags of others than these stay within a cell.
KEEPS_P = ("td", "th", "table", "caption", "button", "li", "div")
ENDS_CELLS = frozenset("td th tr tbody thead tfoot table body html".split())
NO_P = BLOCKS - {"html", "body", "option", "optgroup", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "textarea", "select"}
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
OTHER = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?/][^>]*>?|[^<]+|<", re.S)
QUOTE_OR_END = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
#: What counts as a list's first number: of 300 digits too (Python reads up to 4,300).
INTEGER = re.compile(r"[+-]?[0-9]{1,4000}")
SPACES = re.compile(r"[ \t\n\r\f]+")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)


class Node:
    """An element: its tag, attributes and children, which are nodes and strings."""

    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def tag_end(html: str, at: int) -> int:
    """Where a tag's ``>`` is, outside of quotes; -1 if the page ends within the tag."""
    while m := QUOTE_OR_END.search(html, at):
        if m[0] == ">":
            return m.start()
        at = html.find(m[0], m.end()) + 1
        if at == 0:
            break
    return -1


def build(html: str) -> Node:
    """The tree of a page. A tag that the page ends in is dropped, as browsers do."""
    root = Node("", {})
    stack, at, end = [root], 0, len(html)
    #: By tag, where its open elements are in the stack: nothing has to be looked for in the stack itself.
    places: dict[str, list[int]] = {}

    def close(upto: int) -> None:
        for node in stack[upto:]:
            places[node.tag].pop()
        del stack[upto:]

    def top(tags) -> int:
        """Where the innermost open element of some tags is; 0 if none is open."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def start(tag: str, found: dict[str, str]) -> None:
        ends, scope = ENDS.get(tag, ((), ()))
        if ends:
            above = top(scope)
            cut = min((own[k] for t in ends if (own := places.get(t)) and (k := bisect_right(own, above)) < len(own)), default=0)
            if cut:
                close(cut)
        if tag in NO_P and top("p") > top(KEEPS_P):
            close(top("p"))
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            start("tr", {})
        node = Node(tag, found)
        stack[-1].children.append(node)
        if tag not in VOID:
            stack.append(node)
            places.setdefault(tag, []).append(len(stack) - 1)

    while at < end:
        m = NAME.match(html, at)
        if m is None:
            text = OTHER.match(html, at)[0]
            at += len(text)
            if text[0] != "<" or text == "<":
                if stack[-1].tag == "head" and text.strip():
                    close(len(stack) - 1)
                stack[-1].children.append(text)
            continue
        tag, stop = m[2], tag_end(html, m.end())
        if stop < 0:
            break
        inside, at = html[m.end() : stop], stop + 1
        tag = tag.lower()
        if m[1]:
            if places.get(tag):
                if tag in ENDS_CELLS or places[tag][-1] > top(("td", "th", "table")):
                    close(places[tag][-1])
            elif tag == "p":  # an end without a start is an empty paragraph
                stack[-1].children.append(Node("p", {}))
            continue
        start(tag, attributes(inside))
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            upto = stop.start() if stop else end
            stack[-1].children.append(html[at:upto])
            at = upto
    return root


def hidden(node: Node) -> bool:
    a = node.attributes
    return node.tag in UNSEEN or "hidden" in a or bool(a.get("style") and HIDING.search(a["style"])) or node.tag == "dialog" and "open" not in a or node.tag == "input"


def width(text: str) -> int:
    """Columns of a monospaced font: wide characters take two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """Lines of text with collapsed white space, block gaps and indents."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0
        self.indents: list[str] = []
        self.marker = ""

    def _flush(self, text: str) -> None:
        if self.lines and self.gap:
            self.lines.append("")
        self.gap = 0
        lead = "".join(self.indents)
        if self.marker:
            lead = lead[: max(0, len(lead) - len(self.marker))] + self.marker
            self.marker = ""
        self.lines.append((lead + text).rstrip())

    def words(self, text: str) -> None:
        text = SPACES.sub(" ", text)
        if text[:1] == " " and self.now:
            self.space = True
        core = text.strip(" ")
        if core:
            if self.space and self.now:
                self.now.append(" ")
            self.now.append(core)
            self.space = text[-1] == " "

    def kept(self, text: str) -> None:
        first, *rest = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.now.append(first)
        for line in rest:
            self.line(True)
            self.now.append(line)

    def line(self, even_empty: bool = False) -> None:
        if self.now or even_empty:
            self._flush("".join(self.now))
        self.now, self.space = [], False

    def block(self, gap: int) -> None:
        self.line()
        self.gap = max(self.gap, gap)


class Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[Flow, int]]] = []

    def render(self, to: Flow) -> None:
        """Cells side by side, each column as wide as its widest cell; a cell over several columns
        takes the room it needs in the last of them."""
        grid, widths = [], []
        for row in self.rows:
            at, cells = 0, []
            for flow, span in row:
                flow.line()
                cells.append((at, span, flow.lines))
                at += span
            widths += [0] * (at - len(widths))
            for s, span, lines in cells:
                if span == 1:
                    widths[s] = max(widths[s], max(map(width, lines), default=0))
            grid.append(cells)
        for cells in grid:
            for s, span, lines in cells:
                room = sum(widths[s : s + span]) + 2 * (span - 1)
                widths[s + span - 1] += max(0, max(map(width, lines), default=0) - room)
        for cells in grid:
            for i in range(max((len(lines) for *_, lines in cells), default=0)):
                parts = []
                for s, span, lines in cells:
                    text = lines[i] if i < len(lines) else ""
                    parts.append(text + " " * (sum(widths[s : s + span]) + 2 * (span - 1) - width(text)))
                line = "  ".join(parts).rstrip()
                if line:
                    to._flush(line)


def render(root: Node) -> str:
    """The page's visible text."""
    flow = Flow()
    flows, tables, lists, pre = [flow], [], [], 0
    todo: list[tuple[Node | str, bool]] = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            text = unescape(node) if "&" in node else node
            flow.kept(text) if pre else flow.words(text)
            continue
        tag = node.tag
        if leaving:
            if tag in ("td", "th") and len(flows) > 1:
                flows.pop()
            elif tag == "table":
                table = tables.pop()
                table.render(flow)
                flow.gap = 1
            elif tag in BLOCKS:
                flow.block(1 if tag in SPACED and not (tag in ("ul", "ol", "menu") and len(lists) > 1) else 0)
                if tag in ("ul", "ol", "menu"):
                    lists.pop()
                elif tag == "li" or tag in ("blockquote", "dd"):
                    flow.indents.pop()
                    flow.marker = ""
                elif tag in ("pre", "listing", "xmp", "textarea"):
                    pre -= 1
            continue
        if hidden(node):
            continue
        if tag == "br":
            flow.line(True)
            continue
        if tag == "wbr" or tag in VOID and tag != "hr":
            continue
        if tag in ("td", "th") and tables:
            if not tables[-1].rows:
                tables[-1].rows.append([])
            span = node.attributes.get("colspan", "1")
            flows.append(Flow())
            tables[-1].rows[-1].append((flows[-1], min(1000, max(1, int(span))) if span.isascii() and span.isdigit() else 1))
        elif tag == "tr" and tables:
            tables[-1].rows.append([])
        elif tag in BLOCKS:
            flow.block(1 if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists) else 0)
            if tag == "table":
                tables.append(Table())
            elif tag in ("ul", "ol", "menu"):
                first = node.attributes.get("start", "1")
                lists.append([tag, int(first) if INTEGER.fullmatch(first) else 1])
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0] == "ol":
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                flow.indents.append(" " * len(mark))
                flow.marker = mark
            elif tag in ("blockquote", "dd"):
                flow.indents.append("  ")
            elif tag in ("pre", "listing", "xmp", "textarea"):
                pre += 1
        todo.append((node, True))
        children = node.children
        if tag in ("pre", "listing", "textarea") and children and isinstance(children[0], str):
            children = [re.sub(r"\A\r?\n", "", children[0]), *children[1:]]
        todo.extend((child, False) for child in reversed(children))
    flows[0].line()
    return "\n".join(flows[0].lines).strip("\n")


def visible_text(html: str | None) -> str:
    return render(build(html)) if html else ""


SCHEMA = "page_id bigint, text string, n_chars bigint, n_lines bigint"


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, its visible text, characters and lines of it.

    A null or empty page has an empty text of no lines. Broken markup is read as far as it goes.
    page_id may be null or repeated: one row for each row. Extra columns are ignored; no rows give
    no rows.
    """
    tune(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                texts = [visible_text(x.as_py()) for x in part.column(1)]
                yield pa.record_batch([part.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())], ["page_id", "text", "n_chars", "n_lines"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, SCHEMA)
