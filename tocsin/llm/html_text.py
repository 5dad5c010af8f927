"""HTML to text as a browser lays it out.

A small tree builder takes the tags as they come: void elements, raw-text elements
(script, style, textarea, title), quotes only around values, implied ends (a new li, p, tr, td, dt, option
closes the open one; a block closes an open p; an end tag closes what is open
inside its element), and implied rows and bodies of tables.  Whole subtrees are
invisible: head, script, style, template, noscript and the like, ``hidden``,
``display:none``, ``input type=hidden``; the title, desc, annotation and style parts of
svg and math, whose other text is shown.  ``visibility`` is inherited: what it hides
comes out again inside an element that sets it to visible.

All visible text comes out: runs of white space are one space, blocks start on a
line of their own with a blank line between paragraphs, headings, lists and
tables; list items are indented by depth and bulleted or numbered (``start`` and
``value`` count); pre keeps its spaces; br breaks; alt texts and the values of
buttons count as text.  A table's cells are padded to their columns, with spans
taking several; a cell's lines stay in its column.

Defined cases: null html gives null text and 0 characters; an empty page an empty
text.  Malformed mark-up never fails: a stray ``<`` is text, an unclosed comment or
tag ends with the page.  Nesting deeper than ``MAX_DEPTH`` is flattened, so no
page overflows the stack; its text still comes out, but for that of invisible elements.
Rows are kept one for one, repeated or null ids included.  Extra columns don't matter.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import released, slices

MAX_DEPTH = 150
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe object audio video canvas datalist title meta link noembed noframes area base param source track".split())
FOREIGN = frozenset({"svg", "math"})
FOREIGN_UNSEEN = frozenset("desc metadata defs symbol annotation annotation-xml".split())
HTML_INSIDE = frozenset("foreignobject desc title annotation-xml mtext mi mo mn ms".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset".split())
BLOCKS = PARAGRAPHS | frozenset("html body div section article aside header footer main nav address form li dt dd center details summary dir menu figcaption legend caption tr tbody thead tfoot optgroup option hgroup search".split())
CLOSES_P = BLOCKS - frozenset("html body li dt dd tr tbody thead tfoot caption option optgroup legend summary".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tr": {"tr", "td", "th", "caption"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, "thead": {"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, "tfoot": {"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}, "optgroup": {"select"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}}
BARRIERS = frozenset({"table", "td", "th", "caption", "html", "button", "template", "object"})
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[\s/]|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"?|'[^']*+'?|[^\s>\"'][^\s>]*+)?+)?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>\"'][^\s>]*+))?+)?+")
BLANK = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attributes", "children", "foreign", "tag")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None, foreign: bool = False):
        self.tag, self.attributes, self.children, self.foreign = tag, attributes or {}, [], foreign


def parse(source: str) -> Node:
    """The tree of a page; its root has the tag ''."""
    root = Node("")
    stack = [root]
    deep: list[Counter[str]] = [Counter()]  # open elements that were flattened, by tag: at the limit, and in an invisible element there

    def close(tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        """End the outermost open element of these tags, and all inside it, short of a stopping one."""
        found = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                found = k
            elif stack[k].tag in stop:
                break
        if found:
            del stack[found:]

    at = 0
    while at < len(source):
        if len(stack) <= MAX_DEPTH:
            del deep[1:]
        if len(stack) < MAX_DEPTH:
            deep[0].clear()
        m = TOKEN.search(source, at)
        if m is None:
            stack[-1].children.append(html.unescape(source[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(html.unescape(source[at : m.start()]))
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag == "p" and not any(n.tag == "p" for n in stack):
                stack[-1].children.append(Node("p"))
            elif deep[-1][tag] > 0:
                deep[-1][tag] -= 1
            else:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                    if stack[k].tag in BARRIERS and tag not in BLOCKS:
                        break
        elif m[2]:
            tag = m[2].lower()
            attributes, end = {}, 0
            for a in ATTRIBUTE.finditer(m[3] or ""):
                end = a.end()
                attributes.setdefault(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or ""))
            if tag in CLOSES_P:
                close({"p"}, BARRIERS)
            if tag == "body" or tag in ("div", "p", "article") and any(n.tag == "head" for n in stack):
                close({"head"}, frozenset())
            if tag in CLOSED_BY:
                close(CLOSED_BY[tag], SCOPE[tag])
            if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                row = Node("tr")
                stack[-1].children.append(row)
                stack.append(row)
            near = next((n.tag for n in reversed(stack) if n.tag in FOREIGN or n.tag in HTML_INSIDE), "")
            node = Node(tag, attributes, near in FOREIGN)
            stack[-1].children.append(node)
            if (node.foreign or tag in FOREIGN) and m[3][end:].endswith("/"):
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                text = source[at : end.start() if end else len(source)]
                node.children.append(html.unescape(text) if tag in ("title", "textarea") else text)
                at = end.end() if end else len(source)
            elif tag not in VOID and (len(stack) < MAX_DEPTH or len(stack) == MAX_DEPTH and unseen(node)):
                if len(stack) == MAX_DEPTH:
                    deep.append(Counter())  # at the limit an invisible element still takes what is in it, and is never rendered
                stack.append(node)
            elif tag not in VOID:
                deep[-1][tag] += 1
    return root


def unseen(node: Node) -> bool:
    """Whether the whole subtree is invisible, whatever is in it."""
    a = node.attributes
    if node.tag == "rp" or node.tag == "dialog" and "open" not in a:
        return True
    return node.tag in UNSEEN or node.foreign and node.tag in FOREIGN_UNSEEN or "hidden" in a or node.tag == "input" and a.get("type", "").lower() == "hidden" or bool("style" in a and NO_DISPLAY.search(a["style"]))


def visibility(node: Node) -> bool | None:
    """True or False where the element sets its visibility, else None; of several, the last counts."""
    found = VISIBILITY.findall(node.attributes["style"]) if "style" in node.attributes else None
    return found[-1].lower() == "visible" if found else None


def hide(node: Node, shown: bool = True) -> bool:
    """Take out what visibility hides; whether anything visible is left."""
    kept, left = [], False
    for child in node.children:
        if isinstance(child, str):
            some = shown and bool(child.strip())
            if shown:
                kept.append(child)
        else:
            own = visibility(child)
            here = shown if own is None else own
            some = hide(child, here) or here
            if some:
                kept.append(child)
            if not here:
                child.attributes = {k: v for k, v in child.attributes.items() if k not in ("alt", "value")}
        left |= some
    node.children = kept
    return left


class Writer:
    """Lines of text under construction; a break is remembered until more text comes."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line, self.gap, self.space, self.prefix, self.first = "", 0, False, "", ""

    def text(self, s: str, keep: bool = False) -> None:
        if keep:
            for k, part in enumerate(s.replace("\r\n", "\n").split("\n")):
                if k:
                    self.flush()
                    self.gap = max(self.gap, 1)
                if part:
                    self._start()
                    self.line += part
            return
        flat = BLANK.sub(" ", s)
        if flat.strip(" ") == "":
            self.space |= bool(flat) and bool(self.line)
            return
        if not self.line:
            self._start()
            flat = flat.lstrip(" ")
        elif (self.space or flat[0] == " ") and not self.line.endswith(" "):
            self.line += " "
        self.line += flat.strip(" ")
        self.space = flat[-1] == " "

    def _start(self) -> None:
        if not self.line:
            if self.gap > 1 and self.lines:
                self.lines.append("")
            self.line, self.first, self.gap = self.first or self.prefix, "", 0

    def flush(self) -> None:
        if self.line:
            self.lines.append(self.line.rstrip())
        self.line, self.space = "", False

    def block(self, lines: int) -> None:
        self.flush()
        self.gap = max(self.gap, lines)

    def rows(self, rows: list[str]) -> None:
        self.block(2)
        for r in rows:
            self._start()
            self.line += r
            self.flush()
            self.gap = 1

    def done(self) -> str:
        self.flush()
        return "\n".join(self.lines)


def _number(text: str | None, default: int) -> int:
    return int(text) if text and re.fullmatch(r"\s*-?\d{1,9}\s*", text) else default


def shown_children(node: Node) -> list:
    """All children, of details that aren't open only the first summary."""
    if node.tag != "details" or "open" in node.attributes:
        return node.children
    return [c for c in node.children if not isinstance(c, str) and c.tag == "summary"][:1]


def render(node: Node, out: Writer, keep: bool = False) -> None:
    for child in shown_children(node):
        if isinstance(child, str):
            out.text(child, keep)
            continue
        tag = child.tag
        if unseen(child):
            continue
        if tag == "br":
            out.flush()
            out.gap = max(out.gap, 1)
        elif tag == "hr":
            out.rows(["-" * 8])
            out.block(2)
        elif tag in ("img", "input"):
            shown = child.attributes.get("alt", "") if tag == "img" or child.attributes.get("type", "").lower() == "image" else child.attributes.get("value", "") if child.attributes.get("type", "text").lower() in ("submit", "button", "reset", "text") else ""
            if shown:
                out.text(shown)
        elif tag == "table":
            out.rows(table_rows(child))
            out.block(2)
        elif tag in ("ul", "ol", "menu", "dir"):
            list_items(child, out, keep)
        elif tag in BLOCKS or child.foreign and tag == "text":
            space = 2 if tag in PARAGRAPHS else 1
            out.block(space)
            if tag in ("blockquote", "dd"):
                before, out.prefix = out.prefix, out.prefix + "  "
                render(child, out, keep)
                out.flush()
                out.prefix = before
            else:
                render(child, out, keep or tag == "pre")
            out.block(space)
        else:
            render(child, out, keep or tag == "textarea")


def list_items(node: Node, out: Writer, keep: bool) -> None:
    nested = bool(out.prefix)
    out.block(1 if nested else 2)
    number = _number(node.attributes.get("start"), 1)
    before = out.prefix
    for child in node.children:
        if isinstance(child, str) or child.tag != "li":
            shell = Node("div")
            shell.children = [child]
            render(shell, out, keep)
            continue
        if unseen(child):
            continue
        number = _number(child.attributes.get("value"), number)
        mark = f"{number}. " if node.tag == "ol" else "- "
        number += 1
        out.block(1)
        out.first, out.prefix = before + mark, before + " " * len(mark)
        render(child, out, keep)
        out.block(1)
        out.first, out.prefix = "", before
    out.block(1 if nested else 2)


def _cells(node: Node) -> Iterator[list[Node] | Node]:
    """Rows (lists of cells) and captions of a table, through its sections; stray text is a row of its own."""
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                cell = Node("td")
                cell.children = [child]
                yield [cell]
        elif unseen(child) or child.tag in ("col", "colgroup"):
            continue
        elif child.tag == "tr":
            yield [c for c in child.children if isinstance(c, Node) and c.tag in ("td", "th") and not unseen(c)]
            loose = Node("td")
            loose.children = [c for c in child.children if not (isinstance(c, Node) and c.tag in ("td", "th")) and (not isinstance(c, str) or c.strip())]
            if loose.children:
                yield [loose]
        elif child.tag in ("tbody", "thead", "tfoot"):
            yield from _cells(child)
        elif child.tag == "caption":
            yield child
        else:
            cell = Node("td")
            cell.children = [child]
            yield [cell]


def _lines(node: Node) -> list[str]:
    inner = Writer()
    render(node, inner)
    return inner.done().split("\n")


def table_rows(node: Node) -> list[str]:
    """A table as aligned lines: columns parted by two spaces, caption first."""
    captions: list[str] = []
    grid: list[list[tuple[int, int, list[str]]]] = []
    busy: dict[int, int] = {}
    for row in _cells(node):
        if isinstance(row, Node):
            captions += _lines(row)
            continue
        placed, column = [], 0
        following = {c: n - 1 for c, n in busy.items() if n > 1}
        for cell in row:
            while busy.get(column, 0) > 0:
                column += 1
            wide, high = (max(1, min(_number(cell.attributes.get(k), 1), 1000)) for k in ("colspan", "rowspan"))
            placed.append((column, wide, _lines(cell)))
            if high > 1:
                following.update({c: high - 1 for c in range(column, column + wide)})
            column += wide
        busy = following
        if any(any(lines) for _, _, lines in placed):
            grid.append(placed)
    widths: dict[int, int] = {}
    for placed in grid:
        for column, wide, lines in placed:
            if wide == 1:
                widths[column] = max(widths.get(column, 0), *(len(x) for x in lines))
    out = [x for x in captions if x]
    known = sorted(widths)
    reach = [0, *accumulate(widths[c] + 2 for c in known)]
    for placed in grid:
        for k in range(max(len(lines) for _, _, lines in placed)):
            line = ""
            for column, _, lines in placed:
                at = reach[bisect_left(known, column)]
                if k < len(lines) and lines[k]:
                    if line and len(line) >= at:
                        line = line + "  " + lines[k]
                    else:
                        line = line.ljust(at) + lines[k]
            out.append(line.rstrip())
    return out


def html_text(source: str | None) -> str | None:
    if source is None:
        return None
    out, tree = Writer(), parse(source)
    if VISIBILITY.search(source):
        hide(tree)
    render(tree, out)
    return out.done()


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, 256, column="html"):
                texts = [html_text(x.as_py()) for x in batch["html"]]
                yield pa.record_batch([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t or "") for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(column).cast("string").alias("html"))
    return slim.mapInArrow(released(run), "page_id long, url string, text string, n_chars long")
