"""Visible text of web pages, laid out as a browser would.

A tokenizer splits a page into tags and text; a tree builder closes what HTML lets authors leave open (``</p>``,
``</li>``, ``</td>``, ...) and ignores end tags without a start; visibility rules drop what a browser doesn't show
(scripts, ``hidden``, closed ``details``, and what style attributes and the page's own style sheets hide, by the cascade: see
``styles``); and the renderer sets paragraphs and headings apart, numbers and indents lists, keeps
preformatted text with its line ends, and pads table cells to columns, also where cells span several rows or columns.

Each page is a row of its own; nothing is shuffled. Null or empty html gives empty text. Very long pages are parsed whole, in time in
proportion to their length; the builder and the renderer keep their own stacks, so deep nesting can't exhaust Python's.
Repeated rows and null ids are kept, other columns, whatever their names, aren't read, an empty table gives an empty
result.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.batches import map_batches
from sensorloom.llm.styles import Styles, on_screen

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_NEVER = frozenset("script style head title template noscript iframe noembed noframes datalist object audio video canvas col colgroup desc metadata defs symbol annotation annotation-xml".split())
#: Blank lines around a block: 2 line ends set it apart, 1 only starts a line.
_BLOCK = dict.fromkeys("address article aside body center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup html legend li main nav option search section select summary tbody tfoot thead tr".split(), 1) | dict.fromkeys("blockquote h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul xmp".split(), 2)
#: A start tag of the key ends open elements of the value, up to the barrier.
_ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
    "td": (frozenset({"td", "th"}), frozenset({"table"})),
    "th": (frozenset({"td", "th"}), frozenset({"table"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    **{k: (frozenset({"thead", "tbody", "tfoot", "caption"}), frozenset({"table"})) for k in ("thead", "tbody", "tfoot")},
    "body": (frozenset({"head"}), frozenset()),
}
_P_ENDS = frozenset(k for k in _BLOCK if k not in {"li", "dd", "dt", "tr", "tbody", "thead", "tfoot", "option", "select", "legend", "html", "body"})
_P_BARRIER = frozenset({"td", "th", "table", "button", "object", "caption"})

_TAG = re.compile(r"<(?:!--(.*?)(?:--!?>|\Z)|(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_BLANK = str.maketrans("\t\n\r\f", "    ")


class Node:
    """An element; ``before`` is the element before it in its parent, ``number`` its place there from 1, ``last`` its own last element."""

    __slots__ = ("tag", "attributes", "children", "before", "number", "last")

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes, self.children, self.before, self.number, self.last = tag, attributes, [], None, 1, None

    def add(self, child: Node) -> None:
        self.children.append(child)
        if self.last:
            child.before, child.number = self.last, self.last.number + 1
        self.last = child


def _attributes(text: str) -> dict[str, str]:
    """Of a repeated attribute the first counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), html.unescape(next((v for v in m.groups()[1:] if v is not None), "")))
    return found


def parse(page: str) -> tuple[Node, list[str]]:
    """The page's tree and the contents of its style sheets."""
    page = page.replace("\r\n", "\n").replace("\r", "\n")
    root, sheets = Node("#root", {}), []
    stack, at = [root], 0
    opened: dict[str, list[int]] = {}  # where in the stack each tag is open

    def highest(tags: frozenset[str]) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    def pop(n: int) -> None:
        while len(stack) > n:
            opened[stack.pop().tag].pop()

    def pop_to(tags: frozenset[str], barrier: frozenset[str]) -> None:
        k = highest(tags)
        if k and k > highest(barrier):
            pop(k)

    while at < len(page):
        tag = _TAG.search(page, at)
        end = tag.start() if tag else len(page)
        if end > at:
            stack[-1].children.append(html.unescape(page[at:end]))
        if not tag:
            break
        at = tag.end()
        name = (tag[3] or "").lower()
        if not name:
            continue
        if tag[2]:
            if name == "p" and not opened.get("p"):
                stack[-1].add(Node("p", {}))
            elif name == "br":
                stack[-1].add(Node("br", {}))
            else:
                pop_to(frozenset({name}), frozenset({"table"}) if name not in _BLOCK else frozenset())
            continue
        if name in _P_ENDS:
            pop_to(frozenset({"p"}), _P_BARRIER)
        if name in _ENDS:
            if name in ("tr", "thead", "tbody", "tfoot"):
                pop_to(frozenset({"td", "th"}), frozenset({"table"}))
                if name != "tr":
                    pop_to(frozenset({"tr"}), frozenset({"table"}))
            pop_to(*_ENDS[name])
        elif stack[-1].tag == "head" and name not in ("meta", "link", "title", "style", "script", "base", "noscript", "template"):
            pop(len(stack) - 1)  # anything else begins the body
        attributes = _attributes(tag[4]) if tag[4].strip(" /\t\n\r\f") else {}
        node = Node(name, attributes)
        stack[-1].add(node)
        if name in _RAW:
            close = re.compile(rf"</{name}[\s/>]", re.IGNORECASE).search(page, at)
            inside = page[at : close.start() if close else len(page)]
            at = page.find(">", close.start()) + 1 or len(page) if close else len(page)
            if name == "style":
                if on_screen(attributes.get("media", "")):
                    sheets.append(inside)
            elif name in ("textarea", "title"):
                inside = html.unescape(inside)
            node.children.append(inside)
        elif name not in _VOID and not (tag[4].endswith("/") and (opened.get("svg") or opened.get("math"))):
            opened.setdefault(name, []).append(len(stack))
            stack.append(node)
            if name == "pre" and page.startswith("\n", at):
                at += 1
    return root, sheets


def shown(node: Node, display: str | None, parent: Node) -> bool:
    """Whether a browser makes a box for the element, given the ``display`` that the page asks for."""
    a = node.attributes
    if node.tag in _NEVER or parent.tag == "details" and "open" not in parent.attributes and node.tag != "summary":
        return False
    if node.tag == "input" and a.get("type", "").lower() == "hidden":
        return False
    if display:
        return display != "none"
    return "hidden" not in a and not (node.tag == "dialog" and "open" not in a)


class Flow:
    """Text of one block: pending blanks and line ends are written before the next word only."""

    def __init__(self) -> None:
        self.parts, self.breaks, self.space, self.started = [], 0, False, False

    def put(self, text: str) -> None:
        words = [w for w in text.translate(_BLANK).split(" ") if w]
        if words:
            if text[0] in " \t\n\r\f":
                self.space = True
            self.raw(" ".join(words))
            self.space = text[-1] in " \t\n\r\f"
        elif text:
            self.space = True

    def lines(self, text: str) -> None:
        """Preformatted text: all blanks and line ends count, but for empty lines before any text."""
        first, *rest = text.split("\n")
        if first:
            self.raw(first)
        for line in rest:
            self.line_end()
            if line:
                self.raw(line)

    def collapsed_lines(self, text: str) -> None:
        """Line ends count, blanks beside each other are one."""
        first, *rest = text.split("\n")
        self.put(first)
        for line in rest:
            self.line_end()
            self.put(line.lstrip(" \t\r\f"))

    def raw(self, text: str) -> None:
        if self.started:
            self.parts.append("\n" * self.breaks or " " * self.space)
        self.parts.append(text)
        self.breaks, self.space, self.started = 0, False, True

    def block(self, n: int) -> None:
        self.breaks, self.space = max(self.breaks, n), False

    def line_end(self) -> None:
        self.breaks, self.space = self.breaks + 1, False

    def text(self) -> str:
        return "".join(self.parts)


def table_text(rows: list[list[tuple[str, int, int]]]) -> str:
    """Cells (text, columns, rows) in columns, two blanks apart; a cell of several lines takes as many, one of several rows the first."""
    grid: list[dict[int, list[str]]] = []
    width: dict[int, int] = {}
    wide: list[tuple[int, int, int]] = []  # first and last column of cells over several, and how much they hold
    taken: dict[int, int] = {}  # for how many rows more a column belongs to a cell above
    for row in rows:
        cells, k, later = {}, 0, {}
        for text, columns, deep in row:
            while k in taken:
                k += 1
            cells[k] = text.split("\n")
            longest = max(map(len, cells[k]))
            if columns == 1:
                width[k] = max(width.get(k, 0), longest)
            elif longest:
                wide.append((k, k + columns - 1, longest))
            if deep > 1:
                later |= dict.fromkeys(range(k, k + columns), deep - 1)
            k += columns
        taken = {c: n - 1 for c, n in taken.items() if n > 1} | later
        grid.append(cells)
    n = max((max(cells) for cells in grid if cells), default=-1) + 1
    for first, last, longest in sorted(wide, key=lambda x: x[1]):
        if last < n:
            there = sum(width.get(k, 0) + 2 for k in range(first, last + 1)) - 2
            width[last] = width.get(last, 0) + max(0, longest - there)
    start = [0]
    for k in range(n):
        start.append(start[-1] + width.get(k, 0) + 2)
    out = []
    for cells in grid:
        if any(map(any, cells.values())):
            for i in range(max(map(len, cells.values()))):
                line = ""
                for k, lines in sorted(cells.items()):
                    if i < len(lines) and lines[i]:
                        line = line.ljust(start[k]) + lines[i]
                out.append(line.rstrip())
    return "\n".join(out)


#: What values of ``white-space`` keep: blanks and line ends, line ends, or neither.
WHITE_SPACE = {"pre": "pre", "pre-wrap": "pre", "break-spaces": "pre", "pre-line": "line", "normal": "", "nowrap": "", "initial": ""}


def _number(value: str | None, other: int) -> int:
    value = (value or "").strip()
    return int(value) if value.removeprefix("-").isascii() and value.removeprefix("-").isdigit() and len(value) < 10 else other


def _span(value: str | None, most: int, zero: int = 1) -> int:
    """A number of columns or rows, up to what HTML allows."""
    if not value or not value.isascii() or not value.isdigit() or len(value) > 9:
        return 1
    return min(int(value), most) or zero


def render(root: Node, styles: Styles) -> str:
    """All visible text in order, by an explicit walk with a stack of flows."""
    flows, tables, lists, spaces, drawings = [Flow()], [], [], [""], []
    # Each step has the node, its ancestors as nested pairs, and whether its text is visible.
    work: list[tuple] = [("in", root, (Node("#page", {}), None), True)]
    while work:
        step, node, above, visible = work.pop()
        parent = above[0]
        if step == "in" and isinstance(node, str):
            if not visible or parent.tag == "details" and "open" not in parent.attributes or drawings and not drawings[-1]:
                continue
            if spaces[-1]:
                (flows[-1].lines if spaces[-1] == "pre" else flows[-1].collapsed_lines)(node)
            elif not (parent.tag in ("table", "tr", "tbody", "ul", "ol") and not node.strip()):
                flows[-1].put(node)
            continue
        tag = node.tag
        if step == "in":
            own = {}
            if tag != "#root":
                own = styles(node, above) if styles.by_key or "style" in node.attributes else {}
                if not shown(node, own.get("display"), parent):
                    continue
                if "visibility" in own and own["visibility"] != "inherit":
                    visible = own["visibility"] not in ("hidden", "collapse")
            if tag == "br":
                flows[-1].line_end()
                continue
            if tag in ("input", "img"):
                label = node.attributes.get("value" if tag == "input" else "alt", "")
                if visible:
                    flows[-1].put(label)
                continue
            if tag in _BLOCK:
                flows[-1].block(1 if tag in ("ul", "ol", "menu") and lists else _BLOCK[tag])
            space = "pre" if tag in ("pre", "textarea", "xmp") else spaces[-1]
            spaces.append(WHITE_SPACE.get(own.get("white-space", ""), space))
            if tag in ("ul", "ol", "menu"):
                lists.append([tag == "ol", _number(node.attributes.get("start"), 1)])
            elif tag == "table":
                tables.append([])
                flows.append(Flow())
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables or tag == "li":
                flows.append(Flow())
            elif tag in ("svg", "foreignobject") or drawings and tag == "text":
                drawings.append(tag != "svg")  # of a drawing, only its text elements and embedded pages are text
            work.append(("out", node, above, visible))
            inside = (node, above)
            work.extend(("in", child, inside, visible) for child in reversed(node.children))
            continue
        spaces.pop()
        if tag in ("svg", "foreignobject") or tag == "text" and drawings:
            drawings.pop()
            if tag == "text":
                flows[-1].block(1)
        elif tag in ("ul", "ol", "menu"):
            lists.pop()
        elif tag == "li":
            text, mark = flows.pop().text(), "- "
            if lists and lists[-1][0]:
                lists[-1][1] = _number(node.attributes.get("value"), lists[-1][1])
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            if text:
                flows[-1].block(1)
                flows[-1].raw(mark + re.sub(r"\n(?!\n)", "\n" + " " * len(mark), text))
        elif tag in ("td", "th") and tables:
            if not tables[-1]:
                tables[-1].append([])
            a = node.attributes
            tables[-1][-1].append((flows.pop().text(), _span(a.get("colspan"), 1000), _span(a.get("rowspan"), 65534, 65534)))
        elif tag == "table":
            stray, grid = flows.pop().text(), table_text(tables.pop())
            for text in (stray, grid):  # captions and text between cells come first
                if text:
                    flows[-1].block(1)
                    flows[-1].raw(text)
        if tag in _BLOCK:
            flows[-1].block(1 if tag in ("ul", "ol", "menu") and lists else _BLOCK[tag])
    return flows[0].text()


def visible_text(page: str | None) -> str:
    if not page:
        return ""
    root, sheets = parse(page)
    return render(root, Styles.of(sheets))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, text`` for each row of ``pages``."""

    def make():
        return lambda batch: {"page_id": batch.column(0), "text": [visible_text(h) for h in batch.column(1).cast(pa.string()).to_pylist()]}

    return map_batches(pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")), make, "page_id long, text string")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of all ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op9_html_text": op9_html_text}
ORACLE_SQL: dict[str, str] = {}
