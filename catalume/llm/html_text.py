"""Layout-aware text of web pages: a tree with implied tags, and a renderer of what is visible."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: An attribute: a name, and perhaps a value, which is quoted only if it starts with a quote.
_ATTRIBUTE = r"""(=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+("[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))?+"""
_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</[^A-Za-z<>][^>]*(?:>|\Z)|</>"""
    r"""|</?[A-Za-z][^\s/>]*+(?:[\s/]++|""" + _ATTRIBUTE.replace("(=", "(?:=", 1).replace('("', '(?:"', 1) + r""")*+(?:>|\Z)""",
    re.S,
)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTR = re.compile(_ATTRIBUTE)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_IMPORTANT = re.compile(r"!\s*important\s*\Z")
#: A number of so many digits is no character.
_LONG_NUMBER = re.compile(r"&#[0-9]{20,};?")
_SPACES = re.compile(r"[ \t\n\f\r]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their text runs to their own end tag.
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
UNSEEN = frozenset("head script style title template noscript noembed noframes iframe object audio video canvas datalist".split())
#: Not drawn within these elements.
UNSEEN_IN = {"svg": frozenset("desc metadata defs symbol clippath mask marker pattern".split()), "math": frozenset("annotation annotation-xml".split())}
#: Values of these properties; others have no effect.
DISPLAYS = frozenset("block inline inline-block flex inline-flex grid inline-grid flow-root contents list-item table inline-table table-row table-cell table-row-group table-header-group table-footer-group table-column table-column-group table-caption initial unset".split())
VISIBILITIES = {"hidden": False, "collapse": False, "visible": True, "initial": True}
#: Spaces written before a line at most, however deep its lists and quotes are.
DEEPEST = 40
#: Columns are aligned up to this width; longer cells reach beyond it.
WIDEST = 100
#: A row with more room than this around its text is written without it.
ROOM = 400
#: Cells in columns from this one on don't reach into rows below.
COLUMNS = 100
#: A table within so many tables has its cells in a line, unaligned.
NESTED = 8
BLOCKS = frozenset("svg-text address article aside body center details dialog dir div dd dl dt fieldset figcaption figure footer form header hgroup html legend li main menu nav optgroup option search section summary tr caption thead tbody tfoot".split())
#: A blank line stands before and after them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre hr figure".split())
#: Opening one of these ends an open paragraph.
ENDS_P = (BLOCKS | SPACED) - frozenset("svg-text body html option optgroup tr caption thead tbody tfoot li dd dt".split())
#: Opening a tag closes those open ones, up to the tags that bound the search.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
}
#: End tags don't reach out of these.
SCOPE = frozenset({"table", "td", "th", "caption", "html", "template"})
#: What may stand in a head; any other tag ends it.
IN_HEAD = frozenset("html head title meta link base basefont bgsound script style noscript noframes template".split())


class Node:
    __slots__ = ("tag", "children", "span", "down", "start")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        get = (attributes or {}).get
        self.tag, self.children = tag, []
        self.span = _number(get("colspan"), 1, 100) or 1
        down = _number(get("rowspan"), 0, 65_534)
        self.down = 1 if down is None else down or 65_534  # 0: all rows that follow
        #: of a list the number of its first item, of an item its own, if they say so
        self.start = _number(get("value" if tag == "li" else "start"), 0, 10**9)


def _attributes(token: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in _ATTR.findall(token[_NAME.match(token).end() :].removesuffix(">")):
        out.setdefault(k.lower(), _unescape(v.strip(v[0]) if v[:1] in ("'", '"') else v))
    return out


def _unescape(text: str) -> str:
    return html.unescape(_LONG_NUMBER.sub("\ufffd", text)) if "&" in text else text


def _style(text: str) -> dict[str, str]:
    """Properties of a style attribute: the last one with an effect, important ones first."""
    out: dict[str, tuple[bool, str]] = {}
    for part in _COMMENT.sub(" ", text).lower().split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip(), value.strip()
        if name not in ("display", "visibility"):
            continue
        rank = bool(_IMPORTANT.search(value))
        value = _IMPORTANT.sub("", value).strip()
        known = value == "none" or value in DISPLAYS if name == "display" else value in VISIBILITIES
        if known and rank >= out.get(name, (False, ""))[0]:
            out[name] = rank, value
    return {name: value for name, (_, value) in out.items()}


def _number(text: str | None, low: int, high: int) -> int | None:
    m = re.match(r"\s*(\d{1,9})", text or "")
    return min(high, max(low, int(m[1]))) if m else None


def parse(source: str) -> Node:
    """The tree of a page. What isn't displayed is left out as it is built, and so are texts that aren't visible, while their elements keep their place."""
    root = Node("html")
    stack = [root]
    shown = [True]  # of each element of the stack whether its own text is visible
    hidden = 0  # depth of the stack at which a hidden element was opened
    at = 0
    n = len(source)

    places: defaultdict[str, list[int]] = defaultdict(list)  # where the open elements of a tag are in the stack

    def place(tags: set[str] | frozenset[str]) -> int:
        return max((places[x][-1] for x in tags if places.get(x)), default=0)

    def close(wanted: set[str] | frozenset[str], bound: set[str] | frozenset[str]) -> None:
        nonlocal hidden
        i = place(wanted)
        if i and i >= place(bound):
            for x in stack[i:]:
                places[x.tag].pop()
            del stack[i:], shown[i:]
            if hidden >= len(stack):
                hidden = 0

    def add_text(text: str) -> None:
        if stack[-1].tag == "head" and text.strip(" \t\n\f\r"):
            close({"head"}, frozenset())
        if text and not hidden and shown[-1]:
            stack[-1].children.append(_unescape(text))

    while at < n:
        m = _TOKEN.search(source, at)
        if not m:
            add_text(source[at:])
            break
        add_text(source[at : m.start()])
        token, at = m[0], m.end()
        name = _NAME.match(token)
        if not name:
            if token.startswith("<![CDATA["):
                add_text(token[9:-3] if token.endswith("]]>") else token[9:])
            continue
        tag = name[1].lower()
        if tag == "text" and places["svg"]:
            tag = "svg-text"
        if token[1] == "/":
            if tag in ("br", "body", "html") and stack[-1].tag == "head":
                close({"head"}, frozenset())
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag == "p" and not places["p"]:
                stack[-1].children.append(Node("p"))
            elif tag not in ("html", "body"):
                close({tag}, SCOPE - {tag} if tag not in ("table", "tr", "thead", "tbody", "tfoot") else {"table"} - {tag})
            continue
        attributes = _attributes(token) if len(token) > len(tag) + 2 else {}
        if tag in ENDS_P:
            close({"p"}, SCOPE | {"button", "li", "dd", "dt"})
        if tag in IMPLIED_END:
            wanted, bound = IMPLIED_END[tag]
            for _ in wanted:
                close(wanted, bound)
        elif tag == "a":
            close({"a"}, SCOPE)
        if tag == "body" or (tag not in IN_HEAD and stack[-1].tag == "head"):
            close({"head"}, frozenset())
        if tag == "html" or (tag == "body" and places["body"]):
            continue
        node = Node(tag, attributes)
        style = _style(attributes["style"]) if "style" in attributes else {}
        closed = "hidden" in attributes or (tag == "dialog" and "open" not in attributes)
        unseen = tag in UNSEEN or any(places[x] and tag in inner for x, inner in UNSEEN_IN.items()) or (style["display"] == "none" if "display" in style else closed)
        visible = VISIBILITIES[style["visibility"]] if "visibility" in style else shown[-1]
        if token.endswith("/>") and (tag in UNSEEN_IN or any(places[x] for x in UNSEEN_IN)):
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(source, at)
            body = source[at : end.start() if end else n]
            at = end.end() if end else n
            if not unseen and not hidden and visible:
                node.children.append(_unescape(body) if tag == "textarea" else body)
                stack[-1].children.append(node)
            continue
        if not hidden and not unseen:
            stack[-1].children.append(node)
        if tag in VOID:
            continue
        places[tag].append(len(stack))
        stack.append(node)
        shown.append(visible)
        if unseen and not hidden:
            hidden = len(stack) - 1
    return root


class Writer:
    """Lines of text with blank lines between blocks, indents and bullets. ``tables``: those around it."""

    def __init__(self, tables: int = 0) -> None:
        self.tables = tables
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.space = False
        self.indent = 0
        self.bullet: str | None = None

    def _open(self) -> None:
        if not self.line:
            if self.gap > 1 and self.lines and self.bullet is None:
                self.lines.append("")
            elif self.gap > 1 and self.lines and not self.indent:
                self.lines.append("")
            self.gap = 0
            bullet = self.bullet or ""
            self.line.append(" " * min(self.indent - len(bullet), DEEPEST) + bullet)
            self.bullet = None
            self.space = False

    def text(self, s: str) -> None:
        words = [w for w in _SPACES.split(s) if w]
        if not words:
            self.space = self.space or bool(self.line)
            return
        joined = bool(self.line)
        self._open()
        if joined and (self.space or s[0] in " \t\n\f\r"):
            self.line.append(" ")
        self.line.append(" ".join(words))
        self.space = s[-1] in " \t\n\f\r"

    def verbatim(self, s: str) -> None:
        for i, part in enumerate(s.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if i:
                if not self.line:
                    self._open()
                self.end()
            if part:
                self._open()
                self.line.append(part)

    def end(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False

    def block(self, gap: int) -> None:
        self.end()
        self.gap = max(self.gap, gap)

    def result(self) -> str:
        self.end()
        return "\n".join(self.lines).strip("\n")


def run(steps: Iterator) -> None:
    """Run a generator and those it yields, each to its end before the next step: recursion of any depth."""
    stack = [steps]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


def _wide(text: str) -> int:
    """Columns that a text takes: two for wide characters, none for marks."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _cells(row: Node, out: list[tuple[list[str], int, int]], tables: int) -> Iterator:
    for c in row.children:
        if isinstance(c, Node) and c.tag in ("td", "th"):
            w = Writer(tables + 1)
            yield render(c, w, False)
            out.append(([x for x in w.result().split("\n") if x.strip()], c.span, c.down))


def _row(cells: list[tuple[int, list[str], int]], width: dict[int, int]) -> list[str]:
    """Lines of a row: cells side by side, each line at its column; without columns where they would take more than ``ROOM``."""
    rooms = [width.get(k, 0) if span == 1 else sum(width.get(k + i, 0) for i in range(span)) + 3 * (span - 1) for k, _, span in cells]
    high = max((len(lines) for _, lines, _ in cells), default=0)
    spare = sum(room + 3 - (_wide(lines[0]) if lines and high == 1 else 0) for room, (_, lines, _) in zip(rooms, cells))
    if spare > ROOM:
        return [" | ".join(lines[0] for _, lines, _ in cells if lines)] if high == 1 else [x for _, lines, _ in cells for x in lines]
    out = []
    for i in range(high):
        texts = [lines[i] if i < len(lines) else "" for _, lines, _ in cells]
        out.append(" | ".join(x + " " * (room - _wide(x)) for x, room in zip(texts, rooms)).rstrip())
    return [x for x in out if x.strip(" |")]


def _table(node: Node, w: Writer) -> Iterator:
    """Rows of cells, each column as wide as its widest line; a cell over several rows leaves room below it."""
    rows: list[list[tuple[list[str], int, int]]] = []
    loose: list[Node | str] = []
    open_ = [iter(node.children)]
    while open_:
        for c in open_[-1]:
            if isinstance(c, Node) and c.tag == "tr":
                rows.append([])
                yield _cells(c, rows[-1], w.tables)
                loose.extend(y for y in c.children if not (isinstance(y, Node) and y.tag in ("td", "th")))
            elif isinstance(c, Node) and c.tag in ("thead", "tbody", "tfoot", "colgroup"):
                open_.append(iter(c.children))
                break
            elif isinstance(c, Node) and c.tag in ("td", "th"):  # a cell without a row
                holder = Node("tr")
                holder.children.append(c)
                rows.append([])
                yield _cells(holder, rows[-1], w.tables)
            else:
                loose.append(c)
        else:
            open_.pop()
    for x in loose:  # captions, and what doesn't belong into a table, stand before it
        if isinstance(x, str):
            w.text(x)
        else:
            yield render_one(x, w, False)
    w.block(1)
    width: dict[int, int] = {}
    grid: list[list[tuple[int, list[str], int]]] = []
    below: dict[int, int] = {}  # column -> rows to come that a cell above reaches into
    for row in rows:
        k, new = 0, {}
        grid.append([])
        for lines, span, down in row:
            while below.get(k):
                grid[-1].append((k, [], 1))
                k += 1
            grid[-1].append((k, lines, span))
            if span == 1:
                width[k] = max([width.get(k, 0), *(x for x in map(_wide, lines) if x <= WIDEST)])
            if down > 1:
                new |= dict.fromkeys(range(k, min(k + span, COLUMNS)), down - 1)
            k += span
        below = {c: n - 1 for c, n in below.items() if n > 1} | new
    for row in grid:
        for line in _row(row, width):
            w._open()
            w.line.append(line)
            w.end()


def render_one(c: Node, w: Writer, pre: bool) -> Iterator:
    tag = c.tag
    if tag == "br":
        if w.line:
            w.end()
        else:
            w.gap = max(w.gap, 2)
        return
    gap = 2 if tag in SPACED else 1 if tag in BLOCKS else 0
    if tag in ("ul", "ol", "menu", "dir") and w.indent:
        gap = 1  # a list in a list
    if gap:
        w.block(gap)
    if tag in ("td", "th") and w.line:  # a cell in a line
        w.line.append(" |")
        w.space = True
    if tag == "table" and w.tables < NESTED:
        yield _table(c, w)
    elif tag in ("ul", "ol", "menu", "dir"):
        k = 1 if c.start is None else c.start
        for x in c.children:
            if isinstance(x, Node) and x.tag == "li":
                k = k if x.start is None else x.start
                bullet = f"{k}. " if tag == "ol" else "- "
                k += 1
                w.block(1)
                w.indent += len(bullet)
                w.bullet = bullet
                yield render(x, w, pre)
                w.block(1)
                w.bullet = None
                w.indent -= len(bullet)
            elif isinstance(x, Node):
                yield render_one(x, w, pre)
            else:
                w.text(x)
    elif tag in ("blockquote", "dd"):
        w.indent += 2
        yield render(c, w, pre)
        w.end()
        w.indent -= 2
    else:
        yield render(c, w, pre or tag in ("pre", "textarea", "xmp"))
    if gap:
        w.block(gap)


def render(node: Node, w: Writer, pre: bool) -> Iterator:
    for c in node.children:
        if isinstance(c, Node):
            yield render_one(c, w, pre)
        elif pre:
            w.verbatim(c)
        else:
            w.text(c)


def page_text(source: str | None) -> str | None:
    """The visible text of a page; null for null."""
    if source is None:
        return None
    w = Writer()
    run(render(parse(source), w, False))
    return w.result()


def extract_text(pages: DataFrame, page_id: str = "page_id", source: str = "html", out: str = "text") -> DataFrame:
    """page_id and the visible text of each row; nothing is shuffled.

    Null pages give null, empty ones and ones without visible text ''. Whole pages are read,
    however long and deep, in time and with output in proportion to their length: indents, widths of
    columns and room in rows have bounds, beyond which texts stand closer, none is lost. Hidden are
    elements that aren't displayed (by tag, ``hidden`` or their style attribute), whatever is in
    them, and text that isn't visible, but for what is made visible again inside. Style sheets aren't
    applied: what only a rule for a class or id hides is text, and so is what a closed ``details``
    holds. Text in ``svg`` and ``math`` is text. Null ids stay null, repeated rows give repeated
    rows, other columns aren't looked at, and an empty table gives an empty one.
    """
    kind = pages.schema[page_id].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [page_text(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[page_id, out])

    return pages.select(page_id, pages[source].alias("html")).mapInArrow(scan, f"`{page_id}` {kind}, `{out}` string")
