"""Pages against a plain second reader, hidden and visible text, and pages made to be slow or to grow."""

import random
import time

import pytest

from catalume.llm import html_text

SPACE = " \t\n\f\r"
FLOW = ("div", "p", "ul", "ol", "table", "h1", "blockquote")


def tokens(page):
    """Characters one by one: ('text', t), ('open', tag, {name: value}), ('shut', tag)."""
    state, text, tag, attrs, name, value, quote, closing = "text", "", "", {}, "", "", "", False
    for c in page + "\0":
        if state == "text":
            if c in "<\0":
                if text:
                    yield "text", text
                text, tag, attrs, closing, state = "", "", {}, False, "tag"
            else:
                text += c
        elif state == "tag" and c == "/" and not tag:
            closing = True
        elif state == "tag" and c not in SPACE + ">":
            tag += c.lower()
        elif state == "value" and quote:
            if c == quote:
                attrs.setdefault(name, value)
                name, value, quote, state = "", "", "", "space"
            else:
                value += c
        elif state == "value" and not value and c in "'\"":
            quote = c
        elif c == ">" or c in SPACE:
            if name:
                attrs.setdefault(name, value)
            name, value, state = "", "", "space"
            if c == ">":
                yield ("shut", tag) if closing else ("open", tag, attrs)
                state = "text"
        elif state == "value":
            value += c
        elif c == "=" and name:
            state = "value"
        else:
            name, state = name + c.lower(), "name"


def tree(page):
    """[tag, shown, children]; an element that isn't displayed has the tag 'none'."""
    root = ["root", True, []]
    path = [root]

    def shut(tag, stops):
        for k in range(len(path) - 1, 0, -1):
            if path[k][3] == tag:
                del path[k:]
                return
            if path[k][3] in stops:
                return

    root.append("root")
    for kind, what, *rest in tokens(page):
        if kind == "text":
            if path[-1][1]:
                path[-1][2].append(what)
        elif kind == "shut":
            shut(what, {"table": (), "tr": ("table",)}.get(what, ("table", "td")))
        else:
            if what in FLOW:
                shut("p", ("table", "td", "li"))
            if what == "li":
                shut("li", ("ul", "ol", "table", "td"))
            elif what == "tr":
                shut("tr", ("table",))
            elif what == "td":
                shut("td", ("table", "tr"))
            style = rest[0].get("style", "").replace(" ", "")
            shown = False if "visibility:hidden" in style else True if "visibility:visible" in style else path[-1][1]
            node = ["none" if "hidden" in rest[0] or "display:none" in style else what, shown, [], what]
            path[-1][2].append(node)
            if what != "br":
                path.append(node)
    return root


class Plain:
    def __init__(self):
        self.lines, self.run, self.gap, self.bullet, self.indent = [], "", 0, "", 0

    def flush(self, gap):
        words = " ".join(self.run.split())
        if words:
            self.put(words)
        self.run, self.gap = "", max(self.gap, gap)

    def put(self, line):
        if self.gap == 2 and self.lines and not self.bullet:
            self.lines.append("")
        self.lines.append((" " * (self.indent - len(self.bullet)) + self.bullet + line).rstrip())
        self.gap, self.bullet = 0, ""

    def read(self, node):
        number = 0
        for c in node[2]:
            if isinstance(c, str):
                self.run += c
                continue
            tag = c[0]
            if tag == "none":
                continue
            if tag == "br":
                blank = not self.run.strip()
                self.flush(2 if blank else 0)
                continue
            gap = {"div": 1, "li": 1, "p": 2, "h1": 2, "table": 2, "blockquote": 2}.get(tag, 0)
            gap = (1 if self.indent else 2) if tag in ("ul", "ol") else gap
            if gap:
                self.flush(gap)
            if tag == "li":
                number += 1
                mark = f"{number}. " if node[0] == "ol" else "- "
                self.indent, self.bullet = self.indent + len(mark), mark
                self.read(c)
                self.flush(1)
                self.indent, self.bullet = self.indent - len(mark), ""
            elif tag == "table":
                self.table(c)
            elif tag == "blockquote":
                self.indent += 2
                self.read(c)
                self.flush(0)
                self.indent -= 2
            else:
                self.read(c)
            if gap:
                self.flush(gap)

    def table(self, node):
        rows = []
        for tr in node[2]:
            if isinstance(tr, list) and tr[0] == "tr":
                rows.append([])
                for td in tr[2]:
                    if isinstance(td, list) and td[0] == "td":
                        inner = Plain()
                        inner.read(td)
                        inner.flush(0)
                        rows[-1].append([x for x in inner.lines if x])
        wide = [max((len(x) for r in rows for x in (r[k] if k < len(r) else [])), default=0) for k in range(max(map(len, rows), default=0))]
        for r in rows:
            for i in range(max(map(len, r), default=0)):
                line = " | ".join((c[i] if i < len(c) else "").ljust(wide[k]) for k, c in enumerate(r)).rstrip()
                if line.strip(" |"):
                    self.put(line)


def plain_text(page):
    p = Plain()
    p.read(tree(page))
    p.flush(0)
    return "\n".join(p.lines).strip("\n")


def write(rng, depth, place):
    """A random part of a page; end tags that may be missing are missing at times."""
    out = []
    for _ in range(rng.randrange(1, 4)):
        if depth == 0 or rng.random() < 0.4:
            out.append(rng.choice([" ", "", "\n"]) + f"w{rng.randrange(100)}" + rng.choice([" ", "", "<br>", "<br><br>"]))
            continue
        tag = rng.choice(["span", "b"] if place == "p" else ["div", "p", "span", "b", "ul", "ol", "table", "h1", "blockquote"])
        extra = rng.choice(["", "", "", " hidden", " style='display: none'", ' style="visibility:hidden"', " style=visibility:visible", " title='a > b' data-x=\"<p>\""])
        if tag in ("ul", "ol"):
            body = "".join(f"<li{rng.choice(['', '', extra])}>{write(rng, depth - 1, 'li')}{rng.choice(['', '</li>'])}" for _ in range(rng.randrange(1, 4)))
        elif tag == "table":
            body = "".join("<tr>" + "".join(f"<td>{write(rng, depth - 1, 'td')}{rng.choice(['', '</td>'])}" for _ in range(rng.randrange(1, 4))) + rng.choice(["", "</tr>"]) for _ in range(rng.randrange(1, 4)))
        else:
            body = write(rng, depth - 1, "p" if tag in ("p", "h1", "span", "b") else place)
        out.append(f"<{tag}{extra}>{body}" + ("" if tag == "p" and rng.random() < 0.3 else f"</{tag}>"))
    return "".join(out)


def test_random_pages_equal_those_of_the_plain_reader():
    rng = random.Random(5)
    tables = lists = 0
    for _ in range(1500):
        page = write(rng, rng.choice([1, 2, 3, 4]), "body")
        want = plain_text(page)
        assert html_text.page_text(page) == want, page
        tables, lists = tables + (" | " in want), lists + ("- " in want)
    assert tables > 100 and lists > 100


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div style='visibility:hidden'>a<span style='visibility:visible'>SEEN</span></div>b", "SEEN\nb"),
        ("<div style='display:none'>a<span style='visibility:visible;display:block'>no</span></div>b", "b"),
        ("<p style='visibility:visible;visibility:hidden'>no<p style='visibility:hidden!important;visibility:visible'>no<p style='visibility:odd'>yes", "yes"),
        ("<p style='my-display:none'>a<p style='/* x */ display : NONE'>no<p hidden style='display:block'>b<p style='display:none;display:odd'>no", "a\n\nb"),
        ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "x=1"),
        ("<svg><title>no</title><defs><text>no</text></defs><text>one</text><circle r=1 /><text>two</text></svg> after", "one\ntwo\nafter"),
        ("<table><tr><td>a in<table><tr><td>n1<td>m<tr><td>n2<td>mmm</table><td>b<tr><td>c<td>d</table>", "a in     | b\nn1 | m   |\nn2 | mmm |\nc        | d"),
        ("<table><tr><td>漢字<td>a<tr><td>abc<td>b<tr><td>é<td>c</table>", "漢字 | a\nabc  | b\né    | c"),
        ("<table><tr><td>a<ul><li>x<li>y</ul><td>b</table>", "a   | b\n- x |\n- y |"),
        ("x</1 rubbish", "x"),
        ("a&#99999999999999999999999999;b&#65;", "a�bA"),
        ("a&#" + "9" * 5000 + ";b", "a�b"),
        ("<style>.x{display:none}</style><p class=x>only a rule hides it", "only a rule hides it"),
    ],
)
def test_seen_and_unseen(page, want):
    assert html_text.page_text(page) == want


@pytest.mark.parametrize(
    "part",
    ["</1", "<script></script ", "<ul><li>x", "<blockquote>x", "<table><tr><td>long text<td>x", "<tr><td rowspan=0>x", "<td>x<td colspan=100>y<tr>", "<td>x<br>", "<!--", "<svg><g>", "<p style='display:", "&#9", "<p><table></p>"],
)
def test_time_and_text_grow_with_the_page(part):
    def measure(n):
        start = time.process_time()
        out = html_text.page_text("<table><tr><td>" + part * n if "<td" in part else part * n)
        return time.process_time() - start, len(out)

    (t1, n1), (t4, n4) = measure(2_500), measure(10_000)
    assert n4 <= 5 * n1 + 1_000 and n4 <= 100 * len(part) * 10_000
    assert t4 <= 10 * t1 + 0.2, (t1, t4)  # quadratic: 16 times


def test_no_text_is_lost_where_room_ends():
    words = [f"w{i}" for i in range(600)]
    for page in (
        "<table><tr>" + "".join(f"<td>{w}" + " x" * 30 for w in words) + "<tr><td>last</table>",
        "<table><tr>" + "".join(f"<td>{w}<br>y" for w in words) + "<tr><td>last</table>",
        "".join(f"<table><tr><td>{w}<td>y" for w in words) + " last",
        "".join(f"<ul><li>{w}" for w in words) + " last",
        "<table>" + "".join(f"<tr><td rowspan=0>{w}" for w in words) + "<tr><td>last</table>",
    ):
        got = html_text.page_text(page).split()
        assert [w for w in got if w[0] in "wl"] == [*words, "last"], page[:60]
