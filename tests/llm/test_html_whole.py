"""Whole pages: heads without an end, any depth, attributes of all kinds, tables and lists."""

import random
import re

import pytest

from catalume.llm import html_text


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<head><title>T</title>Hello <span>x</span> y<p>z", "Hello x y\n\nz"),
        ("<head><title>T</title><a href=q><div>in a</div></a>after", "in a\nafter"),
        ("<head><meta name=a><font><p>in font</p></font>", "in font"),
        ("<head>\n<style>s</style>\n<noscript>no</noscript> <template><b>t</b></template>\n<em>seen</em></head>", "seen"),
        ("<html><head><title>T</title></head> <body>b", "b"),
        ("<head><link rel=x><img src=y>text", "text"),
    ],
)
def test_a_head_ends_at_what_cannot_be_in_it(page, want):
    assert html_text.page_text(page) == want


@pytest.mark.parametrize("depth", [10, 149, 150, 160, 20_000])
def test_depth_changes_nothing(depth):
    deep = "<font>" * depth
    page = "<div style='display:none'>no<b>ne</b></div><p>a</p><ul><li>one<li>two</ul><table><tr><td>c<td>d<tr><td>long<td>e</table><span hidden>no</span>end"
    want = "a\n- one\n- two\n\nc    | d\nlong | e\n\nend"
    assert html_text.page_text(page) == want
    assert html_text.page_text(deep + page) == want
    assert html_text.page_text("<div>" * depth + "<b>x</b><span hidden><i>n</i></span>y" + "</div>" * depth + "z") == "xy\nz"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>one</p><a title=don't>hello</a> two three", "one\n\nhello two three"),
        ("<p>a</p><p class=\"x\"y'z>bc</p><p>next</p>", "a\n\nbc\n\nnext"),
        ("<p>one</p><!--> two <p>three</p>", "one\n\ntwo\n\nthree"),
        ("<p>one</p><!---> two", "one\n\ntwo"),
        ("a<!-- x --!>b", "ab"),
        ("<div>" * 200 + "<span style='display:none'>SECRET</span>vis", "vis"),
        ("<a href='x>y' title=\"1>2\">t</a>", "t"),
        ("<p title = 'a' hidden>no</p><p data-x=>yes</p>", "yes"),
        ("x</3 y>z</>w", "xzw"),
        ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
        ("<ol start=3><li>a<li value=7>b<li>c</ol>", "3. a\n7. b\n8. c"),
        ("<table><tr><td rowspan=2>top<td>b<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>", "top | b | c\n    | d | e\nf   | g | h"),
        ("<table><tr><td>a<td rowspan=0>down<tr><td>b<tr><td>c<td>late</table>", "a | down\nb\nc |      | late"),
    ],
)
def test_pages(page, want):
    assert html_text.page_text(page) == want


ATTRIBUTES = [" a=b", " title=don't", ' x="1 > 2"', " y='\"'", ' z="it\'s"', " lone", "/", " p = q", ' e="a"f=g', " u=a\"b'c", " =odd", ' c="<p>"', "\n k='<!--'"]


def test_random_pages_with_attributes_lose_and_show_nothing():
    """Each page is written with the list of its visible words; hidden ones are within hidden elements at any depth."""
    rng = random.Random(11)

    def write(depth, hidden, seen):
        out = []
        for _ in range(rng.randrange(1, 5)):
            if rng.random() < 0.4 or depth == 0:
                word = f"w{rng.randrange(10**6)}"
                out.append(f" {word} ")
                if not hidden:
                    seen.append(word)
            else:
                tag = rng.choice(["div", "span", "b", "section", "i", "article", "em"])
                hide = rng.random() < 0.15
                extra = "".join(rng.choice(ATTRIBUTES) for _ in range(rng.randrange(4)))
                mark = rng.choice([" hidden", ' style="display: none"', " style=visibility:hidden"]) if hide else ""
                out.append(f"<{tag}{extra}{mark}>{write(depth - 1, hidden or hide, seen)}</{tag}{rng.choice(['', ' ', ' x=1'])}>{rng.choice(['', '<!-- no -->', '<!-->', '<?x?>', '<!doctype y>'])}")
        return "".join(out)

    for _ in range(400):
        seen: list[str] = []
        page = write(rng.choice([1, 3, 6]), False, seen)
        assert re.findall(r"w\d+", html_text.page_text(page)) == seen, page


def test_clashing_columns_and_long_pages(spark):
    long = "<p class='x'>" + "word " * 200_000
    pages = spark.createDataFrame([(1, long, "x", None), (2, "<b>a", None, "y")], "page_id long, html string, text string, body string")
    got = dict(html_text.extract_text(pages.withColumn("start", pages["page_id"])).collect())
    assert got[2] == "a" and got[1].count("word") == 200_000
