"""Decontamination, tokens, HTML and chat."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catalume.llm import chat, decontam, html_text, tokens

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(decontam.ITEM_WORD, (t or "").translate(LOW))


def brute(text, items, window):
    w, hit, found = words(text), set(), set()
    for name, t in items:
        iw = words(t)
        k = min(window, len(iw))
        wins = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if iw else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i : i + k]) in wins:
                hit |= set(range(i, i + k))
                found.add(name)
    return len(w), len(hit), {f for f in found if f is not None}


@pytest.mark.parametrize("part_words", [200_000, 40])
def test_overlaps_equal_brute_force(frame, spark, part_words):
    rng = random.Random(2)
    say = lambda n, v=4: " ".join(rng.choice("abcdefgh"[:v]) for _ in range(n))
    items = [(i, say(rng.randrange(1, 14), 3)) for i in range(25)] + [(100, None), (101, ""), (102, "!!"), (3, "a a b"), (None, "c c c"), (103, "É é, B-c")]
    docs = [(i, say(rng.randrange(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, "x é É b C y"), (102, "x É é b C y"), (103, "a " * 5000)]
    it = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_overlaps(frame(docs).select("doc_id", "text"), it, 6, part_words=part_words).collect()
    assert len(got) == len(docs)
    want = Counter((d, t, *(lambda x: (x[0], x[1], tuple(sorted(map(str, x[2])))))(brute(t, items, 6))) for d, t in docs)
    assert Counter((r["doc_id"], r["text"], r["n_words"], sum(b - a for a, b in r["hit_spans"]), tuple(r["hit_items"])) for r in got) == want


def test_report_digest_and_empty(frame, spark):
    it = spark.createDataFrame([(10, "one two"), (9, "two three")], "item_id long, text string")
    r = decontam.overlap_report(frame([(1, "One two three"), (2, None)]), it).orderBy("doc_id").collect()
    assert (r[0]["n_hit"], r[0]["n_items"], r[0]["items_sha256"], r[0]["contaminated"]) == (3, 2, decontam.items_digest(["10", "9"]), True)
    assert (r[1]["n_words"], r[1]["items_sha256"], r[1]["contaminated"]) == (0, decontam.items_digest([]), False)
    assert decontam.overlap_report(frame([]), it).count() == 0
    assert not decontam.overlap_report(frame([(1, "One")]), it.limit(0)).first()["contaminated"]


def test_decontaminate_cuts_and_drops(frame, spark):
    item = " ".join(f"q{i}" for i in range(20))
    it = spark.createDataFrame([(1, item)], "item_id long, text string")
    body = " ".join(f"w{i}" for i in range(60))
    docs = frame([(1, f"{body}. {item}! Then {body}"), (2, item), (3, body), (4, None), (5, " ".join(item.split()[:9]) + " " + body)]).withColumn("n_words", F.lit(-1)).withColumn("row", F.lit("r")).withColumn("spans", F.lit("s"))
    got = {r["doc_id"]: r for r in decontam.decontaminate(docs, it).collect()}
    assert sorted(got) == [1, 3, 4, 5]
    assert got[1]["text"] == f"{body}. ! Then {body}" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[3]["text"] == body and got[3]["n_words"] == -1 and got[3]["row"] == "r" and got[4]["text"] is None
    assert "q8" in got[5]["text"]


def greedy(word, pieces):
    n = i = 0
    longest = max(map(len, pieces), default=1)
    while i < len(word):
        k = next((k for k in range(min(longest, len(word) - i), 1, -1) if word[i : i + k] in pieces), 1)
        n, i = n + 1, i + k
    return n


def test_longest_match_equals_greedy():
    rng = random.Random(6)
    for _ in range(60):
        pieces = {bytes(rng.choices(b"abc", k=rng.randrange(2, 7))) for _ in range(rng.randrange(25))}
        m = tokens.LongestMatch(sorted(pieces))
        for _ in range(80):
            w = bytes(rng.choices(b"abcd", k=rng.randrange(0, 25)))
            assert m.count(w) == greedy(w, pieces), (pieces, w)


def test_token_counts(frame, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    pieces = [b" the", b" th", b"an", b" a", "é".encode()]
    docs = [(1, "the than  é\nthe"), (2, None), (3, ""), (4, "x" * 50_000), (4, "x" * 50_000), (None, "a")]
    got = Counter(tuple(r) for r in tokens.token_counts(frame(docs), pieces).collect())
    def want(t):
        n = [greedy(b" " + w.encode(), set(pieces)) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        return len(n), sum(n), max(n, default=0)
    assert got == Counter((d, *want(t)) for d, t in docs)
    assert tokens.token_counts(frame([]), pieces).count() == 0
    monkeypatch.setattr(tokens, "MOST_PIECES", 2)
    with pytest.raises(ValueError):
        tokens.token_counts(frame(docs), pieces)


PAGES = [
    ("<p>One<p>Two <b>bold</b>  text", "One\n\nTwo bold text"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>end", "- a\n- b\n  3. c\n  4. d\n\nend"),
    ("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td colspan=2>all</table>", "Name      | N\nlong name | 1\nall"),
    ("<head><title>t</title><script>var a='</p>';</script></head><body>x<br>y<div>z</div></body>", "x\ny\nz"),
    ("a<span hidden>no<b>no</b></span>b<i style='display: NONE'>no</i><i title='display:none'>c</i>", "abc"),
    ("<pre>  two\n   lines</pre><p>&lt;tag&gt; &amp;copy &eacute;</p>", "  two\n   lines\n\n<tag> &copy é"),
    ("<!-- <p>no</p> -->5 < 6 & 7 > 3<![CDATA[x]]>", "5 < 6 & 7 > 3x"),
    ("</div>stray</b> ok<p>unclosed <a href='x>y'>link", "stray ok\n\nunclosed link"),
    ("", ""),
    ("<p></p><div> </div>", ""),
    ("<blockquote>q1<br>q2</blockquote>after", "  q1\n  q2\n\nafter"),
    ("<dl><dt>t<dd>d1<dd>d2</dl>", "t\n  d1\n  d2"),
    ("<p>in <span>para<div>block</div>", "in para\n\nblock"),
    ("<textarea>a <b></textarea><style>p{}</style>", "a <b>"),
    ("<table><caption>Cap</caption><tbody><tr><td>a</td><td><table><tr><td>in<td>ner</table></td></tr></table>", "Cap\na | in | ner"),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_pages(page, want):
    assert html_text.page_text(page) == want


def test_deep_and_broken_pages_lose_no_text():
    assert html_text.page_text("<div>" * 5000 + "deep" + "</div>" * 5000 + "after") == "deep\nafter"
    rng = random.Random(1)
    parts = ["<p>", "</p>", "<li>", "<ul>", "</ul>", "<td>", "<tr>", "<table>", "</table>", "<b>", "</b>", "<div>", "</div>", "<", ">", "&", "<a href=\"", "'", "<!--", "-->"]
    for _ in range(300):
        html_text.page_text("".join(rng.choice([*parts, " w1 "]) for _ in range(40)))
    for _ in range(200):
        body = "".join(rng.choice([*parts[:13], " w ", " w "]) for _ in range(40))
        assert html_text.page_text(body).count("w") == body.count("w"), body


def test_extract(spark):
    pages = spark.createDataFrame([(1, "<p>x", "t"), (1, "<p>x", "t"), (2, None, "t"), (None, "", "t")], "page_id long, html string, text string")
    got = sorted(((r["page_id"], r["text"]) for r in html_text.extract_text(pages).collect()), key=str)
    assert got == sorted([(1, "x"), (1, "x"), (2, None), (None, "")], key=str)
    assert html_text.extract_text(pages.limit(0)).count() == 0


TURNS = "pair_id long, turn long, role string, text string"


def test_preferences(spark):
    a = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "good"), (2, 0, "user", "q"), (3, 0, "user", None), (3, 1, None, "x"), (5, 0, "user", "only chosen"), (6, 0, "user", "same"), (6, 1, "assistant", "same")]
    b = [(1, 5, "system", "s"), (1, 6, "user", "q"), (1, 7, "assistant", "bad"), (1, 8, "user", "why"), (2, 0, "user", "other"), (3, 0, "user", None), (3, 1, None, "x"), (3, 2, "assistant", "é"), (6, 0, "user", "same"), (6, 1, "assistant", "same")]
    got = {r["pair_id"]: r for r in chat.format_preferences(spark.createDataFrame(a, TURNS), spark.createDataFrame(b, TURNS)).collect()}
    r = got[1]
    assert (r["n_common"], r["prompt"], r["chosen"], r["rejected"]) == (2, "<|system|>\ns\n<|user|>\nq\n", "<|assistant|>\ngood\n", "<|assistant|>\nbad\n<|user|>\nwhy\n")
    spoken = lambda t, m: [t[s["start"] : s["end"]] for s in m]
    assert spoken(r["chosen"], r["chosen_mask"]) == ["good\n"] and spoken(r["rejected"], r["rejected_mask"]) == ["bad\n"]
    assert got[2]["n_common"] == 0 and got[2]["prompt"] == ""
    assert (got[3]["n_common"], got[3]["chosen"], got[3]["chosen_mask"]) == (2, "", []) and spoken(got[3]["rejected"], got[3]["rejected_mask"]) == ["é\n"]
    assert (got[5]["n_common"], got[5]["rejected"]) == (0, "") and (got[6]["n_common"], got[6]["chosen"], got[6]["rejected"]) == (2, "", "")
    none = spark.createDataFrame([], TURNS)
    assert chat.format_preferences(none, none).count() == 0


def test_swapped_answers(spark):
    t = [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (0, 2, "user", "c"), (0, 3, "assistant", "d"), (0, 4, "user", "e"), (14, 0, "user", "f"), (14, 1, "assistant", "g"), (2, 0, "user", "alone"), (None, 0, "assistant", "i"), (None, None, None, None)]
    docs = spark.createDataFrame(t, "conv_id long, turn long, role string, text string").withColumn("rank", F.lit("x")).withColumn("own", F.lit(1))
    got = {r["conv_id"]: r for r in chat.preference_report(docs).collect()}
    assert set(got) == {0, 14, 2, None}
    own = {0: "d", 14: "g", None: "i"}
    order = sorted(own, key=lambda i: hashlib.md5(("" if i is None else str(i)).encode()).hexdigest())
    other = {order[0]: own[order[1]], order[1]: own[order[0]], order[2]: None}
    say = lambda x: "" if x is None else f"<|assistant|>\n{x}\n"
    after = {0: "<|user|>\ne\n", 14: "", None: ""}
    for i in own:
        if other[i] is not None:
            assert (got[i]["chosen"], got[i]["rejected"]) == (say(own[i]) + after[i], say(other[i]) + after[i]), i
            assert got[i]["chosen_mask"] == "14-16"
    last = got[order[2]]
    assert last["chosen"].startswith(say(own[order[2]])) and say(own[order[2]]) not in last["rejected"]
    assert (got[2]["n_common"], got[2]["chosen"], got[2]["rejected"]) == (1, "", "")


def test_every_conversation_makes_a_pair_also_with_long_and_repeated_turns(spark):
    t = [(f"c{i}", k, "user" if k % 2 else "assistant", "long " * 20_000 if i == 3 else f"t{i}") for i in range(30) for k in range(3)]
    got = chat.preference_report(spark.createDataFrame(t + t[:6], "conv_id string, turn long, role string, text string")).collect()
    assert len(got) == 30 and all(r["rejected"] != "" for r in got)
