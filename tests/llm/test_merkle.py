"""Merkle manifest against a plain tree."""

import binascii
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from catalume.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def above(nodes):
    """The levels above nodes, up to one node."""
    out = [nodes]
    while len(out[-1]) > 1:
        below = out[-1]
        out.append([digest(*below[i : i + 3]) for i in range(0, len(below), 3)])
    return out


def way(levels, i):
    """For each level the nodes before and after in the run."""
    out = []
    for below in levels[:-1]:
        a = i - i % 3
        out.append((below[a:i], below[i + 1 : a + 3]))
        i //= 3
    return out


def plain(rows):
    """rows: doc_id, text, lang, source, n_chars."""
    by = {}
    for d, text, lang, source, n in rows:
        own = (d, source, lang, n, text)
        even = binascii.crc32(b"" if d is None else str(d).encode()) % 2 == 0
        seen = (d, source, lang, n, text.replace("\n", "") if even and text is not None else text)
        by.setdefault(source, []).append((d is not None, d or 0, leaf(own), leaf(seen)))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: above([x[2] for x in sorted(by[s])]) for s in names}
    top = above([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (known, d, h, seen) in enumerate(sorted(by[s])):
            path = way(trees[s], i) + way(top, k)
            at = seen
            for a, b in path:
                at = digest(*a, at, *b)
            out.append((d if known else None, h, trees[s][-1][0], top[-1][0], digest(*(x for a, b in path for x in a + b)), at, at == top[-1][0], s))
    return out


def check(spark, docs, rows):
    got = [tuple(r) for r in merkle.manifest_report(docs).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)


def as_rows(docs):
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_random_tables(spark, frame):
    rng = random.Random(5)
    for n in (1, 2, 4, 40):
        rows = [(rng.randrange(-50, 50), "\n".join("ab" for _ in range(rng.randrange(4))), rng.choice(["en", None]), rng.choice(["a", "é", "b", None])) for _ in range(n)]
        docs = frame(rows)
        check(spark, docs, as_rows(docs))


@pytest.mark.parametrize("height", [1, 2, 3])
def test_superblocks_of_any_height_give_the_same(spark, frame, height):
    docs = frame([(i, f"text\n{i}", "en", "hot" if i % 3 else f"s{i % 11}") for i in range(200)])
    rounds = {(r["doc_id"], r["root"], r["folded_root"], tuple(r["places"]), tuple(map(bytes, r["siblings"]))) for r in merkle.manifest(docs, height=height).collect()}
    whole = {(r["doc_id"], r["root"], r["folded_root"], tuple(r["places"]), tuple(map(bytes, r["siblings"]))) for r in merkle.manifest(docs).collect()}
    assert rounds == whole and len(whole) == 200


def test_nulls_repeated_rows_and_empty_tables(spark, frame):
    rows = [(None, None, None, None), (None, "", "en", None), (3, "x\ny", "en", "s"), (3, "x\ny", "en", "s"), (3, "x\ny", "en", "s"), (3, "z", None, "s"), (2**62, "q" * 100_000 + "\n", "en", "s")]
    docs = frame(rows)
    check(spark, docs, as_rows(docs))
    assert merkle.manifest_report(frame([])).collect() == []


def test_columns_of_any_name_are_left_alone(spark, frame):
    docs = frame([(i, f"a\n{i}") for i in range(9)])
    more = docs.select("*", *[F.lit("x").alias(c) for c in ("leaf", "node", "root", "pos", "n", "at", "part", "seen", "order", "group", "block")])
    check(spark, more, as_rows(docs))


def test_a_changed_row_is_found(spark, frame):
    docs = frame([(i, f"text {i}", "en", f"s{i % 4}") for i in range(60)])
    x = merkle.manifest(docs, seen={"text": F.when(F.col("doc_id") == 17, F.lit("other")).otherwise(F.col("text"))})
    assert {r["doc_id"] for r in x.filter("not verified").collect()} == {17}
