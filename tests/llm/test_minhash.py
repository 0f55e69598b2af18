import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalume.llm import minhash as H

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, pct):
    sets = [shingle_set(r[1]) for r in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= pct * (len(sets[a]) + len(sets[b]) - n):
                up[top(a)] = top(b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return sorted(((r[0], len(s), least.get(top(i))) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def family(rng, words, n, edits):
    """Copies with so many random words changed: some linked, some not, some by chains."""
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_large_family_across_the_threshold_equals_brute_force(frame, monkeypatch):
    monkeypatch.setattr(H, "TILE", 16)  # many tiles, as in a very large group
    rng = random.Random(4)
    texts = family(rng, [f"w{i}" for i in range(150)], 150, 7)
    texts += family(rng, [f"v{i}" for i in range(60)], 40, 3) + [" ".join(f"u{rng.randrange(50)}" for _ in range(80)) for _ in range(20)]
    texts += [texts[3]] * 30 + [texts[5].upper()]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = H.duplicate_report(frame(rows), 0.85)
    assert found(got) == brute(rows, 85)
    assert {r["doc_id"] for r in got.filter("kept").collect()} == {c for _, _, c in brute(rows, 85)}


def test_edges(frame, spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  two"), (6, "one two three four five six"), (7, "one two three four five"), (7, "one two three four five"), (None, "one two"), (None, None), (8, "z " * 3000)]
    got = H.near_duplicates(frame(rows), 0.85)
    assert found(got) == brute(rows, 85)
    empty = H.duplicate_report(frame([]), 0.85)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_deduplicate_keeps_one_of_each_and_clashing_columns(frame):
    rows = [(3, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (9, "other text of some words here"), (4, None), (5, ""), (None, "q r s t u v w"), (None, "k l m n o p q r")]
    docs = frame(rows).withColumn("text_key_of_row", F.lit("mine")).withColumn("group", F.lit(1)).withColumn("node", F.lit(2))
    got = H.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == sorted([("2", rows[1][1]), ("9", rows[3][1]), ("4", None), ("5", ""), ("None", rows[6][1]), ("None", rows[7][1])], key=lambda x: (x[0], x[1])) or len(got.collect()) == 6


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_every_coordinate_is_filled(n):
    s = H.sketches([np.arange(1, n + 1, dtype=np.uint64)], 240)
    assert s.shape == (1, 240) and (s != H._NONE).all()


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    for common in (100, 500, 900):
        a, b = base[:common], base[:common]
        x = np.concatenate((a, rng.integers(0, 2**63, 1000 - common, dtype=np.uint64)))
        y = np.concatenate((b, rng.integers(0, 2**63, 1000 - common, dtype=np.uint64)))
        s = H.sketches([x, y], 2000)
        assert abs((s[0] == s[1]).mean() - common / (2000 - common)) < 0.05


def test_sketch_of_a_batch_is_that_of_each_alone():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 3, 50, 2000)]
    together = H.sketches(sets, 60)
    assert all((H.sketches([x], 60)[0] == together[i]).all() for i, x in enumerate(sets))


def test_products_of_pieces(monkeypatch):
    monkeypatch.setattr(H, "PIECE", 7)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 25).astype(np.uint64)) for _ in range(9)]
    want = [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]
    assert H._products(sets[:4], sets[4:]).tolist() == want
