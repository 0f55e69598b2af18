"""Periodic runs against all stretches of all periods."""

import binascii
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from catalume.llm import periodic


def plain_runs(words, least=12):
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - s >= q and i - s + q >= least:
                best.setdefault((s, i - s + q), q)
    return sorted((s, q, m) for (s, m), q in best.items())


def runs_of(texts, least=12):
    return [[(s, q, m) for s, m, q in r.tolist()] for r in periodic.block_runs([np.array(t, np.int32) for t in texts], least)]


def test_the_cover_holds_every_difference():
    v, d = periodic.MODULUS, periodic.COVER
    assert {(a - b) % v for a in d for b in d} == set(range(v))
    r = np.arange(v)
    s = periodic._STEPS
    assert all((x + s[x, y]) % v in d and (y + s[x, y]) % v in d for x in r for y in r) and s.max() < v


def test_pairs_of_the_grid():
    i, j = periodic._pairs(1, 50)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted((k - q, k) for q in range(1, 50) for k in range(q, 50, q))
    i, j = periodic._pairs(30, 50)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted((k - q, k) for q in range(1, 50) for k in range(q, 50, q) if k >= 30)


def some_text(rng):
    out = []
    while len(out) < rng.choice([0, 3, 30, 200, 400]):
        kind = rng.randrange(3)
        if kind == 0:
            out += [rng.randrange(1, 4) for _ in range(rng.randrange(20))]
        elif kind == 1:
            cycle = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 40))]
            out += (cycle * rng.randrange(1, 9))[: rng.randrange(1, 200)]
        else:
            out += [rng.randrange(1, 500) for _ in range(rng.randrange(40))]
    return out


def test_runs_are_those_of_all_periods():
    rng = random.Random(3)
    for least in (12, 2, 5):
        texts = [some_text(rng) for _ in range(60)]
        assert runs_of(texts, least) == [plain_runs(t, least) for t in texts]


def test_extensions_are_those_of_words():
    rng = random.Random(4)
    v = periodic.MODULUS
    t = [0] * v + [rng.randrange(1, 3) for _ in range(150)] + [7] * 300 + [0] * v
    e = periodic.Extensions(np.array(t, np.int32), np.zeros(len(t), np.int32))
    pairs = [(i, j) for i in range(v, v + 450, 3) for j in range(i + 1, v + 450, 7)]
    got = e.common(np.array([i for i, _ in pairs]), np.array([j for _, j in pairs]))
    for (i, j), n in zip(pairs, got.tolist(), strict=True):
        k = 0
        while t[i + k] == t[j + k] and t[j + k]:
            k += 1
        assert n == k


def test_long_texts_go_beyond_the_kept_grid(monkeypatch):
    monkeypatch.setattr(periodic, "KEPT", 64)
    monkeypatch.setattr(periodic, "_GRID", [])
    rng = random.Random(6)
    texts = [some_text(rng) for _ in range(30)]
    assert runs_of(texts) == [plain_runs(t) for t in texts]


def test_one_word_many_times():
    assert runs_of([[5] * 300_000]) == [[(0, 1, 300_000)]]


def plain_report(doc_id, text):
    words = (text or "").encode().split()
    h = binascii.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, q, m in runs for i in range(s + q, s + m)}
    s, q, m = min(runs, key=lambda r: (-r[2], r[0], r[1])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    lines = "".join(f"{s},{m},{q}\n" for s, q, m in runs).encode()
    return (doc_id, len(runs), s, m, q, 1000 * m // q if runs else None, sha(lines), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_report(frame):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{x}" for x in some_text(rng))) for i in range(120)]
    rows += [(None, None), (None, "a b c d e f g h " * 3), (7, ""), (8, " \n "), (9, "é ü\t" * 20), (9, "é ü\t" * 20), (-5, "x y\n" * 9)]
    got = [tuple(r) for r in periodic.run_report(frame(rows)).collect()]
    assert sorted(got, key=repr) == sorted((plain_report(*r) for r in rows), key=repr)
    assert periodic.run_report(frame([])).collect() == []


def test_other_columns_come_back(spark, frame, monkeypatch):
    monkeypatch.setattr(periodic, "BLOCK", 50)
    docs = frame([(i, "a b " * (i % 30)) for i in range(40)]).select("*", F.lit(1).alias("row"), F.lit("x").alias("runs"), F.lit(2).alias("number"))
    got = periodic.find_runs(docs).collect()
    assert {r["doc_id"]: (r["row"], r["number"], r["n_words"], r["collapsed"]) for r in got}[29] == (1, 2, 58, "a b")
    assert [tuple(r) for r in next(r for r in got if r["doc_id"] == 29)["runs"]] == [(0, 58, 2)]
