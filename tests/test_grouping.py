"""Linkage, leaders, bursts and nearest vectors against sequential versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalume.operators import groups as G
from catalume.operators import linkage as L
from catalume.operators import nearest as N
from catalume.operators import sequence as Q
from catalume.operators import similarity as M
from catalume.operators.graph import connected_components, minimum_forest


def plain_linkage(sim, floor):
    """All pairs of clusters anew for each merger; the first of equal ones."""
    clusters = [[i] for i in range(len(sim))]
    while len(clusters) > 1:
        best, at = -2.0, None
        for (a, p), (b, q) in itertools.combinations(enumerate(clusters), 2):
            mean = sum(sim[x][y] for x in p for y in q) / (len(p) * len(q))
            if mean > best:
                best, at = mean, (a, b)
        if best < floor:
            break
        clusters[at[0]] += clusters.pop(at[1])
    return clusters


def random_component(rng, n):
    """Hashes in families, vectors of few values (many ties), some of them missing."""
    base = [rng.getrandbits(64) for _ in range(max(1, n // 4))]
    hashes = [rng.choice(base) ^ (1 << rng.randrange(64) if rng.random() < 0.5 else 0) for _ in range(n)]
    vecs = [None if rng.random() < 0.15 else [rng.choice((-0.5, 0.0, 0.5)) for _ in range(4)] for _ in range(n)]
    return [None if rng.random() < 0.1 else h for h in hashes], vecs


def similarities(hashes, vecs, t):
    n = len(hashes)
    sim = [[0.0] * n for _ in range(n)]
    for i, j in itertools.product(range(n), repeat=2):
        if hashes[i] is not None and hashes[j] is not None and bin(hashes[i] ^ hashes[j]).count("1") <= t:
            sim[i][j] = 1.0
        elif vecs[i] is not None and vecs[j] is not None:
            sim[i][j] = sum(x * y for x, y in zip(vecs[i], vecs[j], strict=True))
    return sim


def test_linkage_with_ties():
    rng = random.Random(1)
    for n in (3, 4, 7, 12, 30, 60):
        for _ in range(12 if n < 30 else 2):
            sim = similarities(*random_component(rng, n), 2)
            for floor in (0.2, 0.6, 0.9):
                assert sorted(map(sorted, L.average_linkage(np.array(sim, np.float32), floor))) == sorted(map(sorted, plain_linkage(sim, floor)))


def test_linkage_of_two_hundred():
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, size=(200, 6)) / 4
    sim = v @ v.T
    assert sorted(map(sorted, L.average_linkage(sim, 0.3))) == sorted(map(sorted, plain_linkage(sim.tolist(), 0.3)))


def test_linkage_of_many_is_quadratic():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3000, 16)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    parts = L.average_linkage(v @ v.T, 0.5)
    assert sorted(i for p in parts for i in p) == list(range(3000)) and 10 < len(parts) < 3000


@pytest.mark.parametrize("in_task", [10_000, 2])
def test_cohesion_split_in_tasks_and_in_rounds(spark, in_task):
    rng = random.Random(7)
    rows, want = [], set()
    for comp, n in enumerate((2, 3, 9, 25, 1)):
        hashes, vecs = random_component(rng, n)
        ids = [100 * comp + i for i in range(n)]
        rows += [(comp, i, i, None if h is None else f"{h:016x}", v) for i, h, v in zip(ids, hashes, vecs, strict=True)]
        parts = [list(range(n))] if n == 2 else plain_linkage(similarities(hashes, vecs, 2), 0.4)
        want |= {frozenset(ids[i] for i in p) for p in parts if len(p) > 1}
    df = spark.createDataFrame(rows, "component long, id long, ord long, phash string, embedding array<double>")
    got = {}
    for r in L.cohesion_split(df, 0.4, 2, in_task).collect():
        got.setdefault((r["component"], r["part"]), set()).add(r["id"])
    assert {frozenset(p) for p in got.values()} == want and len(want) > 4


def test_cohesion_split_of_nothing(spark):
    df = spark.createDataFrame([], "component long, id long, ord long, phash string, embedding array<double>")
    assert L.cohesion_split(df).collect() == []


@pytest.mark.parametrize("n", [0, 1, 3, 40, 300])
@pytest.mark.parametrize("t", [0, 3, 6])
def test_hamming_join_is_all_pairs(spark, n, t, monkeypatch):
    """Bits that differ are spread over several blocks; few pairs for a key make many blocks."""
    monkeypatch.setattr(M, "PAIRS_FOR_A_KEY", 4 if n < 300 else 1e-9)
    rng = random.Random(n)
    hashes = []
    for _ in range(n):
        h = rng.choice(hashes) if hashes and rng.random() < 0.8 else rng.getrandbits(64)
        for bit in rng.sample(range(64), rng.randrange(8)):
            h ^= 1 << bit
        hashes.append(h)
    df = spark.createDataFrame([(i, f"{h:016x}") for i, h in enumerate(hashes)] + [(n, None)], "id long, phash string")
    got = [tuple(r) for r in M.hamming_join(df, t=t).collect()]
    first = {}
    for i, h in enumerate(hashes):
        first.setdefault(h, i)
    want = {(first[h], i, 0) for i, h in enumerate(hashes) if first[h] < i}
    reps = sorted(first.values())
    want |= {(i, j, bin(hashes[i] ^ hashes[j]).count("1")) for i, j in itertools.combinations(reps, 2) if bin(hashes[i] ^ hashes[j]).count("1") <= t}
    assert sorted(got) == sorted(want)


def test_covering_codes():
    """Any two hashes that differ in t bits agree in a key; more hashes take more blocks, and few pairs meet by chance."""
    rng = random.Random(2)
    for n in (10, 10**4, 10**6, 10**9):
        _, keys = M._code(n, 6)
        for _ in range(300):
            diff = sum(1 << b for b in rng.sample(range(64), 6))
            assert any(diff & bits == 0 for bits, _ in keys)
    assert M._code(10, 6)[0] == 7 and len(M._code(10**9, 6)[1]) == 210


def plain_leaders(n, edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen, out = set(), {}
    for i in range(n):
        if i in seen:
            continue
        own = [j for j in near.get(i, ()) if j > i and j not in seen]
        seen |= {i, *own}
        out |= {j: i for j in (i, *own)} if own else {}
    return out


@pytest.mark.parametrize("in_task", [0, 5, 100_000])
def test_leaders(spark, in_task):
    rng = random.Random(9)
    for n, m in ((30, 25), (40, 90), (12, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + ([(i, i + 1) for i in range(8)] if m else [])
        edges = [(a, b) for a, b in edges if a != b]
        items = spark.createDataFrame([(i, i) for i in range(n)], "id long, ord long")
        got = {r["id"]: r["leader"] for r in G.leader_groups(spark.createDataFrame(edges, "i long, j long"), items, in_task).collect()}
        assert got == plain_leaders(n, edges)


def plain_runs(rows, gap, span, sim):
    """rows: id, t, vector, in order."""
    runs = []
    for i, t, v in sorted(rows, key=lambda r: (r[1], f"/{r[0]:09}")):
        if runs and t - runs[-1][-1][1] <= gap and t - runs[-1][0][1] <= span and float(np.dot(runs[-1][-1][2], v)) >= sim:
            runs[-1].append((i, t, v))
        else:
            runs.append([(i, t, v)])
    return [[i for i, _, _ in r] for r in runs]


def frames(spark, rows):
    return spark.createDataFrame([(i, f"/{i:09}", t, v) for i, t, v in rows], "id long, path string, capture_time double, embedding array<double>")


def runs_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["run"], set()).add(r["id"])
    return sorted(map(sorted, out.values()))


def test_burst_runs_are_those_of_a_fold(spark):
    rng = random.Random(4)
    for spread, gap, span in ((400, 8.0, 30.0), (90_000, 2_000.0, 30.0), (300, 8.0, 5.0), (200_000, 4_000.0, 100_000.0)):
        rows = [(i, float(rng.randrange(spread)), [1.0, 0.0] if rng.random() < 0.9 else [0.0, 1.0]) for i in range(250)]
        df = frames(spark, rows + [(900, None, [1.0, 0.0]), (901, 5.0, None)])
        assert runs_of(Q.burst_runs(df, gap=gap, span=span, sim=0.8)) == sorted(map(sorted, plain_runs(rows, gap, span, 0.8)))


def test_one_segment_of_many_rows(spark):
    n = 200_000
    df = spark.range(n).select("id", F.lpad(F.col("id").cast("string"), 9, "0").alias("path"), (F.col("id") * 3.0).alias("capture_time"), F.array(F.lit(1.0)).alias("embedding"))
    got = Q.burst_runs(df, gap=8.0, span=30.0, sim=0.5).groupBy("run").count().groupBy("count").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r["count"]: r["n"] for r in got} == {11: n // 11, n % 11: 1}


def plain_merge(rows, group_of, runs):
    """Unions in order of time; two sides that hold a group aren't joined."""
    atom = {i: f"g{group_of[i]}" if i in group_of else f"r{i}" for i, _, _ in rows}
    up, real = {}, {a: a[0] == "g" for a in atom.values()}

    def top(a):
        while a in up:
            a = up[a]
        return a

    for run in runs:
        for i in run[1:]:
            a, b = top(atom[run[0]]), top(atom[i])
            if a != b and not (real[a] and real[b]):
                up[b] = a
                real[a] |= real[b]
    out = {}
    for i in atom:
        out.setdefault(top(atom[i]), set()).add(i)
    return sorted(sorted(s) for s in out.values() if len(s) > 1)


def test_burst_merge_is_that_in_order_of_time(spark):
    rng = random.Random(5)
    for k in range(4):
        rows = [(i, float(rng.randrange(500)), [1.0]) for i in range(150)]
        group_of = {i: rng.randrange(25) for i in range(150) if rng.random() < (0.2, 0.5, 0.8, 0.0)[k]}
        runs = plain_runs(rows, 6.0, 30.0, 0.5)
        run_rows = [(i, n, rows[i][1]) for n, run in enumerate(runs) for i in run]
        order = {i: k for k, i in enumerate(sorted(range(150), key=lambda i: f"/{i:09}"))}
        got = {}
        x = G.burst_merge(spark.createDataFrame(sorted(order.items()), "id long, ord long"), spark.createDataFrame(list(group_of.items()), "id long, group long"), spark.createDataFrame(run_rows, "id long, run long, t double"))
        for r in x.collect():
            got.setdefault(r["group"], set()).add(r["id"])
        assert sorted(map(sorted, got.values())) == plain_merge(rows, group_of, runs)


def test_minimum_forest(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(40), rng.randrange(40), k) for k in rng.sample(range(1000), 120)]
    for root in (None, 7):
        up = {}

        def top(a):
            while a in up:
                a = up[a]
            return a

        want = set()
        for a, b, k in sorted(edges, key=lambda e: e[2]):
            if top(a) != top(b):
                up[top(a)] = top(b)
                want.add(k)
        assert {r["k"] for r in minimum_forest(spark.createDataFrame(edges, "a long, b long, k long"), ["k"], "a", "b", root).collect()} == want
    assert minimum_forest(spark.createDataFrame([], "a long, b long, k long"), ["k"], "a", "b").collect() == []


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_nearest_vectors(spark, broadcast):
    rng = random.Random(8)
    left = [(i, [rng.choice((-1.0, 0.0, 1.0)) for _ in range(3)]) for i in range(50)]
    right = [(100 + i, [rng.choice((-1.0, 0.0, 1.0)) for _ in range(3)], f"k{rng.randrange(5)}") for i in range(40)]
    a = spark.createDataFrame(left + [(99, None)], "id long, v array<double>")
    b = spark.createDataFrame(right + [(200, None, "k0")], "id long, v array<double>, kind string")

    def rows(df):
        return sorted((r["id"], r["rank"], r["other"], r["value"]) for r in df.collect())

    dots = {(i, j): sum(x * y for x, y in zip(v, u, strict=True)) for i, v in left for j, u, _ in right}
    want = [(i, k + 1, j, dots[i, j]) for i, _ in left for k, (j, _, _) in enumerate(sorted(right, key=lambda r: (-dots[i, r[0]], r[0]))[:3])]
    assert rows(N.nearest_vectors(a, b, 3, block=16, broadcast=broadcast)) == want
    assert rows(N.nearest_vectors(a, b, 3, floor=1.0, block=16, broadcast=broadcast)) == [w for w in want if w[3] >= 1]
    best = {}
    for i, _ in left:
        for j, _, kind in sorted(right):
            if max(dots[i, j], 0.0) > best.get((i, kind), (-9.0, 0))[0]:
                best[i, kind] = (max(dots[i, j], 0.0), j)
    want = [(i, k + 1, best[i, kind][1], best[i, kind][0]) for i, _ in left for k, kind in enumerate(sorted({x[2] for x in right}, key=lambda c: (-best[i, c][0], c))[:2])]
    assert rows(N.nearest_vectors(a, b, 2, by="kind", clip=0.0, block=16, broadcast=broadcast)) == want
    own = a.select("id", "v", (F.col("id") % 3).alias("g"))
    dots = {(i, j): sum(x * y for x, y in zip(v, u, strict=True)) for i, v in left for j, u in left}
    want = [(i, 1, min((-dots[i, j], j) for j, _ in left if j != i and j % 3 == i % 3)[1]) for i, _ in left]
    assert [w[:3] for w in rows(N.nearest_vectors(own, own, 1, group="g", apart=True, block=4))] == want


@pytest.mark.parametrize("block", [3, 2048])
def test_cosine_joins_are_all_pairs(spark, block):
    """Rows without time are one hot bucket; times before 0 and at the edges of buckets, too."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    t = [None if k % 3 == 0 else float(x) for k, x in enumerate(rng.choice([-700, -600, -1, 0, 5, 600, 601, 1200, 1800, 9000], 60))]
    rows = [(i, v[i].tolist(), t[i]) for i in range(60)] + [(60, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, capture_time double")
    alike = {(i, j): float(v[i] @ v[j]) for i, j in itertools.combinations(range(60), 2) if v[i] @ v[j] >= 0.6}
    near = {(i, j) for i, j in alike if abs((t[i] or 0.0) - (t[j] or 0.0)) <= 600}
    got = [tuple(r) for r in M.cosine_window_join(df, sim=0.6, block=block).collect()]
    assert sorted((i, j) for i, j, _ in got) == sorted(near) and all(abs(c - alike[i, j]) < 1e-9 for i, j, c in got)
    assert sorted((r["i"], r["j"]) for r in M.cosine_all_pairs(df, sim=0.6, block=block).collect()) == sorted(alike)
    assert M.cosine_window_join(df.limit(0)).collect() == []


def test_free_names_are_those_of_one_after_the_other(spark):
    rng = random.Random(3)
    names = ["a.jpg", "a_1.jpg", "a_2.jpg", "a_7.jpg", "b", "b_1", "c_x.png", "a_01.jpg", ".hid"]
    existing = sorted({(f"/d{rng.randrange(2)}", rng.choice(names)) for _ in range(9)})
    moves = [(i, f"/d{rng.randrange(2)}", rng.choice(["a.jpg", "b", "c_x.png", ".hid"])) for i in rng.sample(range(1000), 60)]
    got = {r["id"]: r["dest"] for r in Q.unique_names(spark.createDataFrame(moves, "id long, dir string, name string"), spark.createDataFrame(existing, "dir string, name string")).collect()}
    taken, want = set(existing), {}
    own = {(d, n) for _, d, n in moves}
    for i, d, n in sorted(moves):
        stem, dot, suf = n.rpartition(".") if "." in n[1:] else (n, "", "")
        k, name = 0, n
        while (d, name) in taken or (k and (d, name) in own):
            k += 1
            name = f"{stem}_{k}{dot}{suf}"
        taken.add((d, name))
        want[i] = name
    assert got == want


def test_many_files_of_one_name(spark):
    n = 100_000
    moves = spark.range(n).select("id", F.lit("/d").alias("dir"), F.lit("x.jpg").alias("name"))
    existing = spark.range(0, n, 2).select(F.lit("/d").alias("dir"), F.concat(F.lit("x_"), (F.col("id") + 1).cast("string"), F.lit(".jpg")).alias("name"))
    got = Q.unique_names(moves, existing)
    k = F.coalesce(F.regexp_extract("dest", r"_(\d+)", 1).try_cast("long"), F.lit(0))
    row = got.agg(F.count_distinct("dest").alias("n"), F.sum((k % 2).cast("long")).alias("odd"), F.max(k).alias("top"), F.min(k).alias("low")).first()
    # odd numbers below n are taken: even ones first, then all
    assert (row["n"], row["low"], row["odd"], row["top"]) == (n, 0, n // 4, n + n // 2 - 1)


def test_blocks_by_nearness_lose_no_pair(spark):
    """Rows in bunches: most pairs of blocks are left out, no pair of rows is."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    v = np.repeat(centres, 25, 0) + rng.normal(size=(300, 16)) * 0.15
    v[7] = 0
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    want = sorted((i, j) for i, j in itertools.combinations(range(300), 2) if v[i] @ v[j] >= 0.9)
    got = sorted((r["i"], r["j"]) for r in M.cosine_all_pairs(df, sim=0.9, block=12).collect())
    assert got == want and len(want) > 1000
    rows, pairs = M.near_blocks(df.filter("id != 7").select("id", F.col("embedding").alias("v")), 0.9, 12)
    blocks = rows.select("p").distinct().count()
    assert pairs.count() < 0.4 * blocks * (blocks - 1) / 2


@pytest.mark.parametrize("in_task", [0, 25, 10**6])
def test_components_in_rounds_and_in_one_task(spark, in_task):
    rng = random.Random(in_task)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7), (None, 3)]
    top = {}
    for a, b in edges:
        for x in (a, b):
            top.setdefault(x, {x})
        if a is not None and a != b and top[a] is not top[b]:
            both = top[a] | top[b]
            top.update(dict.fromkeys(both, both))
    want = {x: min(s) for x, s in top.items() if x is not None and len(s) > 1}
    assert {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), in_task=in_task).collect()} == want
    named = spark.createDataFrame([(str(a), str(b)) for a, b in edges[:60]], "a string, b string")
    assert {r["component"] for r in connected_components(named, in_task=in_task).collect()} == {"0"}
    assert connected_components(spark.createDataFrame([], "a long, b long"), in_task=in_task).count() == 0
