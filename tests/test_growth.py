"""Steps whose work has to grow with the input, and results that only larger tables told apart."""

import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from catalume.functions.scores import face_quality
from catalume.operators import linkage as L
from catalume.operators import similarity as M
from catalume.operators.edits import vote_names
from catalume.operators.groups import cull_safe
from catalume.operators.nearest import BLOCKS, LARGEST, blocks_of
from catalume.sources.ingest import resolve_paths


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_hashes_are_not_broadcast(spark):
    df = spark.range(300).selectExpr("id", "substr(md5(cast(id as string)), 1, 16) as phash")
    plan = plan_of(M.hamming_join(df, t=6).filter("d > 0"))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def rows_shuffled(node):
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return rows_shuffled(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return rows_shuffled(node.plan())
    own, below = node.metrics().get("shuffleRecordsWritten"), node.children()
    return (own.get().value() if own.isDefined() and kind == "ShuffleExchangeExec" else 0) + sum(rows_shuffled(below.apply(k)) for k in range(below.size()))


def test_a_hash_is_not_sent_for_each_key(spark, monkeypatch):
    """With ten blocks a hash has 210 keys; it is sent to seven cells, and for its id."""
    monkeypatch.setattr(M, "PAIRS_FOR_A_KEY", 1e-9)
    n = 2000
    df = M.hamming_join(spark.range(n).selectExpr("id", "substr(md5(cast(id - id % 3 as string)), 1, 15) || id % 3 as phash"), t=6).filter("d > 0")
    assert len(M._code(n, 6)[1]) == 210 and len(df.collect()) >= n - 2
    assert rows_shuffled(df._jdf.queryExecution().executedPlan()) <= 12 * n


def all_pairs(hashes, t):
    reps = sorted({h: i for i, h in reversed(list(enumerate(hashes)))}.values())
    near = [(i, j, (hashes[i] ^ hashes[j]).bit_count()) for i, j in itertools.combinations(reps, 2)]
    first = {hashes[i]: i for i in reps}
    return sorted([x for x in near if x[2] <= t] + [(first[h], i, 0) for i, h in enumerate(hashes) if first[h] < i])


def hashes_of(n, bits, seed):
    """Half of them near another one, in some of the bits alone."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        h = rng.choice(out) if out and rng.random() < 0.5 else rng.getrandbits(64) & bits
        for bit in rng.sample([k for k in range(64) if bits >> k & 1], rng.randrange(8)):
            h ^= 1 << bit
        out.append(h)
    return out


@pytest.mark.parametrize("bits", [(1 << 64) - 1, ((1 << 39) - 1) << 25, (1 << 20) - 1, 0x0F0F0F0F0F0F0F0F])
@pytest.mark.parametrize("t", [3, 6])
def test_hot_cells_of_hashes_are_cut(spark, t, bits, monkeypatch):
    """Cells of more hashes than a task takes are cut into parts, long runs of a key get keys of their own: every pair once."""
    for name, value in (("CELL", 20), ("LARGEST_CELL", 60), ("LONG", 16), ("HANDED", 50)):
        monkeypatch.setattr(M, name, value)
    hashes = hashes_of(250, bits, t)
    hashes += hashes[:20]
    df = spark.createDataFrame([(i, f"{h:016x}") for i, h in enumerate(hashes)], "id long, phash string")
    assert sorted(map(tuple, M.hamming_join(df, t=t).collect())) == all_pairs(hashes, t)


@pytest.mark.parametrize("bits", [(1 << 64) - 1, ((1 << 39) - 1) << 25])
def test_long_runs_of_a_key(bits, monkeypatch):
    monkeypatch.setattr(M, "LONG", 16)
    x = np.unique(np.array(hashes_of(600, bits, 4), np.uint64))
    b, keys = M._code(10**8, 6)  # as in a large table, of which these are a part
    got = sorted((min(p, q), max(p, q)) for ps, qs in M._near_by_keys(x, 6, M._blocks_of_bits(b), keys) for p, q in zip(ps.tolist(), qs.tolist(), strict=True))
    assert got == sorted((p, q) for p, q in itertools.combinations(x.tolist(), 2) if (p ^ q).bit_count() <= 6)


def test_hamming_join_of_odd_rows(spark):
    """Ids that are no numbers, come twice or are missing; hashes that differ behind their 64 bits, in case, or are too short."""
    zero, one, far = "0" * 16, "0" * 15 + "1", "f" * 16
    df = spark.createDataFrame([("b", zero), ("a", one), ("b", far), ("c", far.upper()), ("b", "f" * 15 + "e"), (None, "f" * 15 + "7"), ("d", zero + "0"), ("e", "00"), ("f", "00"), ("g", None)], "id string, phash string")
    got = sorted(map(tuple, M.hamming_join(df, t=6).collect()))
    assert got == [("a", "b", 1), ("a", "d", 1), ("b", "c", 0), ("b", "d", 0), ("e", "f", 0)]


def test_quality_is_rounded_as_doubles_are(spark):
    """0.55 * 0.1 + 0.25 * 0.455 + 0.2 * 0.41 and the like lie just below a half, or at it."""
    rows = [(s / 10, e / 100, 0.1 * (50 + 4 * q) / w * 10) for s in range(9) for e in range(100) for q in range(1, 51, 7) for w in (4000, 5000, 6000)]
    df = spark.createDataFrame(rows, "s double, e double, r double")
    got = [(tuple(r)[:3], r["q"]) for r in df.select("s", "e", "r", face_quality(F.col("s"), F.col("e"), F.col("r")).alias("q")).collect()]
    con = duckdb.connect()
    want = [con.execute("select round(0.55 * ?::double + 0.25 * least(1.0, ?::double / 0.10) + 0.20 * ?::double, 4)", [s, r, e]).fetchall()[0][0] for (s, e, r), _ in got[::9]]
    assert [q for _, q in got[::9]] == want


def test_products_of_unit_vectors_are_taken_as_they_are(spark):
    v = np.random.default_rng(1).normal(size=(60, 8))
    v = (v / np.linalg.norm(v, axis=1)[:, None] * 1.0000004).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, embedding array<float>")
    for block in (4, 100):
        got = {(r["i"], r["j"]): r["cos"] for r in M.cosine_all_pairs(df, sim=0.3, block=block, normalize=False).collect()}
        c = v.astype(float) @ v.astype(float).T
        assert set(got) == {(i, j) for i in range(60) for j in range(i + 1, 60) if c[i, j] >= 0.3}
        assert all(abs(got[p] - c[p]) < 1e-12 for p in got)


def test_number_of_blocks_is_bounded(spark):
    n = [r[0] for r in spark.createDataFrame([(1,), (4096,), (10**5,), (600_000,), (10**7,)], "n long").select(blocks_of(F.col("n"), 2048)).collect()]
    assert n == [1, 2, BLOCKS, BLOCKS, -(-(10**7) // LARGEST)]


def test_rescue_in_blocks(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 6))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = [(i, i % 9, float(i % 9) * 300, float(i * 37 % 900), 0.0, float(i * 37 % 900) + 5, 5.0, 0.99, [float(x) for x in v[i]]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, image_id long, capture_time double, x1 double, y1 double, x2 double, y2 double, prob double, v array<double>")
    left, right = df.filter("id % 3 = 0").withColumn("t", F.col("capture_time")), df.filter("id % 3 != 0 and id < 40").withColumn("t", F.col("capture_time"))
    for window, least in ((600.0, 0.7), (None, 0.9)):
        c = v @ v.T >= least
        want = {i for i in range(0, 400, 3) for j in range(40) if j % 3 and c[i, j] and i % 9 != j % 9 and (window is None or abs(i % 9 - j % 9) * 300 <= window)}
        for block in (5, 1000):
            assert {r["id"] for r in M._touching(left, right, least, window, block).collect()} == want


def test_sources_are_chosen_in_tasks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.integers(0, 60)), 3000 + 1000 * (i % 2), 3000, i % 3, [float(x) for x in rng.integers(0, 12, 2)]) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, capture_time double, w int, h int, orientation int, preview array<double>")
    want = set()
    for i, t, w, h, o, p in rows:
        near = [(sum(abs(x - y) for x, y in zip(p, q)) / 2, abs(t - u), u, j) for j, u, w2, h2, o2, q in rows if i != j and j % 3 and o == o2 and abs(t - u) <= 8 and 0.95 <= (w * h2) / (h * w2) <= 1.05]
        want |= {(i, s[3], s[0], r + 1) for r, s in enumerate(sorted(s for s in near if s[0] <= 5)[:2])}
    for block in (7, 20_000):
        x = M.burst_sources(df, df.filter("id % 3 != 0").select("id"), difference=5.0, block=block)
        assert {tuple(r) for r in x.collect()} == want
        assert "CoGroup" in plan_of(x)


def test_items_without_a_row_in_the_ledger_do_not_share_a_key(spark):
    """Only paths are keys of joins that keep items; rows of the ledger meet each other first."""
    im = spark.createDataFrame([(1, "/a", "h"), (2, "/b", "h"), (3, "/c", None)], "id long, path string, content_hash string")
    led = spark.createDataFrame([(5, "/b", "/t/b", "trashed", "h"), (6, "/c", "/t/b", "trashed", "h")], "id long, from_path string, trash_path string, state string, hash string")
    x = resolve_paths(im, im.filter("id = 1").select("path"), led)
    assert {tuple(r) for r in x.collect()} == {(1, "/a", "h", None), (3, "/t/b", None, "h")}
    assert not [line for line in plan_of(x).splitlines() if "Join" in line and "LeftOuter" in line and "trash_path" in line]


def test_equal_boxes_vote_once_and_count_all(spark):
    m = spark.createDataFrame([(i, i % 2, "h", 0.0, 0.0, 10.0, 10.0) for i in range(50)], "id long, cluster_id long, hash string, x1 double, y1 double, x2 double, y2 double")
    a = m.filter("id < 10").select("hash", "x1", "y1", "x2", "y2", F.lit("Ann").alias("name")).union(m.filter("id < 5").select("hash", "x1", "y1", "x2", F.lit(8.0), F.lit("Bob")))
    x = vote_names(m, a)
    assert [tuple(r) for r in x.collect()] == [(0, "Ann")]
    assert "max(name" in plan_of(x)


def test_rounds_of_linkage_look_only_where_something_merged(spark, monkeypatch):
    """A cluster keeps its partner until one of both merges; one without a partner is done; few clusters are merged to the end in a task."""
    rng = np.random.default_rng(5)
    v = np.repeat(rng.normal(size=(4, 16)), 9, axis=0) + 0.4 * rng.normal(size=(36, 16))
    v = np.concatenate((v, rng.normal(size=(4, 16))))
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(1, i, i, None, [float(x) for x in v[i]]) for i in range(40)], "component long, id long, ord long, phash string, embedding array<double>")
    looked = []
    nearest = L.nearest_vectors

    def counted(left, right, *args, **kwargs):
        looked.append((left.count(), right.count()))
        return nearest(left, right, *args, **kwargs)

    monkeypatch.setattr(L, "nearest_vectors", counted)
    got = {}
    for r in L.cohesion_split(df, 0.8, 2, in_task=16).collect():
        got.setdefault(r["part"], set()).add(r["id"])
    want = {frozenset(p) for p in L.average_linkage(v @ v.T, 0.8) if len(p) > 1}
    assert {frozenset(p) for p in got.values()} == want and len(want) >= 4
    assert looked[0] == (40, 40) and 2 <= len(looked) <= 4 and looked[1][0] < looked[1][1] <= 36, looked


def test_first_of_equal_rounded_values_is_the_best(spark):
    v = [[1.0, 0.0], [0.6 + 2e-11, 0.8], [0.6, 0.8], [0.6 + 4e-11, -0.8]]
    df = spark.createDataFrame(list(enumerate(v)), "id long, v array<double>").withColumn("g", F.lit(0).cast("long"))
    got = {r["id"]: (r["other"], r["value"]) for r in L.nearest_vectors(df, df, group="g", apart=True, digits=9, floor=0.5, block=2).collect()}
    assert got == {0: (1, 0.6), 1: (2, 1.0), 2: (1, 1.0), 3: (0, 0.6)}


def test_groups_are_summed_up_before_hashes_meet(spark):
    """Against all pairs: groups decided by their bits, by their least and greatest hash, and only by pairs of others."""
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for g in range(200):
        base, n = int(rng.integers(0, 2**63)) * 2, int(rng.integers(1, 7))
        hashes = [base ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 4)), replace=False)) if rng.random() < 0.9 else None for _ in range(n)]
        times = [float(rng.integers(1, 10)) if rng.random() < 0.98 else None for _ in range(n)]
        ok = None not in times and max(times) - min(times) <= 7 and all((a ^ b).bit_count() <= 3 for a in hashes for b in hashes if a is not None and b is not None)
        for h, t in zip(hashes, times, strict=True):
            want[len(rows)] = ok
            rows.append((len(rows), g, None if h is None else f"{h:016x}", t))
    rows.append((len(rows), None, "0" * 16, 1.0))
    df = spark.createDataFrame(rows, "id long, dup_group long, phash string, capture_time double")
    x = cull_safe(df, "dup_group", span=7.0, t=3)
    assert {r["id"]: r["dup_cull_safe"] for r in x.collect()} == want and 20 < sum(want.values()) < len(want) - 20
    assert not [line for line in plan_of(x).splitlines() if "Join" in line and "phash" in line]
