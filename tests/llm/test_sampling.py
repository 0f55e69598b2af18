"""Mixing and sharding."""

import binascii
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from catalume.llm import mixing, sharding


def jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2147483648.0 / ((key >> 33) + 1)))
    return b


def test_jump_is_the_published_function(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *(random.Random(1).randrange(-(2**63), 2**63) for _ in range(200))]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 8, 9, 100, 1000):
        got = {r["k"]: r["s"] for r in df.select("k", sharding.jump_shard(F.col("k"), n).alias("s")).collect()}
        assert got == {k: jump(k, n) for k in keys}


def test_growth_moves_only_into_the_new_shard(frame):
    rows = [(i, f"text {i % 7}") for i in range(3000)]
    got = sharding.shard_manifest(frame(rows), 8).collect()
    moved = [r for r in got if r["shard"] != r["grown_shard"]]
    assert all(r["grown_shard"] == 8 for r in moved) and 200 < len(moved) < 480
    assert min(Counter(r["shard"] for r in got).values()) > 280


def test_manifest(frame):
    rows = [(i, "é" * (i % 5)) for i in range(40)] + [(None, None), (None, "x"), (3, "same"), (3, "same"), (3, "same")]
    got = sharding.shard_manifest(frame(rows), 3).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    r = next(r for r in got if r["doc_id"] == 4)
    assert (r["size"], r["text_crc32"], r["law"]) == (9, binascii.crc32("éééé".encode()), "key")
    n = next(r for r in got if r["doc_id"] is None and r["text_crc32"] is None)
    assert n["size"] == 1 and n["shard"] == jump(0, 3)
    assert sharding.shard_manifest(frame([]), 3).count() == 0


def water(sizes, weights, share, most):
    """Targets by handing the excess on until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_targets_and_takes(frame):
    rng = random.Random(3)
    names = [*[f"s{i}" for i in range(6)], "é", "Z", None]
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([0, 5, 40, 400]))), "en", rng.choice([names[0], *names])) for i in range(900)] + [(5000, None, "en", "s1")] * 3
    got = mixing.mix_report(frame(rows)).collect()
    assert len(got) == len(rows) and sorted((r["doc_id"], r["size"]) for r in got) == sorted((r[0], len((r[1] or "").split())) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = water(sizes, (3, 1, 2), 1.5, 2.0)
    source = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 2 * 400 for s in sizes)
    again = mixing.mix_report(frame(rows).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_emits_what_is_planned(frame):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randrange(30)), "en", rng.choice("abc")) for i in range(200)] + [(7, "same row", "en", "a")] * 5 + [(None, "no id", None, None)]
    docs = frame(rows).withColumn("row_key", F.lit("mine"))
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    plan = Counter()
    for r in mixing.plan_mix(docs).collect():
        plan[r["doc_id"]] += r["copies"]
    by_id = Counter()
    for (i, _), n in got.items():
        by_id[i] += n
    assert sum(got.values()) == sum(plan.values()) and by_id == Counter({k: v for k, v in plan.items() if v})


def test_mix_leaves_columns_of_any_name_and_type_alone(frame):
    rows = [(i, "w " * (i % 7 + 1), "en", "ab"[i % 2]) for i in range(60)] + [(7, "same", "en", "a")] * 4 + [(99, "long " * 50_000, "en", "b")]
    docs = frame(rows)
    names = ["_own", "_i", "_nth", "_copies", "_equal", "_plan_doc", "row_key", "copies", "own", "row", "nth", "of_key", "size", "kind", "part", "target"]
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(n), F.col("doc_id").cast("string")))
    docs = docs.withColumn("extras", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("parts", F.array(F.struct(F.col("text").alias("copies"))))
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    got = out.collect()
    plan = mixing.plan_mix(frame(rows)).agg(F.sum("copies")).first()[0]
    assert len(got) == plan and all(r[n] == f"{n}{r['doc_id']}" for r in got for n in names) and all(r["extras"] == {"k": r["doc_id"]} for r in got)


def test_mix_of_nothing(frame):
    assert mixing.mix_report(frame([])).count() == 0 and mixing.mix(frame([])).count() == 0
    none = mixing.mix_report(frame([(1, None, "en", "a"), (2, "", "en", None)])).collect()
    assert [(r["taken"], r["target"]) for r in none] == [(0, 0.0)] * 2
