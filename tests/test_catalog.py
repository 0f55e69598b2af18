"""Semantics on tiny tables, with the default thresholds."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalume.functions import scores as S
from catalume.functions import text as X
from catalume.operators import decisions as D
from catalume.operators import edits as E
from catalume.operators import filters as C
from catalume.operators import groups as G
from catalume.operators import sequence as Q
from catalume.operators import similarity as M
from catalume.operators.graph import connected_components
from catalume.sources import ingest as I

ITEM = "id long, path string, phash string, embedding array<double>, capture_time double"


def unit(deg):
    return [math.cos(math.radians(deg)), math.sin(math.radians(deg))]


def groups_of(df, key="dup_group"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], set()).add(r["id"])
    return sorted(map(sorted, (v for k, v in out.items() if k is not None)))


def far_hash(i):
    random.seed(i)
    return f"{random.getrandbits(64):016x}"


def items(spark, rows):
    return spark.createDataFrame([(i, f"/p{i:03d}.jpg", h, v, t) for i, (h, v, t) in enumerate(rows)], ITEM)


def test_equal_hash_a_day_apart(spark):
    df = items(spark, [("f" * 16, None, 0.0), ("f" * 16, None, 86400.0)])
    assert groups_of(G.assign_duplicates(df)) == [[0, 1]]


@pytest.mark.parametrize(("dt", "want"), [(100.0, [[0, 1]]), (10000.0, [])])
def test_cosine_window(spark, dt, want):
    df = items(spark, [("0" * 16, unit(0), 1.0), ("f" * 16, unit(1), 1.0 + dt)])
    assert groups_of(G.assign_duplicates(df)) == want


def test_chain_breaks_into_pairs(spark):
    df = items(spark, [(far_hash(i), unit(d), 100.0 * i) for i, d in enumerate((0, 20, 40, 60))])
    assert groups_of(G.assign_duplicates(df, burst_gap=-1.0)) == [[0, 1], [2, 3]]


def test_tight_triple_and_its_centre(spark):
    df = items(spark, [(far_hash(i), unit(d), 1.0 + i) for i, d in enumerate((0, 8, 16))])
    rows = {r["id"]: r for r in G.assign_duplicates(df).collect()}
    assert len(rows) == 3 and max(rows, key=lambda i: rows[i]["dup_central"]) == 1


def test_burst_rescue_and_span_cap(spark):
    look = [unit(0), unit(31), unit(62), unit(93)]
    near = items(spark, [(far_hash(i), look[i], 10.0 + 2 * i) for i in range(4)])
    assert groups_of(G.assign_duplicates(near)) == [[0, 1, 2, 3]]
    assert groups_of(G.assign_duplicates(near, burst_gap=-1.0)) == []
    wide = items(spark, [(far_hash(i), look[i], 1.0 + 20 * i) for i in range(4)])
    assert all(len(g) < 4 for g in groups_of(G.assign_duplicates(wide, burst_gap=25.0)))


def test_burst_never_fuses_groups(spark):
    df = items(spark, [("0" * 16, unit(0), 1.0), ("0" * 16, unit(0), 2.0), ("f" * 16, unit(30), 4.0), ("f" * 16, unit(30), 5.0)])
    assert groups_of(G.assign_duplicates(df)) == [[0, 1], [2, 3]]


def test_hamming_join_is_brute_force(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    hashes = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base] + base[:10]
    df = spark.createDataFrame([(i, f"{h:016x}") for i, h in enumerate(hashes)], "id long, phash string")
    got = {tuple(r) for r in M.hamming_join(df, t=6).collect()}
    first = {}
    for i, h in enumerate(hashes):
        first.setdefault(h, i)
    want = {(first[h], i, 0) for i, h in enumerate(hashes) if first[h] < i}
    reps = sorted(first.values())
    want |= {(i, j, bin(hashes[i] ^ hashes[j]).count("1")) for i in reps for j in reps if i < j and bin(hashes[i] ^ hashes[j]).count("1") <= 6}
    assert got == want


def test_components_of_long_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_leader_groups_are_not_transitive(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    hashes = [base]
    for _ in range(30):
        hashes.append(hashes[rng.randrange(len(hashes))] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    hashes += hashes[3:8]
    df = spark.createDataFrame([(i, f"{h:016x}") for i, h in enumerate(hashes)], "id long, phash string")
    got = {r["id"]: r["leader"] for r in G.hash_leaders(df, 4).collect()}
    seen, want = set(), {}
    for i, h in enumerate(hashes):
        if i in seen:
            continue
        own = [j for j in range(i + 1, len(hashes)) if j not in seen and bin(h ^ hashes[j]).count("1") <= 4]
        seen |= {i, *own}
        want |= {j: i for j in (i, *own)} if own else {}
    assert got == want


def test_average_linkage_against_plain(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(14, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    sim = v @ v.T
    clusters = [[i] for i in range(14)]
    while len(clusters) > 1:
        best = max((np.mean([sim[x, y] for x in p for y in q]), -a, -b) for a, p in enumerate(clusters) for b, q in enumerate(clusters) if a < b)
        if best[0] < 0.3:
            break
        clusters[-best[1]] += clusters.pop(-best[2])
    assert sorted(map(sorted, G.average_linkage(sim, 0.3))) == sorted(map(sorted, clusters))


@pytest.mark.parametrize(("gap", "n"), [(120.0, 2), (600.0, 1), (5.0, 0)])
def test_regroup_by_gap(spark, gap, n):
    rows = [(i, f"/{i}.jpg", f"h{i}", float(t)) for i, t in enumerate((1000, 1010, 1020, 1320, 1330))] + [(9, "/9.jpg", "h9", None)]
    df = spark.createDataFrame(rows, "id long, path string, content_hash string, capture_time double")
    got = {r["id"]: r["scene_group"] for r in E.regroup_scenes(df, gap).collect()}
    assert len({v for v in got.values() if v is not None}) == n and got[9] is None


def test_merge_and_split_survive_regrouping(spark):
    rows = [(i, f"/{i}.jpg", f"h{i}", float(t)) for i, t in enumerate((1000, 1010, 1020, 1320, 1330))]
    df = spark.createDataFrame(rows, "id long, path string, content_hash string, capture_time double")
    pins = spark.createDataFrame([(1, "h0"), (1, "h4")], "group_id long, hash string")
    merged = {r["id"]: r["scene_group"] for r in E.regroup_scenes(df, 120.0, pins).collect()}
    assert len(set(merged.values())) == 1
    cuts = spark.createDataFrame([("h1", 1010.0), ("h0", 1000.0)], "anchor_hash string, capture_time double")
    cut = {r["id"]: r["scene_group"] for r in E.regroup_scenes(df, 120.0, None, cuts).collect()}
    assert cut[0] != cut[1] == cut[2] and cut[3] == cut[4] and len(set(cut.values())) == 3


def test_segments_equal_one_global_window(spark):
    rng = random.Random(2)
    t, rows = 0.0, []
    for i in range(400):
        t += rng.choice([5, 60, 120, 121, 4000, 90000])
        rows.append((i, f"/{i:04d}", t))
    df = spark.createDataFrame(rows, "id long, path string, capture_time double")
    got = {r["id"]: r["scene_group"] for r in Q.segment_scenes(df, big=120.0, small=120.0).collect()}
    seg, segs = [rows[0]], []
    for r in rows[1:]:
        if r[2] - seg[-1][2] > 120:
            segs.append(seg)
            seg = []
        seg.append(r)
    segs.append(seg)
    want, k = {}, 0
    for s in segs:
        want |= {r[0]: k if len(s) > 1 else None for r in s}
        k += len(s) > 1
    assert got == want


IMG = "id long, path string, filename string, content_hash string, combined double, portrait double, dup_group long, dup_cull_safe boolean, decision string, trash_state string"


def cull(spark, rows):
    df = spark.createDataFrame([(i, f"/{h}{i}", f"{h}{i}", h, c, None, 0, safe, d, None) for i, (h, c, safe, d) in enumerate(rows)], IMG)
    plan, review = D.cull_plan(df)
    return {r["id"]: r["decision"] for r in plan.collect()}, review.first()["needs_review"]


def test_autocull(spark):
    assert cull(spark, [("a", 0.8, True, None), ("b", 0.6, True, None)]) == ({0: "keep", 1: "del"}, False)
    assert cull(spark, [("a", 0.8, False, None), ("a", 0.7, False, None), ("c", 0.6, False, None)]) == ({0: "keep", 1: "del"}, True)
    assert cull(spark, [("a", 0.8, True, None), ("b", 0.8, True, None)]) == ({}, True)
    assert cull(spark, [("a", 0.8, True, None), ("b", 0.6, True, "keep")]) == ({}, True)
    assert cull(spark, [("a", 0.8, True, None), ("a", 0.6, True, "keep")]) == ({0: "del", 1: "keep"}, False)
    assert cull(spark, [("a", 0.8, True, None), ("b", None, True, None)]) == ({}, True)


def test_clean_tags(spark):
    raw = "1. Sunset, 2) beach;4k video\n- 35mm film, SUNSET., , one two three four five, " + "x" * 41
    got = spark.createDataFrame([(raw,)], "t string").select(X.clean_tags(F.col("t"), 4).alias("o")).first()["o"]
    assert got == ["sunset", "beach", "4k video", "35mm film"]


def test_scores(spark):
    x = spark.sql("select 40.0D as lo, 15000.0D as hi, 700.0D as mid, cast(null as double) as n")
    r = x.select(S.calibrated_sharpness(F.col("lo")), S.calibrated_sharpness(F.col("hi")), S.keeper_score(F.lit(0.5), F.col("n")), S.portrait_score(F.lit(0.5), F.col("n")), S.hamming64(F.lit("f" * 16), F.lit("0" * 16)), S.face_quality(F.col("n"), F.col("n"), F.lit(0.05))).first()
    assert list(r) == [0.0, 1.0, 0.5, 0.5, 64, 0.5]


def test_filters(spark):
    df = spark.createDataFrame([(1, "/a/x.jpg", "keep", None, 0.5), (2, "/a/b/y.jpg", None, "trashed", None), (3, "/ab/z.jpg", "del", None, 0.9)], "id long, path string, decision string, trash_state string, combined double")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(C.in_folder(df, "/a")) == [1, 2] and ids(C.in_folder(df, "/a", False)) == [1]
    assert ids(C.decision_in(df, C.verdicts("new,KEEP"))) == [1, 2] and ids(C.decision_in(df, set())) == [1, 2, 3]
    assert ids(C.lifecycle_in(df, set())) == [1, 3] and ids(C.lifecycle_in(df, {"active", "trashed"})) == [1, 2, 3]
    assert ids(C.score_range(df, "combined")) == [1, 2, 3] and ids(C.score_range(df, "combined", 0.0, 0.8)) == [1]


def test_unique_names(spark):
    moves = spark.createDataFrame([(1, "d", "a.jpg"), (2, "d", "a.jpg"), (3, "d", "a_1.jpg"), (4, "d", "b")], "id long, dir string, name string")
    have = spark.createDataFrame([("d", "a.jpg"), ("d", "b")], "dir string, name string")
    got = {r["id"]: r["dest"] for r in Q.unique_names(moves, have).collect()}
    assert len(set(got.values())) == 4 and got[3] == "a_1.jpg" and got[4] == "b_1" and {got[1], got[2]} == {"a_2.jpg", "a_3.jpg"}


def test_report_round_trip(spark, tmp_path):
    doc = {"folder": "/x", "images": [{"path": "/x/a.jpg", "filename": "a.jpg", "combined": 0.8, "tags": ["t"], "faces": [{"bbox": [1.0, 2.0, 3.0, 4.0], "prob": 0.9, "cluster_id": 0}]}, {"path": "/x/b.jpg", "combined": None}]}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    header, images, faces, tags = I.read_report(spark, str(tmp_path / "r.json"))
    assert header.first()["folder"] == "/x" and [r["id"] for r in images.orderBy("id").collect()] == [1, 2]
    assert [(r["image_id"], r["x2"]) for r in faces.collect()] == [(1, 3.0)] and [tuple(r) for r in tags.collect()] == [(1, "t")]
    out = str(tmp_path / "out")
    I.write_report(images, faces, tags, {"folder": "/x"}, out)
    assert spark.read.json(f"{out}/header").first().asDict() == {"folder": "/x", "total_images": 2, "duplicate_groups": 0, "scene_groups": 0, "faces_images": 1, "face_clusters": 1}
    again = I.read_report_folder(spark, out)
    for before, after in zip((images, faces, tags), again[1:], strict=True):
        rows = lambda d, cols=before.columns: sorted(map(str, d.select(*cols).collect()))
        assert rows(before) == rows(after)


def test_discover(spark, tmp_path):
    for p in ("a.JPG", "b.txt", "sub/c.png", "_trash/d.jpg", "sub/_rejected/e.jpg", "_Trash/f.cr3", "g.ORF", "h.bmp", ".jpg"):
        (tmp_path / p).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / p).write_bytes(b"x")
    names = lambda r: sorted(x["path"].rsplit("/", 1)[1] for x in I.discover(spark, [str(tmp_path)], recurse=r).collect())
    assert names(True) == ["a.JPG", "c.png", "g.ORF", "h.bmp"] and names(False) == ["a.JPG", "g.ORF", "h.bmp"]


def test_rescue_needs_another_photo(spark):
    schema = "id long, image_id long, capture_time double, x1 double, y1 double, x2 double, y2 double, prob double, v array<double>"
    cand = spark.createDataFrame([(1, 10, 100.0, 0.0, 0.0, 5.0, 5.0, 0.96, unit(58)), (2, 11, 90000.0, 0.0, 0.0, 5.0, 5.0, 0.96, unit(58)), (3, 10, 100.0, 0.0, 0.0, 5.0, 5.0, 0.90, unit(0)), (4, 12, 95000.0, 50.0, 50.0, 60.0, 60.0, 0.99, unit(40))], schema)
    anchors = spark.createDataFrame([(9, 20, 0.0, 0.0, 0.0, 5.0, 5.0, 0.99, unit(0))], schema)
    got = {r["id"]: r["round"] for r in M.rescue_faces(cand, anchors).collect()}
    assert got == {1: 1, 4: 1, 2: 2}


def test_merge_people_survives_and_keeps_the_name_of_the_target(spark):
    schema = "id long, image_id long, x1 double, y1 double, x2 double, y2 double, prob double, cluster_id long, sharp double, expr double"
    faces = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9, 3, 0.5, 0.5), (2, 2, 0.0, 0.0, 10.0, 10.0, 0.8, 4, 0.5, 0.5), (3, 2, 50.0, 0.0, 60.0, 10.0, 0.7, 5, 0.5, 0.5)], schema)
    images = spark.createDataFrame([(1, "h1", 1, None, None, None), (2, "h2", 2, None, None, None)], "id long, content_hash string, n_faces long, face_sharp double, face_expr double, portrait double")
    clusters = spark.createDataFrame([(3, None), (4, "Ann"), (5, "Bob")], "cluster_id long, name string")
    none = spark.createDataFrame([], "hash string, bbox string, action string, cluster_id long, target_hash string, target_bbox string")
    anchors = spark.createDataFrame([("h2", 0.0, 0.0, 10.0, 10.0, "Ann"), ("h2", 50.0, 0.0, 60.0, 10.0, "Bob")], "hash string, x1 double, y1 double, x2 double, y2 double, name string")
    f, people, over, anc = E.merge_people(faces, images, clusters, none, anchors, [4], 3)
    assert {r["id"]: r["cluster_id"] for r in f.collect()} == {1: 3, 2: 3, 3: 5}
    assert {r["cluster_id"]: r["name"] for r in people.collect()} == {3: None, 5: "Bob"}
    assert [tuple(r) for r in over.collect()] == [("h2", "0.0,0.0,10.0,10.0", "assign", 3, "h1", "0.0,0.0,10.0,10.0")]
    assert [r["name"] for r in anc.collect()] == ["Bob"]
    new = faces.withColumn("cluster_id", F.col("cluster_id") + 10)  # another run of the detector
    after, _ = E.replay_overrides(new, images, over.withColumn("ord", F.lit(1).cast("long")))
    assert {r["id"]: r["cluster_id"] for r in after.collect()} == {1: 13, 2: 13, 3: 15}
    left, items, unknown = E.delete_faces(faces, images, spark.createDataFrame([(2,), (99,)], "id long"))
    assert left.count() == 3 and [r["id"] for r in unknown.collect()] == [99]
    left, items, _ = E.delete_faces(faces, images, spark.createDataFrame([(2,)], "id long"))
    assert sorted(r["id"] for r in left.collect()) == [1, 3] and {r["id"]: r["n_faces"] for r in items.collect()} == {1: 1, 2: 1}


def test_override_replay_reads_untouched_detections(spark):
    faces = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9, 3, 0.5, 0.5), (2, 2, 0.0, 0.0, 10.0, 10.0, 0.9, 4, 0.5, 0.5)], "id long, image_id long, x1 double, y1 double, x2 double, y2 double, prob double, cluster_id long, sharp double, expr double")
    images = spark.createDataFrame([(1, "h1", 1, None, None, None), (2, "h2", 1, None, None, None)], "id long, content_hash string, n_faces long, face_sharp double, face_expr double, portrait double")
    ov = spark.createDataFrame([("h1", "0.0,0.0,10.0,10.0", "assign", None, "h2", "0.0,0.0,10.0,10.0", 1), ("h2", "1.0,0.0,10.0,10.0", "assign", None, "h1", "0.0,0.0,10.0,10.0", 2)], "hash string, bbox string, action string, cluster_id long, target_hash string, target_bbox string, ord long")
    after, items_ = E.replay_overrides(faces, images, ov)
    assert {r["id"]: r["cluster_id"] for r in after.collect()} == {1: 4, 2: 3}
    gone = ov.limit(0).union(spark.createDataFrame([("h1", "0.0,0.0,10.0,10.0", "delete", None, None, None, 1)], ov.schema))
    after, items_ = E.replay_overrides(faces, images, gone)
    assert [r["id"] for r in after.collect()] == [2] and {r["id"]: r["n_faces"] for r in items_.collect()} == {1: 0, 2: 1}


def test_optional_part_is_not_needed():
    import subprocess
    import sys

    code = "import sys, importlib.abc\nclass No(importlib.abc.MetaPathFinder):\n    def find_spec(self, n, p=None, t=None):\n        if n.startswith('catalume.llm') or n == 'corpus_pipeline': raise ModuleNotFoundError(n, name=n)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert e.queries() and e.oracle_sql() and not any(k.startswith('op') for k in e.queries())"
    root = __file__.rsplit("/", 2)[0]
    assert subprocess.run([sys.executable, "-c", code], cwd=root, check=False).returncode == 0
