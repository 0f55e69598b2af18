"""The whole pipeline against a plain version of every stage."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_minhash import brute as brute_groups
from test_models import leaning, prose, scatter, squared, statistics
from test_sampling import jump, water
from test_text import brute as brute_hits

import corpus_pipeline as C
from catalume.llm import decontam, quality
from catalume.llm.minhash import shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def vector(s, lines):
    n, chars, symbols, dup, repeat = s
    half_up = lambda v: math.floor(quality.UNIT * v + 0.5)
    return [half_up(v) for v in (math.log(chars / n), math.log(1 + 4 * (symbols / n)), math.sqrt(dup / lines), math.sqrt(repeat / n))]


def plain_quality(rows):
    points, fine = {}, []
    for k, r in enumerate(rows):
        s = statistics(r[1])
        if s[0] >= 50 and 100 * s[4] <= 50 * s[0]:
            lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in r[1].split("\n"))
            points[k] = vector(s, lines)
            fine.append(k)
    groups = defaultdict(list)
    for k in fine:
        groups[rows[k][2], rows[k][3]].append(points[k])
        groups[rows[k][2]].append(points[k])
        groups[()].append(points[k])
    fits = {g: (len(v), *scatter(np.array(v))) for g, v in groups.items()}
    cut = 23.512742  # 99.99 % of a chi-square distribution with 4 degrees of freedom
    out = []
    for k in fine:
        m, spread = leaning(fits[rows[k][2], rows[k][3]], fits[rows[k][2]], fits[()])
        if squared(np.array([points[k]], float), m, spread)[0] <= cut:
            out.append(rows[k])
    return out


def plain_dedup(rows):
    kept, seen = [], set()
    ids = {r[0] for r in rows}
    leader = {i: c for i, _, c in brute_groups([(r[0], r[1]) for r in rows], 80)}
    assert len(ids) == len(rows)
    for r in rows:
        if not len(shingles(r[1], 5)) or leader[r[0]] == r[0]:
            kept.append(r)
            seen.add(r[0])
    return kept


def plain_decontam(rows, items):
    out = []
    for r in rows:
        w = decontam.item_words(r[1]) if r[1] else []
        n, hit, _ = brute_hits(r[1], items, 10)
        if hit > 0.5 * n:
            continue
        if hit:
            texts = [(k, [x.encode() for x in re.findall(decontam.ITEM_WORD, t.lower())]) for k, t in items]
            marks = [False] * len(w)
            for _, iw in texts:
                k = min(10, len(iw))
                for i in range(len(w) - k + 1):
                    if any(w[i : i + k] == iw[j : j + k] for j in range(len(iw) - k + 1)):
                        marks[i : i + k] = [True] * k
            spans, i = [], 0
            while i < len(marks):
                j = i
                while j < len(marks) and marks[j] == marks[i]:
                    j += 1
                if marks[i] and j - i > 9:
                    spans.append((i, j))
                i = j
            text = decontam.cut_spans(r[1], spans)
            r = (*r[:1], text, *r[2:4], len(text))
        out.append(r)
    return out


def plain_mix(rows):
    size = lambda r: len((r[1] or "").split())
    totals = Counter()
    for r in rows:
        totals[r[3]] += size(r)
    target = water(totals, (3, 1, 2), 1.5, 2.0)
    out = []
    for s, total in totals.items():
        own = []
        for r in rows:
            if r[3] == s:
                n = size(r)
                bits = len(bin(n)) - 2
                own.append(((bits * 8 + ((n >> max(bits - 4, 0)) & 7), hashlib.md5(str(r[0]).encode()).hexdigest()), r))
        u = int(hashlib.md5(f"11:{s or ''}".encode()).hexdigest()[:5], 16) / 2**20
        rate = target[s] / total if total else 0.0
        for k, (_, r) in enumerate(sorted(own, key=lambda x: x[0])):
            out += [r] * (math.floor(u + (k + 1) * rate) - math.floor(u + k * rate))
    return out


def documents(rng):
    rows = [(i, prose(rng, rng.choice([60, 90, 200])), "en" if i % 4 else "de", rng.choice(["a", "b", "é", None])) for i in range(240)]
    base = prose(rng, 120)
    for i in range(300, 330):
        w = base.split(" ")
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(999)}"
        rows.append((i, " ".join(w), "en", "a"))
    rows += [(400 + i, rows[i][1], "en", "b") for i in range(12)]
    rows += [(450 + i, " ".join(x + "###" for x in prose(rng, 80).split()), "en", "a") for i in range(25)]
    rows += [(500, "few words", "en", "a"), (501, None, None, None), (502, "", "de", "b"), (503, "so so so so " * 40, "en", "a")]
    items = [(i, " ".join(f"k{i}x{j}" for j in range(14))) for i in range(4)] + [(9, prose(rng, 60))]
    for i in range(600, 612):
        rows.append((i, f"{prose(rng, 70)} {items[i % 4][1]}. {prose(rng, 70)}", "en", "b"))
    rows.append((650, items[4][1], "en", "a"))
    rng.shuffle(rows)
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows], items


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    rows, items = documents(random.Random(12))
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def rows_of(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_each_stage_and_the_run(spark, case):
    folder, rows, items = case
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = plain_quality(rows)
    steps = dict(C.STAGES)
    assert list(steps) == ["quality", "near_duplicates", "decontamination", "mix", "shards"]
    out = steps["quality"](spark, docs, folder)
    assert out.columns == COLUMNS and rows_of(out) == Counter(want)
    want2 = plain_dedup(want)
    out = steps["near_duplicates"](spark, spark.createDataFrame(want, docs.schema), folder)
    assert out.columns == COLUMNS and rows_of(out) == Counter(want2)
    want3 = plain_decontam(want2, items)
    out = steps["decontamination"](spark, spark.createDataFrame(want2, docs.schema), folder)
    assert out.columns == COLUMNS and rows_of(out) == Counter(want3) and len(want3) < len(want2)
    assert any("k1x3" in r[1] for r in want2) and not any("k1x3" in r[1] for r in want3)
    want4 = plain_mix(want3)
    out = steps["mix"](spark, spark.createDataFrame(want3, docs.schema), folder)
    assert out.columns == COLUMNS and rows_of(out) == Counter(want4)
    final = C.run(spark, folder)
    assert rows_of(final) == Counter(want4)
    assert all(r["shard"] == jump(r["doc_id"], 8) for r in final.collect())


def test_pipeline_of_an_empty_table(spark, case, tmp_path):
    folder, _, _ = case
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0
