"""Packing against a plain best fit, and token ids against whole texts."""

import binascii
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from catalume.llm import packing

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def word_ids():
    with open(FILE, encoding="utf-8") as f:
        return packing.WordIds(f.read(), 2)


def plain_best_fit(sizes, capacity):
    """Sequences that best fit in falling length makes, one piece after the other."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


def most_pairs(large, capacity):
    """Sequences for pieces of which no three fit: all, less the most that can be paired (largest with largest that fits, by brute force over lists)."""
    left, n = sorted(large, reverse=True), 0
    while left:
        a = left.pop(0)
        n += 1
        b = next((x for x in left if a + x <= capacity), None)
        if b is not None:
            left.remove(b)
    return n


def places(plan):
    """All pieces of a plan: (length, rank) -> (sequence, offset)."""
    out = {}
    for size, first, upto, sequence, each, offset in plan:
        for r in range(first, upto):
            assert (size, r) not in out
            out[size, r] = (sequence + (r - first) // each, offset + (r - first) % each * size)
    return out


def check_places(found, sizes, capacity):
    assert Counter(s for s, _ in found) == Counter(sizes)
    by = defaultdict(list)
    for (s, _), (k, offset) in found.items():
        by[k].append((offset, s))
    for stretch in by.values():
        upto = 0
        for offset, s in sorted(stretch):
            assert offset == upto
            upto += s
        assert upto <= capacity
    return len(by)


@settings(max_examples=150, deadline=None)
@given(st.integers(3, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=120))))
def test_plans(case):
    capacity, sizes = case
    plan = packing.packing_plan(Counter(sizes), capacity)
    n = check_places(places(plan), sizes, capacity)
    assert n <= plain_best_fit(sizes, capacity) + 1
    large = [s for s in sizes if 3 * s > capacity]
    if len(large) == len(sizes):
        assert n == most_pairs(sizes, capacity)


def test_large_pieces_are_paired_as_often_as_can_be():
    rng = random.Random(2)
    for _ in range(60):
        c = 30
        sizes = [rng.randrange(11, 31) for _ in range(rng.randrange(1, 9))]

        def fewest(left):
            if not left:
                return 0
            a, rest = left[0], left[1:]
            return 1 + min([fewest(rest), *(fewest(rest[:k] + rest[k + 1 :]) for k, b in enumerate(rest) if a + b <= c)])

        assert check_places(places(packing.packing_plan(Counter(sizes), c)), sizes, c) == fewest(sizes)


def test_plans_are_bounded_by_the_capacity():
    rng = random.Random(1)
    for top in (3, 1000, 10**9):
        counts = {s: rng.randrange(1, top) for s in range(1, 1025)}
        plan = packing.packing_plan(counts, 1024)
        total = sum(s * n for s, n in counts.items())
        sequences = max(row[3] + (row[2] - row[1] - 1) // row[4] for row in plan) + 1
        assert len(plan) < 20_000 and sequences <= -(-total // 1024) * 1.02 + 1


def random_text(rng):
    bits = ["word", "The", "'s", "don't", " ", "  ", "\n", "\t", "\r\n", " ", "　", "\x1c", "\x85", ",", "...", "42", "é", "日本語", "<|endoftext|>", "<|endoftext", "ünï", "​", "🙂", "\x00"]
    return "".join(rng.choice(bits) for _ in range(rng.randrange(30)))


def test_ids_are_those_of_whole_texts(tokenizer, word_ids, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(packing, "REMEMBERED", 300)
    for _ in range(60):
        texts = [random_text(rng) for _ in range(40)]
        ids, n = word_ids.of([word_ids.words(t) for t in texts])
        want = [[*e.ids, 2] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def test_other_tokenizers_encode_whole_texts():
    file = public_tokenizers.path("word_bpe_49k.json")
    with open(file, encoding="utf-8") as f:
        known = packing.WordIds(f.read(), 2)
    texts = ["Some  text\n here", "", "more"]
    ids, n = known.of([known.words(t) for t in texts])
    assert not known.by_word
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*e.ids, 2] for e in Tokenizer.from_file(file).encode_batch(texts, add_special_tokens=False)]


def check_report(docs, rows, tokenizer, capacity):
    got = packing.packing_report(docs, FILE, capacity).collect()
    want = Counter()
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        cut = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            want[doc_id, k, a, b - a, binascii.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    found = {(r["length"], k): (r["sequence_id"], r["offset"]) for k, r in enumerate(got)}
    sizes = [r["length"] for r in got]
    n = check_places(found, sizes, capacity)
    assert n <= plain_best_fit(sizes, capacity) + 1
    return n


def test_report(frame, tokenizer):
    rng = random.Random(9)
    rows = [(i, " ".join("some words of a text"[: rng.randrange(20)] for _ in range(rng.randrange(60)))) for i in range(200)]
    rows += [(None, None), (None, "x"), (5, ""), (6, "same text"), (6, "same text"), (6, "same text"), (7, "long one " * 3000), (8, "a" * 30_000)]
    check_report(frame(rows), rows, tokenizer, 64)
    check_report(frame(rows[:40]), rows[:40], tokenizer, 1024)


def test_empty_table_and_other_columns(spark, frame):
    assert packing.packing_report(frame([]), FILE).collect() == []
    docs = frame([(i, "a b c") for i in range(5)]).select("*", F.lit(1).alias("row"), F.lit("x").alias("sequence_id"), F.lit(2).alias("_at"), F.lit(3).alias("n"), F.lit(4).alias("piece"))
    got = packing.pack(packing.token_pieces(docs, FILE), capacity=8).collect()
    assert {(r["row"], r["_at"], r["n"], r["piece"], r["length"], r["lang"]) for r in got} == {(1, 2, 3, 0, 4, "en")}
    assert sorted((r["sequence_id"], r["offset"]) for r in got) == [(0, 0), (0, 4), (1, 0), (1, 4), (2, 0)]
    assert bytes(got[0]["ids"]) == np.array([*Tokenizer.from_file(FILE).encode("a b c").ids, 2], "<u4").tobytes()


def test_lengths_that_cannot_be_packed(spark):
    x = spark.createDataFrame([(1, 5), (2, None), (3, 0), (4, 9), (5, -1), (6, 8), (7, 3)], "k long, length long")
    got = {r["k"]: (r["sequence_id"], r["offset"]) for r in packing.pack(x, capacity=8).collect()}
    assert [k for k, v in got.items() if v == (None, None)] and {k for k, v in got.items() if v == (None, None)} == {2, 3, 4, 5}
    assert got[1][0] == got[7][0] != got[6][0]
