"""Scores and states of the suffix tree against a plain version with dictionaries."""

import binascii
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from test_models import corpus, toks

from catalume.llm import lm


def learns(i):
    return binascii.crc32(("" if i is None else str(i)).encode()) % 7 != 2


class Plain:
    """Every context of the training texts in dictionaries; retained ones in ``states``."""

    def __init__(self, rows, how):
        train = [toks(t) for i, t in rows if learns(i)]
        self.how, self.c = how, Counter(w for t in train for w in t)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.states = {}
        for depth in range(1, how.depth + 1):
            followers = defaultdict(Counter)
            for t in train:
                for k in range(depth, len(t)):
                    followers[tuple(t[k - depth : k])][t[k]] += 1
            new = {}
            for context, f in followers.items():
                n = sum(f.values())
                own = {w: k - how.discount for w, k in f.items() if k >= how.least}
                if not own:
                    continue
                rest = n - sum(own.values())
                gain = sum(x * math.log(x / n / self.p(context[1:], w)) for w, x in own.items()) + rest * math.log(rest / n)
                if gain >= how.divergence:
                    new[context] = (n, own)
            self.states |= new

    def p(self, context, w):
        if not context:
            return (self.c[w] + 1) / (self.n + self.v + 1)
        if context not in self.states:
            return self.p(context[1:], w)
        n, own = self.states[context]
        return own.get(w, 0.0) / n + (1 - sum(own.values()) / n) * self.p(context[1:], w)

    def score(self, t):
        return sum(math.log10(self.p(tuple(t[max(0, k - self.how.depth) : k]), w)) for k, w in enumerate(t))


def passages(n, seed):
    """Random words with passages that come again, whole documents that occur twice, and one over and over."""
    rng = random.Random(seed)
    said = [" ".join(f"p{rng.randrange(300)}" for _ in range(30)) for _ in range(8)]
    rows = [(i, " ".join(rng.choice(said) if rng.random() < 0.3 else " ".join(f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 6)))) for i in range(n)]
    return rows + [(1000 + i, t) for i, t in rows[:40]] + [(2000 + i, rows[50][1]) for i in range(30)]


@pytest.mark.parametrize("cut", [{}, {"chunk": 900, "bucket": 3_000}, {"chunk": 60, "bucket": 4_000}])
@pytest.mark.parametrize("tree", [{}, {"depth": 2, "least": 3, "discount": 0.5, "divergence": 2.0}])
def test_scores_and_states_are_those_of_the_plain_tree(frame, cut, tree):
    rows = [*corpus(120, 3), *passages(200, 9)]
    how = lm.Settings(**cut, **tree)
    plain = Plain(rows, how)
    scores, states = lm.learn_and_score(frame(rows), how=how)
    want = sorted((str(i), len(toks(t)), plain.score(toks(t))) for i, t in rows)
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in scores.collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(abs(x[2] - y[2]) < 1e-9 * max(1, x[1]) for x, y in zip(got, want, strict=True))
    assert len({len(c) for c in plain.states}) == how.depth
    assert sorted((r["depth"], r["n"], r["own"]) for r in states.collect()) == sorted((len(c), n, sum(own.values())) for c, (n, own) in plain.states.items())


def test_distributions_sum_to_one(frame):
    rows = passages(150, 4)
    plain = Plain(rows, lm.Settings())
    for context in [(), *list(plain.states)[::40]]:
        assert abs(sum(plain.p(context, w) for w in plain.c) + plain.p(context, b"never seen") - 1) < 1e-9


def test_documents_that_occur_twice_stand_out(frame):
    """At any size: one copy elsewhere is evidence enough."""
    rng = random.Random(2)
    alone = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(60))) for i in range(800)]
    twice = [(i + 1000, t) for i, t in alone[:40] if learns(i) and learns(i + 1000)]
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm.score_texts(frame(alone + twice)).collect()}
    copied = {i for i, _ in twice} | {i - 1000 for i, _ in twice}
    assert min(got[i] for i in copied) > max(s for i, s in got.items() if i not in copied) + 1


def test_other_columns_and_hard_rows(frame):
    rows = [(1, "a b " * 300), (1, "a b " * 300), (None, None), (3, ""), (4, "x" * 100_000), (5, "a b c")]
    docs = frame(rows).withColumn("chunk", F.lit("x")).withColumn("held", F.lit(1)).withColumn("level", F.lit(None).cast("int"))
    plain = Plain(rows, lm.Settings())
    got = sorted(((r["doc_id"] or 0, round(r["score"], 6)) for r in lm.score_texts(docs).collect()))
    assert got == sorted((i or 0, round(plain.score(toks(t)), 6)) for i, t in rows)


def a_chunk(frame, rows):
    """The rows as one chunk."""
    docs = frame(rows).coalesce(1)
    return lm._chunks(docs.select("doc_id", lm.held_out(docs["doc_id"]).alias("held"), "text"), 10**6).first().asDict()


def test_a_round_sends_a_part_and_all_rounds_send_everything(frame):
    """Messages of one round at a time are on disk."""
    how, buckets, total, kinds = lm.Settings(rounds=4, least_buckets=3), 12, 0, 0
    every = [a_chunk(frame, passages(200, 9))]
    for meeting in range(1, how.depth + 3):
        rows = lm._table(lm._CHUNK_ROW, every)
        parts = lm._rounds(meeting, how, buckets)
        sent = [lm._asker(meeting, how, part, total, kinds)(rows).to_pylist() for part in parts]
        whole = lm._asker(meeting, how, lm._Round(buckets, 0, buckets), total, kinds)(rows).to_pylist()
        by_bucket = {(m["what"], m["level"], m["bucket"]): m for r in sent for m in r}
        assert len(by_bucket) == sum(map(len, sent)) and by_bucket == {(m["what"], m["level"], m["bucket"]): m for m in whole}
        if 1 < meeting < how.depth + 2:
            sizes = [sum(len(m["keys"]) for m in r) for r in sent]
            assert len(parts) == 4 and max(sizes) < 0.4 * sum(sizes)
        answers = pa.concat_tables([lm._answerer(how)(lm._table(lm._MESSAGE, [m])) for m in whole])
        if meeting == 1:
            total, kinds = (sum(x or 0 for x in answers[c].to_pylist()) for c in ("total", "kinds"))
        if meeting < how.depth + 2:
            every += lm._hearer(meeting, how)(rows, answers.filter(pa.compute.greater_equal(answers["chunk"], 0))).to_pylist()
    assert len(every) == 1 + 2 * how.depth  # c of 1 to 5 and b of 1 to 3


@pytest.mark.parametrize("rounds", [2, 7])
def test_rounds_change_no_score(frame, rounds):
    rows = passages(150, 5)
    how = lm.Settings(rounds=rounds, least_buckets=1, bucket=3_000, chunk=900)
    plain = Plain(rows, how)
    got = sorted((r["doc_id"], r["score"]) for r in lm.learn_and_score(frame(rows), how=how)[0].collect())
    want = sorted((i, plain.score(toks(t))) for i, t in rows)
    assert [x[0] for x in got] == [x[0] for x in want]
    assert all(abs(x[1] - y[1]) < 1e-9 * max(1, len(rows)) for x, y in zip(got, want, strict=True))


def test_small_meetings_have_one_round():
    how = lm.Settings()
    for buckets in (1, 11, 23, 24, 54, 3000):
        for meeting in range(1, how.depth + 3):
            parts = lm._rounds(meeting, how, buckets)
            assert [p.start for p in parts] == [0, *(p.stop for p in parts[:-1])] and parts[-1].stop == buckets
            assert len(parts) == (1 if buckets < 24 or meeting in (1, how.depth + 2) else 2 if buckets < 36 else 3)


def test_a_chunk_keeps_its_words_in_less_room(frame):
    """Frequent words have small numbers; hashes of words of about the same frequency are differences."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.5))}" for _ in range(4000))) for i in range(60)]
    row = a_chunk(frame, rows)
    x = lm._Chunk(row, lm.Settings())
    texts = dict(rows)
    words = [w for d in x.doc_ids.tolist() for w in lm.tokens(texts[d].encode())]
    assert x.word_hash[x.ids].tolist() == [xxhash.xxh3_64_intdigest(w) for w in words]
    often = np.bincount(x.ids)
    assert often[0] == often.max() and often[:100].min() >= often[200:].max()
    assert len(row["hashes"]) < 7.5 * len(x.word_hash)


@pytest.mark.parametrize("x", [np.zeros(0, np.int64), np.array([0, 255, 256, 2**40 + 7, 2**64 - 1], np.uint64), np.array([1, 70000]), np.array([0.1, -3e9, np.inf], np.float32)])
def test_packed_numbers_come_back(x):
    assert lm._unpack(lm._pack(x)).tolist() == x.tolist()
