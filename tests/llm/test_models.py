"""The suffix tree, quality rules, and language identification."""

import binascii
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalume.llm import langid, lm, quality


def toks(t):
    return (t or "").encode().lower().split() + [lm.END]


def corpus(n=300, seed=1):
    """Texts in which 'new' is mostly followed by 'york', and 'city' by 'hall' only after 'old'."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(5, 60)):
            w += rng.choice([["new", "york"], ["new", "york"], ["Old", "city", "hall"], ["big", "city", rng.choice("xyz")], [f"r{rng.randrange(400)}"], ["the"]])
        out.append((i, " ".join(w)))
    return [*out, (9001, None), (9002, ""), (9002, ""), (None, "the new york"), (9003, "new " * 5000)]


def scored(frame, rows):
    return {(r["doc_id"], r["n_tokens"]): r for r in lm.score_texts(frame(rows)).collect()}


def train_counts(rows):
    c = Counter()
    for i, t in rows:
        if binascii.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            c.update(toks(t))
    return c


def test_base_score_is_exact_and_the_tree_predicts_better(frame):
    rows = corpus()
    got = scored(frame, rows)
    c = train_counts(rows)
    n, v = sum(c.values()), len(c)
    base = better = 0.0
    for i, t in rows:
        r = got[i, len(toks(t))]
        assert r["train_tokens"] == n and r["n_known"] == sum(c[w] > 0 for w in toks(t))
        assert r["held_out"] == (binascii.crc32(("" if i is None else str(i)).encode()) % 7 == 2)
        assert abs(r["base_score"] - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks(t))) < 1e-6 * max(1, len(toks(t)))
        if r["held_out"]:
            base, better = base + r["base_score"], better + r["score"]
    assert better > base


def test_models_of_nothing(frame):
    assert lm.score_texts(frame([])).count() == 0 and langid.language_report(frame([])).count() == 0 and quality.quality_report(frame([])).count() == 0
    out = next(i for i in range(99) if binascii.crc32(str(i).encode()) % 7 == 2)
    r = lm.score_texts(frame([(out, "a b")])).first()
    assert (r["train_tokens"], r["n_known"], r["base_score"]) == (0, 0, 0.0)


def statistics(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    g = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i in range(len(w) - 2) if g[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(hit)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_statistics(frame, monkeypatch):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(["a ", "b ", "c\n", "é\t", "|#", " ", "\n\n"]) for _ in range(rng.randrange(120)))) for i in range(80)] + [(900, None), (901, ""), (902, " \n "), (903, "a b c " * 4000), (904, "x")]
    for bits in (30, 62):  # with 62 bits for positions nearly all short hashes collide
        monkeypatch.setattr(quality, "POSITION", bits)
        got = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in quality.text_statistics(frame(rows)).collect()}
        assert got == {i: statistics(t) for i, t in rows}


def prose(rng, n):
    return "\n".join(" ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(10)) for _ in range(n // 10))


def quality_rows():
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.choice([60, 120, 400])), "en" if i % 3 else "de", rng.choice(["a", "b"])) for i in range(400)]
    rows += [(1000 + i, " ".join(w + "%%%" for w in prose(rng, 100).split()), "en", "a") for i in range(60)]
    rows += [(2000 + i, "one two three\n" * 60, "en", "b") for i in range(5)] + [(2010, "short", "en", "a"), (2011, None, None, None), (2012, prose(rng, 80), None, "a"), (2013, prose(rng, 80), "xx", None)]
    return rows


def test_outliers_go_and_clean_documents_stay(frame):
    rows = quality_rows()
    got = {r["doc_id"]: r for r in quality.quality_report(frame(rows)).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["kept"] for i in range(400)) and got[2012]["kept"] and got[2013]["kept"]
    assert not any(got[i]["kept"] for i in got if 1000 <= i < 2012)
    assert got[2000]["base_failed"] and got[2011]["base_failed"] and not got[1000]["base_failed"]
    docs = frame(rows).withColumn("row", F.lit("r")).withColumn("kept", F.lit(False)).withColumn("t_words", F.lit(1)).withColumn("n_words", F.lit("mine"))
    left = quality.filter_quality(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i in got if got[i]["kept"]}


FLOOR = np.array([0.06, 0.10, 0.20, 0.14]) * 1024
#: Makes the half of a normal sample in four dimensions whose distances are least a scatter of all.
HALF = 0.5 / (1 - math.exp(-3.356694 / 2) * (1 + 3.356694 / 2 + (3.356694 / 2) ** 2 / 2))


def lower(s):
    """The factor L of a scatter, variances raised to the least ones, and those left by the statistics before to a tenth."""
    out = np.zeros((4, 4))
    for i in range(4):
        v = max(s[i, i], FLOOR[i] ** 2)
        for j in range(i):
            out[i, j] = (s[i, j] - out[i, :j] @ out[j, :j]) / out[j, j]
        out[i, i] = math.sqrt(max(v - out[i, :i] @ out[i, :i], 0.1 * v))
    return out


def squared(y, m, s):
    return (np.linalg.solve(lower(s), (y - m).T) ** 2).sum(0)


def size(s):
    return 2 * np.log(np.diag(lower(s))).sum()


def scatter(x):
    """Medians, centre about them, and scatter: the best of three starts after concentration."""
    med = np.sort(x, 0)[(len(x) - 1) // 2]
    y = np.clip(x - med, -8192, 8192).astype(float)
    d = np.maximum(1.4826 * np.sort(np.abs(y), 0)[(len(y) - 1) // 2], FLOOR)
    u = y / d / np.maximum(1e-9, np.linalg.norm(y / d, axis=1))[:, None]
    starts = [(k, np.zeros(4), r * np.outer(d, d)) for k, r in enumerate((np.eye(4), np.round(np.tanh(y / d).T @ np.tanh(y / d) / len(y), 6), 4 * np.round(u.T @ u / len(y), 6)))]
    kinds = np.unique(y.astype(int), axis=0)
    for k in range(3, 23):
        some = np.array([v for v in kinds if int(hashlib.md5(",".join(map(str, [k, *v])).encode()).hexdigest()[:8], 16) * len(kinds) < 6 * 2**32], float)
        if len(some):
            starts.append((k, some.mean(0), np.cov(some.T, bias=True)))

    def step(m, s):
        b = np.floor(np.log(squared(y, m, s) + 1e-6) * 64)
        cut = np.sort(b)[max(0, math.ceil(len(y) / 2) - 1)]
        w = (b < cut).astype(float)
        w[b == cut] = (len(y) / 2 - w.sum()) / (b == cut).sum()
        m = w @ y / w.sum()
        return m, HALF * ((y * w[:, None]).T @ y / w.sum() - np.outer(m, m))

    def order(f):
        return round(size(f[2]), 9), f[0]

    for n in range(15):
        starts = [(k, *step(m, s)) for k, m, s in starts]
        if n == 1:
            starts = sorted(starts, key=order)[:3]
    return med, *min(starts, key=order)[1:]


def leaning(*fits):
    """Centre and scatter from those (number, medians, centre, scatter) of a group, its language and all."""
    m, s = None, np.diag((3 * FLOOR) ** 2)
    for n, med, centre, own in reversed(fits):
        w, low = n / (n + 20), lower(own)
        m = med + centre if m is None else w * (med + centre) + (1 - w) * m
        s = w * low @ low.T + (1 - w) * s
    return m, s


def fitted(spark, x):
    rows = Counter(("g", *map(int, r)) for r in x)
    return quality.minimum_covariance(spark.createDataFrame([(*r, n) for r, n in rows.items()], "gid string, x_0 long, x_1 long, x_2 long, x_3 long, n long")).first()


def test_scatter_equals_numpy(frame, spark):
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(0, 1, (300, 4)) @ np.array([[200, 50, 0, 10], [0, 150, 30, 0], [0, 0, 220, 5], [0, 0, 0, 180]]), rng.normal(3000, 50, (60, 4)))).round().astype(int) + 500
    x = np.concatenate((x, x[:40]))  # equal vectors
    got = fitted(spark, x)
    med, m, s = scatter(x)
    low = lower(s)
    assert got["n"] == 400 and [got[f"c_{i}"] for i in range(4)] == med.tolist()
    assert np.allclose([got[f"m_{i}"] for i in range(4)], m) and np.allclose([got[f"l_{i}{j}"] for i, j in quality.PAIRS], [low[i, j] for i, j in quality.PAIRS])
    assert abs(m).max() < 100  # the sixty far points have no say


def random_starts(y, rng, n=300):
    """The least determinant of many random starts with exact halves."""
    out = []
    for _ in range(n):
        z = y[rng.choice(len(y), 6, replace=False)]
        for _ in range(30):
            m, s = z.mean(0), HALF * np.cov(z.T, bias=True)
            z = y[np.argsort(squared(y, m, s), kind="stable")[: len(y) // 2]]
        out.append(size(s))
    return min(out)


def test_determinant_is_as_small_as_of_many_random_starts(spark):
    """A third of each group is far off, a cluster of its own; the estimate isn't drawn to it."""
    close = []
    for seed in range(4):
        rng = np.random.default_rng(seed)
        a = rng.normal(0, 1, (4, 4)) * [[80], [150], [300], [200]]
        x = np.concatenate((rng.normal(0, 1, (140, 4)) @ a, rng.normal(0, 1, (60, 4)) @ a * 0.3 + rng.normal(0, 1, 4) @ a * 7)).round().astype(int)
        got = fitted(spark, x)
        y = np.clip(x - np.sort(x, 0)[(len(x) - 1) // 2], -8192, 8192).astype(float)
        close.append(2 * sum(math.log(got[f"l_{i}{i}"]) for i in range(4)) - random_starts(y, rng))
    assert sum(c < 0.3 for c in close) >= 3, close


def test_small_groups_are_judged_by_larger_ones(frame):
    rng = random.Random(5)
    rows = [(i, prose(rng, 200), "en", "big") for i in range(60)] + [(100 + i, prose(rng, 200), "en", f"own{i}") for i in range(9)] + [(200, prose(rng, 200), "xx", "y")]
    rows += [(300, " ".join(w + "$$$" for w in prose(rng, 100).split()), "en", "lone"), (301, " ".join(w + "$$$" for w in prose(rng, 100).split()), "zz", None)]
    got = {r["doc_id"]: r for r in quality.quality_report(frame(rows)).collect()}
    assert {i for i, r in got.items() if not r["kept"]} == {300, 301}
    few = quality.quality_report(frame(rows[:9])).collect()
    assert all(r["kept"] and r["distance2"] is not None for r in few)
    assert quality.quality_report(frame(rows[:1])).first()["kept"]


def test_no_size_is_a_switch(frame):
    """A document more changes the distances a little, at any size; a far text goes at any size."""
    rng = random.Random(6)
    rows = [(i, prose(rng, 200), "en", "a") for i in range(40)]
    far = (999, prose(rng, 100) + " " + "x" * 4000, "en", "a")

    def report(n):
        return {r["doc_id"]: r for r in quality.quality_report(frame([far, *rows[:n]])).collect()}

    for n in (7, 18):  # 19 and 20 texts with the far one
        got, more = report(n), report(n + 1)
        assert [i for i, r in got.items() if not r["kept"]] == [999]
        assert abs(math.log(more[999]["distance2"] / got[999]["distance2"])) < 0.35, n


def test_chi_square():
    assert abs(quality.chi2_cdf(9.487729, 4) - 0.95) < 1e-6 and abs(quality.chi2_quantile(0.95) - 9.487729) < 1e-4


def test_language_report(frame):
    rng = random.Random(2)
    alphabet = {"aa": "abcdef gh", "bb": "mnopqr st", "cc": "ñéüß ao"}
    say = lambda lang, n: "".join(rng.choice(alphabet[lang]) for _ in range(n)) + "a"
    rows = [(i, say(lang, rng.choice([20, 300, 2000])), lang, "s") for i, lang in enumerate(rng.choice(list(alphabet)) for _ in range(400))]
    rows += [(1000, None, "aa", "s"), (1001, "", "aa", "s"), (1002, "123 !?", "bb", "s"), (1003, say("bb", 50), None, "s"), (None, say("cc", 50), "cc", "s"), (1004, say("aa", 60_000), "aa", "s"), (1004, say("aa", 10), "aa", "s")]
    got = langid.language_report(frame(rows)).collect()
    assert len(got) == len(rows)
    lang = dict((r[0], r[2]) for r in rows)
    fine = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["doc_id"] is not None and r["doc_id"] < 1000 and r["held_out"]]
    assert len(fine) > 60 and sum(fine) / len(fine) > 0.95
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1000, 1001, 1002)) and by[1003]["lang_pred"] == "bb"
    assert all(r["held_out"] == (binascii.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    assert str(sorted(map(str, got))) == str(sorted(map(str, langid.language_report(frame(rows)).collect())))


def test_tables_of_pairs_give_the_responses_of_the_filters():
    net = langid.ByteNet(["a", "b"], 3)
    x = np.random.default_rng(0).integers(0, 64, (5, langid.WINDOW)).astype(np.uint8)
    h = np.maximum(np.concatenate([r.max(1) for r in net.responses(x)], 1), 0)
    z = h @ net.out + net.bias
    want = z - np.log(np.exp(z).sum(1, keepdims=True))
    assert np.allclose(net.log_probabilities(x, net.tables()), want, atol=1e-4)


def test_scripts_beyond_ascii(frame):
    """Lead bytes tell scripts apart; the alphabets share no text with ASCII but spaces."""
    rng = random.Random(6)
    alphabet = {"el": "αβγδεζηθικλμνξο ", "ru": "абвгдежзийклмно ", "th": "กขคงจฉชซญฐณดตถท ", "he": "אבגדהוזחטיכלמנ "}
    rows = [(i, "".join(rng.choices(alphabet[lang], k=rng.choice([12, 86, 400]))) + alphabet[lang][0], lang, "s") for i, lang in enumerate(sorted(alphabet) * 40)]
    lang = {r[0]: r[2] for r in rows}
    got = [r for r in langid.language_report(frame(rows)).collect() if r["held_out"]]
    assert len(got) > 25 and all(r["lang_pred"] == lang[r["doc_id"]] for r in got)


def plain_mean(net, text):
    """Log-probabilities of a text, window by window and filter by filter."""
    raw = text.encode().lower()
    x = [32 if 9 <= b <= 13 else 48 if 48 <= b <= 57 else b for b in raw]
    total, at, done = np.zeros(len(net.languages)), 0, 0
    while done < len(x):
        w = (x[at : at + 256] + [0] * 256)[:256]
        h = [max(0.0, max(sum(f[o][w[p + o]][k] for o in range(len(f))) for p in range(256 - len(f) + 1))) for f in net.filters for k in range(f.shape[2])]
        z = np.array(h) @ net.out + net.bias
        new = min(len(x), at + 256) - done
        total += new * (z - z.max() - np.log(np.exp(z - z.max()).sum()))
        done, at = done + new, at + 253
    return total / len(x)


def test_windows_are_weighted_by_their_bytes(frame):
    net = langid.ByteNet(["a", "b", "c"], 5)
    rng = random.Random(3)
    rows = [(n, "".join(rng.choice("abcXYZ 019é\n") for _ in range(n - 1)) + "a") for n in (1, 2, 255, 256, 257, 300, 509, 510, 1000)]
    docs = frame(rows).withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1))
    for r in langid.identify(docs, net).collect():
        p = np.exp(plain_mean(net, dict(rows)[r["doc_id"]]))
        assert r["lang_pred"] == net.languages[p.argmax()] and abs(r["score"] - (p / p.sum()).max()) < 1e-4


def test_training_follows_the_gradient():
    """The steps on the filters, against differences of the loss."""
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 256, (40, 256)).astype(np.uint8), rng.integers(0, 2, 40)
    net = langid.ByteNet(["a", "b"])
    before = -net.log_probabilities(x, net.tables())[np.arange(40), y].mean()
    net.fit(x, y)
    assert -net.log_probabilities(x, net.tables())[np.arange(40), y].mean() < before / 2


def test_one_language_and_no_labels(frame):
    assert {r["lang_pred"] for r in langid.language_report(frame([(i, "abc", "only", "s") for i in range(9)])).collect()} == {"only"}
    assert {r["lang_pred"] for r in langid.language_report(frame([(1, "abc", None, "s")])).collect()} == {"und"}
