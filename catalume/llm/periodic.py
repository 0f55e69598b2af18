"""Periodic runs of words: maximal stretches that repeat with a period, and texts without the repeats.

A run of period q holds two neighbouring points i and i + q of the grid of multiples of q (counted
from the text's start), with equal words there. All such pairs, some n ln n for a text of n words,
are tested for equal words, and those that pass are extended to both sides by longest common
extensions (LCE), forwards and, in the reversed text, backwards.

An extension is one of two suffixes. Of all suffixes only those are sorted that start at a place
of a difference cover, six residues modulo 31 of which every difference modulo 31 is one. Two places
anywhere come to a pair of sampled places after fewer than 31 words; these are compared, and the
rest is a range minimum, by a sparse table, over the common prefixes of neighbours in the order of
the sampled suffixes.

Texts are worked through in blocks of some 200,000 words (a longer one is a block of its own) with
numpy; nothing is shuffled. Memory grows with the block: some 100 bytes a word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalume.llm.common import WORD

#: A perfect difference set.
MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Words of a run at least; words of a block of texts; and words up to which pairs of the grid are kept.
LEAST, BLOCK, KEPT = 12, 200_000, 1 << 16

_IN_COVER = np.isin(np.arange(MODULUS), COVER)


def _steps() -> np.ndarray:
    """For two residues: after how many words both are in the cover."""
    r = np.arange(MODULUS)
    both = _IN_COVER[(r[:, None, None] + r) % MODULUS] & _IN_COVER[(r[None, :, None] + r) % MODULUS]
    return both.argmax(2)


_STEPS = _steps()


class Extensions:
    """LCE of any two places of one text, in a block of texts.

    words: numbers from 1, with MODULUS zeros before and after each text; text: number of the text
    at each place.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray):
        self.words = words
        at = np.flatnonzero(_IN_COVER[np.arange(len(words)) % MODULUS] & (words > 0))
        self.where = np.full(len(words), -1, np.int32)
        self.where[at] = np.arange(len(at), dtype=np.int32)
        levels = self._ranks(at, text[at])
        self.rank = levels[-1]
        order = np.empty_like(at)
        order[self.rank] = np.arange(len(at))
        common = np.zeros(len(at), np.int32)
        if len(at) > 1:
            common[1:] = self._common(at, order[:-1], order[1:], text, levels)
        self.table = [common]
        k = 1
        while 2 * k <= len(common):
            self.table.append(np.minimum(self.table[-1][:-k], self.table[-1][k:]))
            k *= 2

    def _ranks(self, at: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
        """Ranks of the sampled suffixes by text, then by MODULUS words, then by twice as many, until all differ."""
        rank = np.searchsorted(text, text, "left") if np.all(text[:-1] <= text[1:]) else len(text) - np.searchsorted(text[::-1], text, "right")
        tied = np.arange(len(at))
        for t in range(0, MODULUS, 2):
            two = self.words[at[tied] + t].astype(np.int64) << 32
            if t + 1 < MODULUS:
                two |= self.words[at[tied] + t + 1]
            tied = _refine(rank, tied, two)
        out, far = [rank.astype(np.int32)], MODULUS
        while len(tied):
            to = self.where[np.minimum(at[tied] + far, len(self.words) - 1)]
            tied = _refine(rank, tied, np.where(to >= 0, out[-1][to].astype(np.int64) + 1, 0))
            out.append(rank.astype(np.int32))
            far *= 2
        return out

    def _common(self, at: np.ndarray, a: np.ndarray, b: np.ndarray, text: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common words of the suffixes of each pair of samples."""
        p, q = at[a], at[b]
        live = np.flatnonzero(text[p] == text[q])
        out = np.zeros(len(p), np.int64)
        for k in range(len(levels) - 1, -1, -1):  # as long as they agree in MODULUS * 2 ** k words
            x, y = self._sample(p[live] + out[live]), self._sample(q[live] + out[live])
            same = (x >= 0) & (y >= 0)
            same[same] = levels[k][x[same]] == levels[k][y[same]]
            out[live[same]] += MODULUS << k
        while len(live):
            x, y = p[live] + out[live], q[live] + out[live]
            same = (self.words[x] == self.words[y]) & (self.words[x] > 0)
            live = live[same]
            out[live] += 1
        return out

    def _sample(self, place: np.ndarray) -> np.ndarray:
        return self.where[np.minimum(place, len(self.where) - 1)]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and from j on; both in one text (or at its ends), i != j."""
        out = np.zeros(len(i), np.int64)
        steps = _STEPS[i % MODULUS, j % MODULUS]
        live, t = np.arange(len(i)), 0
        while len(live):
            met = steps[live] == t
            now = live[met]
            out[now] = t + self._sampled(self.where[i[now] + t], self.where[j[now] + t])
            live = live[~met]
            x, y = self.words[i[live] + t], self.words[j[live] + t]
            same = (x == y) & (x > 0)
            out[live[~same]] = t
            live = live[same]
            t += 1
        return out

    def _sampled(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The least of what neighbours have in common between two sampled suffixes; none if one is a text's end."""
        out = np.zeros(len(x), np.int64)
        both = np.flatnonzero((x >= 0) & (y >= 0))
        a, b = self.rank[x[both]], self.rank[y[both]]
        a, b = np.minimum(a, b) + 1, np.maximum(a, b)
        k = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        for level in np.unique(k):
            of = k == level
            row = self.table[level]
            out[both[of]] = np.minimum(row[a[of]], row[b[of] - (1 << int(level)) + 1])
        return out


def _refine(rank: np.ndarray, tied: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Tell those of one rank apart by the key; a rank is the number of smaller ones. Returns who is still tied."""
    if not len(tied):
        return tied
    order = np.lexsort((key, rank[tied]))
    tied, key = tied[order], key[order]
    old = rank[tied]
    place = np.arange(len(tied))
    new_group = np.append(True, old[1:] != old[:-1])
    new = new_group | np.append(True, key[1:] != key[:-1])
    first = np.maximum.accumulate(np.where(new, place, 0))
    rank[tied] = old + first - np.maximum.accumulate(np.where(new_group, place, 0))
    alone = new & np.append(new[1:], True)
    return tied[~alone]


def _pairs(low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """All i and j = i + q, multiples of q, with low <= j < high; in the order of j."""
    q = np.arange(1, high)
    first = np.maximum(q, -(-low // q) * q)
    n = np.maximum(0, -(-(high - first) // q))
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    period = np.repeat(q, n)
    j = np.repeat(first, n) + step * period
    order = np.argsort(j, kind="stable")
    return (j - period)[order].astype(np.int32), j[order].astype(np.int32)


_GRID: list[np.ndarray] = []


def _candidates(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of the grid of a text that have equal words."""
    if not _GRID:
        i, j = _pairs(1, KEPT)
        _GRID.extend((i, j, np.searchsorted(j, np.arange(KEPT + 1))))
    i, j, upto = _GRID
    some = upto[min(len(words), KEPT)]
    at = np.flatnonzero(words[i[:some]] == words[j[:some]])
    found = [(i[at], j[at])]
    for low in range(KEPT, len(words), KEPT):
        x, y = _pairs(low, min(low + KEPT, len(words)))
        at = np.flatnonzero(words[x] == words[y])
        found.append((x[at], y[at]))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def block_runs(texts: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """For each text, as numbers of words from 1: its runs as rows (start, length, period), by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = MODULUS + np.cumsum(sizes + MODULUS) - (sizes + MODULUS)
    words = np.zeros(MODULUS + int((sizes + MODULUS).sum()), np.int32)
    text = np.zeros(len(words), np.int32)
    lefts, rights = [], []
    for k, (t, s) in enumerate(zip(texts, starts.tolist(), strict=True)):
        words[s : s + len(t)] = t
        text[s : s + len(t) + MODULUS] = k
        if len(t) >= least:
            i, j = _candidates(t)
            lefts.append(i.astype(np.int64) + s)
            rights.append(j.astype(np.int64) + s)
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lefts, rights))
    q = j - i
    ahead = Extensions(words, text).common(i, j)
    back = Extensions(words[::-1].copy(), text[::-1].copy()).common(len(words) - i, len(words) - j)
    good = (ahead + back >= q) & (ahead + back + q >= least)
    start, length, q = i[good] - back[good], (ahead + back + q)[good], q[good]
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    # a stretch is found again with multiples of its period
    new = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])) if len(start) else np.zeros(0, bool)
    start, length, q = start[new], length[new], q[new]
    order = np.lexsort((q, start))
    found = np.stack([start, length, q], 1)[order]
    cut = np.searchsorted(found[:, 0], np.append(starts, len(words)))
    return [found[a:b] - (s, 0, 0) for a, b, s in zip(cut[:-1], cut[1:], starts, strict=True)]


def repeats(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words are in a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


#: Columns that are added.
NEW = ("n_words", "runs", "collapsed")
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _found(rows: list[pa.RecordBatch], texts: list[list[bytes]], numbers: list[np.ndarray], least: int, schema: pa.Schema) -> pa.RecordBatch:
    runs = block_runs(numbers, least)
    kept = []
    for words, r in zip(texts, runs, strict=True):
        gone = repeats(r, len(words)) if len(r) else None
        kept.append(b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
    every = np.concatenate(runs)
    struct = pa.StructArray.from_arrays([pa.array(every[:, k]) for k in range(3)], fields=list(_RUNS.value_type))
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(r) for r in runs])), pa.int32()), struct)
    new = [pa.array([len(w) for w in texts], pa.int64()), lists.cast(schema.field(len(schema) - 2).type), pa.array(kept, pa.binary()).cast(pa.string())]
    row = pa.concat_arrays([b.column(0) for b in rows])
    return pa.RecordBatch.from_arrays([row, *new], schema=schema)


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with n_words, runs (array of start, length, period) and collapsed (the words outside repeats, joined by spaces).

    A run is a stretch of words with smallest period q, of ``least`` words and 2 * q words at
    least, that no neighbouring word extends with that period. Runs are in the order of start,
    then period. Repeats are the words of runs after their first periods.

    Null and empty texts have no words, no runs and the collapsed text ''. Texts of any length are
    read whole. Repeated rows are worked through each on its own. Other columns come back as they
    are; those named as the new ones are replaced. An empty table gives an empty one.
    """
    other = [c for c in docs.columns if c.lower() not in NEW]
    row = F.struct(*[docs[c] for c in other]) if other else F.struct(F.lit(0).alias("none"))
    kind = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    x = docs.select(row.alias("row"), docs[text].cast("string").alias("text"))
    schema = T.StructType([x.schema["row"], T.StructField(NEW[0], T.LongType()), T.StructField(NEW[1], kind), T.StructField(NEW[2], T.StringType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields = [b.schema.field(0), pa.field(NEW[0], pa.int64()), pa.field(NEW[1], _RUNS), pa.field(NEW[2], pa.string())]
            column, at = b.column(1).cast(pa.large_binary()), 0
            while at < len(b):
                number: defaultdict[bytes, int] = defaultdict()
                number.default_factory = lambda n=number: len(n) + 1
                texts, numbers, size, first = [], [], 0, at
                while at < len(b) and (size < BLOCK or not texts):
                    words = (column[at].as_py() or b"").split()
                    texts.append(words)
                    numbers.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                    size += len(words)
                    at += 1
                yield _found([b.slice(first, at - first)], texts, numbers, least, pa.schema(fields))

    out = x.mapInArrow(scan, schema)
    return out.select(*[F.col("row")[c].alias(c) for c in other], *NEW)


def with_periods(doc_id: Column, text: Column) -> Column:
    """The text; where crc32 of the id is h with h % 10 = 0, its words from word a on repeat with period p.

    With g = floor(h / 10) and n words, a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). The id
    null counts as the text ''.
    """
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def planted(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        cycle = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(cycle, F.lit(1), n - a)), " "))

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.when(h % 10 == 0, F.transform(F.array(words), planted)[0]).otherwise(text)


def run_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli (of the longest run), runs_sha256, collapsed_sha256: one row per document, every tenth of which is made periodic."""
    doc_id = docs["doc_id"].cast("long")
    x = find_runs(docs.select(doc_id.alias("doc_id"), with_periods(doc_id, docs["text"]).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    x = x.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return x.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
