"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of digits, letters a-z (A-Z lower-cased) and all characters beyond ASCII.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_KEEP = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_SPAN = re.compile(r"[0-9A-Za-z\u0080-\U0010FFFF]+")
#: Columns that are added.
NEW = ("n_words", "hit_spans", "hit_items")
#: Items go to the executors in parts of about this many words each.
PART_WORDS = 200_000


def item_words(text: str) -> list[bytes]:
    """The normalised words of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split()


class ItemAutomaton:
    """Suffix automaton of many word sequences; states know which items they occur in.

    ``window`` words make an occurrence; an item of fewer words occurs as a whole.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.least = window
        seqs = []
        for name, words in items:
            if words:
                seq = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
                seqs.append((name, seq))
                self.least = min(self.least, len(seq))
                last = 0
                for w in seq:
                    last = self._extend(last, w)
        self.items: list[list[str | None]] = [[] for _ in self.link]
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        seen = [-1] * len(self.link)
        for k, (name, seq) in enumerate(seqs):
            at = 0
            for w in seq:
                at = self.next[at][w]
                v = at
                while v > 0 and seen[v] != k:  # every suffix of what has been read occurs in the item
                    seen[v] = k
                    self.items[v].append(name)
                    v = self.link[v]
            if len(seq) < window:
                v = at
                while self.len[self.link[v]] >= len(seq):
                    v = self.link[v]
                self.short.setdefault(v, []).append((len(seq), name))
        self.mask = (1 << max(16, 4 + sum(len(s) for _, s in seqs).bit_length())) - 1
        self.pairs = np.zeros(self.mask + 1, bool)
        for _, seq in seqs:
            s = np.array(seq, np.int64)
            self.pairs[self._pair(s[:-1], s[1:])] = True

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 1000003 + b * 7919) & self.mask

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        known = nxt[last].get(w)
        if known is not None:  # another item has been here
            if length[known] == length[last] + 1:
                return known
            return self._split(last, w, known)
        cur = len(link)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return cur

    def _split(self, p: int, w: int, q: int) -> int:
        new = len(self.link)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Maximal runs of words in which each pair of neighbours may be one of an item; no match crosses their ends."""
        if len(ids) < self.least:
            return []
        joined = np.zeros(len(ids) + 1, bool)  # joined[i]: word i goes on from word i - 1
        if len(ids) > 1:
            joined[1:-1] = self.pairs[self._pair(ids[:-1], ids[1:])] & (ids[1:] > 0) & (ids[:-1] > 0)
        starts = np.flatnonzero(~joined[:-1])
        ends = np.append(starts[1:], len(ids))
        ok = (ends - starts >= self.least) & (ids[starts] > 0)
        return list(zip(starts[ok].tolist(), ends[ok].tolist(), strict=True))

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Hit word spans (merged, end exclusive) of a text and the items that occur in it."""
        ids = np.fromiter(map(self.vocab.get, words, [0] * len(words)), np.int64, len(words))
        spans: list[tuple[int, int]] = []
        found: set[str | None] = set()
        for a, b in self.stretches(ids):
            v = n = 0
            for i, w in enumerate(ids[a:b].tolist(), a):
                while v and w not in self.next[v]:
                    v = self.link[v]
                    n = self.len[v]
                if w in self.next[v]:
                    v, n = self.next[v][w], n + 1
                hit = 0
                if n >= self.window:
                    u = v
                    while self.len[self.link[u]] >= self.window:
                        u = self.link[u]
                    found.update(self.items[u])
                    hit = self.window
                if self.short:
                    u, m = v, n
                    while u > 0:
                        for size, name in self.short.get(u, ()):
                            if size <= m:
                                found.add(name)
                                hit = max(hit, size)
                        u = self.link[u]
                        m = self.len[u]
                if hit:
                    if spans and spans[-1][1] >= i + 1 - hit:
                        start = min(spans[-1][0], i + 1 - hit)
                        spans.pop()
                        while spans and spans[-1][1] >= start:
                            start = min(start, spans.pop()[0])
                        spans.append((start, i + 1))
                    else:
                        spans.append((i + 1 - hit, i + 1))
        return spans, found


def _union(a: list, b: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted([*map(tuple, a), *map(tuple, b)]):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


_BUILT: dict[str, ItemAutomaton] = {}


def _automaton(shared, window: int) -> ItemAutomaton:
    """One automaton per worker and part of the items."""
    key = f"{shared.value[0]}:{window}"
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = ItemAutomaton(shared.value[1], window)
    return _BUILT[key]


def find_overlaps(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """``docs`` with n_words, hit_spans (array of word start and end) and hit_items (array of ids as text).

    Items are dealt by hash into parts of about ``part_words`` words, each broadcast on its own
    (that bound is the size of a broadcast); the documents stream through one part after the
    other, without a shuffle, so neither side has to fit anywhere.

    Null texts have no words and no hits. Items without words match nothing. Repeated items count
    as one. The words of an item whose id is null are hit, but it is in no list. Existing columns
    named as the new ones are replaced.
    """
    spark = docs.sparkSession
    ids = items.select(items[item_id].cast("string").alias("item"), F.coalesce(items[item_text], F.lit("")).alias("t")).distinct()
    total = ids.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, math.ceil(total / 5 / part_words))
    out = docs.drop(*NEW)
    out = out.withColumns({NEW[0]: F.lit(0).cast("long"), NEW[1]: F.array().cast("array<array<int>>"), NEW[2]: F.array().cast("array<string>")})
    for k in range(parts):
        rows = ids.filter(F.pmod(F.xxhash64("item", "t"), F.lit(parts)) == k).collect()  # about part_words words
        shared = spark.sparkContext.broadcast((f"{uuid.uuid4()}", sorted(((r["item"], item_words(r["t"])) for r in rows), key=str)))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            a = _automaton(shared, window)
            for b in batches:
                n, spans, found = [], [], []
                for t, s, f in zip(b.column(text).to_pylist(), b.column(NEW[1]).to_pylist(), b.column(NEW[2]).to_pylist(), strict=True):
                    words = item_words(t) if t else []
                    own, names = a.match(words)
                    n.append(len(words))
                    spans.append(_union(s, own) if s else own)
                    found.append(sorted({*f, *(x for x in names if x is not None)}))
                kinds = [b.schema.field(c).type for c in NEW]
                new = [pa.array(v, kind) for v, kind in zip((n, spans, found), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(b.num_columns - 3)] + new, schema=b.schema)

        out = out.mapInArrow(scan, out.schema)
    return out


def overlap_report(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per document row."""
    x = find_overlaps(docs.select("doc_id", "text"), items, window)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return x.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def cut_spans(text: str, spans: list) -> str:
    """The text without the words of the spans and without what stands between those words."""
    at = [m.span() for m in _SPAN.finditer(text)]
    out, pos = [], 0
    for a, b in spans:
        out.append(text[pos : at[a][0]])
        pos = at[b - 1][1]
    return "".join([*out, text[pos:]])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_span: int = 9, max_coverage: float = 0.5, text: str = "text", least_item: int = 5) -> DataFrame:
    """Clean documents: hit spans of more than ``max_span`` words are cut out, and documents of which more than ``max_coverage`` of the words are hit are dropped.

    A span shorter than ``window`` is made of whole short items; it is cut out too if it has
    ``least_item`` words or more. Shorter ones, which plain language has by chance, stay, and
    :func:`overlap_report` tells the documents with such hits. Untouched documents are returned as they are.
    Columns are those of ``docs``; n_chars, if there, follows the new text.
    """
    other = [c for c in docs.columns if c != text]
    row = F.struct(*[docs[c] for c in other]) if other else F.lit(None)
    x = find_overlaps(docs.select(row.alias("row"), docs[text].alias("text")), items, window)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    long_spans = F.filter("hit_spans", lambda s: (s[1] - s[0] > max_span) | ((s[1] - s[0] >= least_item) & (s[1] - s[0] < window)))

    @F.pandas_udf(T.StringType())
    def cut(t: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([cut_spans(a, b) if isinstance(a, str) and len(b) else a for a, b in zip(t, s, strict=True)], dtype=object)

    x = x.filter(n_hit <= F.col("n_words") * max_coverage).withColumn("spans", long_spans)
    touched = F.size("spans") > 0
    x = x.withColumn("clean", F.when(touched, cut(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    out = []
    for c in docs.columns:
        if c == text:
            out.append(F.col("clean").alias(c))
        elif c == "n_chars":
            out.append(F.when(touched, F.length("clean")).otherwise(F.col("row")[c]).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col("row")[c].alias(c))
    return x.select(*out)


def items_digest(names: list[str]) -> str:
    """items_sha256 of a list of ids, for tests."""
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
