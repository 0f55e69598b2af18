"""Near-duplicates: fast similarity sketching, banding, and exact verification.

The sketch (Dahlgaard, Knudsen and Thorup, FOCS 2017) has t coordinates. In round i of the first
t rounds each shingle is hashed to one coordinate and to a value i + fraction, and the least
value of a coordinate stays; in t further rounds every shingle is hashed to the one coordinate of
that round. Rounds stop as soon as all coordinates of a document are filled, after O(log t) of
them for long texts and 2 t at most, so each coordinate agrees with the chance of the
similarity, and estimates concentrate as with t independent hash functions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalume.llm.common import WORD, fresh
from catalume.operators.graph import connected_components
from catalume.sources.scratch import stage_table

#: Coordinates of a sketch that make one band.
ROWS = 6
#: Chance with which a pair right at the threshold shares no band.
MISS = 1e-8
#: Shingles that are sketched together.
BATCH = 400_000
#: Mixed buckets of so many nodes give their pairs; larger ones are compared in tiles of about so many nodes, over pieces of so many shingles.
LITTLE, TILE, PIECE = 8, 128, 16_384

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; with fewer words, of the whole sequence."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(k, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mix(out + h[i : len(h) - n + 1 + i]) * _ODD[0]
    return np.unique(out)


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """A row of t coordinates for each non-empty set."""
    e = np.concatenate(sets)
    d = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    s = np.full(len(sets) * t, _NONE)
    for i in range(2 * t):
        h = _mix(e + np.uint64((i + 1) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF))
        at = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(s, d * t + at, (np.uint64(i) << np.uint64(48)) | (_mix(h) >> np.uint64(16)))
        if i < t or i % 16 == 0:
            open_ = (s.reshape(-1, t) == _NONE).any(1)
            if not open_.any():
                break
            more = open_[d]
            e, d = e[more], d[more]
    return s.reshape(-1, t)


def band_count(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands needed so that a pair at the threshold shares none with the chance ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def band_keys(s: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each sketch."""
    n, t = s.shape
    x = s.reshape(n, t // rows, rows)
    out = np.broadcast_to(np.arange(t // rows, dtype=np.uint64), (n, t // rows)).copy()
    for i in range(rows):
        out = _mix((out ^ x[:, :, i]) * _ODD[2] + _ODD[3])
    return out.view(np.int64)


def _sets(docs: DataFrame, doc_id: str, text: str, k: int, threshold: float) -> DataFrame:
    """doc_id, text_key, n_shingles, set_a, set_b (a 128-bit fingerprint of the set, null if it is empty), bands."""
    t = ROWS * band_count(threshold)
    kind = pa.list_(pa.int64())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2)
            start = 0
            while start < b.num_rows:
                sets, total = [], 0
                while start + len(sets) < b.num_rows and (not sets or total < BATCH):
                    sets.append(shingles(texts[start + len(sets)].as_py(), k))
                    total += len(sets[-1])
                n = np.array([len(x) for x in sets], np.int64)
                some = np.flatnonzero(n)
                full = [sets[i] for i in some]
                a = np.array([_mix(x * _ODD[4]).sum(dtype=np.uint64) for x in full], np.uint64).view(np.int64)
                c = np.array([_mix(x ^ _ODD[5]).sum(dtype=np.uint64) for x in full], np.uint64).view(np.int64)
                keys = band_keys(sketches(full, t), ROWS) if full else np.zeros((0, t // ROWS), np.int64)
                of = np.full(len(sets), -1)
                of[some] = np.arange(len(some))
                none = of < 0
                take = np.where(none, 0, of)
                put = lambda v: pa.array(v[take] if len(v) else np.zeros(len(sets), np.int64), pa.int64(), mask=none)
                bands = pa.array([None if i < 0 else keys[i] for i in of], kind)
                part = b.slice(start, len(sets))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), put(a), put(c), bands], names=["doc_id", "text_key", "n_shingles", "set_a", "set_b", "bands"])
                start += len(sets)

    narrow = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_key(docs, doc_id, text).alias("text_key"), docs[text].alias("text"))
    return narrow.mapInArrow(scan, "doc_id long, text_key long, n_shingles long, set_a long, set_b long, bands array<long>")


def _full_sets(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """node, shingles (binary) of the given nodes, from the text of one document each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [shingles(x.as_py(), k).tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["node", "shingles"])

    d = docs.select(docs[doc_id].cast("long").alias("of_id"), text_key(docs, doc_id, text).alias("text_key"), docs[text].alias("text"))
    rows = d.join(nodes.select("node", "least_id", "text_key"), "text_key").filter(F.col("of_id").eqNullSafe(F.col("least_id")))
    return rows.dropDuplicates(["text_key"]).select("node", "text").mapInArrow(scan, "node long, shingles binary")


def _common(u: np.ndarray, v: np.ndarray) -> int:
    both = np.sort(np.concatenate((u, v)), kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _confirmed(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """Of the pairs (a, b) those with 100 * |A and B| >= pct * |A or B|, on the full sets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = _common(u, v)
                good.append(100 * common >= pct * (len(u) + len(v) - common))
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(scan, "a long, b long")


def _products(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of the two sides, by products of 0/1 matrices over pieces of the shingles."""
    every, at = np.unique(np.concatenate(left + right), return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in left + right])
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    out = np.zeros((len(left), len(right)), np.float64)
    for a in range(0, len(every), PIECE):
        i, j = np.searchsorted(at, [a, a + PIECE])
        m = np.zeros((len(left) + len(right), min(PIECE, len(every) - a)), np.float32)
        m[row[i:j], at[i:j] - a] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def cell_links(table: pa.Table, pct: int) -> pa.Table:
    """Links between the two sides of a cell: nodes that share a band, are of different labels, and are similar enough."""
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    side = np.array(table.column("side"))
    l, r = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 2 is on both
    if not len(l) or not len(r):
        return none
    node, label, size = (np.array(table.column(c)) for c in ("node", "label", "size"))
    bands = np.array(table.column("bands").to_pylist(), np.int64)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for c in table.column("shingles").chunks for x in c]
    able = label[l][:, None] != label[r][None]
    small, large = np.minimum(size[l][:, None], size[r][None]), np.maximum(size[l][:, None], size[r][None])
    able &= 100 * small >= pct * large
    share = np.zeros_like(able)
    for k in range(bands.shape[1]):
        share |= bands[l, k][:, None] == bands[r, k][None]
    i, j = np.nonzero(able & share)
    if not len(i):
        return none
    if len(i) > 4 * len(side):
        common = _products([sets[x] for x in l], [sets[x] for x in r])[i, j]
    else:
        common = np.array([_common(sets[l[x]], sets[r[y]]) for x, y in zip(i, j, strict=True)])
    good = 100 * common >= pct * (size[l[i]] + size[r[j]] - common)
    a, b = node[l[i[good]]], node[r[j[good]]]
    return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def _family_links(large: DataFrame, nodes: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """Links across labels within large mixed buckets (key, node, label), in cells of two tiles of nodes.

    Buckets that share nodes are one family, so that no pair is compared once for each band. In
    a family only nodes outside its largest label need to be compared with the others: their
    tiles meet all tiles, and those of the largest label never meet each other.
    """
    head = large.groupBy("key").agg(F.min("node").alias("head"))
    family = connected_components(large.join(head, "key").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct())
    member = large.select("node", "label").distinct().join(family, "node").withColumnRenamed("component", "family")
    counts = member.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n"))
    core = counts.groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("core"), F.max("n").alias("n_core"), F.sum("n").alias("n_all"))
    tiles = lambda n: F.ceil(n / TILE).cast("int")
    m = member.join(core, "family").withColumn("rest", F.col("label") != F.col("core"))
    m = m.withColumns({"n_r": F.greatest(F.lit(1), tiles(F.col("n_all") - F.col("n_core"))), "n_c": tiles(F.col("n_core"))})
    m = m.withColumn("tile", F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("n_r")).otherwise(F.col("n_c"))).cast("int"))
    cell = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.alias("side"))
    t, zero = F.col("tile"), F.lit(0)
    upto = lambda n: F.sequence(zero, n - 1)
    with_core = F.transform(upto(F.col("n_c")), lambda j: cell(t, j, zero))
    with_rest = F.transform(upto(F.col("n_r")), lambda j: cell(F.least(t, j), -F.greatest(t, j) - 1, F.when(j == t, 2).when(t < j, 0).otherwise(1)))
    as_core = F.transform(upto(F.col("n_r")), lambda i: cell(i, t, F.lit(1)))
    cells = m.select("family", "node", "label", F.explode(F.when(F.col("rest"), F.concat(with_core, with_rest)).otherwise(as_core)).alias("c")).select("family", "c.i", "c.j", "c.side", "node", "label")
    full = cells.join(nodes.select("node", "size", "bands"), "node").join(sets, "node")
    return full.groupBy("family", "i", "j").applyInArrow(lambda x: cell_links(x, pct), "a long, b long")


def text_key(docs: DataFrame, doc_id: str, text: str) -> Column:
    return F.xxhash64(docs[doc_id].cast("long"), docs[text])


def near_duplicates(docs: DataFrame, threshold: float = 0.8, k: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, n_shingles, component_id, group.

    Documents are linked if the Jaccard similarity of their sets of k-word shingles is the
    threshold or more; component_id is the least doc_id that links lead to, group a number of the
    component (null without shingles).

    Documents with one and the same set are one node from the start, however many. Nodes that
    share a band are candidates. Not all pairs of a bucket are made: first each node is compared
    with one pivot of its bucket, and what is linked becomes one component. Buckets of one
    component, as those of true copies, are done. Of the others, small ones give their pairs
    across components; large ones are compared in cells of two tiles of nodes inside tasks, where
    only links come out. No link between components is lost, and there is no cap on buckets. All
    comparisons are on full sets.

    Null and wordless texts have no shingles and are a component each. Repeated rows are copies.
    A null doc_id is no candidate for component_id: a component of only null ids has null.
    """
    pct = round(threshold * 100)
    docs_sets = stage_table(_sets(docs, doc_id, text, k, threshold), "sets")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    own = docs_sets.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(F.first("n_shingles").alias("size"), F.min_by(F.struct("doc_id", "text_key", "bands"), first).alias("r"))
    nodes = stage_table(own.select(F.monotonically_increasing_id().alias("node"), "set_a", "set_b", "size", F.col("r.doc_id").alias("least_id"), "r.text_key", "r.bands"), "nodes")

    rows = nodes.select("node", "size", F.explode("bands").alias("key"))
    heads = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("node").alias("h"), "node", "size")).alias("p")).filter("n > 1")
    buckets = stage_table(rows.join(heads, "key").select("key", "node", "size", "n", F.col("p.node").alias("pivot"), F.col("p.size").alias("its_size")), "buckets")
    sets = stage_table(_full_sets(docs, nodes.join(buckets, "node", "left_semi"), doc_id, text, k), "full")

    # sets of too different sizes can't be linked
    able = F.least("size", "its_size") * 100 >= F.greatest("size", "its_size") * pct
    pair = lambda df: df.filter(able).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    links = stage_table(_confirmed(pair(buckets.filter("node != pivot")), sets, pct), "links")
    label = connected_components(links)

    open_ = buckets.filter("n > 2").join(label, "node", "left").select("key", "node", "size", "n", F.coalesce("component", "node").alias("label"))
    mixed = open_.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
    open_ = stage_table(open_.join(mixed, "key"), "mixed")
    little = open_.filter(F.col("n") <= LITTLE)
    other = little.select("key", F.col("node").alias("pivot"), F.col("size").alias("its_size"), F.col("label").alias("its"))
    across = _confirmed(pair(little.join(other, "key").filter("node < pivot and label != its")), sets, pct)
    inside = _family_links(open_.filter(F.col("n") > LITTLE).select("key", "node", "label"), nodes, sets, pct)
    links = stage_table(links.union(across).union(inside), "links")
    label = connected_components(links)

    named = nodes.join(label, "node", "left").select("set_a", "set_b", "least_id", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_set = named.join(least, "component").select(F.col("set_a").alias("sa"), F.col("set_b").alias("sb"), F.col("component").alias("group"), F.col("component_id").alias("cid"))
    x = docs_sets.drop("bands").join(of_set, (F.col("set_a") == F.col("sa")) & (F.col("set_b") == F.col("sb")), "left")
    return x.select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("cid")).otherwise(F.col("doc_id")).alias("component_id"), "group")


def duplicate_report(docs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document row."""
    x = near_duplicates(docs, threshold)
    return x.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near-duplicates: that of the least doc_id; of repeated rows one.

    Documents without words all stay. Columns are those of ``docs``.
    """
    key, nth = fresh(docs, "text_key_of_row", "nth_of_row")
    x = near_duplicates(docs, threshold, doc_id=doc_id, text=text).filter("n_shingles > 0")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    keep = x.groupBy("group").agg(F.min_by("text_key", first).alias("_keep"))
    worded = F.coalesce(docs[text].rlike(WORD), F.lit(False))
    rows = docs.filter(worded).withColumn(key, text_key(docs, doc_id, text))
    kept = rows.join(keep, rows[key] == keep["_keep"], "left_semi")
    one = kept.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(key))).filter(F.col(nth) == 1)
    return one.select(*docs.columns).unionByName(docs.filter(~worded))
