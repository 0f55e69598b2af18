"""The k nearest vectors of another table, as matrix products of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalume.functions.scores import l2_normalize

#: Rows of a block, and bytes of vectors of a side that is broadcast at most.
BLOCK, BROADCAST = 2048, 32_000_000

#: Blocks that a side is cut into, as long as a block has at most so many rows: what is shuffled grows with the rows then, not with their square.
BLOCKS, LARGEST = 12, 65_536

_FOUND = "grp long, id long, other long, kind string, value double"


def blocks_of(n: Column, block: int) -> Column:
    """Into how many blocks n rows are cut: of ``block`` rows while these are few, then into ``BLOCKS``."""
    rows = F.greatest(F.lit(block), F.least(F.lit(LARGEST), F.ceil(n / BLOCKS)))
    return F.ceil(n / rows).cast("long")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length, none null, as rows."""
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(x), -1) if len(x) else np.zeros((0, 0))


def _first_best(s: np.ndarray, ids: np.ndarray, others: np.ndarray, floor: float | None, apart: bool, digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that have a best one among ``others`` (in the order of ids, all different), its value, and which it is. Only the greatest values are rounded."""
    if apart:
        at = np.minimum(np.searchsorted(others, ids), len(others) - 1)
        own = np.flatnonzero(others[at] == ids)
        s[own, at[own]] = -np.inf
    at = s.argmax(1)
    top = s[np.arange(len(s)), at]
    value = top if digits is None else np.round(top, digits)
    rows = np.flatnonzero(np.isfinite(top) if floor is None else value >= floor)
    if digits is not None:  # values below the greatest may be equal to it when they are rounded
        least = np.where(np.isfinite(top), top, np.inf) - 1.5 * 10.0**-digits
        r, c = np.nonzero(s >= least[:, None])
        tie = np.round(s[r, c], digits) == value[r]
        r, first = np.unique(r[tie], return_index=True)
        at[r] = c[tie][first]
    return rows, value[rows], at[rows]


def _best(group: np.ndarray, ids: np.ndarray, v: np.ndarray, others: np.ndarray, kinds: np.ndarray, u: np.ndarray, k: int, floor: float | None, clip: float | None, apart: bool, digits: int | None) -> pa.Table:
    """For each row of a block its k best kinds in another one, each by its best member: the first of equal ones.

    Others are sorted by kind, then id; a kind's members follow each other.
    """
    first = np.append(True, kinds[1:] != kinds[:-1]) if len(kinds) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    out: list[tuple[np.ndarray, ...]] = []
    step = max(1, min(512, 4_000_000 // max(1, len(others))))
    one = k == 1 and clip is None and len(others) > 0 and bool((others[1:] > others[:-1]).all()) and len(starts) == len(others)
    for a in range(0, len(ids), step):
        s = v[a : a + step] @ u.T
        if one:
            mine, value, at = _first_best(s, ids[a : a + step], others, floor, apart, digits)
            out.append((group[a + mine], ids[a + mine], at, value))
            continue
        if digits is not None:
            s = np.round(s, digits)
        if clip is not None:
            s = np.maximum(s, clip)
        if apart:
            s[ids[a : a + step, None] == others[None]] = -np.inf
        if len(starts) == len(others):
            top, at = s, np.broadcast_to(np.arange(len(others)), s.shape)
        else:
            top = np.maximum.reduceat(s, starts, axis=1)
            wide = np.repeat(top, np.diff(np.append(starts, len(others))), axis=1)
            place = np.where(s == wide, np.arange(len(others)), len(others))
            at = np.minimum.reduceat(place, starts, axis=1)
        best = top.argmax(1)[:, None] if k == 1 else np.argsort(-top, axis=1, kind="stable")[:, :k]
        value = np.take_along_axis(top, best, 1)
        ok = np.isfinite(value) if floor is None else value >= floor
        r, c = np.nonzero(ok)
        out.append((group[a + r], ids[a + r], np.take_along_axis(at, best, 1)[r, c], value[r, c]))
    g, i, j, value = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    return pa.table({"grp": pa.array(g, pa.int64()), "id": pa.array(i, pa.int64()), "other": pa.array(others[j], pa.int64()), "kind": pa.array(kinds[j].tolist(), pa.string()), "value": pa.array(value, pa.float64())})


def _sorted(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = rows.sort_by([("kind", "ascending"), ("other", "ascending")])
    kinds = np.array(rows.column("kind").to_pylist(), object)
    return rows.column("other").to_numpy(), kinds, matrix(rows.column("u"))


def nearest_vectors(left: DataFrame, right: DataFrame, k: int = 1, by: str | None = None, group: str | None = None, floor: float | None = None, clip: float | None = None, apart: bool = False, digits: int | None = None, block: int = BLOCK, broadcast: int = BROADCAST) -> DataFrame:
    """(id, other, kind, value, rank), with ``group`` if given: for each row of ``left`` the k rows of ``right`` with the greatest product of vectors.

    left, right: id (long), v (vectors of one length); rows without a vector are left out. ``by``
    names a column of ``right`` with kinds: then the k best kinds are told, each by its best row.
    ``group``: a whole-number column of both sides, only rows of one group are compared. ``floor``: least value that counts;
    ``clip``: smaller values count as this; ``apart``: a row is not its own neighbour; ``digits``: values are rounded before they are compared.
    Of equal values the first kind, then the least id wins.

    Without groups, a right side of at most ``broadcast`` bytes, by its count, is sent to all tasks and
    the left one isn't shuffled. Otherwise both sides are cut into blocks; a task multiplies two and
    keeps the k best of each row, and these are merged, so what is shuffled for a row is itself and k
    for each block of the other side. Blocks grow with the rows: :func:`blocks_of`.
    """
    grp = lambda df: (df[group] if group else F.lit(0)).cast("long").alias("grp")
    a = left.filter("v is not null").select(grp(left), left["id"].cast("long").alias("id"), left["v"].cast("array<double>").alias("v"))
    kind = right[by].cast("string") if by else F.lpad((right["id"].cast("decimal(20)") + F.lit(str(1 << 63)).cast("decimal(20)")).cast("string"), 20, "0")
    b = right.filter("v is not null").select(grp(right), right["id"].cast("long").alias("other"), kind.alias("kind"), right["v"].cast("array<double>").alias("u"))
    how = (k, floor, clip, apart, digits)
    if not group:
        size = b.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("u")).alias("d")).first()
        if (size["n"] * (size["d"] or 0)) * 8 <= broadcast:
            return _ranked(_mapped(a, b, how), k, group, merge=False)
    counts = lambda df, name: df.groupBy("grp").agg(blocks_of(F.count(F.lit(1)), block).alias(name))
    blocks = counts(a, "l").join(counts(b, "r"), "grp")
    span = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("long")
    x = a.join(blocks, "grp").select("grp", "id", "v", own("id", "l").alias("bl"), span("r").alias("br"))
    y = b.join(blocks, "grp").select("grp", "other", "kind", "u", own("other", "r").alias("br"), span("l").alias("bl"))

    def product(p: pa.Table, q: pa.Table) -> pa.Table:
        if not len(p) or not len(q):
            return _best(*(np.zeros(0, np.int64),) * 2, np.zeros((0, 0)), np.zeros(0, np.int64), np.zeros(0, object), np.zeros((0, 0)), *how)
        others, kinds, u = _sorted(q)
        return _best(p.column("grp").to_numpy(), p.column("id").to_numpy(), matrix(p.column("v")), others, kinds, u, *how)

    keys = ["grp", "bl", "br"]
    return _ranked(x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInArrow(product, _FOUND), k, group, merge=True)


def _mapped(a: DataFrame, b: DataFrame, how: tuple) -> DataFrame:
    """The right side, whose size was checked, is broadcast."""
    rows = sorted(((r["kind"], r["other"], r["u"]) for r in b.collect()))
    shared = a.sparkSession.sparkContext.broadcast((np.array([r[1] for r in rows], np.int64), np.array([r[0] for r in rows], object), np.array([r[2] for r in rows], np.float64)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others, kinds, u = shared.value
        for x in batches:
            if len(x) and len(others):
                yield from _best(x.column(0).to_numpy(), x.column(1).to_numpy(), matrix(x.column(2)), others, kinds, u, *how).to_batches()

    return a.mapInArrow(scan, _FOUND)


def _ranked(found: DataFrame, k: int, group: str | None, merge: bool) -> DataFrame:
    """Ranks, and of several blocks' best ones the best (each kind once)."""
    of = ["grp", "id"]
    if merge:
        found = found.groupBy(*of, "kind").agg(F.max(F.struct("value", (-F.col("other")).alias("o"))).alias("m")).select(*of, "kind", F.col("m.value").alias("value"), (-F.col("m.o")).alias("other"))
    rank = F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("value"), "kind"))
    x = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return x.select(*([F.col("grp").alias(group)] if group else []), "id", "other", "kind", "value", "rank")


def nearest_centroid(refs: DataFrame, centroids: DataFrame, max_dist: float = 0.40) -> DataFrame:
    """ref, cluster_id, dist: the nearest centroid below the cutoff (of equal ones the least id).

    refs: ref, v; centroids: cluster_id, centroid.
    """
    x = nearest_vectors(refs.select(F.col("ref").alias("id"), "v"), centroids.select(F.col("cluster_id").alias("id"), F.col("centroid").alias("v")))
    return x.select(F.col("id").alias("ref"), F.col("other").alias("cluster_id"), (1 - F.col("value")).alias("dist")).filter(F.col("dist") < max_dist)


def similar_people(centroids: DataFrame, floor: float = 0.35, k: int = 6) -> DataFrame:
    """cluster_id, other, cos, rank: up to ``k`` other people whose centroid is ``floor`` or more alike (of equal ones the least id first)."""
    v = centroids.select(F.col("cluster_id").alias("id"), F.col("centroid").alias("v"))
    return nearest_vectors(v, v, k, floor=floor, apart=True).select(F.col("id").alias("cluster_id"), "other", F.col("value").alias("cos"), "rank")


def zero_shot(items: DataFrame, labels: DataFrame, k: int = 3) -> DataFrame:
    """(id, best_label, best_category, top): the nearest label, and the k best categories by their best label (0 at least).

    items: id, v; labels: label, category, v.
    """
    x = items.select("id", l2_normalize(F.col("v"), 1e-8).alias("v"))
    y = labels.select(F.xxhash64("label").alias("id"), l2_normalize(F.col("v"), 1e-8).alias("v"), "label", "category")
    best = nearest_vectors(x, y, 1, by="label").select("id", F.col("kind").alias("label")).join(labels.select("label", "category"), "label")
    top = nearest_vectors(x, y, k, by="category", clip=0.0).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "kind"))).alias("a"))
    return best.join(top, "id").select("id", F.col("label").alias("best_label"), F.col("category").alias("best_category"), F.transform("a", lambda c: c["kind"]).alias("top"))
