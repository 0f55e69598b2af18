"""Similarity joins: banded Hamming, time-windowed and blocked cosine, boxes, and bursts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalume.functions.scores import iou, l2_normalize
from catalume.operators.nearest import BLOCKS, blocks_of, matrix, nearest_vectors
from catalume.sources.scratch import stage_table


def lookup_vectors(store: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return store.join(keys.select(key).distinct(), key, "left_semi")


def missing_vectors(images: DataFrame, store: DataFrame, hash_: str = "content_hash", key: str = "key") -> DataFrame:
    return images.filter(F.col(hash_).isNotNull()).join(store.select(F.col(key).alias("_k")), F.col(hash_) == F.col("_k"), "left_anti")


#: Pairs of keys that may meet for one key that is written, when the number of blocks is chosen.
PAIRS_FOR_A_KEY = 4

ALL_BITS = (1 << 64) - 1


def _blocks_of_bits(b: int, free: int = ALL_BITS) -> list[int]:
    """64 bits, or those of a mask, cut into b blocks, as masks."""
    places = [k for k in range(64) if free >> k & 1]
    edges = [len(places) * k // b for k in range(b + 1)]
    return [sum(1 << k for k in places[lo:hi]) for lo, hi in zip(edges, edges[1:], strict=False)]


def _code(n: int, t: int, free: int = ALL_BITS) -> tuple[int, list[tuple[int, int]]]:
    """Into how many blocks 64 bits (or those of a mask) are best cut for n hashes, and which sets of blocks are keys: (bits of the set, mask of its blocks).

    With b blocks, two hashes at most t bits apart agree in b - t blocks at least, so sets of that
    size are keys. More blocks make more keys a hash, and far fewer pairs that meet by chance.
    """
    cost = lambda b: math.comb(b, t) * (n + n * n / PAIRS_FOR_A_KEY / 2 ** (free.bit_count() * (b - t) / b))
    b = min(range(t + 1, t + 5), key=cost)
    bits = _blocks_of_bits(b, free)
    return b, [(sum(bits[k] for k in some), sum(1 << k for k in some)) for some in combinations(range(b), b - t)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hash_bits(hex16: Column) -> Column:
    """A hash of 16 hex digits as one long."""
    half = lambda k: F.conv(F.substring(hex16, k, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


#: Hashes of a cell, as it is aimed at, and from how many on it is cut into parts. Hashes of one key, from which on they get keys of their own. Pairs that a task hands on at a time.
CELL, LARGEST_CELL, LONG, HANDED = 4096, 1 << 21, 2048, 1 << 17


def _moves(bits: int) -> list[tuple[int, int]]:
    """How the bits of a set get to the top and the others below them: runs of bits, each with its shift to the left."""
    moves: dict[int, int] = {}
    for place, k in enumerate(sorted(range(64), key=lambda k: bits >> k & 1)):
        moves[place - k] = moves.get(place - k, 0) | 1 << k
    return [(some, by) for by, some in moves.items()]


def _moved(x: np.ndarray, moves: list[tuple[int, int]], back: bool = False) -> np.ndarray:
    y, part = np.zeros_like(x), np.empty_like(x)
    for some, by in moves:
        if back:
            some, by = (some << by if by > 0 else some >> -by), -by
        np.bitwise_and(x, some, out=part)
        (np.left_shift if by > 0 else np.right_shift)(part, abs(by), out=part)
        np.bitwise_or(y, part, out=y)
    return y


def _near_by_keys(x: np.ndarray, t: int, blocks: list[int], keys: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different hashes at most ``t`` bits apart whose first common key is one of ``keys``.

    For each key the hashes are sorted with its bits on top, so those that share it follow each other, and each
    meets the one d places on, for d = 1, 2, ... while any shares the key: no more than a pair a hash is held.
    Where very many share a key, the bits in which these differ are cut into blocks in their turn.
    """
    vary = _varying(x)
    for bits, mask in keys:
        # at its first key a pair differs in all blocks before the last one of the key that the key hasn't
        without = [blocks[k] for k in range(mask.bit_length()) if not mask >> k & 1]
        if not all(block & vary for block in without):
            continue
        moves = _moves(bits)
        y = _moved(x, moves)
        y.sort()
        beyond, d = 1 << 64 - bits.bit_count(), 1
        at = np.flatnonzero(y[1:] ^ y[:-1] < beyond)
        if len(at) >= LONG:
            ends = np.append(np.flatnonzero(np.diff(at) != 1), len(at) - 1)
            starts = np.append(0, ends[:-1] + 1)
            cut = np.zeros(len(ends), bool)
            for k in np.flatnonzero(ends - starts >= LONG):
                z = _moved(y[at[starts[k]] : at[ends[k]] + 2], moves, True)
                b, finer = _code(len(z), t, free := _varying(z))
                cut[k] = 2 * len(finer) < 2 ** (free.bit_count() * (b - t) / b)  # less than half of the pairs are left
                if cut[k]:
                    for p, q in _near_by_keys(z, t, _blocks_of_bits(b, free), finer):
                        yield _apart(p, q, p ^ q, without)
            at = at[np.repeat(~cut, ends - starts + 1)]
        differ = _moved(np.array(without, np.uint64), moves)
        diff = y[at] ^ y[at + 1]
        while len(at):
            some = np.bitwise_count(diff) <= t
            p, q = _apart(at[some], at[some] + d, diff[some], differ)
            if len(p):
                yield _moved(y[p], moves, True), _moved(y[q], moves, True)
            d += 1
            at = at[: np.searchsorted(at, len(y) - d)]
            diff = y[at] ^ y[at + d]
            some = diff < beyond
            at, diff = at[some], diff[some]


def _varying(x: np.ndarray) -> int:
    """The bits in which hashes differ."""
    return int(np.bitwise_or.reduce(x ^ x[:1])) if len(x) else 0


def _apart(p: np.ndarray, q: np.ndarray, diff: np.ndarray, blocks: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that differ in every one of the blocks."""
    for block in blocks:
        some = diff & block != 0
        p, q, diff = p[some], q[some], diff[some]
    return p, q


def _near_hashes(x: DataFrame, n: int, t: int) -> DataFrame:
    """(x, y) of ``n`` hashes x (long) at most ``t`` bits apart, each pair once; a hash that comes more than once is a pair with itself.

    A key is a set of blocks, and a cell takes all keys that begin with one block, so a hash is sent to t + 1
    cells, whatever the number of its keys; the keys are worked through inside the cell. A hot cell is cut into parts, and a task takes two.
    """
    b, keys = _code(n, t)
    blocks = _blocks_of_bits(b)
    begin = F.get(F.array(*[F.lit(_signed(some)) for some in blocks[: t + 1]]), F.col("k"))
    cell = F.pmod(F.xxhash64(F.col("x").bitwiseAND(begin)), F.lit(-(-n // CELL) or 1)) * (t + 1) + F.col("k")
    cells = x.select("x", F.explode(F.sequence(F.lit(0), F.lit(t))).alias("k")).select("x", cell.alias("cell"))
    hot = cells.groupBy("cell").count().filter(F.col("count") > LARGEST_CELL).collect() if n > LARGEST_CELL else []  # (t + 1) * n / LARGEST_CELL at most

    def near(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(rows)
        first = rows.column("cell")[0].as_py() % (t + 1)
        x, at, many = np.unique(rows.column("x").to_numpy().view(np.uint64), return_index=True, return_counts=True)
        cut = "l" in rows.column_names and rows.column("l")[0] != rows.column("r")[0]  # two parts: only pairs across them
        part = rows.column("part").to_numpy()[at] if cut else None
        same = x[many > 1] if first == 0 and not cut else x[:0]
        found, held = [(same, same)], len(same)
        for p, q in _near_by_keys(x, t, blocks, [(bits, mask) for bits, mask in keys if mask & -mask == 1 << first]):
            if cut:
                across = part[np.searchsorted(x, p)] != part[np.searchsorted(x, q)]
                p, q = p[across], q[across]
            found.append((p, q))
            held += len(p)
            if held >= HANDED:
                yield _hashes(found)
                found, held = [], 0
        if held:
            yield _hashes(found)

    pairs = cells.filter(~F.col("cell").isin([r["cell"] for r in hot])) if hot else cells
    pairs = pairs.groupBy("cell").applyInArrow(near, "x long, y long")
    if hot:
        parts = F.create_map(*[F.lit(v) for r in hot for v in (r["cell"], -(-2 * r["count"] // LARGEST_CELL))])[F.col("cell")]
        y = cells.filter(F.col("cell").isin([r["cell"] for r in hot])).withColumn("n", parts).withColumn("part", F.pmod(F.xxhash64("x", F.lit(1)), F.col("n")).cast("int"))
        y = y.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        y = y.select("x", "cell", "part", F.least("part", "other").alias("l"), F.greatest("part", "other").alias("r"))
        pairs = pairs.union(y.groupBy("cell", "l", "r").applyInArrow(near, "x long, y long"))
    return pairs


def _hashes(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*found, strict=True)], names=["x", "y"])


def hamming_join(df: DataFrame, id_: str = "id", hash_: str = "phash", t: int = 6) -> DataFrame:
    """(i, j, d): hashes at most ``t`` bits apart, exactly, by a covering code of blocks of bits.

    The bits are cut into b blocks; every set of b - t of them, with the bits in it, is a key, and
    a pair is taken only at the first set of blocks in which it agrees, so none comes twice. For
    t = 6 and ten blocks there are 210 keys a hash, and n * n / 240,000 pairs meet by chance; small
    tables take fewer blocks. A hash is sent to the t + 1 cells of the blocks with which a key may begin, and keys meet
    in there. Equal hashes are one point, the least id, so a flood of them makes
    no quadratic number of rows: the others come as star edges (least id, id, 0), and pairs of
    different hashes are between least ids. Null hashes are near nothing.
    """
    rows = df.filter(F.col(hash_).isNotNull()).select(F.col(id_).alias("i"), F.lower(hash_).alias("h"))
    points = stage_table(rows.groupBy("h").agg(F.min("i").alias("i"), F.count(F.lit(1)).alias("n")), "hashes")
    x = points.select(hash_bits(F.col("h")).alias("x"), "i").filter("x is not null")
    pairs = _near_hashes(x.select("x"), points.count(), t)
    # hashes get their ids back, one exchange of these for both sides; never broadcast: Spark takes hashes for smaller than they are
    near = pairs.alias("p").join(x.alias("l").hint("merge"), F.expr("p.x = l.x")).join(x.alias("r").hint("merge"), F.expr("p.y = r.x"))
    near = near.filter("if(p.x = p.y, l.i < r.i, l.i <> r.i)")
    near = near.select(F.least("l.i", "r.i").alias("i"), F.greatest("l.i", "r.i").alias("j"), F.expr("cast(bit_count(p.x ^ p.y) as int)").alias("d"))
    star = rows.withColumnRenamed("i", "j").join(points.filter("n > 1").drop("n"), "h").filter("i < j").select("i", "j", F.lit(0).alias("d"))
    return near.union(star)


_PAIR = "i long, j long, cos double"


def _product(rows: pa.Table, alike: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> pa.Table:
    """Pairs of a cell, of its two sides (0 and 1), or of the one that is both (2), that ``alike`` (of cosines, and t of both) takes."""
    side = rows.column("side").to_numpy()
    ids, v, t = rows.column("id").to_numpy(), matrix(rows.column("v")), rows.column("t").to_numpy()
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    step = max(1, min(512, 4_000_000 // max(1, len(right))))
    for a in range(0, len(left), step):
        one = left[a : a + step]
        c = v[one] @ v[right].T
        r, k = np.nonzero(alike(c, t[one], t[right]))
        i, j = one[r], right[k]
        if (side == 2).any():  # each pair once
            r, k, i, j = (x[i < j] for x in (r, k, i, j))
        found.append((np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), c[r, k]))
    i, j, c = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), "cos": pa.array(c, pa.float64())})


def _pairs_in_cells(x: DataFrame, sim: float, window: float | None, block: int) -> DataFrame:
    """Pairs at least ``sim`` alike of rows of one group, and with ``window`` of neighbouring groups, at most so far apart in t."""

    def alike(c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return c >= sim if window is None else (c >= sim) & (np.abs(a[:, None] - b[None]) <= window)

    return _in_cells(x, alike, window is not None, block)


def _in_cells(x: DataFrame, alike: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], neighbours: bool, block: int) -> DataFrame:
    """(i, j, cos), i < j, of rows of one group, or of neighbouring ones, that ``alike`` takes: x has id, v, t, grp.

    A group is cut into blocks, and a task multiplies two of them, each two once: a hot group is many
    tasks, and no pair becomes a row before it is known to be alike. Blocks grow with the group, so a row is sent to ``BLOCKS`` of them at most.
    """
    n = x.groupBy("grp").agg(blocks_of(F.count(F.lit(1)), block).alias("n"))
    after = n.select((F.col("grp") - 1).alias("grp"), F.col("n").alias("n_after"))
    before = n.select((F.col("grp") + 1).alias("grp"), F.col("n").alias("n_before"))
    n = n.join(after, "grp", "left").join(before, "grp", "left")
    own = F.pmod(F.xxhash64("id"), F.col("n")).cast("long")
    x = x.join(n, "grp").withColumn("b", own)
    cell = lambda grp, l, r, side, nxt: F.struct(grp.alias("grp"), F.lit(nxt).alias("nxt"), l.alias("l"), r.alias("r"), F.lit(side).alias("side"))
    many = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    side = lambda k: F.when(k == F.col("b"), 2).when(k > F.col("b"), 0).otherwise(1)
    inner = F.transform(many("n"), lambda k: cell(F.col("grp"), F.least("b", k), F.greatest("b", k), 0, 0).withField("side", side(k)))
    cells = inner
    if neighbours:
        none = F.array().cast(x.select(inner.alias("c")).schema["c"].dataType)
        to = F.when(F.col("n_after").isNotNull(), F.transform(many("n_after"), lambda k: cell(F.col("grp"), F.col("b"), k, 0, 1))).otherwise(none)
        of = F.when(F.col("n_before").isNotNull(), F.transform(many("n_before"), lambda k: cell(F.col("grp") - 1, k, F.col("b"), 1, 1))).otherwise(none)
        cells = F.concat(inner, to, of)
    y = x.select("id", "v", "t", F.explode(cells).alias("c")).select("id", "v", "t", "c.*")
    return y.groupBy("grp", "nxt", "l", "r").applyInArrow(lambda rows: _product(rows, alike), _PAIR)


def cosine_window_join(df: DataFrame, id_: str = "id", vec: str = "embedding", time: str = "capture_time", sim: float = 0.92, window: float = 600.0, block: int = 2048) -> DataFrame:
    """(i, j, cos), i < j: unit vectors at least ``sim`` alike and at most ``window`` seconds apart; a missing time is 0.

    Rows meet in buckets of the window's length and their neighbours. A hot bucket, as that of all rows without
    time, is cut into blocks. Rows without a vector are in no pair.
    """
    t = F.coalesce(F.col(time).cast("double"), F.lit(0.0))
    x = df.filter(F.col(vec).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"), t.alias("t"), F.floor(t / window).cast("long").alias("grp"))
    return _pairs_in_cells(x, sim, window, block)


def _touching(left: DataFrame, right: DataFrame, least: float, window: float | None = None, block: int = 8192) -> DataFrame:
    """(id) of rows of ``left`` that are at least ``least`` like a row of ``right`` of another photo, within ``window`` seconds if given.

    Both: id, image_id, t, v (unit vectors). Rows meet in blocks, of time if there is a window, and a
    task that multiplies two tells whom it found, so no pair becomes a row.
    """
    grp = F.lit(0).cast("long") if window is None else F.floor(F.col("t") / window).cast("long")
    cols = ["id", F.col("image_id").alias("photo"), "t", F.col("v").cast("array<double>").alias("v")]
    a = left.filter("v is not null").select(*cols, grp.alias("grp"))
    b = right.filter("v is not null").select(*cols, F.explode(F.array(grp) if window is None else F.array(grp - 1, grp, grp + 1)).alias("grp"))
    if window is not None:
        a, b = a.filter("grp is not null"), b.filter("grp is not null")
    n = a.groupBy("grp").agg(blocks_of(F.count(F.lit(1)), block).alias("nl")).join(b.groupBy("grp").agg(blocks_of(F.count(F.lit(1)), block).alias("nr")), "grp")
    part = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("long")
    many = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    keys = ["grp", "l", "r"]
    x = a.join(n, "grp").select("id", "photo", "t", "v", "grp", part("nl").alias("l"), many("nr").alias("r"))
    y = b.join(n, "grp").select("photo", "t", "v", "grp", many("nl").alias("l"), part("nr").alias("r"))

    def found(p: pa.Table, q: pa.Table) -> pa.Table:
        hit = np.zeros(len(p), bool)
        if len(p) and len(q):
            v, u = matrix(p.column("v")), matrix(q.column("v"))
            photo, other = p.column("photo").to_numpy(), q.column("photo").to_numpy()
            t, at = p.column("t").to_numpy(), q.column("t").to_numpy()
            step = max(1, min(512, 4_000_000 // len(q)))
            for k in range(0, len(p), step):
                some = slice(k, k + step)
                ok = (v[some] @ u.T >= least) & (photo[some, None] != other[None])
                if window is not None:
                    ok &= np.abs(t[some, None] - at[None]) <= window
                hit[some] = ok.any(1)
        return pa.table({"id": p.column("id").cast(pa.int64()).filter(pa.array(hit))})

    return x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInArrow(found, "id long").distinct()


def near_blocks(x: DataFrame, sim: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, v, p) by their nearest pivot p, and the pairs (p, q), p <= q, of pivots whose rows may be ``sim`` alike.

    One row in ``block`` is a pivot, drawn by a hash. A pivot's rows are within the angle of its farthest one,
    so two pivots that are farther apart than their two angles and that of ``sim`` have no pair.
    """
    n = x.count()
    x = x.select("id", "v", l2_normalize(F.col("v"), 1e-8).alias("unit"))
    pivots = stage_table(x.select("id", F.col("unit").alias("v"), F.xxhash64("id").alias("h")).orderBy("h", "id").limit(max(1, math.ceil(n / block))).select("id", "v"), "pivots")
    of = nearest_vectors(x.select("id", F.col("unit").alias("v")), pivots, 1).select("id", F.col("other").alias("p"), F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "value"))).alias("angle"))
    rows = stage_table(x.select("id", "v").join(of, "id"), "blocks")
    wide = rows.groupBy("p").agg(F.max("angle").alias("wide"))
    tops = pivots.join(wide, F.col("id") == F.col("p")).select("id", "v", "wide")
    reach = math.acos(max(-1.0, sim - 1e-5)) + 1e-6  # lengths are 1 to single precision only

    def meet(c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(c, -1, 1)) <= a[:, None] + b[None] + reach

    return rows.select("id", "v", "p"), _in_cells(tops.select("id", "v", F.col("wide").alias("t"), F.lit(0).cast("long").alias("grp")), meet, False, 2048).select(F.col("i").alias("p"), F.col("j").alias("q"))


def cosine_all_pairs(df: DataFrame, id_: str = "id", vec: str = "embedding", sim: float = 0.5, block: int = 2048, normalize: bool = True) -> DataFrame:
    """(i, j, cos), i < j, of all pairs of vectors at least ``sim`` alike.

    Quadratic by definition, but blocks are made by nearness to pivots, and two blocks are
    multiplied, once and in one task, only where the angles between them allow ``sim``; a block of many rows is
    cut further. Only what is alike comes out. With ``sim`` of 0 or less, few rows, or where pivots
    leave out too little, blocks are made by hash; then a row is sent to ``BLOCKS`` blocks (more from 65,536 rows a block on).
    ``normalize`` False: vectors have length 1, to single precision, and are multiplied as they are.
    """
    v = l2_normalize(F.col(vec), 1e-8) if normalize else F.col(vec).cast("array<double>")
    x = df.filter(F.col(vec).isNotNull()).select(F.col(id_).cast("long").alias("id"), v.alias("v"))
    by_hash = lambda: _pairs_in_cells(x.select("id", "v", F.lit(0.0).alias("t"), F.lit(0).cast("long").alias("grp")), sim, None, block)
    if sim <= 0 or (rows_in := x.count()) <= 2 * block:
        return by_hash()
    x = x.filter(F.exists("v", lambda e: e != 0))  # a vector of zeros is like nothing
    rows, pairs = near_blocks(x, sim, block)
    pairs = stage_table(pairs, "meet")
    n = rows.groupBy(F.col("p").alias("_p")).agg(F.count(F.lit(1)).alias("rows"), blocks_of(F.count(F.lit(1)), block).alias("n"))
    side = lambda c: n.select(F.col("_p").alias(c), F.col("rows").alias(f"rows_{c}"), F.col("n").alias(f"n{c}"))
    pairs = pairs.join(side("p"), "p").join(side("q"), "q")
    sent = pairs.agg(F.sum(F.col("rows_p") * F.col("nq") + F.col("rows_q") * F.col("np"))).first()[0] or 0
    if sent > BLOCKS * rows_in:
        return by_hash()
    own = _pairs_in_cells(rows.select("id", "v", F.lit(0.0).alias("t"), F.col("p").alias("grp")), sim, None, block)
    part = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("long")
    many = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = rows.join(pairs, "p").select("id", "v", "p", "q", part("np").alias("l"), many("nq").alias("r"), F.lit(0).alias("side"))
    right = rows.withColumnRenamed("p", "q").join(pairs, "q").select("id", "v", "p", "q", many("np").alias("l"), part("nq").alias("r"), F.lit(1).alias("side"))
    cells = left.unionByName(right).withColumn("t", F.lit(0.0))
    alike = lambda c, a, b: c >= sim
    return own.union(cells.groupBy("p", "q", "l", "r").applyInArrow(lambda rows: _product(rows, alike), _PAIR))


def duplicate_edges(df: DataFrame, t: int = 6, sim: float = 0.92, window: float = 600.0, id_: str = "id", hash_: str = "phash", vec: str = "embedding", time: str = "capture_time") -> DataFrame:
    """(i, j): near by hash, or alike within the window. Two joins instead of one with OR."""
    return hamming_join(df, id_, hash_, t).select("i", "j").union(cosine_window_join(df, id_, vec, time, sim, window).select("i", "j")).distinct()


def _sources(p: pa.Table, q: pa.Table, seconds: float, k: int, difference: float) -> pa.Table:
    """The k best sources in ``q`` of each target in ``p``. Looks differ by what their means do at least, so only rows of near means are compared; the reach doubles for targets that may find better ones beyond it."""
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 3]
    if len(p) and len(q):
        (ids, t, w, h, look), (jds, at, cw, ch, other) = ((*(x.column(c).to_numpy() for c in ("id", "t", "w", "h")), matrix(x.column("preview"))) for x in (p, q))
        mean = other.mean(1)
        by = np.argsort(mean, kind="stable")
        jds, at, cw, ch, other, mean = jds[by], at[by], cw[by], ch[by], other[by], mean[by]
        own = look.mean(1)
        todo, reach = np.argsort(own, kind="stable"), min(difference, 64 * (mean[-1] - mean[0]) / len(q) + 1e-6)
        while len(todo):
            again = []
            start = 0
            while start < len(todo):
                some = todo[start : start + 128]
                lo = np.searchsorted(mean, own[some[0]] - reach - 1e-9)
                hi = np.searchsorted(mean, own[some[-1]] + reach + 1e-9, side="right")
                start += len(some)
                diff = np.zeros((len(some), hi - lo))
                for d in range(look.shape[1]):
                    diff += np.abs(look[some, d, None] - other[None, lo:hi, d])
                diff /= look.shape[1]
                gap = np.abs(t[some, None] - at[None, lo:hi])
                shape = (w[some, None] * ch[None, lo:hi]) / (h[some, None] * cw[None, lo:hi])
                ok = (ids[some, None] != jds[None, lo:hi]) & (gap <= seconds) & (shape >= 0.95) & (shape <= 1.05) & (diff <= difference)
                sure = ok & (diff < reach - 1e-9) if reach < difference else ok
                done = (sure.sum(1) >= k) | (reach >= difference)
                again.append(some[~done])
                diff = np.where(ok, diff, np.inf)
                if hi - lo > k:  # no farther than the k-th
                    ok &= diff <= np.partition(diff, k - 1, axis=1)[:, k - 1 : k]
                r, c = np.nonzero(ok & done[:, None])
                one = (ids[some[r]], jds[lo + c], diff[r, c], gap[r, c], at[lo + c])
                order = np.lexsort((one[1], one[4], one[3], one[2], one[0]))
                one = tuple(x[order] for x in one)
                first = np.flatnonzero(np.append(True, one[0][1:] != one[0][:-1])) if len(order) else np.zeros(0, np.int64)
                place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
                found.append(tuple(x[place < k] for x in one))
            todo, reach = np.concatenate(again), min(difference, 2 * reach)
    return pa.table(dict(zip(("target", "source", "diff", "gap", "at"), (np.concatenate(x) for x in zip(*found, strict=True)), strict=True)))


def burst_sources(frames: DataFrame, proposals: DataFrame, seconds: float = 8.0, k: int = 2, difference: float = 30.0, block: int = 20_000) -> DataFrame:
    """For each frame the up to ``k`` other frames with proposals, near in time, of the same shape and look.

    frames: id, capture_time, w, h, orientation, preview (array<double>, of one length); proposals: id. Targets and
    sources meet in a task for each bucket of time and orientation (targets are cut into blocks of ``block``), which keeps the
    k best of each target: no pair is shuffled.
    """
    around = F.floor(F.col("capture_time") / seconds).cast("long")
    cols = [F.col("id").cast("long").alias("id"), F.col("capture_time").cast("double").alias("t"), F.col("w").cast("double").alias("w"), F.col("h").cast("double").alias("h"), "orientation", F.col("preview").cast("array<double>").alias("preview")]
    whole = frames.filter("capture_time is not null and w > 0 and h > 0 and orientation is not null and preview is not null and size(preview) > 0 and not exists(preview, x -> x is null)")
    a = whole.select(*cols, around.alias("b"))
    c = whole.join(proposals.select("id").distinct(), "id", "left_semi").select(*cols, F.explode(F.array(around - 1, around, around + 1)).alias("b"))
    n = a.groupBy("b", "orientation").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("n"))
    a = a.join(n, ["b", "orientation"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("n")).cast("long"))
    c = c.join(n, ["b", "orientation"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    a, c = (x.select(*[F.col(name).alias(name) for name in ("id", "t", "w", "h", "preview", "b", "orientation", "part")]) for x in (a, c))
    keys = ["b", "orientation", "part"]
    x = a.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(lambda p, q: _sources(p, q, seconds, k, difference), "target long, source long, diff double, gap double, at double")
    w = Window.partitionBy("target").orderBy("diff", "gap", "at", "source")
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("target", "source", "diff", "rank")


BOX = ("x1", "y1", "x2", "y2")


def _box(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(prefix + c) for c in BOX)


def match_same_face(boxes: DataFrame, faces: DataFrame, min_iou: float = 0.5, key: str = "image_id", how: str = "inner") -> DataFrame:
    """Each box (box_id) with the face (id) of the same photo that overlaps it best; of equal ones the last."""
    f = faces.select(F.col("id").alias("face_id"), F.col(key).alias("_k"), *[F.col(c).alias(f"f_{c}") for c in BOX])
    x = boxes.join(f, boxes[key] == f["_k"], how).withColumn("iou", iou(_box(), _box("f_"))).filter(F.col("iou") >= min_iou)
    w = Window.partitionBy("box_id").orderBy(F.desc("iou"), F.desc("face_id"))
    return x.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("box_id", "face_id", "iou")


def drop_overlapping(boxes: DataFrame, known: DataFrame, max_iou: float = 0.25, key: str = "image_id") -> DataFrame:
    """Boxes that overlap no known box of the same photo by ``max_iou`` or more."""
    k = known.select(F.col(key).alias("_k"), *[F.col(c).alias(f"k_{c}") for c in BOX]).distinct()
    return boxes.join(k, (boxes[key] == k["_k"]) & (iou(_box(), _box("k_"), clamp=False) >= max_iou), "left_anti")


def rescue_faces(candidates: DataFrame, anchors: DataFrame, rounds: int = 3, min_prob: float = 0.95, window: float = 600.0, near: float = 0.50, anywhere: float = 0.60, overlap: float = 0.25) -> DataFrame:
    """Candidates that match a face accepted in another photo; each one accepted is an anchor of the next round.

    Both tables: id, image_id, capture_time, x1..y2, v (unit vector); candidates also prob.
    Returns id, round. A candidate that overlaps an accepted box of its photo is out.
    """
    pool = candidates.filter(F.col("prob") >= min_prob)
    cols = ["id", "image_id", "capture_time", *BOX, "v"]
    side = lambda df: df.select("id", "image_id", F.col("capture_time").cast("double").alias("t"), "v")
    known = anchors.select(cols)
    out = []
    for k in range(1, rounds + 1):
        # who is left has no match among the earlier ones
        pool = stage_table(drop_overlapping(pool, known, overlap), "pool")
        hits = stage_table(_touching(side(pool), side(known), near, window).union(_touching(side(pool), side(known), anywhere)).distinct(), "rescued")
        known = pool.join(hits, "id", "left_semi").select(cols)
        out.append(known.select("id", F.lit(k).alias("round")))
        pool = pool.join(hits, "id", "left_anti")
    return reduce(DataFrame.union, out)
