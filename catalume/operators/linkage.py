"""Average linkage: components of a similarity graph split into cohesive parts, whatever their size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalume.functions.scores import dot
from catalume.operators.nearest import matrix, nearest_vectors
from catalume.operators.similarity import hamming_join
from catalume.sources.scratch import stage_table

#: Points of a component that is split in one task (its matrix takes four bytes a pair); larger ones are split in rounds of joins, with the same result.
IN_TASK = 10_000
#: Clusters of a component that are left after some rounds, and that one task merges to the end (eight bytes a pair).
FINISH = 3_000
#: Averages that are equal in so many digits are ties, in rounds.
DIGITS = 9


def average_linkage(sim: np.ndarray, floor: float, weight: np.ndarray | None = None, digits: int | None = None) -> list[list[int]]:
    """Merge the most alike clusters (the first pair of equal ones) while their average similarity is ``floor`` or more.

    Each cluster keeps its best later partner, which a merger leaves as it is for most: quadratic
    time, and no copy but one of the matrix, whose sums stay exact as long as similarities of 1 and 0 are.
    A row of ``weight`` w stands for w equal ones. ``digits``: averages are rounded before they are compared.
    """
    n = len(sim)
    total = np.array(sim)
    size = np.ones(n) if weight is None else weight.astype(np.float64)
    if weight is not None:
        total *= size[:, None].astype(total.dtype)
        total *= size.astype(total.dtype)
    members = [[i] for i in range(n)]
    alive = np.ones(n, bool)
    best, mate = np.full(n, -np.inf), np.zeros(n, np.int64)
    rounded = lambda x: x if digits is None else np.round(x, digits)

    def look(a: int) -> None:
        later = np.flatnonzero(alive[a + 1 :]) + a + 1
        best[a] = -np.inf
        if len(later):
            mean = rounded(total[a, later] / (size[a] * size[later]))
            k = int(mean.argmax())
            best[a], mate[a] = mean[k], later[k]

    for a in range(n):
        look(a)
    for _ in range(n - 1):
        p = int(best.argmax())
        if best[p] < floor:
            break
        q = int(mate[p])
        total[p] += total[q]
        total[:, p] = total[p]
        size[p] += size[q]
        alive[q], best[q] = False, -np.inf
        members[p] += members[q]
        e = np.flatnonzero(alive[:p])
        mean = rounded(total[p, e] / (size[p] * size[e]))
        stale = (mate[e] == p) | (mate[e] == q)
        better = np.where(stale, mean >= best[e], (mean > best[e]) | ((mean == best[e]) & (p < mate[e])))
        best[e[better]], mate[e[better]] = mean[better], p
        between = np.flatnonzero(alive[p + 1 : q] & (mate[p + 1 : q] == q)) + p + 1
        for a in (*e[stale & ~better], *between, p):
            look(int(a))
    return [members[i] for i in np.flatnonzero(alive)]


def _similarity(g: pd.DataFrame, t: int) -> np.ndarray:
    """Products of vectors (0 without one), and 1 for hashes at most t bits apart."""
    have = g["v"].notna().to_numpy()
    v = np.zeros((len(g), len(g["v"][have].iloc[0]) if have.any() else 1))
    if have.any():
        v[have] = np.stack(g["v"][have].to_numpy())
    hashed = g["phash"].notna().to_numpy()
    bits = np.array([int(h, 16) for h in g["phash"].fillna("0")], np.uint64)
    sim = np.empty((len(g), len(g)), np.float32)
    for a in range(0, len(g), 256):
        rows = slice(a, a + 256)
        sim[rows] = v[rows] @ v.T
        near = np.bitwise_count(bits[rows, None] ^ bits[None]) <= t
        sim[rows][near & hashed[rows, None] & hashed[None]] = 1.0
    return sim


def _points(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of one component and hash as one point with their mean vector, and which row is of which point.

    Such rows are alike by 1, and are so to the same others, so linkage puts them together before
    all else; a flood of them is one point.
    """
    x = members.withColumn("hash", F.coalesce(F.lower("phash"), F.concat(F.lit("row "), F.col("id").cast("string"))))
    key = ["component", "hash"]
    first = F.min(F.struct("ord", "id"))
    points = x.groupBy(*key).agg(first.alias("m"), F.count(F.lit(1)).alias("n"), F.first(F.lower("phash")).alias("phash"), F.first("embedding").alias("one"))
    points = points.select(*key, F.col("m.id").alias("point"), F.col("m.ord").alias("ord"), "n", "phash", "one")
    several = points.filter("n > 1").select(*key, "n")
    each = x.join(several, key).select(*key, "n", F.posexplode("embedding"))
    mean = each.groupBy(*key, "pos").agg((F.sum(F.col("col").cast("double")) / F.first("n")).alias("mean")).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "mean"))).alias("a"))
    mean = mean.select(*key, F.transform("a", lambda p: p["mean"]).alias("mean"))
    points = points.join(mean, key, "left").withColumn("v", F.when(F.col("n") > 1, F.col("mean")).otherwise(F.col("one").cast("array<double>")))
    points = stage_table(points.select(*key, "point", "ord", "n", "phash", "v"), "points")
    return points, x.select("id", *key).join(points.select(*key, "point"), key).select("id", "component", "point")


def cohesion_split(members: DataFrame, floor: float = 0.90, t: int = 6, in_task: int = IN_TASK) -> DataFrame:
    """(id, component, part): components of more than two are clustered by average linkage; parts of one drop out.

    members: component, id, ord (a number of its own for each row), phash, embedding. Pairs of
    near hashes count as 1, missing vectors as 0. Components of two stay as they are. Those of up
    to ``in_task`` points (rows of one hash are one) are split in a task each, larger
    ones in rounds: see :func:`linkage_rounds`.
    """
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    members = members.join(size, "component")
    two = members.filter("_n = 2").select("id", "component", F.lit(0).cast("long").alias("part"))
    points, of = _points(members.filter("_n > 2").drop("_n"))
    many = points.groupBy("component").agg(F.count(F.lit(1)).alias("_points"))
    points = points.join(many, "component")

    def split(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ord").reset_index(drop=True)
        parts = average_linkage(_similarity(g, t), floor, g["n"].to_numpy())
        out = [(int(g["point"][i]), int(g["component"][0]), k) for k, c in enumerate(parts) if g["n"][c].sum() > 1 for i in c]
        return pd.DataFrame(out, columns=["point", "component", "part"])

    small = points.filter(F.col("_points") <= in_task).select("component", "point", "ord", "n", "phash", "v")
    parts = small.groupBy("component").applyInPandas(split, "point long, component long, part long")
    large = points.filter(F.col("_points") > in_task).drop("_points")
    if not large.isEmpty():
        parts = parts.unionByName(linkage_rounds(large, floor, t, min(in_task, FINISH)))
    return two.union(of.join(parts.select("point", "part"), "point").select("id", "component", "part"))


def _near(rows: DataFrame, t: int) -> DataFrame:
    """(p, q): points of near hashes. A hash may be a point in several components; star edges to its first one lead to the others."""
    near = hamming_join(rows, "point", "phash", t)
    of = rows.filter("phash is not null").select("point").join(near.filter("d = 0").select(F.col("i").alias("head"), F.col("j").alias("point")), "point", "left").select(F.coalesce("head", "point").alias("head"), "point")
    where = of.join(rows.select("point", "component"), "point")
    i, j = where.select(F.col("head").alias("i"), F.col("point").alias("p"), "component"), where.select(F.col("head").alias("j"), F.col("point").alias("q"), "component")
    return near.filter("d > 0").select("i", "j").join(i, "i").join(j, ["j", "component"]).select("p", "q")


def _finisher(floor: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Merges the clusters of a component, few by now, to the end: (component, id, into)."""

    def finish(clusters: pa.Table, more: pa.Table) -> pa.Table:
        clusters = clusters.sort_by("id")
        ids, n, s = clusters.column("id").to_numpy(), clusters.column("n").to_numpy(), matrix(clusters.column("s"))
        total = s @ s.T
        a, b = (np.searchsorted(ids, more.column(c).to_numpy()) for c in "ab")
        total[a, b] += more.column("more").to_numpy()
        total[b, a] = total[a, b]
        parts = average_linkage(total / n[:, None] / n, floor, n, DIGITS) if len(ids) else []
        pairs = [(ids[i], ids[min(c)]) for c in parts for i in c if i != min(c)]
        component = clusters.column("component")[0].as_py() if len(ids) else 0
        return pa.table({"component": pa.array([component] * len(pairs), pa.int64()), "id": pa.array([i for i, _ in pairs], pa.int64()), "into": pa.array([j for _, j in pairs], pa.int64())})

    return finish


def linkage_rounds(points: DataFrame, floor: float, t: int, finish: int = FINISH) -> DataFrame:
    """(point, component, part) by average linkage in rounds: clusters that are each other's best partner merge, all at once.

    points: component, point, ord, n, phash, v. That gives what merging the best pair first
    gives, since a merger never comes closer to a third cluster than its parts were, and ties
    go to the least ord. The sum of its vectors says how alike a cluster is to another,
    all but for near hashes; what these add is kept for each pair of clusters that has some.

    For the same reason a cluster keeps its partner until one of the two merges, and one without a partner
    is done, for itself and for all others. So a round looks for partners only of clusters that
    merged or whose partner did, among those that aren't done, by products of blocks: quadratic, but dealt to
    tasks, and no task holds a component before it has come down to ``finish`` clusters, which one task merges to the end.
    """
    dim = points.agg(F.max(F.size("v"))).first()[0] or 1
    none = F.array_repeat(F.lit(0.0), max(dim, 1))
    rows = stage_table(points.select("component", "point", F.col("ord").cast("long").alias("ord"), "n", "phash", F.coalesce("v", none).alias("v")), "rows")
    near = _near(rows, t)
    side = lambda k: rows.select(F.col("point").alias(k), F.col("component").alias(f"c{k}"), F.col("ord").alias(f"o{k}"), F.col("n").alias(f"n{k}"), F.col("v").alias(f"v{k}"))
    more = near.join(side("p"), "p").join(side("q"), "q").filter("cp = cq")
    more = more.select(F.col("cp").alias("component"), F.least("op", "oq").alias("a"), F.greatest("op", "oq").alias("b"), (F.col("np") * F.col("nq") * (1 - dot(F.col("vp"), F.col("vq")))).alias("more"))
    more = stage_table(more, "more")
    clusters = stage_table(rows.select("component", F.col("ord").alias("id"), F.col("n").cast("double").alias("n"), F.transform("v", lambda x: x * F.col("n")).alias("s")), "clusters")
    of = rows.select("component", "point", "n", F.col("ord").alias("cluster"))
    key = ["component", "id"]
    move = lambda df, c, to: df.join(to.select("component", F.col("id").alias(c), F.col("into").alias("_to")), ["component", c], "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    kept = stale = None  # partners that are still the best, and clusters that look for one: at first, all
    while True:
        mean = clusters.select(*key, F.transform("s", lambda x: x / F.col("n")).alias("v"))
        looks = mean if stale is None else mean.join(stale, key, "left_semi")
        plain = nearest_vectors(looks, mean, 1, group="component", floor=floor, apart=True, digits=DIGITS).select(*key, "other", "value")
        one = clusters.select("component", F.col("id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
        two = clusters.select("component", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
        value = F.round((dot(F.col("sa"), F.col("sb")) + F.col("more")) / (F.col("na") * F.col("nb")), DIGITS)
        added = more.join(one, ["component", "a"]).join(two, ["component", "b"]).select("component", "a", "b", value.alias("value")).filter(F.col("value") >= floor)
        added = added.select("component", F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("e"), "value").select("component", "e.*", "value")
        every = plain.unionByName(added if stale is None else added.join(stale, key, "left_semi"))
        best = every.groupBy(*key).agg(F.max(F.struct("value", (-F.col("other")).alias("o"))).alias("m")).select(*key, (-F.col("m.o")).alias("other"))
        best = stage_table(best if kept is None else best.unionByName(kept), "best")
        back = best.select("component", F.col("id").alias("other"), F.col("other").alias("id"))
        merged = stage_table(best.join(back, [*key, "other"]).filter("id < other").select("component", F.col("id").alias("into"), F.col("other").alias("id")), "merged")
        if merged.isEmpty():
            break
        changed = merged.select(*key).union(merged.select("component", "into"))
        whose = changed.withColumnRenamed("id", "other")
        kept = best.join(changed, key, "left_anti").join(whose, ["component", "other"], "left_anti").select(*key, "other")
        stale = best.join(merged.select(*key), key, "left_anti").join(kept, key, "left_anti").select(*key)
        gone = merged.join(clusters, key).select("component", F.col("into").alias("id"), F.col("n").alias("n2"), F.col("s").alias("s2"))
        left = clusters.join(best, key, "left_semi").join(merged.select(*key), key, "left_anti").join(gone, key, "left")
        both = F.when(F.col("s2").isNull(), F.col("s")).otherwise(F.zip_with("s", "s2", lambda x, y: x + y))
        clusters = stage_table(left.select(*key, (F.col("n") + F.coalesce("n2", F.lit(0.0))).alias("n"), both.alias("s")), "clusters")
        moved = move(move(more, "a", merged), "b", merged).filter("a != b").select("component", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "more")
        moved = moved.groupBy("component", "a", "b").agg(F.sum("more").alias("more"))
        for c in "ab":  # pairs of clusters that are done say nothing any more
            moved = moved.join(clusters.select("component", F.col("id").alias(c)), ["component", c], "left_semi")
        more = stage_table(moved.select("component", "a", "b", "more"), "more")
        of = move(of, "cluster", merged)
        few = stage_table(clusters.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= finish).select("component"), "few")
        if not few.isEmpty():
            last = clusters.join(few, "component").groupBy("component").cogroup(more.join(few, "component").groupBy("component"))
            ended = stage_table(last.applyInArrow(_finisher(floor), "component long, id long, into long"), "ended")
            of = move(of, "cluster", ended)
            clusters, more = (stage_table(x.join(few, "component", "left_anti"), name) for x, name in ((clusters, "clusters"), (more, "more")))
            if clusters.isEmpty():
                of = stage_table(of, "of")
                break
            kept, stale = kept.join(few, "component", "left_anti"), stale.join(few, "component", "left_anti")
        kept, stale, of = (stage_table(x, name) for x, name in ((kept, "kept"), (stale, "stale"), (of, "of")))
    several = of.groupBy("component", "cluster").agg(F.sum("n").alias("rows")).filter("rows > 1").select("component", "cluster")
    return of.join(several, ["component", "cluster"]).select("point", "component", F.col("cluster").alias("part"))
